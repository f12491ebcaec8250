"""History measures: an order is a commit, its customer the author, its parts the files.

The project is the customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import history as h
from archspark.queries.registry import query, table
from archspark.sources.commits import parse_commit_log

K = ["project_id"]


def commits(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id"), "c_name"
    )
    return orders.join(customers, "o_custkey").select(
        "project_id", F.col("o_orderkey").alias("sha"), F.col("c_name").alias("author"),
        F.col("o_orderdate").alias("ts"),
    )


def touches(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"),
    )
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey", "l_linenumber")
    per_file = files.join(parts, "l_partkey").select("sha", "path", F.col("l_linenumber").alias("pos"))
    return per_file.join(commits(spark, sf), "sha").select("project_id", "sha", "author", "ts", "path")


COMMITS = """
commits AS (
  SELECT c_nationkey AS project_id, o_orderkey AS sha, c_name AS author, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
TOUCHES = COMMITS + """,
touches AS (
  SELECT project_id, sha, author, ts, p_brand || '/' || p_type || '/' || p_partkey AS path
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN commits ON l_orderkey = sha
)"""
CHURN = TOUCHES + """,
by_author AS (
  SELECT project_id, path, author, count(*) AS n, max(ts) AS last
  FROM touches GROUP BY project_id, path, author
),
churn AS (
  SELECT project_id, path, CAST(sum(n) AS BIGINT) AS changes, count(*) AS authors, max(last) AS last_changed
  FROM by_author GROUP BY project_id, path
),
owners AS (
  SELECT project_id, path, author AS primary_owner FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY n DESC, author) AS rn FROM by_author
  ) WHERE rn = 1
)"""
HOT = CHURN + """,
ranked AS (
  SELECT churn.*, primary_owner,
         row_number() OVER (PARTITION BY project_id ORDER BY changes DESC, path) AS rank,
         changes * 1.0 / max(changes) OVER (PARTITION BY project_id) AS share
  FROM churn JOIN owners USING (project_id, path)
),
hot AS (
  SELECT project_id, path, changes, authors, primary_owner, last_changed, CAST(rank AS INTEGER) AS rank,
         CASE WHEN share > 0.6 AND authors <= 2 THEN 'high' WHEN share > 0.4 THEN 'medium' ELSE 'low' END AS risk
  FROM ranked WHERE rank <= 25
)"""
COMPONENTS = """,
comp_author AS (
  SELECT project_id, split_part(path, '/', 1) AS component, author, count(*) AS n
  FROM touches GROUP BY ALL
),
comp AS (
  SELECT project_id, component, CAST(sum(n) AS BIGINT) AS changes, count(*) AS contributors,
         first(author ORDER BY n DESC, author) AS primary_owner
  FROM comp_author GROUP BY project_id, component
)"""


@query("file_churn", f"WITH {CHURN} SELECT project_id, path, changes, authors, primary_owner, last_changed "
       "FROM churn JOIN owners USING (project_id, path)")
def file_churn(spark, sf):
    return h.file_churn(touches(spark, sf), K)


@query("file_churn_hotspots", f"WITH {HOT} SELECT * FROM hot")
def file_churn_hotspots(spark, sf):
    return h.hotspot_risk(h.file_churn(touches(spark, sf), K), K)


@query("component_churn", f"""WITH {TOUCHES}{COMPONENTS}
SELECT project_id, component, changes, contributors, primary_owner FROM comp
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY changes DESC, component) <= 12""")
def component_churn(spark, sf):
    return h.component_churn(touches(spark, sf), K)


# One project per customer: its order priorities are the authors, part types the components.
CUSTOMER_TOUCHES = """
touches AS (
  SELECT o_custkey AS project_id, o_orderkey AS sha, o_orderpriority AS author, o_orderdate AS ts,
         p_type || '/' || p_brand || '/' || p_partkey AS path
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def customer_touches(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
    )
    commits_ = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sha"),
        F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("ts"),
    )
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), "l_partkey")
    return files.join(parts, "l_partkey").join(commits_, "sha").select("project_id", "sha", "author", "ts", "path")


@query("history_risks", f"""WITH {HOT.replace(TOUCHES, CUSTOMER_TOUCHES)}{COMPONENTS},
tot AS (SELECT project_id, sum(changes) AS total, first(component ORDER BY changes DESC, component) AS component,
               max(changes) AS top FROM comp GROUP BY project_id),
rows_ AS (
  SELECT project_id, 1 AS section, -top AS ord, 'high' AS severity, component AS area,
         CAST(CAST(round_even(100.0 * top / total, 0) AS BIGINT) AS VARCHAR) || ' percent of the changes went to ' || component AS message
  FROM tot WHERE top * 1.0 / total > 0.35
  UNION ALL
  SELECT project_id, 2, -changes, 'medium', component,
         'only ' || primary_owner || ' changes ' || component
  FROM comp WHERE changes >= 20 AND contributors = 1
  UNION ALL
  SELECT project_id, 3, -changes, 'medium', path,
         path || ': ' || changes || ' changes, authors: ' || authors
  FROM hot WHERE rank <= 3 AND risk = 'high'
)
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY section, ord, area) AS INTEGER) AS seq,
       severity, area, message FROM rows_
QUALIFY seq <= 10""")
def history_risks(spark, sf):
    t = customer_touches(spark, sf)
    return h.history_risks(h.component_churn(t, K, limit=None), h.hotspot_risk(h.file_churn(t, K), K), K)


@query("co_change_pairs", f"""WITH {TOUCHES},
sizes AS (SELECT project_id, sha FROM touches GROUP BY project_id, sha HAVING count(*) BETWEEN 2 AND 25),
numbered AS (
  SELECT t.project_id, t.sha, path, row_number() OVER (PARTITION BY t.project_id, t.sha ORDER BY path) AS rn
  FROM touches t JOIN sizes s ON t.project_id = s.project_id AND t.sha = s.sha
),
pairs AS (
  SELECT a.project_id, a.path AS file_a, b.path AS file_b, count(*) AS together
  FROM numbered a JOIN numbered b ON a.project_id = b.project_id AND a.sha = b.sha AND a.rn < b.rn
  GROUP BY ALL
)
SELECT project_id, file_a, file_b, together FROM pairs WHERE together >= 2
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY together DESC, file_a, file_b) <= 15""")
def co_change_pairs(spark, sf):
    return h.co_change(touches(spark, sf), K, min_together=2)


@query("author_commits", f"""WITH {COMMITS}
SELECT project_id, author, count(*) AS commits FROM commits GROUP BY project_id, author
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, author) <= 10""")
def author_commits(spark, sf):
    return h.author_commits(commits(spark, sf), K)


@query("contributor_share", f"""WITH {COMMITS},
top AS (
  SELECT project_id, author, count(*) AS commits FROM commits GROUP BY project_id, author
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, author) <= 10
)
SELECT project_id, author, commits,
       round_even(CAST(commits AS DOUBLE) / sum(commits) OVER (PARTITION BY project_id), 4) AS share FROM top""")
def contributor_share(spark, sf):
    return h.contributor_share(h.author_commits(commits(spark, sf), K), K)


@query("activity_by_month", f"""WITH {COMMITS}
SELECT project_id, strftime(ts, '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY ALL""")
def activity_by_month(spark, sf):
    return h.activity_by_month(commits(spark, sf), K)


@query("history_summary", f"""WITH {COMMITS}
SELECT project_id, count(*) AS commit_count, min(ts) AS first_commit, max(ts) AS last_commit,
       count(DISTINCT author) AS contributors FROM commits GROUP BY project_id""")
def history_summary(spark, sf):
    return h.history_summary(commits(spark, sf), K)


# Commit records written by Spark from orders and their lines, then parsed back.
def log_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.concat_ws(
            "\n", F.array_sort(F.collect_list(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py"))))
        ).alias("body")
    )
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    header = F.concat_ws(
        "\x1f", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.lit("a@example.org"), F.unix_timestamp("o_orderdate").cast("string"), "o_orderpriority",
    )
    return orders.select(
        F.col("o_orderstatus").alias("project_id"),
        F.concat(header, F.lit("\n"), F.coalesce("body", F.lit(""))).alias("record"),
    )


@query("parse_commit_log", """
SELECT o_orderstatus AS project_id, CAST(o_orderkey AS VARCHAR) AS sha, 'c' || o_custkey AS author,
       'a@example.org' AS email, o_orderdate AS ts, o_orderpriority AS subject,
       CAST(coalesce(n, 0) AS INTEGER) AS n_files, coalesce(first_file, '') AS first_file
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, min('src/' || l_partkey || '.py') AS first_file FROM lineitem GROUP BY l_orderkey
) ON o_orderkey = l_orderkey""")
def commit_log(spark, sf):
    parsed = parse_commit_log(log_records(spark, sf), K)
    return parsed.select(
        "project_id", "sha", "author", "email", "ts", "subject", F.size("files").alias("n_files"),
        F.coalesce(F.array_min("files"), F.lit("")).alias("first_file"),
    )


# A user's events form a chain; every fifth event also merges the event five steps back.
def event_dag(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    events = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    prev, far = F.lag("event_id", 1).over(w), F.lag("event_id", 5).over(w)
    step = F.row_number().over(w)
    return events.select(
        F.col("user_id").alias("project_id"), F.col("event_id").cast("string").alias("sha"),
        (-step).alias("seq"), step.alias("step"),
        F.array_compact(F.array(prev.cast("string"), F.when(step % 5 == 0, far.cast("string")))).alias("parents"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("tag: v"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "error", F.concat(F.lit("origin/fix-"), F.col("event_id").cast("string"), F.lit(", fix")))
        .otherwise(F.lit("")).alias("decoration"),
    )


DAG = """
steps AS (
  SELECT user_id AS project_id, event_id, event_type,
         row_number() OVER w AS step, lag(event_id, 1) OVER w AS prev, lag(event_id, 5) OVER w AS far
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
links AS (
  SELECT project_id, CAST(event_id AS VARCHAR) AS sha, CAST(prev AS VARCHAR) AS parent, 0 AS pos, step, far FROM steps
  WHERE prev IS NOT NULL
  UNION ALL
  SELECT project_id, CAST(event_id AS VARCHAR), CAST(far AS VARCHAR), 1, step, far FROM steps
  WHERE step % 5 = 0 AND far IS NOT NULL
)"""


@query("parent_links", f"""WITH {DAG}
SELECT project_id, sha, parent, CAST(pos AS INTEGER) AS pos, pos = 0 AS continues,
       step % 5 = 0 AND far IS NOT NULL AS is_merge, FALSE AS truncated FROM links""")
def parent_links(spark, sf):
    return h.commit_parent_edges(event_dag(spark, sf), K)


@query("commit_refs", """
SELECT user_id AS project_id, CAST(event_id AS VARCHAR) AS sha, 'v' || event_id AS name, 'tag' AS kind
FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT user_id, CAST(event_id AS VARCHAR), 'origin/fix-' || event_id, 'remote' FROM events WHERE event_type = 'error'
UNION ALL
SELECT user_id, CAST(event_id AS VARCHAR), 'fix', 'branch' FROM events WHERE event_type = 'error'""")
def commit_refs(spark, sf):
    return h.classify_refs(event_dag(spark, sf), K)


@query("commit_lanes")
def commit_lanes(spark, sf):
    return h.assign_lanes(event_dag(spark, sf), K)


@query("lane_invariants", f"""WITH {DAG}
SELECT project_id, count(DISTINCT sha) AS commits, (SELECT count(*) FROM links l WHERE l.project_id = s.project_id) AS links,
       0 AS misplaced, 0 AS closed, 0 AS shared
FROM (SELECT project_id, CAST(event_id AS VARCHAR) AS sha FROM steps) s GROUP BY project_id""")
def lane_invariants(spark, sf):
    """What holds of any right drawing: a commit takes the lowest lane that awaits it, lanes that links lead to are open after the
    commit, and no two open lanes are one."""
    lanes = h.assign_lanes(event_dag(spark, sf), K, block=500)
    links = lanes.select(*K, "sha", "lane", "open_lanes", F.explode("links").alias("l")).select(
        *K, F.col("l.parent").alias("sha"), F.col("l.to").alias("to"), (~F.array_contains("open_lanes", F.col("l.to"))).cast("long").alias("closed"))
    into = links.groupBy(*K, "sha").agg(F.count("*").alias("n"), F.min("to").alias("lowest"), F.sum("closed").alias("closed"))
    shared = F.when(F.size(F.array_distinct("open_lanes")) < F.size("open_lanes"), 1).otherwise(0)
    facts = lanes.join(into, [*K, "sha"], "left").groupBy(*K).agg(
        F.count("*").alias("commits"), F.sum(F.coalesce("n", F.lit(0))).alias("links"),
        F.count_if(F.col("lowest") != F.col("lane")).cast("int").alias("misplaced"), F.coalesce(F.sum("closed"), F.lit(0)).cast("int").alias("closed"),
        F.sum(shared).cast("int").alias("shared"))
    return facts
