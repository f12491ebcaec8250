"""Scorecard, comparison, repair, review and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from archspark.operators import diff as d
from archspark.operators import metrics as m
from archspark.operators import repair as rp
from archspark.operators import review as rv
from archspark.operators import score as sc
from archspark.operators import views as vw
from archspark.queries import corpus
from archspark.queries.extract import code_graph
from archspark.queries.graph import DAY, MONTH, YEAR, modules_of, trade, trade_sql
from archspark.queries.registry import query, table
from archspark.schema import KEYS
from archspark.session import staged

K = ["project_id"]
PK = list(KEYS)


# Facts of a document source: labelled documents are the tests.
def source_facts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("test"), "toxic")
    rows = docs.join(labels, "doc_id", "left")
    test = F.col("test").isNotNull()
    return rows.groupBy(F.col("source").alias("project_id")).agg(
        F.count("*").alias("files"), F.count_if(test).alias("test_files"), F.count_if(~test).alias("source_files"),
        F.sum(F.when(test, F.col("n_chars")).otherwise(0)).alias("test_loc"), F.sum(F.when(test, 0).otherwise(F.col("n_chars"))).alias("source_loc"),
        F.count_if(F.col("text").contains("token = ")).alias("sec_critical"), F.count_if(F.col("text").contains("@")).alias("sec_high"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("markers"), F.sum("n_chars").alias("loc"),
        F.bool_or(F.col("text").contains("MIT License")).alias("license"),
    )


SIGNALS = """
facts AS (
  SELECT source AS project_id, count(*) AS files, count(quality) AS test_files, count(*) - count(quality) AS source_files,
         CAST(coalesce(sum(n_chars) FILTER (quality IS NOT NULL), 0) AS DOUBLE) AS test_loc,
         CAST(coalesce(sum(n_chars) FILTER (quality IS NULL), 0) AS DOUBLE) AS source_loc,
         count(*) FILTER (contains(text, 'token = ')) AS crit, count(*) FILTER (contains(text, '@')) AS hi
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
),
ratios AS (SELECT *, CASE WHEN source_files = 0 THEN 0.0 ELSE CAST(test_files AS DOUBLE) / source_files END AS fr,
                  CASE WHEN source_loc = 0 THEN 0.0 ELSE test_loc / source_loc END AS lr FROM facts),
raw AS (
  SELECT project_id, 'security' AS category, 'security.critical' AS signal, 'critical' AS severity, -least(crit * 20.0, 60.0) AS impact FROM ratios WHERE crit > 0
  UNION ALL SELECT project_id, 'security', 'security.high', 'high', -least(hi * 9.0, 32.0) FROM ratios WHERE hi > 0
  UNION ALL SELECT project_id, 'security', 'security.clean', 'info', 6.0 FROM ratios WHERE crit = 0 AND hi = 0
  UNION ALL SELECT project_id, 'testing', 'testing.none', 'critical', -50.0 FROM ratios WHERE source_files > 0 AND test_files = 0
  UNION ALL SELECT project_id, 'testing', 'testing.coverage_breadth', CASE WHEN fr < 0.1 THEN 'high' ELSE 'medium' END, -least((0.25 - fr) / 0.25 * 40, 40.0)
    FROM ratios WHERE source_files > 0 AND test_files > 0 AND fr < 0.25
  UNION ALL SELECT project_id, 'testing', 'testing.breadth', 'info', 4.0 FROM ratios WHERE source_files > 0 AND test_files > 0 AND fr >= 0.25
  UNION ALL SELECT project_id, 'testing', 'testing.depth', 'medium', -least((0.2 - lr) / 0.2 * 16, 16.0) FROM ratios WHERE source_files > 0 AND test_files > 0 AND lr < 0.2
  UNION ALL SELECT project_id, 'testing', 'testing.assertions', 'low', -9.0 FROM ratios WHERE source_files > 0 AND test_files > 0
  UNION ALL SELECT project_id, 'testing', 'testing.ci', 'medium', -12.0 FROM ratios WHERE source_files > 0
  UNION ALL SELECT project_id, 'testing', 'testing.coverage_tooling', 'low', -5.0 FROM ratios WHERE source_files > 0
),
signals AS (SELECT project_id, category, signal, severity, round_even(impact, 1) AS impact FROM raw WHERE round_even(abs(impact), 1) > 0),
weights(category, weight, ord) AS (VALUES ('architecture', 0.20, 0), ('code_quality', 0.15, 1), ('security', 0.20, 2), ('testing', 0.12, 3),
  ('documentation', 0.08, 4), ('maintainability', 0.12, 5), ('performance', 0.08, 6), ('technical_debt', 0.05, 7)),
cats AS (
  SELECT f.project_id, w.category, w.ord, CAST(w.weight AS DOUBLE) AS weight,
         round_even(greatest(0.0, least(100.0, 100.0 + coalesce(sum(CAST(s.impact AS DECIMAL(18,1))), 0)::DOUBLE)), 1) AS score_exact,
         count(s.signal) FILTER (s.severity <> 'info') AS issue_count
  FROM facts f, weights w LEFT JOIN signals s ON s.project_id = f.project_id AND s.category = w.category
  GROUP BY ALL
),
overall AS (
  SELECT project_id, CAST(sum(CAST(score_exact * weight AS DECIMAL(28,8))) AS DOUBLE) AS exact,
         first(category ORDER BY score_exact, ord) AS weakest, first(category ORDER BY score_exact DESC, ord) AS strongest
  FROM cats GROUP BY project_id
)"""
TWO = ("security", "testing")


def source_signals(spark, sf):
    return sc.score_signals(source_facts(spark, sf), K, TWO)


@query("score_signals", f"WITH {SIGNALS} SELECT * FROM signals")
def score_signals(spark, sf):
    return source_signals(spark, sf).select("project_id", "category", "signal", "severity", "impact")


@query("category_scores", f"WITH {SIGNALS} SELECT project_id, category, score_exact, round_even(score_exact * weight, 2) AS contribution, issue_count FROM cats")
def category_scores(spark, sf):
    facts = source_facts(spark, sf)
    cats = sc.category_scores(sc.score_signals(facts, K, TWO), facts, sc.default_weights(spark), K)
    return cats.select("project_id", "category", "score_exact", "contribution", "issue_count")


@query("overall_score", f"""WITH {SIGNALS}
SELECT project_id, CAST(round_even(exact, 0) AS INTEGER) AS overall, weakest, strongest,
       CASE WHEN round_even(exact, 0) >= 90 THEN 'excellent' WHEN round_even(exact, 0) >= 75 THEN 'good' WHEN round_even(exact, 0) >= 60 THEN 'fair'
            WHEN round_even(exact, 0) >= 40 THEN 'poor' ELSE 'critical' END AS band FROM overall""")
def overall_score(spark, sf):
    facts = source_facts(spark, sf)
    cats = sc.category_scores(sc.score_signals(facts, K, TWO), facts, sc.default_weights(spark), K)
    return sc.overall_score(cats, K).select("project_id", "overall", "weakest", "strongest", "band")


ROADMAP = SIGNALS + """,
recs AS (
  SELECT project_id, s.category, CASE signal WHEN 'security.critical' THEN 'security.fix_critical' WHEN 'security.high' THEN 'security.fix_high'
         WHEN 'testing.none' THEN 'testing.bootstrap' WHEN 'testing.coverage_breadth' THEN 'testing.expand' ELSE 'testing.add_ci' END AS recommendation,
         CASE signal WHEN 'security.critical' THEN CASE WHEN crit <= 3 THEN 'low' ELSE 'medium' END
                     WHEN 'security.high' THEN CASE WHEN hi <= 3 THEN 'low' ELSE 'medium' END
                     WHEN 'testing.none' THEN 'high' WHEN 'testing.coverage_breadth' THEN 'medium' ELSE 'low' END AS effort,
         round_even(-impact * CAST(weight AS DOUBLE), 1) AS overall_gain
  FROM signals s JOIN weights USING (category) JOIN facts USING (project_id)
  WHERE signal IN ('security.critical', 'security.high', 'testing.none', 'testing.coverage_breadth', 'testing.ci')
),
actions AS (
  SELECT *, round_even(overall_gain / CASE effort WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, 2) AS roi FROM recs
)"""


@query("roadmap", f"""WITH {ROADMAP}
SELECT project_id, recommendation, effort, overall_gain, roi,
       CASE WHEN overall_gain >= 4 AND effort = 'low' THEN 'critical' WHEN overall_gain >= 3 OR (overall_gain >= 1.5 AND effort = 'low') THEN 'high'
            WHEN overall_gain >= 0.8 THEN 'medium' ELSE 'low' END AS priority,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY roi DESC, overall_gain DESC, recommendation) AS INTEGER) AS rank FROM actions""")
def roadmap(spark, sf):
    rows = sc.roadmap(sc.recommendation_rows(source_signals(spark, sf), keys=K), sc.default_weights(spark), K)
    return rows.select("project_id", "recommendation", "effort", "overall_gain", "roi", "priority", "rank")


@query("top_issues", f"""WITH {SIGNALS}
SELECT project_id, signal, round_even(abs(impact) * CAST(weight AS DOUBLE), 2) AS weighted_impact,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY round_even(abs(impact) * CAST(weight AS DOUBLE), 2) DESC,
         CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, signal) AS INTEGER) AS rank
FROM signals JOIN weights USING (category) WHERE severity <> 'info' QUALIFY rank <= 12""")
def top_issues(spark, sf):
    return sc.top_issues(source_signals(spark, sf), sc.default_weights(spark), K).select("project_id", "signal", "weighted_impact", "rank")


@query("strengths", f"""WITH {SIGNALS}
SELECT project_id, signal, impact, CAST(row_number() OVER (PARTITION BY project_id ORDER BY impact DESC, signal) AS INTEGER) AS rank
FROM signals WHERE severity = 'info' AND impact > 0 QUALIFY rank <= 10""")
def strengths(spark, sf):
    return sc.strengths(source_signals(spark, sf), K).select("project_id", "signal", "impact", "rank")


@query("weights", """
WITH raw AS (SELECT n_nationkey AS project_id, category, CASE WHEN (n_nationkey + i) % 3 = 0 THEN 'bad' ELSE CAST((n_nationkey + i) % 5 AS VARCHAR) END AS w
             FROM nation, (VALUES ('architecture', 0), ('security', 1), ('testing', 2)) AS c(category, i)),
base(category, base) AS (VALUES ('architecture', 0.20), ('security', 0.20), ('code_quality', 0.15), ('maintainability', 0.12), ('testing', 0.12),
     ('documentation', 0.08), ('performance', 0.08), ('technical_debt', 0.05)),
v AS (SELECT n_nationkey AS project_id, b.category, greatest(0.0, least(1.0, coalesce(TRY_CAST(raw.w AS DOUBLE), b.base::DOUBLE))) AS w
      FROM nation, base b LEFT JOIN raw ON raw.project_id = n_nationkey AND raw.category = b.category)
SELECT project_id, category, round_even(w / sum(w) OVER (PARTITION BY project_id), 4) AS weight FROM v""")
def weights(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"))
    names = F.array(F.lit("architecture"), F.lit("security"), F.lit("testing"))
    n = F.col("project_id") + F.col("i")
    raw = nation.select("project_id", F.posexplode(names).alias("i", "category")).withColumn(
        "weight", F.when(n % 3 == 0, "bad").otherwise((n % 5).cast("string")))
    return sc.normalise_weights(raw, K)


@query("unindexed_keys", f"""WITH {corpus.duck_cte()}
SELECT project_id, 't' || id AS "table", 'parent_id' AS "column",
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY 't' || id) AS INTEGER) AS rank FROM corpus WHERE lang = 'sql' QUALIFY rank <= 40""")
def unindexed_keys(spark, sf):
    from archspark.operators.extract.sql import extract_ddl

    x = extract_ddl(corpus.files(spark, sf), PK)
    return sc.unindexed_foreign_keys(x.fks, x.indexes, x.columns, PK, limit=40).select("project_id", "table", "column", "rank")


# Runs: one month of a nation's orders.
def runs(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id"))
    month = F.date_trunc("month", "o_orderdate")
    rows = table(spark, sf, "orders").join(customers, "o_custkey").groupBy("project_id", month.alias("at")).agg((F.count("*") % 101).alias("overall"))
    return rows.withColumns({"run_id": F.date_format("at", "yyyy-MM"), "status": F.when(F.month("at") == 2, "failed").otherwise("succeeded")})


RUNS = """runs AS (
  SELECT c_nationkey AS project_id, date_trunc('month', o_orderdate) AS started, count(*) % 101 AS overall,
         strftime(date_trunc('month', o_orderdate), '%Y-%m') AS run_id, CASE WHEN month(date_trunc('month', o_orderdate)) = 2 THEN 'failed' ELSE 'succeeded' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query("score_trend", f"""WITH {RUNS},
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY started) AS INTEGER) AS point FROM runs WHERE status = 'succeeded')
SELECT project_id, run_id, point, overall, CASE WHEN count(*) OVER w >= 2 THEN last(overall ORDER BY point) OVER w - first(overall ORDER BY point) OVER w END AS delta
FROM p WINDOW w AS (PARTITION BY project_id)""")
def score_trend(spark, sf):
    return sc.score_trend(runs(spark, sf)).select("project_id", "run_id", "point", "overall", "delta")


@query("latest_run", f"WITH {RUNS} SELECT project_id, max(run_id) AS run_id FROM runs GROUP BY project_id")
def latest_run(spark, sf):
    return sc.latest_run(runs(spark, sf)).select("project_id", "run_id")


@query("recent_runs", f"WITH {RUNS}, o AS (SELECT project_id || '-' || run_id AS run_id, started FROM runs) SELECT run_id FROM o ORDER BY started DESC, run_id DESC LIMIT 50")
def recent_runs(spark, sf):
    rows = runs(spark, sf).withColumn("run_id", F.concat(F.col("project_id").cast("string"), F.lit("-"), F.col("run_id")))
    return sc.recent_runs(rows).select("run_id")


# ---------------------------------------------------------------- comparison of each year with the one before


def consecutive(spark, sf):
    """(nodes, edges) of the years before and of the years, both keyed by the later year; all pairs of consecutive years."""
    nodes, edges = trade(spark, sf, YEAR)
    later = (F.col("project_id").cast("int") + 1).cast("string")
    years = edges.select("project_id").distinct()
    pairs = years.join(years.select(later.alias("project_id")), K, "left_semi")
    move = lambda df: df.withColumn("project_id", later)
    return tuple(move(df).join(pairs, K, "left_semi") for df in (nodes, edges)), tuple(df.join(pairs, K, "left_semi") for df in (nodes, edges))


SIDES = trade_sql(YEAR) + """,
nkeys AS (SELECT project_id, 'class:' || name AS key FROM active UNION SELECT project_id, 'module:' || module FROM active),
ekeys AS (SELECT project_id, 'class:' || a.name AS "from", 'class:' || b.name AS "to", 'uses' AS kind FROM trade t JOIN who a ON a.id = source JOIN who b ON b.id = target),
years AS (SELECT DISTINCT project_id, CAST(CAST(project_id AS INTEGER) + 1 AS VARCHAR) AS later FROM trade),
pairs AS (SELECT later FROM years WHERE later IN (SELECT project_id FROM years)),
hn AS (SELECT project_id, key FROM nkeys WHERE project_id IN (FROM pairs)),
bn AS (SELECT later AS project_id, key FROM nkeys JOIN years USING (project_id) WHERE later IN (FROM pairs)),
he AS (SELECT project_id, "from", "to", kind FROM ekeys WHERE project_id IN (FROM pairs)),
be AS (SELECT later AS project_id, "from", "to", kind FROM ekeys JOIN years USING (project_id) WHERE later IN (FROM pairs)),
nd AS (
  SELECT *, 'added' AS change FROM (FROM hn EXCEPT FROM bn) UNION ALL SELECT *, 'removed' FROM (FROM bn EXCEPT FROM hn)
),
ed AS (
  SELECT *, 'added' AS change FROM (FROM he EXCEPT FROM be) UNION ALL SELECT *, 'removed' FROM (FROM be EXCEPT FROM he)
),
s AS (SELECT project_id, count(*) AS n FROM modules GROUP BY ALL), e AS (SELECT project_id, count(*) AS e FROM medges GROUP BY ALL),
r AS (SELECT project_id, CAST(n AS DOUBLE) AS module_count, round_even(e / (n * (n - 1)), 4) AS density, 50.0 + 2 * (CAST(project_id AS INTEGER) * 3 % 10) AS score FROM s JOIN e USING (project_id)),
l AS (UNPIVOT (SELECT project_id, CAST(module_count AS DOUBLE) AS module_count, CAST(density AS DOUBLE) AS density, CAST(score AS DOUBLE) AS score FROM r) ON module_count, density, score INTO NAME metric VALUE v),
deltas AS (
  SELECT h.project_id, metric, b.v AS before, h.v AS after, round_even(h.v - b.v, 4) AS delta
  FROM l h JOIN years y ON y.later = h.project_id JOIN l b USING (metric) WHERE b.project_id = y.project_id
),
moved AS (
  SELECT k.project_id, 'class:' || name AS key, b.degree AS degree_before, h.degree AS degree_after
  FROM (SELECT later AS project_id, id, degree FROM deg JOIN years USING (project_id)) b JOIN deg h USING (project_id, id) JOIN who USING (id)
  JOIN (SELECT later AS project_id FROM pairs) k USING (project_id) WHERE abs(h.degree - b.degree) >= 3
),
sizes AS (
  SELECT later AS project_id, (SELECT count(*) FROM nd WHERE project_id = later AND change = 'added') AS added, (SELECT count(*) FROM nd WHERE project_id = later AND change = 'removed') AS removed,
         (SELECT count(*) FROM ed WHERE project_id = later AND change = 'added') AS edges_added, (SELECT count(*) FROM ed WHERE project_id = later AND change = 'removed') AS edges_removed,
         (SELECT before FROM deltas WHERE project_id = later AND metric = 'score') AS score_before, (SELECT after FROM deltas WHERE project_id = later AND metric = 'score') AS score_after
  FROM pairs
)"""


@query("diff_nodes", f"WITH {SIDES} SELECT project_id, key, change, starts_with(key, 'module:') AS is_component FROM nd")
def diff_nodes(spark, sf):
    return d.diff_nodes(*consecutive(spark, sf), K)


@query("diff_edges", f"""WITH {SIDES} SELECT * FROM ed""")
def diff_edges(spark, sf):
    return d.diff_edges(*consecutive(spark, sf), K)


@query("changed_nodes", f"""WITH {SIDES} SELECT * FROM moved""")
def changed_nodes(spark, sf):
    return d.changed_nodes(*consecutive(spark, sf), K, limit=None).select("project_id", "key", "degree_before", "degree_after")


METRICS = ("score", "module_count", "density")


def year_metrics(spark, sf):
    nodes, edges, modules, mod = modules_of(spark, sf, YEAR)
    year = F.col("project_id").cast("int")
    rows = m.graph_shape(modules, mod, K).withColumn("score", F.lit(50.0) + 2 * (year * 3 % 10))
    rows = staged(rows, "year-metrics")
    before = rows.withColumn("project_id", (year + 1).cast("string")).join(rows.select("project_id"), K, "left_semi")
    return before, rows.join(before.select("project_id"), K, "left_semi")


@query("metric_delta", f"""WITH {SIDES} SELECT * FROM deltas""")
def metric_delta(spark, sf):
    return d.metric_delta(*year_metrics(spark, sf), K, METRICS)


def year_diffs(spark, sf):
    sides = consecutive(spark, sf)
    return staged(d.diff_nodes(*sides, K), "node-diff"), staged(d.diff_edges(*sides, K), "edge-diff"), d.metric_delta(*year_metrics(spark, sf), K, METRICS), sides


@query("diff_impact", f"""WITH {SIDES}
SELECT project_id, added + removed + edges_added + edges_removed AS churn,
       CASE WHEN added + removed + edges_added + edges_removed > 120 OR abs(score_after - score_before) >= 10 THEN 'high'
            WHEN added + removed + edges_added + edges_removed > 30 OR abs(score_after - score_before) >= 4 THEN 'medium' ELSE 'low' END AS impact FROM sizes""")
def diff_impact(spark, sf):
    return d.diff_impact(*year_diffs(spark, sf)[:3], K)


@query("diff_risks", f"""WITH {SIDES}
SELECT project_id, 'score_regressed' AS risk, 0 AS endpoints_removed FROM sizes WHERE score_after - score_before < -5
UNION ALL SELECT project_id, 'many_new_dependencies', 0 FROM sizes WHERE edges_added > 40""")
def diff_risks(spark, sf):
    return d.diff_risks(*year_diffs(spark, sf)[:3], K)


@query("diff_summary", f"""WITH {SIDES},
few AS (SELECT project_id, change, list(key ORDER BY key) AS keys FROM (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY project_id, change ORDER BY key) <= 3) GROUP BY ALL)
SELECT z.*, 0 AS endpoints_removed, score_after - score_before AS score_delta, 0.0 AS cycle_delta,
       coalesce((SELECT keys FROM few f WHERE f.project_id = z.project_id AND change = 'added'), []) AS added_examples,
       coalesce((SELECT keys FROM few f WHERE f.project_id = z.project_id AND change = 'removed'), []) AS removed_examples,
       (SELECT count(*) FROM moved m WHERE m.project_id = z.project_id) AS modified,
       CASE WHEN score_after > score_before THEN 'improved' WHEN score_after < score_before THEN 'regressed' ELSE 'unchanged' END AS direction
FROM sizes z""")
def diff_summary(spark, sf):
    gone, edges, deltas, sides = year_diffs(spark, sf)
    return d.diff_summary(gone, edges, d.changed_nodes(*sides, K, limit=None), deltas, K)


# ---------------------------------------------------------------- repair on documents and the corpus


def doc_files(spark, sf):
    docs = table(spark, sf, "documents")
    # every third document gets a loose end to repair
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("  \n\n\n"))).otherwise(F.col("text"))
    return docs.select(F.col("source").alias("project_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
                       F.lit("text").alias("language"), tail.alias("text"))


TIDY = ("trailing-whitespace", "missing-final-newline", "trailing-blank-lines")
FIXED = r"""
docs AS (SELECT source AS project_id, 'docs/' || doc_id AS path, doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '  ' || chr(10) || chr(10) || chr(10) ELSE text END AS text FROM documents),
trimmed AS (SELECT *, regexp_replace(regexp_replace(text, '[ \t]+(\r?\n)', '\1', 'g'), '[ \t]+$', '') AS t1 FROM docs),
ended AS (SELECT *, CASE WHEN ends_with(t1, chr(10)) THEN t1 ELSE t1 || chr(10) END AS t2 FROM trimmed),
fixed AS (SELECT *, regexp_replace(t2, '(\r?\n)([ \t]*\r?\n)+$', '\1') AS new_text FROM ended)"""


@query("rewrite_lines", f"WITH {FIXED} SELECT path, sha256(new_text) AS digest, new_text <> text AS changed FROM fixed")
def rewrite_lines(spark, sf):
    out = rp.rewrite_lines(doc_files(spark, sf), TIDY, cosmetic=True)
    return out.select("path", F.sha2("new_text", 256).alias("digest"), (F.col("new_text") != F.col("text")).alias("changed"))


@query("change_rows", r"""
WITH docs AS (SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN text || '  ' || chr(10) || chr(10) || chr(10) ELSE text END AS text FROM documents),
l AS (SELECT path, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS before, unnest(range(1, len(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) + 1)) AS line FROM docs)
SELECT path, CAST(line AS INTEGER) AS line, before, regexp_replace(before, '[ \t]+(\r?\n)?$', '\1') AS after FROM l
WHERE regexp_matches(before, '[ \t]+(\r?\n)?$')""")
def change_rows(spark, sf):
    return rp.change_rows(rp.rewrite_lines(doc_files(spark, sf), ["trailing-whitespace"]), K).drop("project_id")


@query("digest_dedupe", """
SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def digest_dedupe(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("apply_rewrites", f"""WITH {FIXED}
SELECT path, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok,
       CASE WHEN doc_id % 5 = 0 THEN 'text differs from the digest' WHEN doc_id % 7 = 0 THEN 'rule has no rewrite' ELSE '' END AS error
FROM fixed WHERE doc_id % 3 = 0""")
def apply_rewrites(spark, sf):
    files = doc_files(spark, sf)
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    digest = F.when(n % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    rule = F.when(n % 7 == 0, "dynamic-eval").otherwise("trailing-blank-lines")
    chosen = files.filter(n % 3 == 0).select("project_id", "path", rule.alias("rule"), digest.alias("digest"))
    return rp.apply_rewrites(files, chosen, K, confirm=True)[1].select("path", "ok", "error")


@query("detect_issues", f"""WITH {corpus.duck_cte()}
SELECT project_id, path, 'os-command' AS rule, 1 AS occurrences, 18 AS line FROM corpus WHERE lang = 'python'
UNION ALL SELECT project_id, path, 'request-without-timeout', 1, 23 FROM corpus WHERE lang = 'python'""")
def detect_issues(spark, sf):
    found = rp.detect_issues(corpus.files(spark, sf), PK)
    return found.select("project_id", "path", "rule", "occurrences", F.col("lines")[0].alias("line"))


@query("proposal_counts", f"""WITH {corpus.duck_cte()}
SELECT project_id, 2 * count(*) AS proposals, 2 * count(*) AS advisory, count(*) AS files FROM corpus WHERE lang = 'python' GROUP BY project_id""")
def proposal_counts(spark, sf):
    rows = rp.propose(corpus.files(spark, sf), PK)
    return rp.proposal_counts(rows, PK).select("project_id", "proposals", "advisory", "files")


# ---------------------------------------------------------------- review and views


@query("classify_request", """
WITH p AS (SELECT conv_id, turn, lower(text || CASE turn % 5 WHEN 0 THEN ' small dependency view' WHEN 1 THEN ' full schema' WHEN 2 THEN ' executive system' ELSE '' END) AS t
           FROM conversations),
d AS (SELECT *, CASE WHEN regexp_matches(t, 'executive|customer|simplified|high level|overview|מנהלים|פשוט|לקוח') THEN 'executive'
  WHEN regexp_matches(t, 'detailed|deep|full|everything|מפורט') THEN 'detailed' ELSE 'standard' END AS base,
  CASE WHEN contains(t, 'small') THEN 12 WHEN contains(t, 'tiny') THEN 8 WHEN contains(t, 'minimal') THEN 10 WHEN contains(t, 'simple') THEN 14
       WHEN contains(t, 'brief') THEN 12 WHEN contains(t, 'compact') THEN 14 WHEN contains(t, 'קטן') THEN 12 WHEN contains(t, 'פשוט') THEN 14 END AS size FROM p)
SELECT conv_id, turn, CASE
    WHEN regexp_matches(t, 'sequence|flow of|call flow|interaction|login flow|payment flow|רצף|זרימה') THEN 'sequence'
    WHEN regexp_matches(t, 'database|schema|er |tables|entity relationship|בסיס נתונים|טבלאות') THEN 'database'
    WHEN regexp_matches(t, 'deploy|kubernetes|docker|infrastructure|runtime topology|פריסה|תשתית') THEN 'deployment'
    WHEN regexp_matches(t, 'dependency|dependencies|coupling|circular|cycle|תלות|תלויות') THEN 'dependency'
    WHEN regexp_matches(t, 'data flow|dataflow|security boundar|trust boundar|privacy|זרימת נתונים|אבטחה') THEN 'dataflow'
    WHEN regexp_matches(t, 'class|uml|inheritance|types|מחלקות|ירושה') THEN 'class'
    WHEN regexp_matches(t, 'component|module view|boundaries|interfaces|רכיבים|ממשקים') THEN 'component'
    WHEN regexp_matches(t, 'state machine|states|lifecycle|status|מצבים|מחזור חיים') THEN 'state' ELSE 'architecture' END AS kind,
  CASE WHEN size IS NOT NULL AND base = 'standard' THEN 'executive' ELSE base END AS detail,
  CAST(least(CASE base WHEN 'executive' THEN 18 ELSE 60 END, coalesce(size, 60)) AS INTEGER) AS max_nodes,
  regexp_matches(t, 'external|third party|integration|חיצוני') AS include_external
FROM d""")
def classify_request(spark, sf):
    turns = table(spark, sf, "conversations")
    more = F.when(F.col("turn") % 5 == 0, " small dependency view").when(F.col("turn") % 5 == 1, " full schema").when(F.col("turn") % 5 == 2, " executive system").otherwise("")
    asked = turns.select("conv_id", "turn", F.concat("text", more).alias("prompt"))
    return rv.classify_request(asked).drop("prompt")


@query("sanitize_filters", f"""WITH {trade_sql(YEAR)},
req AS (
  SELECT CAST(1992 + conv_id % 8 AS VARCHAR) AS project_id, conv_id || '-' || turn AS id,
         CASE conv_id % 5 WHEN 0 THEN 'ER#00000' || conv_id % 1000 WHEN 1 THEN 'Nation_' || turn WHEN 2 THEN 'zz' || turn WHEN 3 THEN '#' ELSE '' END AS focus,
         ['Nation_' || conv_id % 13, 'ION_' || turn % 4, 'nowhere', '_'] AS modules
  FROM conversations
),
known AS (SELECT project_id, lower(name) AS known FROM active UNION SELECT project_id, lower(module) FROM active),
borne AS (SELECT DISTINCT r.id FROM req r JOIN known k ON k.project_id = r.project_id AND r.focus <> '' AND contains(k.known, lower(r.focus))),
part AS (SELECT id, project_id, unnest(modules) AS m FROM req),
met AS (
  SELECT p.id, p.m, o.module FROM part p JOIN modules o ON o.project_id = p.project_id AND contains(lower(o.module), lower(p.m))
  QUALIFY row_number() OVER (PARTITION BY p.id, p.m ORDER BY CASE WHEN lower(o.module) = lower(p.m) THEN 0 WHEN starts_with(lower(o.module), lower(p.m)) THEN 1 ELSE 2 END, length(o.module), o.module) = 1
)
SELECT r.project_id, r.id, CASE WHEN b.id IS NULL THEN '' ELSE r.focus END AS focus,
       coalesce((SELECT string_agg(DISTINCT module, ',' ORDER BY module) FROM met WHERE met.id = r.id), '') AS modules
FROM req r LEFT JOIN borne b ON b.id = r.id""")
def sanitize_filters(spark, sf):
    """Requests for a year's trade graph with a focus and module names that are right, near or unknown."""
    c, t = F.col("conv_id"), F.col("turn")
    focus = (F.when(c % 5 == 0, F.concat(F.lit("ER#00000"), c % 1000)).when(c % 5 == 1, F.concat(F.lit("Nation_"), t))
             .when(c % 5 == 2, F.concat(F.lit("zz"), t)).when(c % 5 == 3, "#").otherwise(""))
    asked = table(spark, sf, "conversations").select(
        (c % 8 + 1992).cast("string").alias("project_id"), F.concat(c, F.lit("-"), t).alias("id"), focus.alias("focus"),
        F.array(F.concat(F.lit("Nation_"), c % 13), F.concat(F.lit("ION_"), t % 4), F.lit("nowhere"), F.lit("_")).alias("modules"))
    return rv.sanitize_filters(asked, trade(spark, sf, YEAR)[0], K).select("project_id", "id", "focus", F.array_join("modules", ",").alias("modules"))


@query("select_nodes", f"""WITH {trade_sql()},
c AS (SELECT project_id, count(*) AS matched FROM active GROUP BY project_id)
SELECT a.project_id, a.id, CAST(row_number() OVER (PARTITION BY a.project_id ORDER BY degree DESC, a.id) AS INTEGER) AS position
FROM active a JOIN deg USING (project_id, id) QUALIFY position <= 20""")
def select_nodes(spark, sf):
    nodes, edges = trade(spark, sf)
    rows = vw.select_nodes(nodes, edges, nodes.filter(F.col("kind") == "class"), vw.Filters(), K, budget=20, keep_connected=False)
    return rows.select("project_id", "id", "position")


@query("filter_nodes", f"""WITH {trade_sql()}
SELECT project_id, id FROM active WHERE module = 'NATION_7' AND contains(lower(name || ' ' || name || ' ' || module || ' ' || name), 'supplier')""")
def filter_nodes(spark, sf):
    return vw.filter_nodes(trade(spark, sf)[0], vw.Filters(modules=("NATION_7",), focus="Supplier")).select("project_id", "id")


@query("view_dependency", f"""WITH {trade_sql(DAY)},
e AS (SELECT project_id, src_module AS a, dst_module AS b FROM medges),
two AS (SELECT x.project_id, x.a AS module FROM e x JOIN e y ON y.project_id = x.project_id AND y.a = x.b AND y.b = x.a),
three AS (SELECT x.project_id, x.a AS module FROM e x JOIN e y ON y.project_id = x.project_id AND y.a = x.b JOIN e z ON z.project_id = x.project_id AND z.a = y.b AND z.b = x.a WHERE y.b <> x.a),
cyc AS (SELECT * FROM two UNION SELECT * FROM three)
SELECT c.project_id, c.module, c.fan_in, c.fan_out, y.module IS NOT NULL AS in_cycle,
       CAST(row_number() OVER (PARTITION BY c.project_id ORDER BY (y.module IS NOT NULL) DESC, coupling DESC, c.module) AS INTEGER) AS position
FROM coupled c LEFT JOIN cyc y ON y.project_id = c.project_id AND y.module = c.module QUALIFY position <= 18""")
def view_dependency(spark, sf):
    from archspark.operators.iterate import find_cycles

    nodes, edges, _, mod = modules_of(spark, sf, DAY)
    cycles = find_cycles(mod, K, max_length=3, limit=None)
    shown, _ = vw.view_dependency(nodes, edges, vw.Filters(detail="executive"), K, cycles)
    return shown.select("project_id", "module", "fan_in", "fan_out", "in_cycle", "position")


@query("view_class")
def view_class(spark, sf):
    nodes, edges = trade(spark, sf, MONTH)
    return vw.view_class(nodes, edges, vw.Filters(), K)[0].drop("members")


@query("view_state", f"""WITH {corpus.duck_cte()},
machines AS (SELECT project_id, 'type:python:' || replace(module, '/', '.') || '.Status' || id AS id FROM corpus WHERE lang = 'python'
  UNION ALL SELECT project_id, 'type:rust:' || module || '.Mode' || id FROM corpus WHERE lang = 'rust'),
best AS (SELECT project_id, min(id) AS id FROM machines GROUP BY project_id)
SELECT project_id, id, 'NEW' AS source, 'DONE' AS target, 'done' AS event FROM best""")
def view_state(spark, sf):
    from archspark.operators.graph import mark_state_machines

    x = code_graph(spark, sf)
    return vw.view_state(mark_state_machines(x.nodes), x.edges, vw.Filters(), PK)[1].drop("run_id")


@query("relate_tables", f"""WITH {corpus.duck_cte()}
SELECT a.project_id, 'table:t' || a.id AS source, 'table:t' || a.peer AS target, 'parent_id' AS "column", TRUE AS optional
FROM corpus a JOIN corpus b ON b.project_id = a.project_id AND b.id = a.peer AND b.lang = 'sql' WHERE a.lang = 'sql'""")
def relate_tables(spark, sf):
    from archspark.operators import graph as g
    from archspark.operators import resolve as rs
    from archspark.operators.extract.sql import extract_ddl

    x = extract_ddl(corpus.files(spark, sf), PK)
    done = rs.resolve_tables(x.refs, x.nodes, g.index_symbols(x.nodes, PK), PK).filter("target is not null")
    edges = g.edge_frame(done, PK, attr=F.col("attr"), source=F.col("source_id"), target=F.col("target"), kind=F.lit("references"))
    return vw.relate_tables(edges, x.columns, PK).drop("run_id")
