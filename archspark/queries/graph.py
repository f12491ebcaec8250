"""Graph measures over the trade graph: customers use suppliers, nations are the modules.

The region of a nation stands for its layer.  One project is one period of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions.frames import by_shuffle
from archspark.operators import graph as g
from archspark.operators import iterate as it
from archspark.operators import metrics as m
from archspark.queries.registry import query, table
from archspark.schema import LAYERS
from archspark.session import shared_path, staged
from archspark.sources.store import read_run, write_graph

K = ["project_id"]
DAY, MONTH, YEAR = ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy-MM", "%Y-%m"), ("yyyy", "%Y")


def trade(spark: SparkSession, sf: str, period=MONTH) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.date_format("o_orderdate", period[0]).alias("project_id")
    )
    pairs = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(by_shuffle(orders), "l_orderkey")
        .groupBy(*K, "o_custkey", "l_suppkey").agg(F.count("*").alias("weight"))
    )
    edges = g.edge_frame(
        pairs, K, source=F.concat(F.lit("c"), F.col("o_custkey")), target=F.concat(F.lit("s"), F.col("l_suppkey")),
        kind=F.lit("uses"), weight=F.col("weight"),
    )
    edges = staged(edges, "trade-edges")  # several branches of a plan read nodes and edges
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), F.col("n_regionkey") + 1)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey"), "n_name", layer.alias("layer"))
    who = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey")
    ).union(table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")), "s_name", "s_nationkey"
    )).join(nations, "n_nationkey")
    active = edges.select(*K, F.explode(F.array("source", "target")).alias("id")).distinct().join(by_shuffle(who), "id")
    people = g.node_frame(
        active, K, attr=g.attr_struct(layer=F.col("layer")), id=F.col("id"), kind=F.lit("class"), name=F.col("name"),
        qualified_name=F.col("name"), module=F.col("n_name"), file=F.col("name"),
    )
    modules = g.node_frame(
        active.select(*K, "n_name", "layer").distinct(), K, attr=g.attr_struct(layer=F.col("layer")),
        id=F.concat(F.lit("module:"), F.col("n_name")), kind=F.lit("module"), name=F.col("n_name"),
        qualified_name=F.col("n_name"), module=F.col("n_name"),
    )
    return staged(people.unionByName(modules), "trade-nodes"), edges


def trade_sql(period=MONTH) -> str:
    layers = "[" + ", ".join(f"'{x}'" for x in LAYERS) + "]"
    return f"""
trade AS (
  SELECT strftime(o_orderdate, '{period[1]}') AS project_id, 'c' || o_custkey AS source, 's' || l_suppkey AS target, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
),
who AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, n_name AS module, {layers}[n_regionkey + 1] AS layer
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 's' || s_suppkey, s_name, n_name, {layers}[n_regionkey + 1] FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
active AS (
  SELECT project_id, who.* FROM (SELECT project_id, source AS id FROM trade UNION SELECT project_id, target FROM trade) JOIN who USING (id)
),
medges AS (
  SELECT t.project_id, a.module AS src_module, b.module AS dst_module, count(*) AS weight
  FROM trade t JOIN who a ON a.id = t.source JOIN who b ON b.id = t.target WHERE a.module <> b.module GROUP BY ALL
),
modules AS (SELECT DISTINCT project_id, module FROM active),
deg AS (SELECT project_id, id, count(*) AS degree FROM (SELECT project_id, source AS id FROM trade UNION ALL SELECT project_id, target FROM trade) GROUP BY ALL),
fans AS (
  SELECT project_id, module, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (
    SELECT project_id, src_module AS module, 0 AS i, 1 AS o FROM medges UNION ALL SELECT project_id, dst_module, 1, 0 FROM medges
  ) GROUP BY ALL
),
coupled AS (
  SELECT project_id, module, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
         coalesce(fan_in, 0) + coalesce(fan_out, 0) AS coupling,
         CASE WHEN coalesce(fan_in, 0) + coalesce(fan_out, 0) = 0 THEN 0.0
              ELSE round_even(CAST(fan_out AS DOUBLE) / (fan_in + fan_out), 3) END AS instability
  FROM modules LEFT JOIN fans USING (project_id, module)
)"""


@query("module_edges", f"WITH {trade_sql()} SELECT * FROM medges")
def module_edges(spark, sf):
    nodes, edges = trade(spark, sf)
    return m.module_edges(edges, nodes, K)


def modules_of(spark, sf, period):
    nodes, edges = trade(spark, sf, period)
    mod = staged(m.module_edges(edges, nodes, K), "trade-modules")
    return nodes, edges, m.module_universe(nodes, mod, K), mod


@query("module_universe", f"WITH {trade_sql(DAY)} SELECT * FROM modules")
def module_universe(spark, sf):
    return modules_of(spark, sf, DAY)[2]


@query("coupling", f"""WITH {trade_sql(DAY)}
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY coupling DESC, module) AS INTEGER) AS rank
FROM coupled QUALIFY rank <= 25""")
def coupling(spark, sf):
    _, _, modules, mod = modules_of(spark, sf, DAY)
    return m.coupling(modules, mod, K)


@query("average_instability", f"""WITH {trade_sql(DAY)}
SELECT project_id, CAST(round_even(CAST(CAST(sum(CAST(instability AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS DECIMAL(18,9)), 3) AS DOUBLE)
       AS average_instability FROM coupled GROUP BY project_id""")
def average_instability(spark, sf):
    _, _, modules, mod = modules_of(spark, sf, DAY)
    return m.average_instability(m.coupling(modules, mod, K), K)


@query("density", f"""WITH {trade_sql(DAY)},
c AS (SELECT project_id, count(*) AS module_count FROM modules GROUP BY project_id),
e AS (SELECT project_id, count(*) AS n FROM medges GROUP BY project_id)
SELECT project_id, module_count, coalesce(n, 0) AS module_dependency_count,
       CASE WHEN module_count > 1 THEN round_even(coalesce(n, 0) / (module_count * (module_count - 1)), 4) ELSE 0.0 END AS density
FROM c LEFT JOIN e USING (project_id)""")
def density(spark, sf):
    _, _, modules, mod = modules_of(spark, sf, DAY)
    return m.graph_shape(modules, mod, K)


@query("layering_violations", f"""WITH {trade_sql()}
SELECT t.project_id, CAST(row_number() OVER (PARTITION BY t.project_id ORDER BY a.name, b.name) AS INTEGER) AS rank,
       a.name AS "from", a.layer AS from_layer, b.name AS "to", b.layer AS to_layer, 'uses' AS kind, a.name AS file
FROM trade t JOIN who a ON a.id = t.source JOIN who b ON b.id = t.target
WHERE list_position({list(LAYERS)}, b.layer) < list_position({list(LAYERS)}, a.layer)
QUALIFY rank <= 25""")
def layering_violations(spark, sf):
    nodes, edges = trade(spark, sf)
    return m.layering_violations(edges, nodes, K)


@query("orphan_modules", f"""WITH {trade_sql(DAY)},
ends AS (SELECT project_id, src_module AS module FROM medges UNION SELECT project_id, dst_module FROM medges)
SELECT project_id, module, CAST(row_number() OVER (PARTITION BY project_id ORDER BY module) AS INTEGER) AS rank
FROM modules ANTI JOIN ends USING (project_id, module) QUALIFY rank <= 15""")
def orphan_modules(spark, sf):
    _, _, modules, mod = modules_of(spark, sf, DAY)
    return m.orphan_modules(modules, mod, K)


@query("hub_nodes", f"""WITH {trade_sql()}
SELECT project_id, id, name, 'class' AS kind, degree, name AS file,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY degree DESC, id) AS INTEGER) AS rank
FROM deg JOIN who USING (id) WHERE degree >= 10 QUALIFY rank <= 15""")
def hub_nodes(spark, sf):
    nodes, edges = trade(spark, sf)
    return m.hub_nodes(nodes, edges, K)


@query("god_entities", f"""WITH {trade_sql(YEAR)},
deps AS (SELECT project_id, source AS id, count(DISTINCT target) AS dependencies FROM trade GROUP BY ALL)
SELECT project_id, id, name, name AS file, 0 AS methods, 0 AS properties, dependencies,
       round_even(least(dependencies / 12, 3.0), 2) AS severity,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY round_even(least(dependencies / 12, 3.0), 2) DESC, id) AS INTEGER) AS rank
FROM deps JOIN who USING (id) WHERE dependencies >= 12 QUALIFY rank <= 15""")
def god_entities(spark, sf):
    nodes, edges = trade(spark, sf, YEAR)
    return m.god_classes(nodes, edges, K)


@query("layer_summary", f"""WITH {trade_sql(DAY)}
SELECT project_id, layer, count(DISTINCT module) AS modules FROM active GROUP BY ALL""")
def layer_summary(spark, sf):
    return m.layer_summary(trade(spark, sf, DAY)[0], K)


@query("degree", f"WITH {trade_sql(YEAR)} SELECT * FROM deg")
def degree(spark, sf):
    return g.degree(trade(spark, sf, YEAR)[1], K)


@query("neighbors", f"""WITH {trade_sql(YEAR)}
SELECT project_id, target AS id, source AS neighbor FROM trade WHERE ends_with(target, '7')""")
def neighbors(spark, sf):
    nodes, edges = trade(spark, sf, YEAR)
    return g.neighbors(edges, nodes.filter(F.col("id").startswith("s") & F.col("id").endswith("7")), ["uses"], K)


@query("out_in_edges", f"""WITH {trade_sql(YEAR)}
SELECT project_id, source, target, CAST(weight AS DOUBLE) AS weight, 'out' AS side FROM trade WHERE ends_with(source, '9')
UNION ALL
SELECT project_id, source, target, CAST(weight AS DOUBLE), 'in' FROM trade WHERE ends_with(target, '9')""")
def out_in_edges(spark, sf):
    nodes, edges = trade(spark, sf, YEAR)
    ids = nodes.filter(F.col("id").endswith("9"))
    kept = ["project_id", "source", "target", "weight"]
    out = g.out_edges(edges, ids, ["uses"], K).select(*kept).withColumn("side", F.lit("out"))
    return out.unionByName(g.in_edges(edges, ids, ["uses"], K).select(*kept).withColumn("side", F.lit("in")))


@query("collect_edges", f"""WITH {trade_sql()},
keep AS (SELECT DISTINCT id FROM who WHERE layer IN ('api', 'domain'))
SELECT project_id, source, target, CAST(weight AS DOUBLE) AS weight,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, source, target) AS INTEGER) AS rank
FROM trade WHERE source IN (FROM keep) AND target IN (FROM keep) QUALIFY rank <= 60""")
def collect_edges(spark, sf):
    nodes, edges = trade(spark, sf)
    kept = nodes.filter(F.col("attr.layer").isin("api", "domain"))
    return g.collect_edges(edges, kept, ["uses"], 60, K).select("project_id", "source", "target", "weight", "rank")


@query("subgraph", f"""WITH {trade_sql()},
keep AS (SELECT DISTINCT id FROM who WHERE module = 'NATION_3' OR module = 'NATION_4')
SELECT project_id, source, target, CAST(weight AS DOUBLE) AS weight FROM trade
WHERE source IN (FROM keep) AND target IN (FROM keep)""")
def subgraph(spark, sf):
    nodes, edges = trade(spark, sf)
    return g.subgraph(nodes, edges, nodes.filter(F.col("module").isin("NATION_3", "NATION_4")), K)[1].select(
        "project_id", "source", "target", "weight"
    )


@query("top_degree_graph", f"""WITH {trade_sql()},
alln AS (
  SELECT project_id, id, degree FROM deg
  UNION ALL SELECT DISTINCT project_id, 'module:' || module, 0 FROM active
),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY degree DESC, id) AS rank,
         count(*) OVER (PARTITION BY project_id) > 40 AS truncated FROM alln QUALIFY rank <= 40
),
es AS (
  SELECT t.project_id, count(*) AS n FROM trade t JOIN kept a ON a.project_id = t.project_id AND a.id = t.source
  JOIN kept b ON b.project_id = t.project_id AND b.id = t.target GROUP BY ALL
)
SELECT kept.project_id, id, degree, CAST(rank AS INTEGER) AS rank, truncated, coalesce(n, 0) AS edges_kept
FROM kept LEFT JOIN es USING (project_id)""")
def top_degree_graph(spark, sf):
    nodes, edges = trade(spark, sf)
    kept, inside = g.top_degree_graph(nodes, edges, 40, K)
    n = inside.groupBy(*K).agg(F.count("*").alias("edges_kept"))
    return kept.join(n, K, "left").fillna(0, ["edges_kept"]).select(
        "project_id", "id", "degree", "rank", "truncated", "edges_kept"
    )


@query("graph_stats", f"""WITH {trade_sql()}
SELECT project_id, 'nodes_by_kind' AS section, 'class' AS name, count(*) AS n FROM active GROUP BY project_id
UNION ALL SELECT project_id, 'nodes_by_kind', 'module', count(*) FROM modules GROUP BY project_id
UNION ALL SELECT project_id, 'edges_by_kind', 'uses', count(*) FROM trade GROUP BY project_id
UNION ALL SELECT project_id, 'edge_count', '', count(*) FROM trade GROUP BY project_id
UNION ALL SELECT project_id, 'node_count', '', sum(n) FROM (
  SELECT project_id, count(*) AS n FROM active GROUP BY project_id UNION ALL SELECT project_id, count(*) FROM modules GROUP BY project_id
) GROUP BY project_id""".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def graph_stats(spark, sf):
    return g.graph_stats(*trade(spark, sf), K)


@query("search_nodes", f"""WITH {trade_sql(YEAR)}
SELECT project_id, id, name, CAST(row_number() OVER (PARTITION BY project_id ORDER BY length(name), id) AS INTEGER) AS rank
FROM active WHERE contains(lower(name), '#00000012') QUALIFY rank <= 50""")
def search_nodes(spark, sf):
    return g.search_nodes(trade(spark, sf, YEAR)[0], " #00000012", 50, K).select("project_id", "id", "name", "rank")


@query("index_symbols", f"""WITH {trade_sql(YEAR)}
SELECT DISTINCT project_id, lower(name) AS name_lc, id AS node_id FROM active""")
def index_symbols(spark, sf):
    return g.index_symbols(trade(spark, sf, YEAR)[0], K)


# Duplicate customer rows: one per order, the order date decides which comes first.
@query("merge_nodes", """
WITH seen AS (
  SELECT 'c' || o_custkey AS id, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS file,
         CASE o_orderstatus WHEN 'F' THEN 'class' WHEN 'O' THEN 'interface' ELSE 'class' END AS kind,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS module
  FROM orders
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file) AS rn FROM seen)
SELECT id, CASE WHEN max(kind) FILTER (rn = 1) = 'interface' OR bool_or(kind = 'interface') THEN 'interface' ELSE 'class' END AS kind,
       min(file) AS file, coalesce(first(module ORDER BY rn) FILTER (module <> ''), '') AS module,
       first(o_orderstatus ORDER BY rn) AS name,
       first(o_orderstatus ORDER BY rn) AS first_status,
       map_keys_sorted AS statuses
FROM numbered JOIN (
  SELECT id, array_to_string(list_sort(list(DISTINCT 'k' || o_orderstatus)), ',') AS map_keys_sorted FROM seen GROUP BY id
) USING (id) GROUP BY id, map_keys_sorted""")
def merge_nodes(spark, sf):
    orders = table(spark, sf, "orders").withColumn("project_id", F.lit("p"))
    seen = g.node_frame(
        orders, K,
        attr=g.attr_struct(
            layer=F.col("o_orderstatus"),
            extra=F.create_map(F.concat(F.lit("k"), F.col("o_orderstatus")), F.lit("1")),
        ),
        id=F.concat(F.lit("c"), F.col("o_custkey")), name=F.col("o_orderstatus"),
        kind=F.when(F.col("o_orderstatus") == "O", "interface").otherwise("class"),
        file=F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey")),
        module=F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")),
    )
    merged = g.merge_nodes(seen, keys=K, order=["file"])
    return merged.select(
        "id", "kind", "file", "module", "name", F.col("attr.layer").alias("first_status"),
        F.array_join(F.array_sort(F.map_keys("attr.extra")), ",").alias("statuses"),
    )


@query("merge_edges", """
WITH e AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, l_returnflag AS kind, l_quantity AS weight
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT source, target, kind, sum(weight) AS weight FROM e GROUP BY ALL""")
def merge_edges(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = table(spark, sf, "lineitem").join(by_shuffle(orders), "l_orderkey").withColumn("project_id", F.lit("p"))
    edges = g.edge_frame(
        rows, K, source=F.concat(F.lit("c"), F.col("o_custkey")), target=F.concat(F.lit("s"), F.col("l_suppkey")),
        kind=F.col("l_returnflag"), weight=F.col("l_quantity"),
    )
    return g.merge_edges(edges, keys=K).select("source", "target", "kind", "weight")


@query("link_edges", f"""WITH {trade_sql(YEAR)}
SELECT project_id, source, target, CAST(weight AS DOUBLE) AS weight FROM trade
WHERE source IN (SELECT id FROM who WHERE layer <> 'api') AND target IN (SELECT id FROM who WHERE layer <> 'api')""")
def link_edges(spark, sf):
    nodes, edges = trade(spark, sf, YEAR)
    return g.link(edges, nodes.filter(F.col("attr.layer") != "api"), K).select("project_id", "source", "target", "weight")


@query("entropy", """
WITH c AS (SELECT o_orderpriority AS project_id, o_custkey, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT project_id, n, sum(n) OVER (PARTITION BY project_id) AS total FROM c)
SELECT project_id, round_even(-sum(CAST(n AS DOUBLE) / total * log2(CAST(n AS DOUBLE) / total)), 3) AS entropy FROM t GROUP BY project_id""")
def entropy(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("project_id"), "o_custkey").agg(F.count("*").alias("n"))
    return m.entropy(counts, K, "n")


# ---------------------------------------------------------------- iterative

ROUNDS = 8


def pagerank_sql() -> str:
    parts = [trade_sql(YEAR), """
nodes AS (SELECT project_id, id FROM active UNION SELECT project_id, 'module:' || module FROM active),
links AS (
  SELECT project_id, source, target, weight FROM trade
  UNION ALL SELECT project_id, target, 'module:' || module, weight FROM trade JOIN who ON id = target
),
wl AS (SELECT project_id, source, target, max(weight) AS weight FROM links GROUP BY ALL),
ow AS (SELECT project_id, source, sum(weight) AS w FROM wl GROUP BY ALL),
sh AS (SELECT project_id, source, target, weight / w AS share FROM wl JOIN ow USING (project_id, source)),
sz AS (SELECT project_id, count(*) AS n FROM nodes GROUP BY project_id),
r0 AS (SELECT project_id, nodes.id, 1.0 / n AS rank, n, ow.source IS NULL AS dangling
       FROM nodes JOIN sz USING (project_id) LEFT JOIN ow ON ow.project_id = nodes.project_id AND ow.source = nodes.id)"""]
    for i in range(ROUNDS):
        parts.append(f"""
m{i} AS (SELECT project_id, coalesce(sum(rank) FILTER (dangling), 0) AS lost FROM r{i} GROUP BY project_id),
f{i} AS (SELECT sh.project_id, target AS id, sum(rank * share) AS flow FROM sh JOIN r{i} r ON r.project_id = sh.project_id AND r.id = sh.source GROUP BY ALL),
r{i + 1} AS (SELECT r.project_id, r.id, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(flow, 0) AS rank, n, dangling
             FROM r{i} r JOIN m{i} USING (project_id) LEFT JOIN f{i} f ON f.project_id = r.project_id AND f.id = r.id)""")
    return ",".join(parts)


def ranked(spark, sf):
    nodes, edges = trade(spark, sf, YEAR)
    home = nodes.select(*K, F.col("id").alias("target"), "module")
    sold = g.edge_frame(
        edges.join(by_shuffle(home), [*K, "target"]), K, source=F.col("target"), target=F.concat(F.lit("module:"), F.col("module")),
        kind=F.lit("depends_on"), weight=F.col("weight"),
    )
    # the heaviest of parallel sales stands for all
    sold = sold.groupBy(*K, "source", "target", "kind", "label").agg(F.max("weight").alias("weight")).withColumn("attr", F.create_map().cast("map<string,string>"))
    return nodes, it.pagerank(nodes, edges.unionByName(sold), K, max_iterations=ROUNDS, tolerance=0.0)


@query("pagerank", f"WITH {pagerank_sql()} SELECT project_id, id, round_even(rank, 8) AS rank FROM r{ROUNDS}")
def pagerank(spark, sf):
    ranks = ranked(spark, sf)[1]
    return ranks.withColumn("rank", F.bround("rank", 8))


@query("centrality", f"""WITH {pagerank_sql()},
scored AS (
  SELECT r.project_id, r.id, coalesce(who.name, replace(r.id, 'module:', '')) AS name, round_even(rank, 6) AS score
  FROM r{ROUNDS} r LEFT JOIN who ON who.id = r.id
)
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) AS INTEGER) AS position
FROM scored QUALIFY position <= 20""")
def centrality(spark, sf):
    nodes, ranks = ranked(spark, sf)
    return it.centrality(ranks, nodes, K)


def cycles_sql(period=DAY) -> str:
    return trade_sql(period) + """,
e AS (SELECT project_id, src_module AS a, dst_module AS b FROM medges),
cyc AS (
  SELECT x.project_id, 2 AS length, [x.a, x.b] AS members FROM e x JOIN e y ON y.project_id = x.project_id AND y.a = x.b AND y.b = x.a
  WHERE x.a < x.b
  UNION ALL
  SELECT x.project_id, 3, [x.a, x.b, y.b] FROM e x JOIN e y ON y.project_id = x.project_id AND y.a = x.b
  JOIN e z ON z.project_id = x.project_id AND z.a = y.b AND z.b = x.a
  WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b
)"""


@query("bounded_cycles", f"""WITH {cycles_sql()}
SELECT project_id, length, array_to_string(members, '>') AS members FROM cyc""")
def bounded_cycles(spark, sf):
    mod = modules_of(spark, sf, DAY)[3]
    found = it.find_cycles(mod, K, max_length=3, limit=None)
    return found.select("project_id", "length", F.array_join("members", ">").alias("members"))


@query("top_cycles", f"""WITH {cycles_sql()}
SELECT project_id, length, array_to_string(members, '>') AS members,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY length, members) AS INTEGER) AS rank
FROM cyc QUALIFY rank <= 5""")
def top_cycles(spark, sf):
    mod = modules_of(spark, sf, DAY)[3]
    found = it.find_cycles(mod, K, max_length=3, limit=5)
    return found.select("project_id", "length", F.array_join("members", ">").alias("members"), "rank")


@query("cycle_edges", f"""WITH {cycles_sql()}
SELECT DISTINCT project_id, members[i] AS source, members[CASE WHEN i = length THEN 1 ELSE i + 1 END] AS target
FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM cyc)""")
def cycle_edges(spark, sf):
    mod = modules_of(spark, sf, DAY)[3]
    return it.cycle_edges(it.find_cycles(mod, K, max_length=3, limit=None), K)


TANGLES = """
t AS (SELECT 'p' || month(o_orderdate) AS project_id, o_custkey AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey - o_custkey % 6 ELSE o_custkey + 1 + o_orderkey % 5 END AS b
      FROM orders),
e AS (SELECT DISTINCT project_id, 'm' || a AS a, 'm' || b AS b FROM t WHERE a <> b)"""


def tangles(spark, sf):
    """Every order as an import between numbered modules, one project per month; some lead on to the next few, some back to the first of six."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    target = F.when(key % 4 == 0, customer - customer % 6).otherwise(customer + 1 + key % 5)
    rows = table(spark, sf, "orders").select(F.concat(F.lit("p"), F.month("o_orderdate")).alias("project_id"), customer.alias("a"), target.alias("b"))
    name = lambda c: F.concat(F.lit("m"), F.col(c))
    return rows.filter("a <> b").select("project_id", name("a").alias("src_module"), name("b").alias("dst_module"))


@query("cyclic_modules", f"""WITH RECURSIVE {TANGLES},
w AS (SELECT project_id, a, b FROM e UNION SELECT w.project_id, w.a, e.b FROM w JOIN e ON w.project_id = e.project_id AND w.b = e.a)
SELECT x.project_id, x.a AS module, min(x.b) AS component FROM w x JOIN w y ON x.project_id = y.project_id AND x.a = y.b AND x.b = y.a
GROUP BY x.project_id, x.a""")
def cyclic_modules(spark, sf):
    return it.cyclic_components(tangles(spark, sf), K).select("project_id", "module", "component")


@query("long_cycles", f"""WITH RECURSIVE {TANGLES},
w AS (
  SELECT project_id, [a, b] AS members FROM e WHERE a < b
  UNION ALL
  SELECT w.project_id, list_append(members, e.b) FROM w JOIN e ON e.project_id = w.project_id AND e.a = members[-1]
  WHERE e.b > members[1] AND NOT list_contains(members, e.b)
)
SELECT w.project_id, CAST(len(members) AS INTEGER) AS length, array_to_string(members, '>') AS members
FROM w JOIN e ON e.project_id = w.project_id AND e.a = members[-1] AND e.b = members[1]""")
def long_cycles(spark, sf):
    """Cycles of any length."""
    found = it.find_cycles(tangles(spark, sf), K, max_length=None, limit=None)
    return found.select("project_id", "length", F.array_join("members", ">").alias("members"))


@query("stored_runs", f"""WITH {trade_sql(YEAR)}
SELECT project_id, source, target, CAST(CASE WHEN CAST(project_id AS INTEGER) % 2 = 0 THEN weight + 100 ELSE weight END AS DOUBLE) AS weight
FROM trade WHERE CAST(project_id AS INTEGER) % 2 = 1 OR CAST(substr(source, 2) AS INTEGER) % 3 = 0""")
def stored_runs(spark, sf):
    """All years' graphs stored, the even years stored again with other edges; read back, a run is of one commit."""
    nodes, edges = trade(spark, sf, YEAR)
    path = shared_path(spark, "stored-runs")
    write_graph(nodes, edges, path, K)
    even = lambda df: df.filter(F.col("project_id").cast("int") % 2 == 0)
    heavier = even(edges).filter(F.substring("source", 2, 20).cast("int") % 3 == 0).withColumn("weight", F.col("weight") + 100)
    write_graph(even(nodes), heavier, path, K)
    return read_run(spark, path, "edges", K).select("project_id", "source", "target", "weight")
