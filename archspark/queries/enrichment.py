"""What is added to a graph: services, derived reads, lifted edges, reach, annotations, patterns, first score.

The graph: parts are nodes, consecutive items of an order are edges; a seventh of the orders is a project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import graph as g
from archspark.operators import history as h
from archspark.operators import iterate as it
from archspark.operators import metrics as m
from archspark.operators import quality as q
from archspark.operators import review as rv
from archspark.queries.registry import query, table
from archspark.queries.scorecard import FACTS, card_facts
from archspark.session import staged

K = ["project_id"]
KINDS = ("class", "interface", "component", "container", "table", "database", "file", "function", "method", "api_endpoint", "queue", "data_store")
STEREOTYPES = ("repository", "controller", "service", "factory", "adapter", "middleware", "")
LINKS = ("uses", "calls", "depends_on", "implements")


def _pick(values, at: str) -> str:
    return "CASE " + " ".join(f"WHEN {at} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# The same text in both engines.
NAME = """CASE WHEN kind IN ('component', 'container') THEN CASE WHEN k % 5 = 0 THEN concat('Billing', k % 35) ELSE concat('Pay-Service', k % 35) END
  WHEN kind = 'class' AND k % 24 = 0 THEN concat('EventListener', k) ELSE concat('Part', k) END"""
NODE = f"""SELECT project_id, concat('n', k) AS id, k, kind, {NAME} AS name, concat('m', k % 9, '/s', k % 4) AS module,
  k % 17 = 0 AS external, CASE WHEN kind IN ('class', 'interface') THEN {_pick(STEREOTYPES, 'k % 7')} ELSE '' END AS stereotype FROM kinded"""

GRAPH = f"""
li AS (SELECT 'p' || l_orderkey % 7 AS project_id, l_orderkey, l_linenumber, l_partkey AS k FROM lineitem),
kinded AS (SELECT project_id, k, {_pick(KINDS, 'k % 12')} AS kind FROM (SELECT DISTINCT project_id, k FROM li)),
nodes AS ({NODE}),
edges AS (
  SELECT a.project_id, 'n' || a.k AS source, 'n' || b.k AS target, {_pick(LINKS, '(a.k + a.l_linenumber) % 4')} AS kind, count(*) AS weight
  FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.k <> b.k GROUP BY ALL
)"""


def parts_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written once, as the operators read them several times."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_orderkey") % 7).alias("project_id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    kinded = li.select("project_id", "k").distinct().withColumn("kind", F.expr(_pick(KINDS, "k % 12")))
    rows = spark.sql(NODE.replace("FROM kinded", "FROM {kinded}"), kinded=kinded)
    nodes = g.node_frame(
        rows, K, attr=g.attr_struct(stereotype=F.col("stereotype")), id=F.col("id"), kind=F.col("kind"), name=F.col("name"),
        qualified_name=F.col("name"), file=F.col("name"), module=F.col("module"), external=F.col("external"))
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("k").alias("b"))
    links = li.join(after, ["l_orderkey", "l_linenumber"]).filter("k <> b").withColumn("kind", F.expr(_pick(LINKS, "(k + l_linenumber) % 4")))
    links = links.groupBy("project_id", F.concat(F.lit("n"), "k").alias("source"), F.concat(F.lit("n"), "b").alias("target"), "kind").agg(F.count("*").alias("n"))
    edges = g.edge_frame(links, K, source=F.col("source"), target=F.col("target"), kind=F.col("kind"), weight=F.col("n"))
    return staged(nodes, "parts-nodes"), staged(edges, "parts-edges")


@query("kinds_and_names", f"""WITH {GRAPH}
SELECT project_id, id, 'kind' AS found FROM nodes WHERE kind IN ('table', 'queue') UNION ALL SELECT project_id, id, 'name' FROM nodes WHERE lower(name) = 'billing10'""")
def kinds_and_names(spark, sf):
    nodes, _ = parts_graph(spark, sf)
    found = lambda df, how: df.select("project_id", "id", F.lit(how).alias("found"))
    return found(g.nodes_by_kind(nodes, "table", "queue"), "kind").unionByName(found(g.find_by_name(nodes, "bILLing10"), "name"))


@query("store_reads", f"""WITH {GRAPH}
SELECT e.project_id, e.source, e.target, 'reads' AS kind, 1.0::DOUBLE AS weight FROM edges e JOIN nodes n ON n.project_id = e.project_id AND n.id = e.target
WHERE e.kind IN ('uses', 'calls', 'depends_on') AND n.kind IN ('table', 'database', 'data_store')""")
def store_reads(spark, sf):
    nodes, edges = parts_graph(spark, sf)
    return g.derive_reads(edges, nodes, K).select("project_id", "source", "target", "kind", "weight")


@query("lifted_edges", f"""WITH {GRAPH},
p AS (SELECT e.project_id, 'component:' || split_part(a.module, '/', 1) AS source, 'component:' || split_part(b.module, '/', 1) AS target, b.external
      FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.id = e.source JOIN nodes b ON b.project_id = e.project_id AND b.id = e.target
      WHERE e.kind IN ('depends_on', 'uses', 'calls'))
SELECT project_id, source, target, 'depends_on' AS kind, CAST(count(*) AS DOUBLE) AS weight FROM p
WHERE NOT external AND source <> target AND source <> 'component:m8' AND target <> 'component:m8' GROUP BY ALL""")
def lifted_edges(spark, sf):
    nodes, edges = parts_graph(spark, sf)
    names = F.explode(F.array(*[F.lit(f"m{i}") for i in range(8)]))  # the ninth is no component
    components = nodes.select("project_id").distinct().withColumn("name", names)
    components = g.node_frame(components, K, id=F.concat(F.lit("component:"), "name"), kind=F.lit("component"), name=F.col("name"), qualified_name=F.col("name"))
    return g.lift_edges(edges, nodes, components, K).select("project_id", "source", "target", "kind", "weight")


@query("services", f"""WITH {GRAPH},
c AS (SELECT project_id, lower(name) AS low, min(id) AS container FROM nodes WHERE kind = 'container' GROUP BY ALL)
SELECT n.project_id, n.id, c.container IS NOT NULL OR contains(lower(n.name), 'service') AS is_service, coalesce(c.container, '') AS deployed_by
FROM nodes n LEFT JOIN c ON c.project_id = n.project_id AND c.low = lower(n.name) WHERE n.kind = 'component'""")
def services(spark, sf):
    nodes, deploys = g.mark_services(parts_graph(spark, sf)[0], K)
    by = deploys.select("project_id", F.col("target").alias("id"), F.col("source").alias("deployed_by"))
    rows = nodes.filter("kind = 'component'").join(by, [*K, "id"], "left")
    return rows.select("project_id", "id", F.coalesce("attr.is_service", F.lit(False)).alias("is_service"), F.coalesce("deployed_by", F.lit("")).alias("deployed_by"))


@query("endpoint_stores", f"""WITH RECURSIVE {GRAPH},
seed AS (SELECT DISTINCT e.project_id, e.source AS endpoint, e.target AS spot FROM edges e JOIN nodes n ON n.project_id = e.project_id AND n.id = e.source
         WHERE n.kind = 'api_endpoint' AND e.kind = 'implements'),
step AS (SELECT DISTINCT e.project_id, e.source AS spot, e.target, n.id IS NOT NULL AS store FROM edges e
         LEFT JOIN nodes n ON n.project_id = e.project_id AND n.id = e.target AND n.kind IN ('table', 'database', 'data_store') WHERE e.kind IN ('calls', 'uses')),
r1 AS (SELECT DISTINCT s.project_id, endpoint, target, store FROM seed s JOIN step USING (project_id, spot)),
r2 AS (SELECT DISTINCT r.project_id, endpoint, t.target, t.store FROM r1 r JOIN step t ON t.project_id = r.project_id AND t.spot = r.target AND NOT r.store)
SELECT DISTINCT project_id, endpoint AS source, target, 'reads' AS kind FROM (FROM r1 UNION ALL FROM r2) WHERE store""")
def endpoint_stores(spark, sf):
    nodes, edges = parts_graph(spark, sf)
    kind = F.when(F.col("kind") == "implements", "exposes").when(F.col("kind") == "depends_on", "imports").otherwise(F.col("kind"))
    return it.endpoint_store_reads(edges.withColumn("kind", kind), nodes, K, hops=2).select("project_id", "source", "target", "kind")


@query("patterns", f"""WITH {GRAPH},
c AS (
  SELECT project_id, {', '.join(f"count(*) FILTER (stereotype = '{s}') AS {s}" for s in STEREOTYPES if s)}, count(*) FILTER (kind = 'interface') AS interfaces,
         count(*) FILTER (contains(name, 'Listener')) AS observers, count(*) FILTER (kind = 'queue') AS queues, count(*) FILTER (kind = 'container') AS containers
  FROM nodes GROUP BY project_id
),
i AS (SELECT project_id, count(*) AS impl FROM edges WHERE kind = 'implements' GROUP BY project_id),
x AS (
  SELECT project_id, unnest([
    {{pattern: 'Repository', w: repository > 0, c: 0.5 + 0.1 * least(repository, 4), n: repository}},
    {{pattern: 'MVC / Layered', w: controller > 0 AND service > 0, c: 0.5 + 0.05 * least(controller + service, 8), n: controller + service}},
    {{pattern: 'Factory', w: factory > 0, c: 0.4 + 0.1 * least(factory, 3), n: factory}}, {{pattern: 'Adapter', w: adapter > 0, c: 0.4 + 0.1 * least(adapter, 3), n: adapter}},
    {{pattern: 'Chain of Responsibility', w: middleware > 0, c: 0.4, n: middleware}},
    {{pattern: 'Dependency Inversion / DI', w: interfaces > 0 AND impl > 0, c: 0.4 + 0.02 * least(impl, 20), n: impl}},
    {{pattern: 'Observer / Event-driven', w: observers >= 3, c: 0.45, n: observers}}, {{pattern: 'Message-driven integration', w: queues > 0, c: 0.6, n: queues}},
    {{pattern: 'Microservices / Containerised deployment', w: containers >= 3, c: 0.55, n: containers}}], recursive := true)
  FROM c JOIN i USING (project_id)
)
SELECT project_id, pattern, CAST(round(c, 2) AS DOUBLE) AS confidence, n AS count FROM x WHERE w""")
def patterns(spark, sf):
    return m.detect_patterns(*parts_graph(spark, sf), K)


FIRST = ("cycles", "god_classes", "violations", "density", "hubs", "abstraction_ratio")


@query("first_scores", f"""WITH base AS (SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
f AS (SELECT k AS project_id, {', '.join(f'CAST({FACTS[c]} AS DOUBLE) AS {c}' for c in FIRST)} FROM base),
s AS (SELECT project_id, CAST(least(100, greatest(0, 100 - least(cycles * 6, 25) - least(god_classes * 4, 16) - least(violations * 3, 18) - least(floor(density * 100), 15)
        - least(hubs * 2, 10)) + CASE WHEN abstraction_ratio > 0.15 THEN 5 ELSE 0 END) AS INTEGER) AS base_score FROM f)
SELECT *, CASE WHEN base_score >= 90 THEN 'A' WHEN base_score >= 80 THEN 'B' WHEN base_score >= 70 THEN 'C' WHEN base_score >= 60 THEN 'D' ELSE 'E' END AS base_grade FROM s""")
def first_scores(spark, sf):
    return m.base_score(card_facts(spark, sf).select(*K, *FIRST)).select(*K, "base_score", "base_grade")


@query("history_notes", f"""WITH {GRAPH},
churn AS (SELECT project_id, name, k * 2 AS changes, k % 5 AS authors FROM nodes WHERE kind IN ('file', 'class') AND k % 2 = 0),
parts AS (SELECT DISTINCT project_id, name, length(name) AS changes, 3 AS authors FROM nodes WHERE kind = 'component' AND starts_with(name, 'Billing'))
SELECT n.project_id, n.id, CAST(coalesce(c.changes, p.changes) AS BIGINT) AS change_count, CAST(coalesce(c.authors, p.authors) AS BIGINT) AS authors,
       CASE WHEN c.changes IS NOT NULL THEN '2024-03-01 10:00:00' END AS last_changed
FROM nodes n LEFT JOIN churn c ON n.kind = 'file' AND c.project_id = n.project_id AND c.name = n.name
LEFT JOIN parts p ON n.kind = 'component' AND p.project_id = n.project_id AND p.name = n.name""")
def history_notes(spark, sf):
    """Churn of files and, by mistake, of classes, which take none; and of some components."""
    nodes, _ = parts_graph(spark, sf)
    k = F.substring("id", 2, 20).cast("long")
    churn = nodes.filter(F.col("kind").isin("file", "class") & (k % 2 == 0)).select(
        *K, F.col("name").alias("path"), (k * 2).alias("changes"), (k % 5).alias("authors"), F.lit("2024-03-01 10:00:00").cast("timestamp").alias("last_changed"))
    parts = nodes.filter("kind = 'component' AND startswith(name, 'Billing')").select(
        *K, F.col("name").alias("component"), F.char_length("name").cast("long").alias("changes"), F.lit(3).cast("long").alias("contributors")).distinct()
    noted = h.annotate_history(nodes, churn, parts, K)
    return noted.select(*K, "id", F.col("attr.change_count").cast("long").alias("change_count"), F.col("attr.authors").cast("long").alias("authors"),
                        F.try_element_at("attr.extra", F.lit("last_changed")).alias("last_changed"))


@query("quality_notes", f"""WITH {GRAPH}
SELECT project_id, id, CASE WHEN s THEN k % 400 END AS loc, CASE WHEN s THEN k % 6 END AS findings, CASE WHEN s THEN k % 3 END AS risk_findings, CASE WHEN s THEN k % 4 END AS markers,
       CASE WHEN s THEN CAST(k % 200 AS VARCHAR) END AS code_lines
FROM (SELECT *, kind = 'file' AND k % 5 > 0 AS s FROM nodes)""")
def quality_notes(spark, sf):
    nodes, _ = parts_graph(spark, sf)
    k = F.substring("id", 2, 20).cast("long")
    named = nodes.withColumns({"key": k, "id": F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "name")).otherwise(F.col("id"))})
    profiles = named.filter("kind = 'file' AND key % 5 > 0").select(
        *K, F.col("name").alias("path"), (F.col("key") % 400).alias("loc"), (F.col("key") % 6).alias("findings"), (F.col("key") % 3).alias("risk_findings"),
        F.lit(False).alias("is_test"), (F.col("key") % 4).alias("markers"), (F.col("key") % 200).alias("code_lines"),
        F.lit(0).alias("comment_lines"), F.lit(0).alias("blank_lines"), F.lit(0).alias("long_lines"))
    noted = q.annotate_quality(named.drop("key"), profiles, K)
    count = lambda c: F.col(f"attr.{c}").cast("long").alias(c.replace("debt_", ""))
    return noted.select(*K, F.when(F.col("kind") == "file", F.concat(F.lit("n"), F.substring("name", 5, 20))).otherwise(F.col("id")).alias("id"),
                        *[count(c) for c in ("loc", "findings", "risk_findings", "debt_markers")],
                        F.try_element_at("attr.extra", F.lit("code_lines")).alias("code_lines"))


DEGREES = GRAPH + """,
deg AS (SELECT project_id, id, count(*) AS degree FROM (SELECT project_id, source AS id FROM edges UNION ALL SELECT project_id, target FROM edges) GROUP BY ALL)"""


@query("entry_points", f"""WITH {DEGREES}
SELECT project_id, id, name, kind, CAST(row_number() OVER (PARTITION BY project_id ORDER BY coalesce(degree, 0) DESC, id) AS INTEGER) AS rank
FROM nodes LEFT JOIN deg USING (project_id, id) WHERE kind = 'api_endpoint' QUALIFY rank <= 3""")
def entry_points(spark, sf):
    return it.pick_entry_points(*parts_graph(spark, sf), K).select("project_id", "id", "name", "kind", "rank")


@query("callable_entries", f"""WITH {DEGREES},
c AS (SELECT project_id, source AS id, count(*) AS calls FROM edges WHERE kind = 'calls' GROUP BY ALL),
f AS (SELECT project_id, id, name, coalesce(calls, 0) AS calls FROM nodes LEFT JOIN c USING (project_id, id) WHERE kind IN ('function', 'method') AND contains(lower(name), 'part1'))
SELECT project_id, id, name, CAST(row_number() OVER (PARTITION BY project_id ORDER BY calls DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 3""")
def callable_entries(spark, sf):
    """With a focus that no endpoint bears: the callables that bear it, by their calls."""
    nodes, edges = parts_graph(spark, sf)
    others = nodes.filter("kind <> 'api_endpoint'")
    return it.pick_entry_points(others, edges, K, focus=" PART1 ").select("project_id", "id", "name", "rank")


@query("corpus_summary", f"""WITH {DEGREES},
r AS (
  SELECT project_id, 'components' AS section, kind, name, 0 AS n, row_number() OVER (PARTITION BY project_id ORDER BY id) AS rank FROM nodes WHERE kind = 'component'
  UNION ALL SELECT project_id, 'types', kind, name, coalesce(degree, 0), row_number() OVER (PARTITION BY project_id ORDER BY coalesce(degree, 0) DESC, id)
  FROM nodes LEFT JOIN deg USING (project_id, id) WHERE kind IN ('class', 'interface')
  UNION ALL SELECT project_id, 'surface', kind, name, 0, row_number() OVER (PARTITION BY project_id, kind ORDER BY name, id)
  FROM nodes WHERE kind IN ('api_endpoint', 'table', 'database', 'queue', 'container')
)
SELECT project_id, section, kind, CAST(rank AS INTEGER) AS rank, name, n FROM r WHERE rank <= 5""")
def corpus_summary(spark, sf):
    return rv.corpus_summary(*parts_graph(spark, sf), K, limit=5)


@query("advice", f"""WITH base AS (SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
f AS (SELECT k AS project_id, {', '.join(f'{FACTS[c]} AS {c}' for c in FIRST)} FROM base),
a AS (SELECT project_id, list_filter([CASE WHEN cycles > 0 THEN 'cycle' END, CASE WHEN god_classes > 0 THEN 'god' END, CASE WHEN violations > 0 THEN 'layer' END,
        CASE WHEN abstraction_ratio < 0.1 THEN 'abstraction' END], lambda x: x IS NOT NULL) AS found FROM f),
d AS (SELECT project_id, CASE WHEN len(found) > 0 THEN found ELSE ['docs'] END AS found FROM a)
SELECT project_id, CAST(unnest(range(0, len(found))) AS INTEGER) AS pos, unnest(found) AS advice FROM d""")
def advice(spark, sf):
    return rv.improvements(card_facts(spark, sf), K)


@query("merged_graphs", f"""WITH {GRAPH},
twice AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE kind IN ('uses', 'calls'))
SELECT project_id, source, target, kind, CAST(sum(weight) AS DOUBLE) AS weight, (SELECT count(*) FROM nodes n WHERE n.project_id = twice.project_id) AS nodes
FROM twice GROUP BY ALL""")
def merged_graphs(spark, sf):
    """A graph and a part of it: nodes once, weights of equal edges added."""
    nodes, edges = parts_graph(spark, sf)
    part = nodes.filter(F.substring("id", 2, 20).cast("long") % 2 == 0), edges.filter(F.col("kind").isin("uses", "calls"))
    merged, links = g.merge_graphs((nodes, edges), part, K)
    sizes = merged.groupBy(*K).agg(F.count("*").alias("nodes"))
    return links.join(sizes, K).select("project_id", "source", "target", "kind", "weight", "nodes")
