"""Extraction and resolution over the part-derived corpus.

The expected facts follow from the part key by arithmetic, so the SQL does not
repeat the parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators import graph as g
from archspark.operators import resolve as rs
from archspark.operators.extract import brace, facts, infra, python_source, sql
from archspark.queries import corpus
from archspark.queries.registry import query, table
from archspark.schema import KEYS
from archspark.session import cut_lineage, staged
from archspark.sources.tree import classify_files

PK = list(KEYS)
K = ["project_id"]
CORPUS = corpus.duck_cte()
DOTTED = "CASE WHEN module = '(root)' THEN '' ELSE replace(module, '/', '.') || '.' END"


def fact_rows(spark, sf):
    return facts.all_facts(corpus.files(spark, sf), PK)


def fact_lists(spark, sf, column):
    """One list of every file, written before it is exploded: the planner tests a list for rows first, by working it out again, and again."""
    return staged(fact_rows(spark, sf).select("project_id", "path", column), f"facts-{column}")


_staged: dict[tuple[str, str], DataFrame] = {}


def code_graph(spark, sf):
    """Graph tables of the corpus.

    The fact rows feed a dozen explodes and many queries: they are staged once per
    session, as a job would write them, instead of parsing again for each.
    """
    at = (spark.sparkContext.applicationId, sf)
    if at not in _staged:
        _staged[at] = cut_lineage(fact_rows(spark, sf))
    return facts.graph_of(_staged[at], PK)


IMPORTS = CORPUS + """,
imports AS (
  SELECT project_id, path, lang, nxt, module, unnest(CASE lang
    WHEN 'python' THEN ['os', 'requests', nsvc || '.' || ndir || '.mod' || nxt]
    WHEN 'typescript' THEN [nsvc || '/' || ndir || '/mod' || nxt, 'axios']
    WHEN 'java' THEN ['com.' || nsvc || '.' || ndir || '.Gadget' || nxt, 'org.apache.kafka.clients.Producer']
    WHEN 'go' THEN ['fmt', 'net/http']
    WHEN 'rust' THEN ['crate', 'helper' || id]
    WHEN 'cpp' THEN [nsvc || '/' || ndir || '/mod' || nxt || '.hpp']
    ELSE [] END) AS target
  FROM corpus
)"""


@query("extract_imports", f"""WITH {IMPORTS}
SELECT project_id, path, target, lang = 'typescript' AND contains(target, '/') AS relative FROM imports""")
def extract_imports(spark, sf):
    rows = fact_lists(spark, sf, "imports")
    return rows.select("project_id", "path", F.explode("imports").alias("i")).select("project_id", "path", "i.*")


TYPES = CORPUS + f""",
types AS (
  SELECT project_id, path, lang, module, id, nxt, dir, unnest(CASE lang
    WHEN 'python' THEN [{{name: 'Widget' || id, kind: 'class', line: 7}}, {{name: 'Status' || id, kind: 'enum', line: 25}}]
    WHEN 'typescript' THEN [{{name: 'IPanel' || id, kind: 'interface', line: 3}}, {{name: 'Panel' || id, kind: 'class', line: 4}}]
    WHEN 'java' THEN [{{name: 'Gadget' || id, kind: 'class', line: 6}}]
    WHEN 'go' THEN [{{name: 'Node' || id, kind: 'struct', line: 6}}, {{name: 'Walker' || id, kind: 'interface', line: 10}}]
    WHEN 'rust' THEN [{{name: 'Cell' || id, kind: 'struct', line: 3}}, {{name: 'Mode' || id, kind: 'enum', line: 7}},
                      {{name: 'Walk' || id, kind: 'interface', line: 11}}]
    WHEN 'cpp' THEN [{{name: 'Shape' || id, kind: 'abstract_class', line: 4}}]
    ELSE [] END) AS t,
    CASE lang WHEN 'python' THEN {DOTTED} WHEN 'java' THEN 'com.' || svc || '.' || dir || '.'
              WHEN 'cpp' THEN dir || '::' ELSE module || '.' END AS prefix
  FROM corpus
)"""


@query("extract_types", f"""WITH {TYPES}
SELECT project_id, path, t.name AS name, t.kind AS kind, prefix || t.name AS qualified, CAST(t.line AS INTEGER) AS line,
       CASE WHEN lang = 'java' THEN 'service' ELSE '' END AS stereotype FROM types""")
def extract_types(spark, sf):
    rows = fact_lists(spark, sf, "types").select("project_id", "path", F.explode("types").alias("t"))
    return rows.select("project_id", "path", *[f"t.{c}" for c in ("name", "kind", "qualified", "line", "stereotype")])


@query("extract_members", f"""WITH {CORPUS}
SELECT project_id, path, unnest(CASE lang
    WHEN 'python' THEN ['Widget' || id || '.run public 2', 'Widget' || id || '.helper' || id || ' public 1']
    WHEN 'typescript' THEN ['Panel' || id || '.render public 0']
    WHEN 'java' THEN ['Gadget' || id || '.run public 2', 'Gadget' || id || '.compute' || id || ' protected 1']
    WHEN 'go' THEN ['Node' || id || '.Walk public 0', 'Walker' || id || '.Walk public 0']
    WHEN 'rust' THEN ['Cell' || id || '.walk public 0', 'Walk' || id || '.walk public 0']
    ELSE [] END) AS member FROM corpus""")
def extract_members(spark, sf):
    nodes = code_graph(spark, sf).nodes
    rows = nodes.select("project_id", F.col("file").alias("path"), "name", F.explode("attr.methods").alias("m"))
    return rows.select("project_id", "path", F.concat(
        "name", F.lit("."), "m.name", F.lit(" "), "m.visibility", F.lit(" "), F.size("m.params").cast("string")).alias("member"))


@query("extract_fields", f"""WITH {CORPUS}
SELECT project_id, path, unnest(CASE lang
    WHEN 'python' THEN ['Widget' || id || '.peer:Widget' || nxt || ' public', 'Status' || id || '.NEW: public', 'Status' || id || '.DONE: public']
    WHEN 'typescript' THEN ['Panel' || id || '.peer:Panel' || nxt || ' private', 'IPanel' || id || '.title:string public']
    WHEN 'java' THEN ['Gadget' || id || '.peer:Gadget' || nxt || ' private', 'Gadget' || id || '.LIMIT:int private']
    WHEN 'go' THEN ['Node' || id || '.Next:Node' || nxt || ' public', 'Node' || id || '.Size:int public']
    WHEN 'rust' THEN ['Cell' || id || '.next:Option<Cell' || nxt || '> public', 'Cell' || id || '.size:u32 private']
    WHEN 'cpp' THEN ['Shape' || id || '.count:int private']
    ELSE [] END) AS field FROM corpus""")
def extract_fields(spark, sf):
    rows = fact_lists(spark, sf, "types").select("project_id", "path", F.explode("types").alias("t"))
    rows = rows.select("project_id", "path", "t.name", F.explode("t.properties").alias("p"))
    return rows.select("project_id", "path", F.concat(
        "name", F.lit("."), "p.name", F.lit(":"), "p.type", F.lit(" "), "p.visibility").alias("field"))


@query("extract_functions", f"""WITH {CORPUS}
SELECT project_id, path, f.name AS name, CAST(f.line AS INTEGER) AS line, f.owned AS owned,
       CAST(f.complexity AS INTEGER) AS complexity FROM (
  SELECT project_id, path, unnest(CASE lang
    WHEN 'python' THEN [{{name: 'run', line: 11, owned: TRUE, complexity: 3}}, {{name: 'helper' || id, line: 16, owned: TRUE, complexity: 2}},
                        {{name: 'fetch' || id, line: 22, owned: FALSE, complexity: 1}}]
    WHEN 'typescript' THEN [{{name: 'build' || id, line: 12, owned: FALSE, complexity: NULL}}]
    WHEN 'go' THEN [{{name: 'Walk', line: 13, owned: TRUE, complexity: NULL}}, {{name: 'visit' || id, line: 16, owned: FALSE, complexity: NULL}}]
    WHEN 'cpp' THEN [{{name: 'area' || id, line: 10, owned: FALSE, complexity: NULL}}]
    ELSE [] END) AS f FROM corpus)""")
def extract_functions(spark, sf):
    nodes = code_graph(spark, sf).nodes.filter(F.col("kind").isin("function", "method"))
    return nodes.select("project_id", F.col("file").alias("path"), "name", "line", (F.col("kind") == "method").alias("owned"),
                        F.col("attr.complexity").alias("complexity"))


def refs_of(spark, sf, *kinds):
    refs = code_graph(spark, sf).refs.filter(F.col("kind").isin(*kinds))
    return refs.select("project_id", "source_id", "target_name", "kind")


@query("extract_inheritance", f"""WITH {TYPES}
SELECT project_id, 'type:' || lang || ':' || prefix || t.name AS source_id, b.name AS target_name, b.kind AS kind FROM (
  SELECT *, unnest(CASE
    WHEN t.name = 'Widget' || id THEN [{{name: 'Widget' || nxt, kind: 'inherits'}}]
    WHEN t.name = 'Panel' || id THEN [{{name: 'Panel' || nxt, kind: 'inherits'}}, {{name: 'IPanel' || id, kind: 'implements'}}]
    WHEN t.name = 'Gadget' || id THEN [{{name: 'Gadget' || nxt, kind: 'inherits'}}, {{name: 'IRunner', kind: 'implements'}}]
    WHEN t.name = 'Cell' || id THEN [{{name: 'Walk' || id, kind: 'implements'}}]
    WHEN t.name = 'Shape' || id THEN [{{name: 'Shape' || nxt, kind: 'inherits'}}] ELSE [] END) AS b FROM types)""")
def extract_inheritance(spark, sf):
    return refs_of(spark, sf, "inherits", "implements")


@query("extract_compositions", f"""WITH {TYPES}
SELECT project_id, 'type:' || lang || ':' || prefix || t.name AS source_id, regexp_extract(t.name, '[A-Za-z]+') || nxt AS target_name,
       'composes' AS kind FROM types WHERE regexp_extract(t.name, '[A-Za-z]+') IN ('Widget', 'Panel', 'Gadget', 'Node', 'Cell')""")
def extract_compositions(spark, sf):
    return refs_of(spark, sf, "composes")


@query("extract_calls", f"""WITH {CORPUS}
SELECT project_id, c.source AS source_id, c.callee AS target_name, 'calls' AS kind FROM (
  SELECT project_id, unnest(CASE lang
    WHEN 'python' THEN [
      {{source: 'func:python:' || {DOTTED} || 'Widget' || id || '.run', callee: 'fetch' || nxt}},
      {{source: 'func:python:' || {DOTTED} || 'Widget' || id || '.run', callee: 'helper' || id}},
      {{source: 'func:python:' || {DOTTED} || 'Widget' || id || '.helper' || id, callee: 'system'}},
      {{source: 'func:python:' || {DOTTED} || 'fetch' || id, callee: 'get'}},
      {{source: 'func:python:' || {DOTTED} || 'fetch' || id, callee: 'get'}}]
    WHEN 'typescript' THEN [{{source: 'type:typescript:' || module || '.Panel' || id, callee: 'render'}},
      {{source: 'type:typescript:' || module || '.Panel' || id, callee: 'log'}},
      {{source: 'type:typescript:' || module || '.Panel' || id, callee: 'build' || id}}]
    WHEN 'java' THEN list_transform(['GetMapping', 'run', 'load', 'compute' || id],
      lambda x: {{source: 'type:java:com.' || svc || '.' || dir || '.Gadget' || id, callee: x}})
    WHEN 'go' THEN [{{source: 'func:go:' || module || '.Node' || id || '.Walk', callee: 'visit' || nxt}}]
    WHEN 'rust' THEN [{{source: 'type:rust:' || module || '.Cell' || id, callee: 'walk'}},
      {{source: 'type:rust:' || module || '.Cell' || id, callee: 'relay' || nxt}}]
    WHEN 'cpp' THEN [{{source: 'type:cpp:' || dir || '::Shape' || id, callee: 'draw'}}]
    ELSE [] END) AS c FROM corpus)""")
def extract_calls(spark, sf):
    return refs_of(spark, sf, "calls")


@query("extract_routes", f"""WITH {CORPUS}
SELECT project_id, path AS file, CASE lang
    WHEN 'python' THEN 'api:GET:/items/' || id WHEN 'typescript' THEN 'api:GET:/panels/' || id
    WHEN 'java' THEN 'api:GET:/gadgets/' || id ELSE 'api:ANY:/nodes/' || id END AS id,
  CASE lang WHEN 'python' THEN 'app' WHEN 'typescript' THEN 'express-like' WHEN 'java' THEN 'java' ELSE 'go-http' END AS framework
FROM corpus WHERE lang IN ('python', 'typescript', 'java', 'go')""")
def extract_routes(spark, sf):
    nodes = code_graph(spark, sf).nodes.filter(F.col("kind") == "api_endpoint")
    return nodes.select("project_id", "file", "id", F.col("attr.extra")["framework"].alias("framework"))


@query("integration_hints", f"""WITH {CORPUS}
SELECT project_id, 'file:' || path AS source, 'ext:' || e.label AS target, e.kind AS kind FROM (
  SELECT project_id, path, unnest(CASE lang
    WHEN 'python' THEN [{{label: 'requests (HTTP client)', kind: 'communicates_with'}}, {{label: 'api' || sub || '.internal.net', kind: 'communicates_with'}}]
    WHEN 'typescript' THEN [{{label: 'axios', kind: 'communicates_with'}}]
    WHEN 'java' THEN [{{label: 'Kafka', kind: 'communicates_with'}}]
    WHEN 'go' THEN [{{label: 'net/http', kind: 'communicates_with'}}] ELSE [] END) AS e FROM corpus)""")
def integration_hints(spark, sf):
    edges = code_graph(spark, sf).edges.filter(F.col("target").startswith("ext:"))
    return edges.select("project_id", "source", "target", "kind")


@query("containment", f"""WITH {TYPES},
m AS (
  SELECT DISTINCT project_id, 'module:' || module AS source, 'file:' || path AS target FROM corpus
  WHERE lang IN ('python', 'typescript', 'java', 'go', 'rust', 'cpp')
)
SELECT project_id, source, target FROM m
UNION ALL
SELECT project_id, 'file:' || path, 'type:' || lang || ':' || prefix || t.name FROM types""")
def containment(spark, sf):
    edges = code_graph(spark, sf).edges.filter(
        (F.col("kind") == "contains") & (F.col("target").startswith("file:") | F.col("target").startswith("type:")))
    return edges.select("project_id", "source", "target")


@query("extraction_warnings")
def extraction_warnings(spark, sf):
    """Every document behind an assignment, read as Python: which ones parse only a parser can tell."""
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("project_id"), F.lit("r1").alias("run_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.lit("docs").alias("module"),
        F.lit("python").alias("language"), F.concat(F.lit("value = 1 "), "text").alias("text"),
    )
    rows = python_source.python_facts(docs, PK)
    return facts.extraction_warnings(facts.graph_of(cut_lineage(rows), PK).warnings, PK)


# A script per customer: nested brackets, quoted commas and brackets, keys of tables, ALTER TABLE, a unique index over two columns.
NESTED = (
    "-- CREATE TABLE no{k} (a INT);\n"
    "CREATE TABLE IF NOT EXISTS shop.c{k} (\n"
    "  id BIGINT PRIMARY KEY, /* the key, */\n"
    "  \"full name\" VARCHAR( 40 ) NOT NULL DEFAULT 'a, b); -- {k}',\n"
    "  amount NUMERIC(10, 2) CHECK (amount > 0 AND (amount IS NOT NULL OR f(({n}),(2)) = 'UNIQUE')),\n"
    "  state TEXT DEFAULT 'it''s (open' UNIQUE,\n"
    "  nation_id INT REFERENCES nation{n}(id),\n"
    "  CONSTRAINT fk{k} FOREIGN KEY (agent_id) REFERENCES \"agent\" (\"no\") ON DELETE CASCADE,\n"
    "  CHECK ((id > {n}), 'x')\n"
    ") ENGINE=InnoDB;\n"
    "CREATE UNIQUE INDEX ux{k} ON shop.c{k} (lower(state), id);\n"
    "ALTER TABLE c{k} ADD CONSTRAINT fb{k} FOREIGN KEY (boss_id) REFERENCES c{n} (id);\n"
    "CREATE TABLE broken{k} (a INT, b TEXT\n"
)


@query("extract_ddl_nested", """SELECT 'p' || c_nationkey AS project_id, 'c' || c_custkey AS "table", x.what AS what, x.name AS name, x.detail AS detail, x.flag AS flag
FROM (SELECT *, unnest([
  {what: 'column', name: 'id', detail: 'BIGINT', flag: 'primary'}, {what: 'column', name: 'full name', detail: 'VARCHAR(40)', flag: 'required'},
  {what: 'column', name: 'amount', detail: 'NUMERIC(10,2)', flag: ''}, {what: 'column', name: 'state', detail: 'TEXT', flag: 'unique'},
  {what: 'column', name: 'nation_id', detail: 'INT', flag: ''}, {what: 'fk', name: 'nation_id', detail: 'nation' || c_nationkey, flag: 'id'},
  {what: 'fk', name: 'agent_id', detail: 'agent', flag: 'no'}, {what: 'fk', name: 'boss_id', detail: 'c' || c_nationkey, flag: 'id'},
  {what: 'index', name: 'lower(state)', detail: 'ux' || c_custkey, flag: 'unique'}, {what: 'index', name: 'id', detail: 'ux' || c_custkey, flag: 'unique'},
  {what: 'origin', name: 'c' || c_custkey, detail: 'migration', flag: '2'}]) AS x FROM customer)""")
def extract_ddl_nested(spark, sf):
    text = F.replace(F.replace(F.lit(NESTED), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{n}"), F.col("c_nationkey").cast("string"))
    # one key becomes a whole script: spread the keys before they grow
    customers = table(spark, sf, "customer").repartition(max(spark.sparkContext.defaultParallelism, 1), "c_custkey")
    scripts = customers.select(
        F.concat(F.lit("p"), "c_nationkey").alias("project_id"), F.lit("r1").alias("run_id"),
        F.concat(F.lit("db/migrations/"), "c_custkey", F.lit("_c.sql")).alias("path"), text.alias("text"))
    x = sql.extract_ddl(classify_files(scripts), PK)
    flag = F.when(F.col("primary_key"), "primary").when(F.col("unique"), "unique").when(~F.col("nullable"), "required").otherwise("")
    row = lambda what, name, detail, flag: ["project_id", "table", F.lit(what).alias("what"), name.alias("name"), detail.alias("detail"), flag.alias("flag")]
    made = x.nodes.filter("kind = 'table'").withColumn("table", F.col("name"))
    return g.union_all(
        x.columns.select(*row("column", F.col("name"), F.col("type"), flag)),
        x.fks.select(*row("fk", F.col("column"), F.col("references_table"), F.col("references_column"))),
        x.indexes.select(*row("index", F.col("column"), F.col("index"), F.when(F.col("unique"), "unique").otherwise(""))),
        made.select(*row("origin", F.col("name"), F.col("attr.extra")["origin"], F.col("line").cast("string"))),
    )


@query("extract_containers", f"""WITH {CORPUS}
SELECT project_id, n.id AS id, n.kind AS kind, n.technology AS technology FROM (
  SELECT project_id, unnest(CASE lang
    WHEN 'docker' THEN [{{id: 'container:' || module, kind: 'container', technology: NULL}}]
    WHEN 'compose' THEN [{{id: 'container:api' || id, kind: 'container', technology: noun || '/api'}},
                         {{id: 'container:db' || id, kind: 'database', technology: 'PostgreSQL'}}]
    WHEN 'k8s' THEN [{{id: 'k8s:Deployment:work' || id, kind: 'database', technology: 'Redis'}},
                     {{id: 'k8s:Service:front' || id, kind: 'component', technology: NULL}}] ELSE [] END) AS n FROM corpus)""")
def extract_containers(spark, sf):
    nodes = infra.extract_infra(corpus.files(spark, sf), PK).nodes
    kept = nodes.filter(F.col("id").startswith("container:") | F.col("id").startswith("k8s:"))
    return kept.select("project_id", "id", "kind", F.col("attr.technology").alias("technology"))


@query("container_links", f"""WITH {CORPUS}
SELECT project_id, 'container:api' || id AS source, 'container:db' || id AS target FROM corpus WHERE lang = 'compose'""")
def container_links(spark, sf):
    edges = infra.extract_infra(corpus.files(spark, sf), PK).edges
    return edges.filter(F.col("kind") == "communicates_with").select("project_id", "source", "target")


@query("classify_image", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'queue' WHEN 2 THEN 'component' ELSE 'container' END AS kind,
       CASE p_partkey % 4 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'Kafka' WHEN 2 THEN 'NGINX' ELSE lower(p_brand) || '/app:' || p_size END AS technology
FROM part""")
def classify_image(spark, sf):
    parts = table(spark, sf, "part")
    names = F.array(F.lit("postgres"), F.lit("bitnami/kafka"), F.lit("NGINX"), F.concat(F.lower("p_brand"), F.lit("/app")))
    image = F.concat(names[(F.col("p_partkey") % 4).cast("int")], F.lit(":"), F.col("p_size"))
    kind, label = infra.classify_image(image)
    return parts.select("p_partkey", kind.alias("kind"), label.alias("technology"))


@query("extract_dependencies", f"""WITH {CORPUS}
SELECT project_id, 'module:' || module AS source, 'ext:' || d.name AS target, d.version AS version FROM (
  SELECT project_id, module, unnest(CASE lang
    WHEN 'npm' THEN [{{name: 'react', version: '^18.0.0'}}, {{name: 'lib' || id, version: '1.0.' || sub}}, {{name: 'jest', version: '29.0.0'}}]
    WHEN 'pip' THEN [{{name: 'pandas', version: NULL}}, {{name: 'lib-' || id, version: NULL}}] ELSE [] END) AS d FROM corpus)""")
def extract_dependencies(spark, sf):
    edges = infra.extract_dependencies(corpus.files(spark, sf), PK)[1]
    return edges.select("project_id", "source", "target", F.try_element_at("attr", F.lit("version")).alias("version"))


# ---------------------------------------------------------------- links of web pages


@query("extract_links", """
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href,
       split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages""")
def extract_links(spark, sf):
    host = F.element_at(F.split(F.element_at(F.split("url", "//"), 2), "/"), 1)
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.explode(links).alias("href"), host.alias("host"))


@query("extract_urls", r"""
WITH found AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(url || ' ' || html, 'https?://[A-Za-z0-9._\-/:%?=&+~#]+')) AS url FROM pages),
hosts AS (SELECT DISTINCT doc_id, split_part(split_part(regexp_replace(url, '[),.;]+$', ''), '//', 2), '/', 1) AS host FROM found)
SELECT p.page_id AS doc_id, count(h.host) AS hosts FROM pages p LEFT JOIN hosts h ON h.doc_id = p.page_id AND h.host <> '' GROUP BY p.page_id""")
def extract_urls(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"))
    return pages.select("doc_id", F.size(python_source.urls_of(F.col("text"))).cast("bigint").alias("hosts"))


# ---------------------------------------------------------------- resolution


@query("resolve_imports", f"""WITH {IMPORTS}
SELECT i.project_id, i.path, i.target AS target_name, t.path AS resolved
FROM imports i LEFT JOIN corpus t ON t.project_id = i.project_id AND t.id = i.nxt AND t.lang = i.lang
  AND ((i.lang = 'python' AND contains(i.target, '.mod') AND t.id % 16 <> 8) OR (i.lang = 'typescript' AND contains(i.target, '/'))
       OR (i.lang = 'java' AND starts_with(i.target, 'com.')) OR i.lang = 'cpp')""")
def resolve_imports(spark, sf):
    x = code_graph(spark, sf)
    nodes = g.merge_nodes(x.nodes, keys=PK)
    refs = rs.with_ref_id(x.refs.filter(F.col("kind") == "imports"), PK)
    done = rs.resolve_imports(refs, nodes, g.index_symbols(nodes, PK), PK)
    files = nodes.select(*PK, F.col("id").alias("target"), F.col("file").alias("resolved"))
    return done.join(files, [*PK, "target"], "left").select(
        "project_id", F.regexp_replace("source_id", "^file:", "").alias("path"), "target_name", "resolved")


@query("externalize", f"""WITH {IMPORTS}
SELECT DISTINCT i.project_id, 'file:' || i.path AS source, 'ext:' || split_part(split_part(i.target, '.', 1), '/', 1) AS target
FROM imports i LEFT JOIN corpus t ON t.project_id = i.project_id AND t.id = i.nxt AND t.lang = i.lang
  AND ((i.lang = 'python' AND contains(i.target, '.mod') AND t.id % 16 <> 8) OR (i.lang = 'typescript' AND contains(i.target, '/'))
       OR (i.lang = 'java' AND starts_with(i.target, 'com.')) OR i.lang = 'cpp')
WHERE t.path IS NULL""")
def externalize(spark, sf):
    x = code_graph(spark, sf)
    nodes = g.merge_nodes(x.nodes, keys=PK)
    refs = rs.with_ref_id(x.refs.filter(F.col("kind") == "imports"), PK)
    done = rs.resolve_imports(refs, nodes, g.index_symbols(nodes, PK), PK)
    return rs.externalize(done.filter("target is null"), PK)[1].select("project_id", "source", "target")


@query("longest_prefix_match", """
WITH names AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[/?#].*$', '') AS unused,
                      page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS name FROM pages),
prefixes AS (SELECT page_id, array_to_string(string_split(replace(name, '/', '.'), '.')[1:n], '.') AS prefix, n
             FROM (SELECT *, unnest(range(1, len(string_split(replace(name, '/', '.'), '.')) + 1)) AS n FROM names)),
known AS (SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages WHERE page_id % 2 = 0)
SELECT page_id, first(prefix ORDER BY n DESC) AS host FROM prefixes JOIN known ON host = prefix GROUP BY page_id""")
def longest_prefix_match(spark, sf):
    pages = table(spark, sf, "pages")
    name = F.translate(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/", ".")
    tried = pages.select("page_id", F.explode(rs.dotted_prefixes(name)).alias("host"))
    host = F.element_at(F.split(F.element_at(F.split("url", "//"), 2), "/"), 1)
    known = pages.filter("page_id % 2 = 0").select(host.alias("host")).distinct()
    return tried.join(known, "host").groupBy("page_id").agg(F.max_by("host", F.char_length("host")).alias("host"))


# Parts as symbols: the brand is the file, the type the module, size decides kind and language.
def part_symbols(spark, sf):
    parts = table(spark, sf, "part").withColumn("project_id", F.lit("p"))
    nodes = g.node_frame(
        parts, K, id=F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")), name=F.col("p_name"), qualified_name=F.col("p_name"),
        kind=F.element_at(F.array(*[F.lit(x) for x in ("class", "interface", "function", "enum")]), (F.col("p_size") % 4 + 1).cast("int")),
        file=F.col("p_brand"), module=F.col("p_type"), language=F.concat(F.lit("l"), F.col("p_size") % 3),
    )
    names = parts.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"))
    refs = parts.join(names, F.col("k") == F.col("p_partkey") + 1).select(
        "project_id", F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("source_id"), F.col("n").alias("target_name"),
        F.element_at(F.array(*[F.lit(x) for x in ("inherits", "calls", "uses")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"),
        F.lit("").alias("language"), F.lit("").alias("hint_module"), F.create_map().cast("map<string,string>").alias("attr"),
    )
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey"), F.col("l_suppkey")).distinct().withColumn("project_id", F.lit("p"))
    edges = g.edge_frame(sold, K, source=F.concat(F.lit("s"), F.col("l_suppkey")),
                         target=F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")), kind=F.lit("uses"))
    return nodes, edges, refs


RANKED = """
syms AS (
  SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_partkey, p_name AS name, p_brand AS file, p_type AS module, 'l' || (p_size % 3) AS language,
         ['class', 'interface', 'function', 'enum'][p_size % 4 + 1] AS kind FROM part
),
deg AS (SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS id, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY ALL),
refs AS (SELECT a.*, b.name AS target_name, ['inherits', 'calls', 'uses'][a.p_partkey % 3 + 1] AS ref_kind
         FROM syms a JOIN syms b ON b.p_partkey = a.p_partkey + 1),
cands AS (
  SELECT r.id AS source_id, r.ref_kind, r.module AS s_module, r.language AS s_language, c.id AS target, c.kind AS t_kind,
         c.module AS t_module, c.language AS t_language, coalesce(degree, 0) AS degree,
         CASE WHEN r.ref_kind = 'inherits' THEN c.kind IN ('class', 'interface') WHEN r.ref_kind = 'calls' THEN c.kind = 'function' ELSE FALSE END AS fits,
         c.file = r.file AS same_file, c.module = r.module AS same_module, c.language = r.language AS same_language,
         count(*) OVER (PARTITION BY r.id) AS n
  FROM refs r JOIN syms c ON lower(c.name) = lower(r.target_name) AND c.id <> r.id LEFT JOIN deg ON deg.id = c.id
),
best AS (
  SELECT * FROM cands
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fits DESC, same_file DESC, same_module DESC, same_language DESC, degree, target) = 1
)"""


@query("ranked_match", f"""WITH {RANKED}
SELECT source_id, target, CASE WHEN ref_kind = 'inherits' AND t_kind = 'interface' THEN 'implements'
  WHEN ref_kind = 'calls' AND t_kind = 'class' THEN 'uses' ELSE ref_kind END AS edge_kind
FROM best WHERE NOT (t_module <> s_module AND t_language <> s_language AND n > 3)""")
def ranked_match(spark, sf):
    nodes, edges, refs = part_symbols(spark, sf)
    done = rs.resolve_symbols(rs.with_ref_id(refs, K), g.index_symbols(nodes, K), nodes, edges, K)
    return done.filter("target is not null").select("source_id", "target", "edge_kind")


@query("module_depends_on", f"""WITH {RANKED}
SELECT 'module:' || s_module AS source, 'module:' || t_module AS target, CAST(count(*) AS DOUBLE) AS weight
FROM best WHERE NOT (t_module <> s_module AND t_language <> s_language AND n > 3) AND s_module <> t_module GROUP BY ALL""")
def module_depends_on(spark, sf):
    nodes, edges, refs = part_symbols(spark, sf)
    done = rs.resolve_symbols(rs.with_ref_id(refs, K), g.index_symbols(nodes, K), nodes, edges, K)
    return rs.module_depends_on(done, nodes, K).select("source", "target", "weight")


@query("resolution_stats", f"""WITH {RANKED}
SELECT 'p' AS project_id, (SELECT count(*) FROM refs) AS pending,
  (SELECT count(DISTINCT target_name) FROM refs WHERE id NOT IN (
     SELECT source_id FROM best WHERE NOT (t_module <> s_module AND t_language <> s_language AND n > 3))) AS unresolved_unique""")
def resolution_stats(spark, sf):
    nodes, edges, refs = part_symbols(spark, sf)
    done = rs.resolve_symbols(rs.with_ref_id(refs, K), g.index_symbols(nodes, K), nodes, edges, K)
    return rs.resolution_stats(refs, done.filter("target is null"), K)


@query("resolve_tables", f"""WITH {CORPUS}
SELECT a.project_id, 'table:t' || a.id AS source, 't' || a.peer AS target_name, CASE WHEN b.id IS NOT NULL THEN 'table:t' || b.id END AS target
FROM corpus a LEFT JOIN corpus b ON b.project_id = a.project_id AND b.id = a.peer AND b.lang = 'sql' WHERE a.lang = 'sql'""")
def resolve_tables(spark, sf):
    x = sql.extract_ddl(corpus.files(spark, sf), PK)
    symbols = g.index_symbols(x.nodes, PK)
    done = rs.resolve_tables(x.refs, x.nodes, symbols, PK)
    return done.select("project_id", F.col("source_id").alias("source"), "target_name", "target")


@query("resolve_infra", f"""WITH {CORPUS}
SELECT project_id, 'k8s:Service:front' || id AS source, 'k8s:Deployment:work' || id AS target FROM corpus WHERE lang = 'k8s'""")
def resolve_infra(spark, sf):
    x = infra.extract_infra(corpus.files(spark, sf), PK)
    return rs.resolve_infra(x.refs, x.nodes, PK).select("project_id", F.col("source_id").alias("source"), "target")


@query("anti_unresolved", """
WITH hrefs AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"/]+)', 1)) AS target_name FROM pages),
known AS (SELECT DISTINCT split_part(url, '/', 4) AS name FROM pages)
SELECT target_name FROM hrefs ANTI JOIN known ON name = target_name""")
def anti_unresolved(spark, sf):
    pages = table(spark, sf, "pages")
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)'), F.lit(1))).alias("target_name")).distinct()
    known = pages.select(F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(4)), F.lit("")).alias("target_name")).distinct()
    return hrefs.join(known, "target_name", "left_anti")


# ---------------------------------------------------------------- enrichment on extracted nodes


def layered(spark, sf):
    x = code_graph(spark, sf)
    nodes, edges = g.merge_nodes(x.nodes, keys=PK), g.merge_edges(x.edges, keys=PK)
    return g.assign_layers(nodes, edges, PK), edges


LAYER_OF_DIR = "CASE dir WHEN 'api' THEN 'api' WHEN 'core' THEN 'domain' WHEN 'data' THEN 'data' WHEN 'web' THEN 'presentation' ELSE 'unassigned' END"
CODE = "lang IN ('python', 'typescript', 'java', 'go', 'rust', 'cpp')"


@query("assign_layers", f"""WITH {CORPUS}
SELECT project_id, 'file:' || path AS id, CASE WHEN lang = 'python' AND id % 16 = 8 THEN 'unassigned' ELSE {LAYER_OF_DIR} END AS layer
FROM corpus WHERE {CODE}""")
def assign_layers(spark, sf):
    nodes, _ = layered(spark, sf)
    return nodes.filter(F.col("kind") == "file").select("project_id", "id", F.col("attr.layer").alias("layer"))


@query("build_components", f"""WITH {CORPUS},
mods AS (
  SELECT project_id, svc, module, CASE split_part(module, '/', 2) WHEN 'api' THEN 'api' WHEN 'core' THEN 'domain' WHEN 'data' THEN 'data'
         WHEN 'web' THEN 'presentation' ELSE 'unassigned' END AS path_layer, count(*) AS files,
         count(*) FILTER (lang = 'python') AS py
  FROM corpus WHERE {CODE} GROUP BY ALL
)
SELECT project_id, 'component:' || svc AS id, CAST(count(*) AS VARCHAR) AS module_count, CAST(sum(files) AS VARCHAR) AS file_count
FROM mods GROUP BY project_id, svc""")
def build_components(spark, sf):
    nodes, edges = layered(spark, sf)
    components, _ = g.build_components(nodes, edges, PK)
    return components.select("project_id", "id", F.col("attr.extra")["module_count"].alias("module_count"),
                             F.col("attr.extra")["file_count"].alias("file_count"))


@query("state_machines", f"""WITH {CORPUS}
SELECT project_id, 'type:python:' || {DOTTED} || 'Status' || id AS id FROM corpus WHERE lang = 'python'
UNION ALL
SELECT project_id, 'type:rust:' || module || '.Mode' || id FROM corpus WHERE lang = 'rust'""")
def state_machines(spark, sf):
    nodes = g.mark_state_machines(code_graph(spark, sf).nodes)
    return nodes.filter("attr.is_state_machine").select("project_id", "id")


@query("derive_actor", f"""WITH {CORPUS}
SELECT project_id, 'actor:user' AS source, CASE lang
    WHEN 'python' THEN 'api:GET:/items/' || id WHEN 'typescript' THEN 'api:GET:/panels/' || id
    WHEN 'java' THEN 'api:GET:/gadgets/' || id ELSE 'api:ANY:/nodes/' || id END AS target
FROM corpus WHERE lang IN ('python', 'typescript', 'java', 'go')""")
def derive_actor(spark, sf):
    nodes, _ = layered(spark, sf)
    return g.derive_actor(nodes, PK)[1].filter(F.col("kind") == "calls").select("project_id", "source", "target")
