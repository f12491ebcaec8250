"""One fact row per code file, and the graph tables that follow from it.

Every language family produces the same nested row without the text.  Write that
row once; nodes, edges and references are explodes of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.operators.graph import attr_struct, edge_frame, merge_nodes, node_frame, ref_frame, union_all
from archspark.schema import KEYS, METHOD, PARAM, PROPERTY

FACTS = {
    "namespace": "string",
    "error": "string",
    "imports": "array<struct<target:string,relative:boolean>>",
    "hints": "array<struct<kind:string,label:string>>",
    "urls": "array<string>",
    "types": (
        "array<struct<name:string,kind:string,qualified:string,line:int,stereotype:string,docstring:string,"
        f"bases:array<struct<name:string,kind:string>>,composes:array<string>,calls:array<string>,"
        f"methods:array<{METHOD}>,properties:array<{PROPERTY}>,members:array<string>,table:string,is_orm:boolean>>"
    ),
    "functions": (
        f"array<struct<name:string,qualified:string,owner:string,line:int,params:array<{PARAM}>,returns:string,"
        "visibility:string,is_async:boolean,docstring:string,complexity:int,"
        "calls:array<struct<name:string,expression:string,line:int>>>>"
    ),
    "late_methods": f"array<struct<owner:string,method:{METHOD}>>",
    "late_bases": "array<struct<owner:string,base:string>>",
    "late_calls": "array<struct<owner:string,callee:string>>",
    "routes": "array<struct<verb:string,path:string,name:string,qualified:string,framework:string,handler:string,exposes:string,line:int>>",
    "orm": (
        "array<struct<owner:string,table:string,columns:array<struct<name:string,type:string,primary_key:boolean,"
        "nullable:boolean>>,fks:array<struct<column:string,references:string>>,relations:array<string>>>"
    ),
}


def fact_rows(df: DataFrame, keys: Sequence[str], **given: Column) -> DataFrame:
    """Project onto the fact row; lists that are not given are empty."""
    out = []
    for name, kind in FACTS.items():
        value = given.get(name)
        if value is None:
            value = F.expr(f"cast(array() as {kind})") if kind.startswith("array") else F.lit("")
        out.append(value.cast(kind).alias(name))
    return df.select(*keys, "path", "module", "language", "size", "loc", *out)


def prepare(files: DataFrame, languages: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Files of the languages with size and number of lines."""
    text = F.col("text")
    return files.filter(F.col("language").isin(*languages)).select(
        *keys, "path", "module", "language", "text",
        F.octet_length(text).cast("long").alias("size"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("loc"),
    )


def qualify(name: Column, module: Column = None) -> Column:
    module = F.col("module") if module is None else module
    return F.when(module != "(root)", F.concat(module, F.lit("."), name)).otherwise(name)


@dataclass
class Extraction:
    """Tables one extractor yields; ``None`` where it has nothing to say."""

    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame
    columns: DataFrame | None = None
    fks: DataFrame | None = None
    indexes: DataFrame | None = None
    warnings: DataFrame | None = None
    extra: dict = field(default_factory=dict)




def _file_id() -> Column:
    return F.concat(F.lit("file:"), F.col("path"))


def _type_id(qualified: Column) -> Column:
    return F.concat(F.lit("type:"), F.col("language"), F.lit(":"), qualified)


def _func_id(qualified: Column) -> Column:
    return F.concat(F.lit("func:"), F.col("language"), F.lit(":"), qualified)


def file_nodes(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """File and module nodes, and module-contains-file edges (part of the containment tree)."""
    files = node_frame(
        df, keys, attr=attr_struct(loc=F.col("loc"), extra=F.create_map(F.lit("size"), F.col("size").cast("string"))),
        id=_file_id(), kind=F.lit("file"), name=F.element_at(F.split("path", "/"), -1), qualified_name=F.col("path"),
        file=F.col("path"), module=F.col("module"), language=F.col("language"),
    )
    modules = df.groupBy(*keys, "module").agg(F.min_by("language", "path").alias("language"))
    modules = node_frame(
        modules, keys, id=F.concat(F.lit("module:"), F.col("module")), kind=F.lit("module"),
        name=F.element_at(F.split("module", "/"), -1), qualified_name=F.col("module"), module=F.col("module"),
        language=F.col("language"),
    )
    contains = edge_frame(
        df, keys, source=F.concat(F.lit("module:"), F.col("module")), target=_file_id(), kind=F.lit("contains")
    )
    return files.unionByName(modules), contains


def graph_of(facts: DataFrame, keys: Sequence[str] = KEYS) -> Extraction:
    """Nodes, edges and references of fact rows."""
    good = facts.filter(F.coalesce("error", F.lit("")) == "")
    base = [*keys, "path", "module", "language"]
    nodes, contains = file_nodes(good, keys)

    types = good.select(*base, F.explode("types").alias("t")).select(*base, "t.*")
    late = good.select(*base, F.explode("late_methods").alias("m"))
    late = late.select(*keys, F.concat(F.lit("type:"), F.col("language"), F.lit(":"), F.col("m.owner")).alias("id"),
                       F.col("path").alias("p"), F.col("m.method").alias("m"))
    late = late.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("late"))
    typed = types.withColumn("id", _type_id(F.col("qualified"))).join(late, [*keys, "id"], "left")
    all_methods = F.concat(
        F.coalesce("methods", F.expr(f"cast(array() as array<{METHOD}>)")),
        F.coalesce(F.transform("late", lambda x: x["m"]), F.expr(f"cast(array() as array<{METHOD}>)")),
    )
    type_nodes = node_frame(
        typed, keys,
        attr=attr_struct(
            stereotype=F.col("stereotype"), docstring=F.col("docstring"), methods=all_methods,
            properties=F.col("properties"), members=F.col("members"), table=F.col("table"),
        ),
        id=F.col("id"), kind=F.col("kind"), name=F.col("name"), qualified_name=F.col("qualified"),
        file=F.col("path"), module=F.col("module"), language=F.col("language"), line=F.col("line"),
    )
    type_edges = edge_frame(types, keys, source=_file_id(), target=_type_id(F.col("qualified")), kind=F.lit("contains"))

    funcs = good.select(*base, F.explode("functions").alias("f")).select(*base, "f.*")
    known = type_nodes.select(*keys, F.col("id").alias("owner_id"), F.lit(True).alias("owned")).distinct()
    funcs = funcs.withColumn("owner_id", F.when(F.col("owner") != "", _type_id(F.col("owner")))).join(
        known, [*keys, "owner_id"], "left"
    )
    func_nodes = node_frame(
        funcs, keys,
        attr=attr_struct(
            visibility=F.col("visibility"), docstring=F.col("docstring"), complexity=F.col("complexity"),
            params=F.col("params"),
            extra=F.create_map(F.lit("returns"), F.coalesce("returns", F.lit("")),
                               F.lit("is_async"), F.coalesce(F.col("is_async").cast("string"), F.lit("false"))),
        ),
        id=_func_id(F.col("qualified")), kind=F.when(F.col("owned"), "method").otherwise("function"), name=F.col("name"),
        qualified_name=F.col("qualified"), file=F.col("path"), module=F.col("module"), language=F.col("language"),
        line=F.col("line"),
    )
    func_edges = edge_frame(
        funcs, keys, source=F.when(F.col("owned"), F.col("owner_id")).otherwise(_file_id()),
        target=_func_id(F.col("qualified")), kind=F.lit("contains"),
    )

    route_id = F.concat(F.lit("api:"), F.col("verb"), F.lit(":"), F.col("path_"))
    routes = good.select(*base, F.explode("routes").alias("r")).select(*base, F.col("r.path").alias("path_"), *[
        F.col(f"r.{c}").alias(c) for c in ("verb", "name", "qualified", "framework", "handler", "exposes", "line")
    ])
    route_nodes = node_frame(
        routes, keys,
        attr=attr_struct(extra=F.create_map(F.lit("framework"), F.col("framework"), F.lit("handler"), F.coalesce("handler", F.lit("")))),
        id=route_id, kind=F.lit("api_endpoint"), name=F.col("name"), qualified_name=F.col("qualified"), file=F.col("path"),
        module=F.col("module"), language=F.col("language"), line=F.col("line"),
    )
    route_edges = edge_frame(routes, keys, source=_file_id(), target=route_id, kind=F.lit("contains")).unionByName(
        edge_frame(routes.filter(F.col("exposes") != ""), keys, source=route_id, target=F.col("exposes"), kind=F.lit("exposes"))
    )

    hinted = good.select(*base, F.explode("hints").alias("h")).select(*base, "h.*")
    urls = good.select(*base, F.explode("urls").alias("url"))
    host = F.element_at(F.split(F.element_at(F.split("url", "//"), 2), "/"), 1)
    outside = hinted.select(*base, "kind", "label", F.col("label").alias("tech"), F.lit("").alias("url")).unionByName(
        urls.select(*base, F.lit("external_api").alias("kind"), host.alias("label"), F.lit("").alias("tech"), "url")
    )
    systems = outside.select(
        *keys, "kind", "label", F.when(F.col("url") != "", "http").otherwise(F.col("language")).alias("language")
    ).distinct()
    ext_nodes = node_frame(
        systems, keys, id=F.concat(F.lit("ext:"), F.col("label")), kind=F.col("kind"), name=F.col("label"),
        qualified_name=F.col("label"), language=F.col("language"), external=F.lit(True),
    )
    ext_edges = edge_frame(
        outside, keys,
        attr=F.when(F.col("url") != "", F.create_map(F.lit("url"), F.col("url"))).otherwise(
            F.create_map(F.lit("technology"), F.col("tech"))),
        source=_file_id(), target=F.concat(F.lit("ext:"), F.col("label")),
        kind=F.when(F.col("kind") == "database", "uses").otherwise("communicates_with"),
    )

    imports = good.select(*base, F.explode("imports").alias("i")).select(*base, "i.*")
    file_of = lambda df, **kw: ref_frame(df, keys, source_id=_file_id(), language=F.col("language"), **kw)
    of_type = lambda df, name, kind, own: ref_frame(
        df, keys, source_id=_type_id(own), target_name=name, kind=kind, language=F.col("language"), hint_module=F.col("module"))
    bases = types.select(*base, "qualified", F.explode("bases").alias("b"))
    parts = types.select(*base, "qualified", F.explode("composes").alias("c"))
    type_calls = types.select(*base, "qualified", F.explode("calls").alias("c"))
    late_bases = good.select(*base, F.explode("late_bases").alias("b"))
    late_calls = good.select(*base, F.explode("late_calls").alias("c"))
    func_calls = funcs.select(*base, "qualified", F.explode("calls").alias("c"))
    refs = union_all(
        file_of(imports, target_name=F.col("target"), kind=F.lit("imports"),
                attr=F.when(F.col("relative"), F.create_map(F.lit("relative"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))),
        of_type(bases, F.col("b.name"), F.col("b.kind"), F.col("qualified")),
        of_type(parts, F.col("c"), F.lit("composes"), F.col("qualified")),
        of_type(type_calls, F.col("c"), F.lit("calls"), F.col("qualified")),
        of_type(late_bases, F.col("b.base"), F.lit("implements"), F.col("b.owner")),
        of_type(late_calls, F.col("c.callee"), F.lit("calls"), F.col("c.owner")),
        ref_frame(
            func_calls, keys, attr=F.create_map(F.lit("expression"), F.col("c.expression"), F.lit("line"), F.col("c.line").cast("string")),
            source_id=_func_id(F.col("qualified")), target_name=F.col("c.name"), kind=F.lit("calls"),
            language=F.col("language"), hint_module=F.col("module"),
        ),
    )

    orm = good.select(*base, F.explode("orm").alias("o")).select(*base, "o.*")
    table_id = F.concat(F.lit("table:"), F.col("table"))
    table_nodes = node_frame(
        orm, keys, attr=attr_struct(extra=F.create_map(F.lit("origin"), F.lit("orm"))), id=table_id, kind=F.lit("table"),
        name=F.col("table"), qualified_name=F.col("table"), file=F.col("path"), module=F.col("module"), language=F.lit("sql"),
    )
    table_edges = edge_frame(
        orm, keys, attr=F.create_map(F.lit("mapping"), F.lit("orm")), source=_type_id(F.col("owner")), target=table_id, kind=F.lit("writes")
    )
    columns = orm.select(*keys, "table", F.posexplode("columns").alias("pos", "c")).select(
        *keys, "table", "pos", "c.*", F.lit(False).alias("unique")
    )
    fk = orm.select(*keys, "table", F.explode("fks").alias("k"))
    fks = fk.select(
        *keys, "table", F.col("k.column").alias("column"), F.lit("").alias("references_table"), F.lit("").alias("references_column")
    )
    refs = union_all(
        refs,
        ref_frame(fk, keys, attr=F.create_map(F.lit("column"), F.col("k.column")), source_id=table_id,
                  target_name=F.element_at(F.split("k.references", r"\."), 1), kind=F.lit("references"), language=F.lit("sql")),
        of_type(orm.select(*base, "owner", F.explode("relations").alias("r")), F.col("r"), F.lit("associates"), F.col("owner")),
    )
    warnings = facts.filter(F.coalesce("error", F.lit("")) != "").select(*keys, "path", F.col("error").alias("warning"))
    return Extraction(
        nodes=union_all(nodes, type_nodes, func_nodes, route_nodes, ext_nodes, table_nodes),
        edges=union_all(contains, type_edges, func_edges, route_edges, ext_edges, table_edges),
        refs=refs, columns=columns, fks=fks, warnings=warnings,
    )


FactFn = Callable[[DataFrame, Sequence[str]], DataFrame]
FAMILIES: dict[str, FactFn] = {}


def register_extractor(name: str, fn: FactFn) -> FactFn:
    """Add a language family: a function from files to fact rows."""
    FAMILIES[name] = fn
    return fn


def all_facts(files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fact rows of every registered family: one scan per family, no shuffle."""
    from archspark.operators.extract import brace, python_source  # noqa: F401  (registers the families)

    return union_all(*[fn(files, keys) for fn in FAMILIES.values()])


def extract_all(
    files: DataFrame, keys: Sequence[str] = KEYS, stage: Callable[[DataFrame, str], DataFrame] | None = None
) -> Extraction:
    """Everything the files say.  ``stage`` writes a table and reads it back: one per family, so that no plan holds them all."""
    from archspark.operators.extract import infra, sql

    from archspark.operators.extract import brace, python_source  # noqa: F401  (registers the families)

    facts = all_facts(files, keys) if stage is None else union_all(*[stage(fn(files, keys), f"facts_{name}") for name, fn in FAMILIES.items()])
    code = graph_of(facts, keys)
    ddl, ops = sql.extract_ddl(files, keys), infra.extract_infra(files, keys)
    # analyzers run in this order on a file: python, java, web, c, go, infrastructure, sql
    nodes = merge_nodes(code.nodes, ops.nodes, ddl.nodes, keys=keys)
    return Extraction(
        nodes=nodes, edges=union_all(code.edges, ops.edges, ddl.edges), refs=union_all(code.refs, ops.refs, ddl.refs),
        columns=code.columns.unionByName(ddl.columns), fks=code.fks.unionByName(ddl.fks), indexes=ddl.indexes,
        warnings=code.warnings.unionByName(ops.warnings),
    )


def extraction_warnings(warnings: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None) -> DataFrame:
    """Failed files; with a ``limit``, the first so many per run."""
    from archspark.functions.frames import top_k

    return warnings if limit is None else top_k(warnings, keys, [F.col("path"), F.col("warning")], limit)
