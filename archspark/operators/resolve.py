"""Resolve deferred references into edges: equi joins on exploded candidate keys, best one by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.frames import top_k
from archspark.operators.graph import degree, edge_frame, index_symbols, node_frame, union_all
from archspark.schema import KEYS
from archspark.session import cut_lineage

# Endings tried on a relative import, in order.
PATH_ENDINGS = (
    "", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.js", "/index.tsx", "/__init__.py",
)


def with_ref_id(refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct references with a stable id: the hash of what identifies them.

    A row number would change when a lost task is run again; a hash does not.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
             (*keys, "source_id", "target_name", "kind", "language", "hint_module")]
    ref_id = F.sha2(F.concat_ws("\x1f", *parts, F.to_json("attr")), 256)
    return refs.withColumn("ref_id", ref_id)


def _file_index(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.filter((F.col("kind") == "file") & (F.col("qualified_name") != "")).select(
        *keys, F.col("qualified_name").alias("path"), F.col("id").alias("target"), "language"
    )


def resolve_relative_imports(refs: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(ref, target) for paths: the first ending that names a file."""
    relative = (F.try_element_at("attr", F.lit("relative")) == "true") | F.contains("target_name", F.lit("/"))
    endings = F.array(*[F.lit(e) for e in PATH_ENDINGS])
    tried = refs.filter(F.coalesce(relative, F.lit(False))).select(
        *keys, "ref_id", F.posexplode(F.transform(endings, lambda e: F.concat("target_name", e))).alias("pos", "path")
    )
    hit = tried.join(_file_index(nodes, keys).drop("language"), [*keys, "path"])
    return hit.groupBy(*keys, "ref_id").agg(F.min_by("target", "pos").alias("target"))


def python_module_index(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dotted names of Python files: full, package name for ``__init__``, and without the first folder
    where no full name claims it."""
    files = _file_index(nodes, keys).filter(F.col("language") == "python")
    dotted = files.withColumn("name", F.translate(F.regexp_replace("path", r"\.py$", ""), "/", "."))
    package = dotted.filter(F.col("name").endswith(".__init__")).withColumn(
        "name", F.regexp_replace("name", r"\.__init__$", "")
    )
    alias = dotted.filter(F.instr("name", ".") > 0).withColumn("name", F.regexp_replace("name", r"^[^.]*\.", ""))
    ranked = union_all(
        dotted.withColumn("rank", F.lit(0)), package.withColumn("rank", F.lit(0)), alias.withColumn("rank", F.lit(1))
    )
    return ranked.groupBy(*keys, "name").agg(F.min_by("target", F.struct("rank", "path")).alias("target"))


def dotted_prefixes(name: Column) -> Column:
    """All prefixes of a dotted name that end at a dot or at its end."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def resolve_python_imports(refs: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(ref, target) by the longest dotted prefix that names a module."""
    tried = refs.filter(F.col("language") == "python").select(
        *keys, "ref_id", F.explode(dotted_prefixes(F.col("target_name"))).alias("name")
    )
    hit = tried.join(python_module_index(nodes, keys), [*keys, "name"])
    return hit.groupBy(*keys, "ref_id").agg(F.max_by("target", F.char_length("name")).alias("target"))


def resolve_unique_type_imports(refs: DataFrame, symbols: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(ref, target) for Java and C#: the last segment, when exactly one symbol bears it."""
    single = symbols.groupBy(*keys, "name_lc").agg(
        F.min("node_id").alias("target"), F.max("node_id").alias("other")
    ).filter(F.col("target") == F.col("other")).drop("other")
    named = refs.filter(F.col("language").isin("java", "csharp")).select(
        *keys, "ref_id", F.lower(F.element_at(F.split("target_name", r"\."), -1)).alias("name_lc")
    )
    return named.join(single, [*keys, "name_lc"]).select(*keys, "ref_id", "target")


def resolve_includes(refs: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(ref, target) for C and C++: the first file of that base name."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    files = _file_index(nodes, keys).groupBy(*keys, base(F.col("path")).alias("base")).agg(
        F.min_by("target", "path").alias("target")
    )
    named = refs.filter(F.col("language").isin("c", "cpp")).select(*keys, "ref_id", base(F.col("target_name")).alias("base"))
    return named.join(files, [*keys, "base"]).select(*keys, "ref_id", "target")


def resolve_imports(refs: DataFrame, nodes: DataFrame, symbols: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Import references with ``target``, null where nothing in the project matches."""
    ways = (
        resolve_relative_imports(refs, nodes, keys), resolve_python_imports(refs, nodes, keys),
        resolve_unique_type_imports(refs, symbols, keys), resolve_includes(refs, nodes, keys),
    )
    tagged = union_all(*[w.withColumn("way", F.lit(i)) for i, w in enumerate(ways)])
    best = tagged.groupBy(*keys, "ref_id").agg(F.min_by("target", "way").alias("target"))
    return refs.join(best, [*keys, "ref_id"], "left")


def externalize(unresolved: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """External package nodes and depends_on edges for imports nothing matched, and the names left over."""
    root = F.element_at(F.split(F.element_at(F.split("target_name", r"\."), 1), "/"), 1)
    rows = unresolved.withColumn("root", root)
    named = rows.filter(F.coalesce("root", F.lit("")) != "")
    packages = named.groupBy(*keys, "root").agg(F.min("language").alias("language"))
    nodes = node_frame(
        packages, keys, id=F.concat(F.lit("ext:"), F.col("root")), kind=F.lit("external_package"), name=F.col("root"),
        qualified_name=F.col("root"), language=F.col("language"), external=F.lit(True),
    )
    edges = edge_frame(
        named, keys, source=F.col("source_id"), target=F.concat(F.lit("ext:"), F.col("root")), kind=F.lit("depends_on")
    )
    left = rows.filter(F.coalesce("root", F.lit("")) == "").select(*keys, "target_name")
    return nodes, edges, left


def resolve_tables(refs: DataFrame, nodes: DataFrame, symbols: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Table references with ``target``: by table name, else through a class mapped to a table."""
    tables = nodes.filter(F.col("kind") == "table").groupBy(*keys, F.lower("name").alias("name_lc")).agg(F.min("id").alias("by_name"))
    mapped = nodes.filter(F.coalesce("attr.table", F.lit("")) != "").select(
        *keys, F.col("id").alias("node_id"), F.lower("attr.table").alias("mapped_lc")
    )
    classes = (
        symbols.join(mapped, [*keys, "node_id"])
        .groupBy(*keys, "name_lc").agg(F.min_by("mapped_lc", "node_id").alias("mapped_lc"))
        .join(tables.select(*keys, F.col("name_lc").alias("mapped_lc"), F.col("by_name").alias("by_class")), [*keys, "mapped_lc"])
        .drop("mapped_lc")
    )
    named = refs.withColumn("name_lc", F.lower("target_name"))
    joined = named.join(tables, [*keys, "name_lc"], "left").join(classes, [*keys, "name_lc"], "left")
    return joined.withColumn("target", F.coalesce("by_name", "by_class")).drop("name_lc", "by_name", "by_class")


def resolve_infra(refs: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Infrastructure references with ``target`` by lower-case name."""
    kinds = ("container", "component", "database", "queue")
    named = nodes.filter(F.col("kind").isin(*kinds)).groupBy(*keys, F.lower("name").alias("name_lc")).agg(F.min("id").alias("target"))
    return refs.withColumn("name_lc", F.lower("target_name")).join(named, [*keys, "name_lc"], "left").drop("name_lc")


# Which of (file, module, language) must agree, best combination first.
_LEVELS = tuple((f, m, l) for f in (True, False) for m in (True, False) for l in (True, False))
_TYPE_KINDS = ("class", "interface", "abstract_class", "struct")
_CALL_KINDS = ("function", "method")


def _level_keys(file: Column, module: Column, language: Column, pools: Column, name: Column) -> Column:
    """Lookup keys of one row: one per pool and level, the level number in front."""
    blank = F.lit("")
    levels = [
        F.struct(
            F.lit(i).alias("level"),
            (file if f else blank).alias("k_file"), (module if m else blank).alias("k_module"),
            (language if l else blank).alias("k_language"),
        )
        for i, (f, m, l) in enumerate(_LEVELS)
    ]
    return F.flatten(F.transform(
        pools, lambda p: F.transform(
            F.array(*levels),
            lambda x: F.struct(
                p.alias("pool"), x["level"].alias("level"), name.alias("name_lc"), x["k_file"].alias("k_file"),
                x["k_module"].alias("k_module"), x["k_language"].alias("k_language"),
            ),
        ),
    ))


#: Copies of a name's answer, among which the lookups of that name are dealt.
SALTS = 16


def _found(asks: DataFrame, best: DataFrame, keys: list[str], ask: list[str]) -> DataFrame:
    """The lookups with their ``best`` at the first level that has symbols.

    Levels that name a file or module are tried first; what finds nothing goes on to those that name neither. There a name
    may be asked by a third of all files, so each (name, language) is looked up once, and its answer goes back in
    ``SALTS`` copies.
    """
    slot = [*keys, "pool", "level", "name_lc", "k_file", "k_module", "k_language"]
    near = [i for i, (f, m, _) in enumerate(_LEVELS) if f or m]
    rest, found = cut_lineage(asks), None
    for pool in ("own", "any"):
        pools = F.array(F.col("want") if pool == "own" else F.lit("any"))
        for wide in (False, True):
            tried = rest.filter("want <> 'any'") if pool == "own" else rest
            rows = tried.select(*ask, F.inline(F.filter(
                _level_keys(F.col("a_file"), F.col("a_module"), F.col("a_language"), pools, F.col("name_lc")),
                lambda k: k["level"].isin(near) != F.lit(wide))).alias("pool", "level", "name_", "k_file", "k_module", "k_language"))
            if wide:
                answers = best.join(rows.select(*slot).distinct(), slot, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                met = rows.withColumn("salt", F.pmod(F.xxhash64("a_file", "a_module"), F.lit(SALTS)).cast("int")).join(answers, [*slot, "salt"])
            else:
                met = rows.join(best, slot)
            hits = cut_lineage(met.groupBy(*ask).agg(F.min_by("best", "level").alias("best")))
            found = hits if found is None else found.unionByName(hits)
            rest = cut_lineage(rest.join(hits, ask, "left_anti"))
    return found


def resolve_symbols(
    refs: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS,
    ambiguous: int = 3,
) -> DataFrame:
    """Best symbol for each reference by (kind fits, same file, same module, same language, lowest degree, id).

    The order is lexicographic, so the winner is the best symbol of the first
    level that has one.  Symbols are reduced to the best two per level key before
    any reference meets them, two because a reference may not pick its own source.
    References that ask the same are one lookup, which goes on to the next levels only if those before found nothing
    (``_found``). A reference whose level offers itself alone is looked up again at all levels.
    """
    base = nodes.select(*keys, F.col("id").alias("node_id"), "kind", "file", "module", "language")
    load = degree(edges, keys).withColumnRenamed("id", "node_id")
    cand = symbols.join(base, [*keys, "node_id"]).join(load, [*keys, "node_id"], "left").fillna(0, ["degree"])
    pools = F.array_compact(F.array(
        F.when(F.col("kind").isin(*_TYPE_KINDS), "type"), F.when(F.col("kind").isin(*_CALL_KINDS), "call"), F.lit("any"),
    ))
    blankless = lambda c: F.coalesce(F.col(c), F.lit(""))
    offered = cand.select(
        *keys, "node_id", "degree",
        F.inline(_level_keys(blankless("file"), blankless("module"), blankless("language"), pools, F.col("name_lc"))),
    )
    slot = [*keys, "pool", "level", "name_lc", "k_file", "k_module", "k_language"]
    best = top_k(offered, slot, [F.col("degree"), F.col("node_id")], 2).groupBy(*slot).agg(
        F.array_sort(F.collect_list(F.struct("degree", F.col("node_id")))).alias("best")
    )
    count = symbols.groupBy(*keys, "name_lc").agg(F.count("*").alias("candidates"))

    source = base.select(
        *keys, F.col("node_id").alias("source_id"), F.col("file").alias("s_file"),
        F.col("module").alias("s_module"), F.col("language").alias("s_language"),
    )
    asked = refs.join(source, [*keys, "source_id"]).withColumn("name_lc", F.lower("target_name"))
    want_module = F.when(F.coalesce("hint_module", F.lit("")) != "", F.col("hint_module")).otherwise(blankless("s_module"))
    want_language = F.when(F.coalesce(asked["language"], F.lit("")) != "", asked["language"]).otherwise(blankless("s_language"))
    want = F.when(F.col("kind").isin("inherits", "implements", "composes"), "type").when(F.col("kind") == "calls", "call").otherwise("any")
    asked = asked.withColumns({"want": want, "a_file": blankless("s_file"), "a_module": want_module, "a_language": want_language})
    best = cut_lineage(best)
    ask = [*keys, "want", "name_lc", "a_file", "a_module", "a_language"]
    offers = asked.join(_found(asked.select(*ask).distinct(), best, keys, ask), ask, "left")
    other = F.try_element_at(F.filter("best", lambda b: b["node_id"] != F.col("source_id")), F.lit(1))["node_id"]
    first = cut_lineage(offers.select(*keys, "ref_id", "source_id", *[c for c in ask if c not in keys], "best", other.alias("target")))
    alone = first.filter("best IS NOT NULL AND target IS NULL")
    pools = F.when(F.col("want") == "any", F.array(F.lit("any"))).otherwise(F.array(F.col("want"), F.lit("any")))
    lookups = alone.select(
        *keys, "ref_id", "source_id",
        F.inline(_level_keys(F.col("a_file"), F.col("a_module"), F.col("a_language"), pools, F.col("name_lc"))),
    )
    met = lookups.join(best, slot).select(
        *keys, "ref_id", (F.col("pool") == "any").alias("fallback"), "level", other.alias("target")).filter("target is not null")
    again = met.groupBy(*keys, "ref_id").agg(F.min_by("target", F.struct("fallback", "level")).alias("target"))
    winner = first.filter("target IS NOT NULL").select(*keys, "ref_id", "target").unionByName(again)
    asked = asked.drop("want", "a_file", "a_module", "a_language")
    own = symbols.select(*keys, "name_lc", F.col("node_id").alias("source_id"), F.lit(1).alias("own")).distinct()
    out = (
        asked.join(winner, [*keys, "ref_id"], "left")
        .join(count, [*keys, "name_lc"], "left")
        .join(own, [*keys, "name_lc", "source_id"], "left")
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)) - F.coalesce("own", F.lit(0)))
    )
    found = base.select(
        *keys, F.col("node_id").alias("target"), F.col("kind").alias("t_kind"),
        F.col("module").alias("t_module"), F.col("language").alias("t_language"),
    )
    out = out.join(found, [*keys, "target"], "left")
    noise = (
        (F.coalesce("t_module", F.lit("")) != F.coalesce("s_module", F.lit("")))
        & (F.coalesce("t_language", F.lit("")) != F.coalesce("s_language", F.lit("")))
        & (F.col("candidates") > ambiguous)
    )
    kind = (
        F.when((F.col("kind") == "inherits") & (F.col("t_kind") == "interface"), "implements")
        .when((F.col("kind") == "calls") & F.col("t_kind").isin("class", "struct", "abstract_class"), "uses")
        .otherwise(F.col("kind"))
    )
    return out.withColumn("target", F.when(~noise, F.col("target"))).withColumn("edge_kind", kind).select(
        *refs.columns, "target", "edge_kind", "s_module", "t_module", "candidates"
    )


def module_depends_on(resolved: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Module edges from resolved references across modules; the weight counts the references.

    ``resolved`` has ``source_id`` and ``target``.
    """
    module = nodes.filter(F.coalesce("module", F.lit("")) != "").select(*keys, "id", "module")
    joined = (
        resolved.filter("target is not null").select(*keys, "source_id", "target")
        .join(module.select(*keys, F.col("id").alias("source_id"), F.col("module").alias("m_from")), [*keys, "source_id"])
        .join(module.select(*keys, F.col("id").alias("target"), F.col("module").alias("m_to")), [*keys, "target"])
        .filter(F.col("m_from") != F.col("m_to"))
    )
    counted = joined.groupBy(*keys, "m_from", "m_to").agg(F.count("*").alias("n"))
    return edge_frame(
        counted, keys, source=F.concat(F.lit("module:"), F.col("m_from")), target=F.concat(F.lit("module:"), F.col("m_to")),
        kind=F.lit("depends_on"), weight=F.col("n"),
    )


def resolution_stats(refs: DataFrame, unresolved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """References seen and distinct names left unresolved."""
    pending = refs.groupBy(*keys).agg(F.count("*").alias("pending"))
    left = unresolved.groupBy(*keys).agg(F.count_distinct("target_name").alias("unresolved_unique"))
    return pending.join(left, list(keys), "left").fillna(0, ["unresolved_unique"])


def resolve_all(
    nodes: DataFrame, edges: DataFrame, refs: DataFrame, keys: Sequence[str] = KEYS,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and external nodes of all references, and the resolution counts.

    ``stage`` writes what several later steps read, so that no plan holds a resolver twice.
    """
    known = nodes.select(*keys, F.col("id").alias("source_id")).distinct()
    asked = stage(with_ref_id(refs, keys).join(known, [*keys, "source_id"], "left_semi"), "asked_refs")
    symbols = stage(index_symbols(nodes, keys), "symbols")
    imports = stage(resolve_imports(asked.filter(F.col("kind") == "imports"), nodes, symbols, keys), "import_targets")
    tables = stage(resolve_tables(asked.filter(F.col("kind") == "references"), nodes, symbols, keys), "table_targets")
    infra = stage(resolve_infra(asked.filter(F.col("kind") == "communicates_with"), nodes, keys), "infra_targets")
    others = asked.filter(~F.col("kind").isin("imports", "references", "communicates_with"))
    named = stage(resolve_symbols(others, symbols, nodes, edges, keys), "symbol_targets")
    ext_nodes, ext_edges, dotted = externalize(imports.filter("target is null"), keys)

    def edges_of(rows: DataFrame, kind: Column, attr: Column | None = None) -> DataFrame:
        return edge_frame(
            rows.filter("target is not null"), keys, attr=attr,
            source=F.col("source_id"), target=F.col("target"), kind=kind,
        )

    crossing = union_all(*[r.select(*keys, "source_id", "target") for r in (imports, named)])
    made = union_all(
        edges_of(imports, F.col("kind")), edges_of(tables, F.col("kind"), F.col("attr")),
        edges_of(infra, F.col("kind")), edges_of(named, F.col("edge_kind"), F.col("attr")),
        ext_edges, module_depends_on(crossing, nodes, keys),
    )
    left = union_all(
        dotted,
        tables.filter("target is null").select(*keys, F.concat(F.lit("table:"), F.col("target_name")).alias("target_name")),
        infra.filter("target is null").select(*keys, F.concat(F.lit("infra:"), F.col("target_name")).alias("target_name")),
        named.filter("target is null").select(*keys, "target_name"),
    )
    return ext_nodes, made, resolution_stats(refs, left, keys)
