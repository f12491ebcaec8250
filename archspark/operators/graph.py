"""The code graph as two tables: assembly, merge, selection and summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.frames import by_shuffle, half_even, rank_in, top_k
from archspark.functions.paths import classify_layer, stereotype_layer
from archspark.schema import (
    ATTR, EDGE_COLUMNS, EDGE_LABELS, KEYS, LAYERS, NODE_COLUMNS, REF_COLUMNS, SELF_LOOP_KINDS,
)

STRING_MAP = "map<string,string>"


# --------------------------------------------------------------------------- construction


def attr_struct(**fields: Column) -> Column:
    """Attribute struct with the given fields set and the others null."""
    out = F.from_json(F.lit("{}"), ATTR)
    for name, value in fields.items():
        out = out.withField(name, value)
    return out.cast(ATTR)


def node_frame(df: DataFrame, keys: Sequence[str] = KEYS, attr: Column | None = None, **given) -> DataFrame:
    """Project a frame onto the node columns; what is not given is blank."""
    blank = {
        "qualified_name": F.lit(""), "file": F.lit(""), "module": F.lit(""), "language": F.lit(""),
        "external": F.lit(False), "line": F.lit(0),
    }
    values = {**blank, **given, "attr": attr if attr is not None else attr_struct()}
    typed = {"external": "boolean", "line": "int", "attr": ATTR}
    return df.select(*keys, *[values[c].cast(typed.get(c, "string")).alias(c) for c in NODE_COLUMNS])


def edge_label(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in EDGE_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def edge_frame(df: DataFrame, keys: Sequence[str] = KEYS, attr: Column | None = None, **given) -> DataFrame:
    values = {"weight": F.lit(1.0), **given}
    values.setdefault("label", edge_label(values["kind"]))
    values["attr"] = attr if attr is not None else F.create_map()
    typed = {"weight": "double", "attr": STRING_MAP}
    return df.select(*keys, *[values[c].cast(typed.get(c, "string")).alias(c) for c in EDGE_COLUMNS])


def ref_frame(df: DataFrame, keys: Sequence[str] = KEYS, attr: Column | None = None, **given) -> DataFrame:
    values = {"hint_module": F.lit(""), "language": F.lit(""), **given}
    values["attr"] = attr if attr is not None else F.create_map()
    typed = {"attr": STRING_MAP}
    return df.select(*keys, *[values[c].cast(typed.get(c, "string")).alias(c) for c in REF_COLUMNS])


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --------------------------------------------------------------------------- merge


def _merge_maps(df: DataFrame, group: Sequence[str], column: str, seq: Column, last: bool) -> DataFrame:
    """One map per group; for a key set twice the first (or last) row wins.

    Entries are aggregated key by key, so a group of any size is reduced on the map
    side and only its distinct keys are collected.
    """
    entries = df.select(*group, seq.alias("_seq"), F.explode(column).alias("key", "value"))
    pick = (F.max_by if last else F.min_by)("value", "_seq")
    per_key = entries.groupBy(*group, "key").agg(pick.alias("value"))
    return per_key.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(column))


def merge_nodes(*frames: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("file", "line", "kind")) -> DataFrame:
    """One row per node id.

    The first row wins, in the order of the frames and then of ``order``.  Blank
    file, module and language are filled from later rows, a class becomes the
    interface or abstract class a later row says it is, and each attribute keeps
    its first value.
    """
    tagged = union_all(*[f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)])
    rows = tagged.withColumn("seq", F.struct("_src", *[F.col(c) for c in order]))
    group = [*keys, "id"]
    seq = F.col("seq")

    def first_filled(c: str) -> Column:
        return F.coalesce(F.min_by(F.col(c), F.when(F.trim(c) != "", seq)), F.lit("")).alias(c)

    attr_fields = [f.name for f in rows.schema["attr"].dataType.fields if f.name != "extra"]
    upgraded = F.min_by("kind", F.when(F.col("kind").isin("interface", "abstract_class"), seq))
    merged = rows.groupBy(*group).agg(
        F.min_by(F.struct("kind", "name", "qualified_name", "external", "line"), "seq").alias("head"),
        upgraded.alias("up"),
        *[first_filled(c) for c in ("file", "module", "language")],
        *[
            F.min_by(F.col(f"attr.{c}"), F.when(F.col(f"attr.{c}").isNotNull(), seq)).alias(f"a_{c}")
            for c in attr_fields
        ],
    )
    extra = rows.select(*group, "seq", F.col("attr.extra").alias("extra")).filter(F.size("extra") > 0)
    maps = _merge_maps(extra, group, "extra", F.col("seq"), last=False)
    kind = F.when((F.col("head.kind") == "class") & F.col("up").isNotNull(), F.col("up")).otherwise(F.col("head.kind"))
    attr = F.struct(*[F.col(f"a_{c}").alias(c) for c in attr_fields], F.col("extra").alias("extra"))
    return merged.join(by_shuffle(maps), group, "left").select(
        *keys, "id", kind.alias("kind"), F.col("head.name").alias("name"),
        F.col("head.qualified_name").alias("qualified_name"), "file", "module", "language",
        F.col("head.external").alias("external"), F.col("head.line").alias("line"), attr.cast(ATTR).alias("attr"),
    )


def merge_edges(*frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per (source, target, kind): weights add up, later attributes win, self loops only for
    calls and transitions."""
    rows = union_all(*[f.withColumn("seq", F.lit(i)) for i, f in enumerate(frames)])
    rows = rows.filter((F.col("source") != F.col("target")) | F.col("kind").isin(*SELF_LOOP_KINDS))
    group = [*keys, "source", "target", "kind"]
    merged = rows.groupBy(*group).agg(F.min("label").alias("label"), F.sum("weight").alias("weight"))
    with_attr = rows.filter(F.size("attr") > 0)
    maps = _merge_maps(with_attr, group, "attr", F.struct("seq", F.to_json("attr")), last=True)
    return merged.join(by_shuffle(maps), group, "left").select(
        *group[:-3], "source", "target", "kind", "label", "weight",
        F.coalesce("attr", F.create_map().cast(STRING_MAP)).alias("attr"),
    )


def link(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges whose both ends exist."""
    ids = by_shuffle(nodes.select(*keys, "id").distinct())
    kept = edges.join(ids.withColumnRenamed("id", "source"), [*keys, "source"], "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi").select(*edges.columns)


def merge_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], keys=KEYS):
    return merge_nodes(a[0], b[0], keys=keys), merge_edges(a[1], b[1], keys=keys)


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, keys: Sequence[str] = KEYS):
    """Induced subgraph of the given ids."""
    kept = nodes.join(by_shuffle(ids.select(*keys, "id").distinct()), [*keys, "id"], "left_semi").select(*nodes.columns)
    return kept, link(edges, kept, keys)


# --------------------------------------------------------------------------- selection


def nodes_by_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.lower("name") == name.lower())


def out_edges(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    rows = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return rows.join(by_shuffle(ids.select(*keys, F.col("id").alias("source")).distinct()), [*keys, "source"], "left_semi")


def in_edges(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    rows = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return rows.join(by_shuffle(ids.select(*keys, F.col("id").alias("target")).distinct()), [*keys, "target"], "left_semi")


def neighbors(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """(id, neighbor) pairs in either direction, without the id itself."""
    out = out_edges(edges, ids, kinds, keys).select(*keys, F.col("source").alias("id"), F.col("target").alias("neighbor"))
    back = in_edges(edges, ids, kinds, keys).select(*keys, F.col("target").alias("id"), F.col("source").alias("neighbor"))
    return out.unionByName(back).filter(F.col("id") != F.col("neighbor")).distinct()


def degree(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """In plus out edge rows; counts combine on the map side, so a hub costs little."""
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy(*keys, "id").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return nodes.join(by_shuffle(degree(edges, keys)), [*keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def search_nodes(nodes: DataFrame, term: str, limit: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Name or qualified name contains the term; shortest names first."""
    needle = term.strip().lower()
    hits = nodes.filter(F.lower("name").contains(needle) | F.lower("qualified_name").contains(needle))
    return top_k(hits, keys, [F.char_length("name"), F.col("id")], limit, rank="rank")


def collect_edges(
    edges: DataFrame, nodes: DataFrame, kinds: Sequence[str] = (), limit: int = 260, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Heaviest edges between the given nodes."""
    rows = edges.filter(F.col("source") != F.col("target"))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    order = [F.desc("weight"), F.col("source"), F.col("target"), F.col("kind")]
    return top_k(link(rows, nodes, keys), keys, order, limit, rank="rank")


def top_degree_graph(nodes: DataFrame, edges: DataFrame, limit: int = 400, keys: Sequence[str] = KEYS):
    """Nodes of highest degree (10 to 4000), the edges between them, and a ``truncated`` flag."""
    n = max(10, min(limit, 4000))
    totals = nodes.groupBy(*keys).agg(F.count("*").alias("total_nodes"))
    kept = top_k(with_degree(nodes, edges, keys), keys, [F.desc("degree"), F.col("id")], n, rank="rank")
    kept = kept.join(totals, list(keys)).withColumn("truncated", F.col("total_nodes") > n)
    return kept, link(edges, kept, keys)


def graph_stats(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts in long form: section, name, n."""

    def counted(df: DataFrame, section: str, name: Column) -> DataFrame:
        return df.groupBy(*keys, name.alias("name")).agg(F.count("*").alias("n")).select(
            *keys, F.lit(section).alias("section"), "name", "n"
        )

    files = nodes.filter((F.col("kind") == "file") & (F.col("language") != ""))
    by_kind = counted(nodes, "nodes_by_kind", F.col("kind"))
    by_edge = counted(edges, "edges_by_kind", F.col("kind"))
    total = lambda d, s: d.groupBy(*keys).agg(F.sum("n").alias("n")).select(
        *keys, F.lit(s).alias("section"), F.lit("").alias("name"), "n"
    )
    return union_all(
        total(by_kind, "node_count"), total(by_edge, "edge_count"), by_kind, by_edge,
        counted(files, "files_by_language", F.col("language")),
    )


def index_symbols(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lower-case names of types and callables; types are also known by their qualified name."""
    types = ("class", "interface", "abstract_class", "struct", "enum")
    rows = nodes.filter(F.col("kind").isin(*types, "function", "method") & ~F.col("external"))
    names = F.when(
        F.col("kind").isin(*types), F.array(F.lower("name"), F.lower("qualified_name"))
    ).otherwise(F.array(F.lower("name")))
    return rows.select(*keys, F.explode(F.array_distinct(names)).alias("name_lc"), F.col("id").alias("node_id"))


# --------------------------------------------------------------------------- enrichment


def assign_layers(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Layer of every node: path, then module, then stereotype; a module without one takes the most
    common layer of what it contains."""
    is_module = F.col("kind") == "module"
    shown = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))
    modules = nodes.filter(is_module).select(
        *keys, F.concat(F.lit("module:"), F.col("module")).alias("_mid"), classify_layer(shown).alias("_mlayer")
    ).dropDuplicates([*keys, "_mid"])
    rows = nodes.withColumn("_mid", F.concat(F.lit("module:"), F.col("module"))).join(modules, [*keys, "_mid"], "left")
    stereotype = F.coalesce(F.col("attr.stereotype"), F.lit(""))
    by_path = F.when(F.col("file") != "", classify_layer(F.col("file"), stereotype))
    first = F.when(by_path.isNull() | (by_path == "unassigned"), F.coalesce("_mlayer", by_path, F.lit(""))).otherwise(by_path)
    layer = F.when((first == "unassigned") & (stereotype != ""), stereotype_layer(stereotype)).otherwise(first)
    layer = (
        F.when(is_module, classify_layer(shown))
        .when(F.col("external"), F.col("attr.layer"))
        .when(F.col("kind") == "api_endpoint", "api")
        .when(F.col("kind").isin("table", "database", "data_store"), "data")
        .when(layer == "", "unassigned").otherwise(layer)
    )
    staged = rows.withColumn("_layer", layer)
    children = (
        edges.filter(F.col("kind") == "contains")
        .join(staged.select(*keys, F.col("id").alias("target"), "_layer"), [*keys, "target"])
        .filter(F.col("_layer") != "unassigned")
        .groupBy(*keys, F.col("source").alias("id"), "_layer").agg(F.count("*").alias("n"))
    )
    majority = children.groupBy(*keys, "id").agg(
        F.min_by("_layer", F.struct(-F.col("n"), rank_in(F.col("_layer"), LAYERS))).alias("_major")
    )
    out = staged.join(majority, [*keys, "id"], "left")
    final = F.when(is_module & (F.col("_layer") == "unassigned"), F.coalesce("_major", "_layer")).otherwise(F.col("_layer"))
    return out.withColumn("attr", F.col("attr").withField("layer", final)).select(*nodes.columns)


# Responsibility phrase per layer.
RESPONSIBILITY = {
    "presentation": "User facing surface for ",
    "api": "External interface and request handling for ",
    "application": "Use-case orchestration for ",
    "domain": "Business rules and domain logic for ",
    "data": "Persistence and data access for ",
    "infrastructure": "Cross-cutting technical capabilities for ",
}


def build_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Component nodes from the first segment of the modules, and component-contains-module edges."""
    shown = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))
    top = F.element_at(F.split(shown, "/"), 1)
    modules = nodes.filter(F.col("kind") == "module").select(
        *keys, "id", "language", F.coalesce("attr.layer", F.lit("unassigned")).alias("layer"),
        F.when(top == "", "(root)").otherwise(top).alias("top"),
    )
    tops = modules.groupBy(*keys).agg((F.min("top") != F.max("top")).alias("many"))
    modules = modules.join(tops, list(keys)).filter((F.col("top") != "(root)") | ~F.col("many"))
    files = (
        edges.filter(F.col("kind") == "contains").select(*keys, F.col("source").alias("id"), "target")
        .join(nodes.filter(F.col("kind") == "file").select(*keys, F.col("id").alias("target")), [*keys, "target"])
        .groupBy(*keys, "id").agg(F.count("*").alias("files"))
    )
    counted = modules.join(files, [*keys, "id"], "left")

    def mode(column: str, tie: Column, where: Column) -> DataFrame:
        n = modules.filter(where).groupBy(*keys, "top", column).agg(F.count("*").alias("n"))
        return n.groupBy(*keys, "top").agg(
            F.min_by(column, F.struct(-F.col("n"), tie, F.col(column))).alias(f"main_{column}"),
            *([F.map_from_entries(F.collect_list(F.struct(F.col(column), F.col("n").cast("string")))).alias("languages")]
              if column == "language" else []),
        )

    layer = mode("layer", (F.col("layer") == "unassigned"), F.lit(True))
    language = mode("language", F.lit(0), F.col("language") != "")
    grouped = (
        counted.groupBy(*keys, "top")
        .agg(F.count("*").alias("module_count"), F.coalesce(F.sum("files"), F.lit(0)).alias("file_count"))
        .join(layer, [*keys, "top"]).join(language, [*keys, "top"], "left")
    )
    readable = F.trim(F.translate("top", "_-", "  "))
    readable = F.when(readable == "", "root").otherwise(readable)
    phrase = F.lit("Module group: ")
    for name, text in RESPONSIBILITY.items():
        phrase = F.when(F.col("main_layer") == name, text).otherwise(phrase)
    extra = F.create_map(
        F.lit("module_count"), F.col("module_count").cast("string"), F.lit("file_count"), F.col("file_count").cast("string"),
        F.lit("languages"), F.coalesce(F.to_json("languages"), F.lit("{}")),
        F.lit("responsibility"), F.concat(phrase, readable),
    )
    components = node_frame(
        grouped, keys, attr=attr_struct(layer=F.col("main_layer"), extra=extra),
        id=F.concat(F.lit("component:"), F.col("top")), kind=F.lit("component"), name=F.col("top"),
        qualified_name=F.col("top"), module=F.col("top"), language=F.coalesce("main_language", F.lit("")),
    )
    contains = edge_frame(
        modules, keys, source=F.concat(F.lit("component:"), F.col("top")), target=F.col("id"), kind=F.lit("contains")
    )
    return components, contains


CODE_EDGES = ("depends_on", "imports", "uses", "calls")


def lift_edges(edges: DataFrame, nodes: DataFrame, components: DataFrame, keys: Sequence[str] = KEYS,
               kinds: Sequence[str] = CODE_EDGES) -> DataFrame:
    """Code edges between components as depends_on; the weight counts the edges."""
    first = lambda c: F.concat(F.lit("component:"), F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), 1))
    src = nodes.select(*keys, F.col("id").alias("source"), first(F.col("module")).alias("s"))
    dst = nodes.filter(~F.col("external")).select(*keys, F.col("id").alias("target"), first(F.col("module")).alias("t"))
    pairs = (
        edges.filter(F.col("kind").isin(*kinds))
        .join(by_shuffle(src), [*keys, "source"]).join(by_shuffle(dst), [*keys, "target"])
        .filter(F.col("s") != F.col("t")).groupBy(*keys, "s", "t").agg(F.count("*").alias("n"))
    )
    rows = edge_frame(pairs, keys, source=F.col("s"), target=F.col("t"), kind=F.lit("depends_on"), weight=F.col("n"))
    return link(rows, components, keys)


# Name parts that mark a service.
SERVICE_HINTS = ("service", "svc", "api", "worker", "daemon", "server", "gateway", "microservice")


def mark_services(nodes: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Flag components that look deployable; also container-deploys-component edges by name."""
    containers = nodes.filter(F.col("kind") == "container").groupBy(*keys, F.lower("name").alias("_lname")).agg(
        F.min("id").alias("_container")
    )
    rows = nodes.withColumn("_lname", F.when(F.col("kind") == "component", F.lower("name"))).join(
        containers, [*keys, "_lname"], "left"
    )
    hint = F.col("_lname").rlike("|".join(SERVICE_HINTS)) | F.col("_container").isNotNull()
    attr = F.col("attr").withField(
        "is_service", F.when((F.col("kind") == "component") & hint, True).otherwise(F.col("attr.is_service"))
    )
    deploys = edge_frame(
        rows.filter((F.col("kind") == "component") & F.col("_container").isNotNull()), keys,
        source=F.col("_container"), target=F.col("id"), kind=F.lit("deploys"),
    )
    return rows.withColumn("attr", attr).select(*nodes.columns), deploys


STORE_KINDS = ("table", "database", "data_store")


def derive_reads(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extra reads edges for code that uses, calls or depends on a store."""
    stores = nodes.filter(F.col("kind").isin(*STORE_KINDS)).select(*keys, F.col("id").alias("target"))
    rows = edges.filter(F.col("kind").isin("uses", "calls", "depends_on"))
    hit = rows.join(by_shuffle(stores), [*keys, "target"], "left_semi")
    return edge_frame(hit, keys, source=F.col("source"), target=F.col("target"), kind=F.lit("reads"))


def derive_actor(nodes: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The user of every project that has an endpoint or container, and what the user calls and uses."""
    has = nodes.filter(F.col("kind").isin("api_endpoint", "container")).select(*keys).distinct()
    actor = node_frame(
        has, keys,
        attr=attr_struct(layer=F.lit("presentation"), extra=F.create_map(F.lit("description"), F.lit("External consumer of the system"))),
        id=F.lit("actor:user"), kind=F.lit("actor"), name=F.lit("User"), qualified_name=F.lit("User"),
    )
    surface = nodes.filter((F.col("kind") == "component") & (F.col("attr.layer") == "presentation"))
    surface = surface.join(has, list(keys), "left_semi")
    calls = edge_frame(nodes.filter(F.col("kind") == "api_endpoint"), keys,
                       source=F.lit("actor:user"), target=F.col("id"), kind=F.lit("calls"))
    uses = edge_frame(surface, keys, source=F.lit("actor:user"), target=F.col("id"), kind=F.lit("uses"))
    return actor, calls.unionByName(uses)


# What makes an enumeration a state machine.
STATE_NAME = "state|status|phase|stage|step|mode"
STATE_MEMBERS = (
    "pending", "created", "new", "active", "running", "started", "completed", "done", "failed", "error",
    "cancelled", "canceled", "closed", "approved", "rejected", "draft",
)


def mark_state_machines(nodes: DataFrame) -> DataFrame:
    """Flag enumerations with two members or more that are named or filled like states."""
    members = F.transform(F.coalesce("attr.members", F.array().cast("array<string>")), F.lower)
    known = F.array(*[F.lit(m) for m in STATE_MEMBERS])
    machine = (F.col("kind") == "enum") & (F.size(members) >= 2) & (
        F.lower("name").rlike(STATE_NAME) | (F.size(F.array_intersect(members, known)) >= 2)
    )
    flag = F.when(machine, True).otherwise(F.col("attr.is_state_machine"))
    return nodes.withColumn("attr", F.col("attr").withField("is_state_machine", flag))


def technology_of(node: str = "attr") -> Column:
    """First non-blank of technology, image, framework, package name, main language, language."""
    extra = lambda k: F.nullif(F.trim(F.try_element_at(F.col(f"{node}.extra"), F.lit(k))), F.lit(""))
    counts = F.map_entries(F.from_json(F.try_element_at(F.col(f"{node}.extra"), F.lit("languages")), "map<string,int>"))
    ranked = F.array_sort(F.transform(counts, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"))))
    return F.coalesce(
        F.nullif(F.trim(f"{node}.technology"), F.lit("")), extra("image"), extra("framework"), extra("package_name"),
        F.try_element_at(ranked, F.lit(1))["key"], F.col("language"), F.lit(""),
    )
