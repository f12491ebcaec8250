"""The data behind the nine views: which nodes and edges each one shows.

Every function returns (view_nodes, view_edges) per key; drawing is left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions.frames import by_shuffle, top_k
from archspark.operators import iterate as it
from archspark.operators import metrics as m
from archspark.operators.graph import collect_edges, neighbors, technology_of, union_all, with_degree
from archspark.schema import KEYS, LAYERS

# Budgets and weights of the selection.
BUDGET = {"executive": 18, "standard": 45, "detailed": 110}
STEREOTYPE_WEIGHT = {
    "controller": 2.0, "service": 2.0, "repository": 1.6, "entity": 1.4, "handler": 1.3, "manager": 1.3, "factory": 1.1, "adapter": 1.1,
}
BOOSTED = ("component", "service", "container", "api_endpoint")
DATA_KINDS, SOURCE_KINDS = ("database", "table", "data_store"), ("actor", "external_api", "queue")


@dataclass(frozen=True)
class Filters:
    """What a view may show."""

    modules: tuple[str, ...] = ()
    nodes: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    include_external: bool = False
    max_nodes: int = 60
    detail: str = "standard"
    focus: str = ""

    def budget(self) -> int:
        return max(4, min(self.max_nodes, BUDGET.get(self.detail, 45)))

    def by_detail(self, executive: int, standard: int, detailed: int) -> int:
        return {"executive": executive, "detailed": detailed}.get(self.detail, standard)


def filter_nodes(nodes: DataFrame, f: Filters) -> DataFrame:
    """Conjunction of the filter's predicates."""
    test = F.lit(True)
    if not f.include_external:
        test = test & ~F.col("external")
    if f.languages:
        test = test & ((F.coalesce("language", F.lit("")) == "") | F.col("language").isin(*f.languages))
    if f.modules:
        own = F.lit(False)
        for name in f.modules:
            own = own | (F.col("module") == name) | F.col("module").startswith(f"{name}/")
        test = test & F.coalesce(own, F.lit(False))
    if f.nodes:
        test = test & (F.col("id").isin(*f.nodes) | F.col("name").isin(*f.nodes))
    if f.focus:
        hay = F.lower(F.concat_ws(" ", "name", "qualified_name", "module", "file", F.coalesce("attr.stereotype", F.lit(""))))
        test = test & hay.contains(f.focus.lower())
    return nodes.filter(test)


def layer_of() -> Column:
    layer = F.coalesce("attr.layer", F.lit("unassigned"))
    return F.when(F.col("external"), "external").when(layer.isin(*LAYERS), layer).otherwise("unassigned")


def importance(degree: Column, rank: Column) -> Column:
    """Degree and rank, weighted by stereotype, methods, kind and origin."""
    weight = F.lit(1.0)
    for name, value in STEREOTYPE_WEIGHT.items():
        weight = F.when(F.col("attr.stereotype") == name, value).otherwise(weight)
    score = (degree + 800.0 * rank) * weight + F.least(F.greatest(F.size("attr.methods"), F.lit(0)), F.lit(25)) * 0.15
    score = F.when(F.col("external"), score * 0.35).otherwise(score)
    return F.when(F.col("kind").isin(*BOOSTED), score * 1.4).otherwise(score)


def select_nodes(
    nodes: DataFrame, edges: DataFrame, candidates: DataFrame, f: Filters, keys: Sequence[str] = KEYS,
    budget: int | None = None, ranks: DataFrame | None = None, keep_connected: bool = True,
) -> DataFrame:
    """Most important candidates within the budget, with ``elided``: how many matched but are not shown.

    Without a focus match the neighbours of nodes named like the focus stand in.
    Where fewer than half of the picks are connected, up to five connected ones are
    added.  ``ranks`` is the stored PageRank of the run.
    """
    limit = budget or f.budget()
    matched = filter_nodes(candidates, f)
    if f.focus:
        named = candidates.filter(F.lower("name").contains(f.focus.lower())).select(*keys, "id")
        near = neighbors(edges, named, keys=keys).select(*keys, F.col("neighbor").alias("id"))
        fallback = candidates.join(named.unionByName(near).distinct(), [*keys, "id"], "left_semi")
        hit = matched.select(*keys).distinct()
        matched = matched.unionByName(fallback.join(hit, list(keys), "left_anti").select(*matched.columns))
    totals = matched.groupBy(*keys).agg(F.count("*").alias("matched"))
    scored = with_degree(matched, edges, keys)
    if ranks is not None:
        # the ranked list the selection looks at holds the 5000 most central inner nodes
        top = it.centrality(ranks, nodes, keys, 5000).select(*keys, "id", F.col("score").alias("pr"))
        scored = scored.join(top, [*keys, "id"], "left")
    else:
        scored = scored.withColumn("pr", F.lit(0.0))
    scored = scored.withColumn("importance", importance(F.col("degree"), F.coalesce("pr", F.lit(0.0))))
    order = [F.desc("importance"), F.col("id")]
    chosen = top_k(scored, keys, order, limit, rank="position")
    if keep_connected:
        ids = chosen.select(*keys, "id")
        pairs = neighbors(edges, ids, keys=keys)
        linked = pairs.join(ids.withColumnRenamed("id", "neighbor"), [*keys, "neighbor"], "left_semi").select(*keys, "id").distinct()
        n_linked = linked.groupBy(*keys).agg(F.count("*").alias("linked"))
        loose = totals.filter(F.col("matched") > limit).join(n_linked, list(keys), "left").filter(
            F.coalesce("linked", F.lit(0)) < limit // 2).select(*keys)
        around = pairs.select(*keys, F.col("neighbor").alias("id")).distinct()
        rest = scored.join(ids, [*keys, "id"], "left_anti").join(around, [*keys, "id"], "left_semi").join(loose, list(keys), "left_semi")
        extra = top_k(rest, keys, order, 5, rank="position").withColumn("position", F.col("position") + limit)
        chosen = chosen.unionByName(extra.select(*chosen.columns))
    shown = Window.partitionBy(*keys)  # at most limit + 5 rows per key
    return chosen.join(totals, list(keys)).withColumn("elided", F.col("matched") - F.count("*").over(shown)).drop("pr", "matched")


def _one_per_pair(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the first edge of each (source, target) of a short ranked list."""
    return top_k(edges, [*keys, "source", "target"], [F.col("rank")], 1)


def _kinds(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def _shown(nodes: DataFrame, keys, *extra) -> DataFrame:
    return nodes.select(*keys, "id", "name", "kind", "module", "file", layer_of().alias("layer"), technology_of().alias("technology"), *extra)


def _components_or_modules(nodes: DataFrame, keys: Sequence[str], *kinds: str) -> DataFrame:
    parts = _kinds(nodes, *kinds)
    has = parts.select(*keys).distinct()
    return parts.unionByName(_kinds(nodes, "module").join(has, list(keys), "left_anti").select(*parts.columns))


def view_architecture(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """Components with external systems and actors; risky ones flagged."""
    picked = select_nodes(nodes, edges, _components_or_modules(nodes, keys, "component", "service"), f, keys, ranks=ranks)
    base = picked.select(*nodes.columns)
    external = top_k(_kinds(nodes, "database", "queue", "external_api", "data_store"), keys, [F.col("id")], f.by_detail(5, 10, 10))
    parts = [base, external, _kinds(nodes, "actor")]
    if f.detail == "detailed":
        parts.append(top_k(_kinds(nodes, "api_endpoint"), keys, [F.col("id")], 10))
    shown = union_all(*[p.select(*nodes.columns) for p in parts]).dropDuplicates([*keys, "id"])
    hubs = m.hub_nodes(nodes, edges, keys, 5).select(*keys, "id")
    mod = m.module_edges(edges, nodes, keys)
    tight = m.coupling(m.module_universe(nodes, mod, keys), mod, keys, 3).filter("coupling >= 8").select(
        *keys, F.concat(F.lit("component:"), F.element_at(F.split("module", "/"), 1)).alias("id"))
    risky = hubs.unionByName(tight).distinct().withColumn("risk", F.lit(True))
    view = shown.join(risky, [*keys, "id"], "left").withColumn("risk", F.coalesce("risk", F.lit(False)))
    kinds = ("depends_on", "uses", "communicates_with", "calls", "reads", "writes", "exposes")
    links = _one_per_pair(collect_edges(edges, shown, kinds, 120, keys), keys)
    label = F.coalesce(F.try_element_at("attr", F.lit("technology")), F.replace("kind", F.lit("_"), F.lit(" ")))
    return _shown(view, keys, "risk"), links.select(*keys, "source", "target", "kind", label.alias("label"))


def view_component(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """Components and the interfaces they provide."""
    picked = select_nodes(nodes, edges, _components_or_modules(nodes, keys, "component"), f, keys, ranks=ranks).select(*nodes.columns)
    budget = f.by_detail(0, 10, 24)
    parts = [picked]
    if budget:
        best = top_k(with_degree(_kinds(nodes, "interface"), edges, keys), keys, [F.desc("degree"), F.col("id")], budget)
        own = best.withColumn("_c", F.concat(F.lit("component:"), F.element_at(F.split("module", "/"), 1)))
        parts.append(own.join(picked.select(*keys, F.col("id").alias("_c")), [*keys, "_c"], "left_semi").select(*nodes.columns))
    if f.include_external:
        parts.append(top_k(_kinds(nodes, "database", "queue", "external_api", "data_store"), keys, [F.col("id")], 8).select(*nodes.columns))
    shown = union_all(*parts).dropDuplicates([*keys, "id"])
    links = collect_edges(edges, shown, ("depends_on", "uses", "implements", "contains", "communicates_with"), 110, keys)
    kinds = shown.select(*keys, F.col("id").alias("target"), F.col("kind").alias("_k"))
    links = links.join(kinds, [*keys, "target"]).filter((F.col("kind") != "contains") | (F.col("_k") == "interface"))
    label = F.when(F.col("kind") == "contains", "provides").otherwise(F.replace("kind", F.lit("_"), F.lit(" ")))
    return _shown(shown, keys), links.select(*keys, "source", "target", "kind", label.alias("label"))


def view_class(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """Types with their first members and their relations."""
    types = _kinds(nodes, "class", "interface", "abstract_class", "struct", "enum")
    budget = min(f.budget(), 90 if f.detail == "detailed" else 40)
    picked = select_nodes(nodes, edges, types, f, keys, budget, ranks)
    n = f.by_detail(0, 6, 14)
    kinds = ("inherits", "implements", "composes", "aggregates", "associates", "uses", "depends_on")
    first = lambda c: F.slice(F.coalesce(c, F.array()), 1, n) if n else F.array()
    names = lambda c: F.transform(F.col(c), lambda x: x["name"])
    members = F.when(F.col("kind") == "enum", first(F.col("attr.members"))).otherwise(F.concat(first(names("attr.properties")), first(names("attr.methods"))))
    view = _shown(picked, keys, "position", "elided", members.cast("array<string>").alias("members"),
                  F.greatest(F.size("attr.methods"), F.lit(0)).alias("methods"))
    return view, collect_edges(edges, picked, kinds, 180, keys).select(*keys, "source", "target", "kind", "rank")


def view_dependency(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, cycles: DataFrame | None = None, ranks=None):
    """Modules, those on a cycle first, and their dependencies with the cycle edges flagged."""
    mod = m.module_edges(edges, nodes, keys)
    found = it.find_cycles(mod, keys) if cycles is None else cycles
    on_cycle = found.select(*keys, F.explode("members").alias("module")).distinct().withColumn("in_cycle", F.lit(True))
    rows = m.coupling(m.module_universe(nodes, mod, keys), mod, keys, None).join(by_shuffle(on_cycle), [*keys, "module"], "left")
    rows = rows.withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    if f.modules:
        test = F.lit(False)
        for name in f.modules:
            test = test | (F.col("module") == name) | F.col("module").startswith(f"{name}/")
        rows = rows.filter(test)
    if f.focus:
        hit = rows.filter(F.lower("module").contains(f.focus.lower())).select(*keys, "module")
        ends = mod.select(*keys, F.col("src_module").alias("a"), F.col("dst_module").alias("b"))
        both = ends.unionByName(ends.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(hit.withColumnRenamed("module", "a"), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("module"))
        keep = hit.unionByName(near).distinct()
        without = rows.join(hit.select(*keys).distinct(), list(keys), "left_anti")
        rows = rows.join(keep, [*keys, "module"], "left_semi").unionByName(without.select(*rows.columns))
    shown = top_k(rows, keys, [F.desc("in_cycle"), F.desc("coupling"), F.col("module")], f.budget(), rank="position")
    shown = shown.withColumn("folder", F.element_at(F.split("module", "/"), 1))
    flagged = it.cycle_edges(found, keys).withColumn("cycle", F.lit(True))
    ids = shown.select(*keys, "module")
    links = mod.join(by_shuffle(ids.withColumnRenamed("module", "src_module")), [*keys, "src_module"], "left_semi").join(
        by_shuffle(ids.withColumnRenamed("module", "dst_module")), [*keys, "dst_module"], "left_semi")
    links = links.select(*keys, F.col("src_module").alias("source"), F.col("dst_module").alias("target"), "weight").join(
        by_shuffle(flagged), [*keys, "source", "target"], "left")
    return shown, links.withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def view_dataflow(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """External entities, entry points, processing and stores, with the flows between them."""
    budget = max(6, f.budget() // 2)
    work = select_nodes(nodes, edges, _kinds(nodes, "component", "service"), f, keys, budget, ranks).select(*nodes.columns)

    def busiest(kinds, n):
        return top_k(with_degree(_kinds(nodes, *kinds), edges, keys), keys, [F.desc("degree"), F.col("id")], n).select(*nodes.columns)

    shown = union_all(
        busiest(SOURCE_KINDS, 10), busiest(("api_endpoint",), f.by_detail(3, 8, 8)), work, busiest(DATA_KINDS, f.by_detail(12, 12, 30)))
    zone = F.when(F.col("kind").isin(*SOURCE_KINDS), "external").when(F.col("kind") == "api_endpoint", "entry").when(
        F.col("kind").isin(*DATA_KINDS), "store").otherwise("processing")
    kinds = ("reads", "writes", "uses", "calls", "communicates_with", "exposes", "depends_on")
    links = _one_per_pair(collect_edges(edges, shown, kinds, 120, keys), keys)
    label = F.when(F.col("kind") == "reads", "reads").when(F.col("kind") == "writes", "writes").when(
        F.col("kind") == "communicates_with", "exchanges data").when(F.col("kind") == "exposes", "handles").otherwise("data")
    return _shown(shown, keys, zone.alias("zone")), links.select(*keys, "source", "target", "kind", label.alias("label"))


def view_deployment(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """Containers, deployed components and backing services with their tiers; a node may be in two."""
    origin = F.coalesce(F.col("attr.extra")["origin"], F.lit(""))
    kind = F.col("kind")
    wanted = (
        kind.isin("actor", "container") | ((kind == "component") & ((origin == "kubernetes") | F.col("language").isin("kubernetes", "docker")))
        | (kind.isin("database", "queue") & (origin.isin("compose", "kubernetes") | F.col("external"))))
    deployed = nodes.filter(wanted)
    real = deployed.filter(kind.isin("container", "component")).select(*keys).distinct()
    shown = deployed.join(real, list(keys), "left_semi")
    workload = F.lower(F.coalesce(F.col("attr.extra")["workload"], F.lit("")))
    edge = ((kind == "component") & workload.isin("ingress", "service")) | F.lower("name").rlike("nginx|traefik|gateway|ingress|lb|proxy")
    tiers = F.array_compact(F.array(
        F.when(kind == "actor", "clients"), F.when(edge, "edge"), F.when(kind == "container", "runtime"), F.when(kind.isin("database", "queue", "data_store"), "backing")))
    view = _shown(shown, keys, F.explode(F.when(F.size(tiers) > 0, tiers).otherwise(F.array(F.lit("other")))).alias("tier"))
    links = collect_edges(edges, shown, ("communicates_with", "deploys", "uses", "calls"), 90, keys)
    return view, links.select(*keys, "source", "target", "kind")


# Names an entity type or column may not have.
def entity_name(name: Column) -> Column:
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.substring(F.upper(F.when((clean == "") | clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean)), 1, 48)


def normalise_type(raw: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(raw, F.lit("")), F.lit("string")), r"[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    clean = F.when(clean == "", "string").otherwise(clean)
    return F.substring(F.when(clean.rlike("^[0-9]"), F.concat(F.lit("t_"), clean)).otherwise(clean), 1, 24)


def relate_tables(edges: DataFrame, columns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Table pairs with the foreign key column; a nullable one is optional."""
    refs = edges.filter(F.col("kind").isin("references", "associates"))
    pair = refs.select(*keys, "source", "target", F.coalesce(F.try_element_at("attr", F.lit("column")), F.lit("")).alias("column"))
    pair = top_k(pair, [*keys, "source", "target"], [F.col("column")], 1)
    known = columns.select(*keys, F.concat(F.lit("table:"), "table").alias("source"), F.col("name").alias("column"), "nullable").distinct()
    return pair.join(known, [*keys, "source", "column"], "left").select(
        *keys, "source", "target", "column", F.coalesce("nullable", F.lit(True)).alias("optional"))


def table_stats(nodes: DataFrame, columns: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns, origin and isolation of each table."""
    tables = _kinds(nodes, "table").select(*keys, "id", "name", F.coalesce(F.col("attr.extra")["origin"], F.lit("schema")).alias("origin"))
    n = columns.groupBy(*keys, F.concat(F.lit("table:"), "table").alias("id")).agg(F.count("*").alias("columns"))
    linked = edges.filter(F.col("kind") == "references").select(*keys, F.explode(F.array("source", "target")).alias("id")).distinct()
    linked = linked.withColumn("linked", F.lit(True))
    return tables.join(n, [*keys, "id"], "left").join(linked, [*keys, "id"], "left").select(
        *keys, "id", "name", "origin", F.coalesce("columns", F.lit(0)).alias("columns"), F.col("linked").isNull().alias("isolated"))


def view_database(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, columns: DataFrame | None = None, fks: DataFrame | None = None, ranks=None):
    """Tables by degree with their first columns, and the relations between them."""
    tables = with_degree(_kinds(nodes, "table"), edges, keys)
    if f.focus:
        hit = tables.filter(F.lower("name").contains(f.focus.lower())).select(*keys, "id")
        near = neighbors(edges, hit, ["references"], keys).select(*keys, F.col("neighbor").alias("id"))
        focused = tables.join(hit.unionByName(near).distinct(), [*keys, "id"], "left_semi")
        tables = focused.unionByName(tables.join(hit.select(*keys).distinct(), list(keys), "left_anti").select(*focused.columns))
    shown = top_k(tables, keys, [F.desc("degree"), F.col("name")], min(f.budget(), 60 if f.detail == "detailed" else 30), rank="position")
    view = shown.select(*keys, "id", "name", entity_name(F.col("name")).alias("entity"), "position", "degree")
    ids = shown.select(*keys, "id")
    if columns is not None:
        marked = columns.join(fks.select(*keys, "table", F.col("column").alias("name"), F.lit(True).alias("fk")).distinct(), [*keys, "table", "name"], "left")
        marker = F.when(F.col("primary_key"), "PK").when(F.col("fk"), "FK").when(F.col("unique"), "UK").otherwise("")
        cut = marked.filter(F.col("pos") < f.by_detail(3, 8, 24)).groupBy(*keys, F.concat(F.lit("table:"), "table").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "name", normalise_type(F.col("type")).alias("type"), marker.alias("marker"), "nullable"))).alias("columns"))
        view = view.join(cut, [*keys, "id"], "left")
    links = relate_tables(edges, columns, keys) if columns is not None else edges.filter(F.col("kind") == "references").select(*keys, "source", "target")
    links = links.join(ids.withColumnRenamed("id", "source"), [*keys, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi")
    return view, links


def participants_of(calls: DataFrame, nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Owner of each callable: its type, else its component, else itself."""
    kind = nodes.select(*keys, F.col("id").alias("source"), F.col("kind").alias("o_kind"))
    types = edges.filter(F.col("kind") == "contains").join(kind, [*keys, "source"]).filter(
        F.col("o_kind").isin("class", "abstract_class", "struct", "interface")).groupBy(*keys, F.col("target").alias("id")).agg(F.min("source").alias("owner"))
    component = F.concat(F.lit("component:"), F.element_at(F.split(F.coalesce("module", F.lit("")), "/"), 1))
    parts = nodes.filter(F.col("kind") == "component").select(*keys, F.col("id").alias("cid"), F.col("id").alias("component"))
    own = nodes.withColumn("cid", component).join(types, [*keys, "id"], "left").join(parts, [*keys, "cid"], "left")
    callable_ = F.col("kind").isin("method", "function")
    own = own.select(*keys, "id", F.when(callable_, F.coalesce("owner", "component", "id")).otherwise(F.col("id")).alias("participant"))
    out = calls.join(own.withColumnsRenamed({"id": "caller", "participant": "from"}), [*keys, "caller"])
    return out.join(own.withColumnsRenamed({"id": "callee", "participant": "to"}), [*keys, "callee"])


def view_sequence(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """Participants and numbered steps of the first entry point's call chain."""
    entry = it.pick_entry_points(nodes, edges, keys, f.focus).filter("rank = 1")
    chain = it.call_chain(entry, edges, nodes, keys, depth=f.by_detail(3, 5, 7))
    steps = participants_of(chain, nodes, edges, keys).filter(F.col("from") != F.col("to"))
    actor = nodes.filter(F.col("id") == "actor:user").select(*keys, F.lit(-1).alias("at"), F.col("id"))
    ends = steps.select(*keys, F.posexplode(F.array("from", "to")).alias("p", "id"), "step").select(*keys, (F.col("step") * 2 + F.col("p")).alias("at"), "id")
    first = actor.unionByName(ends).groupBy(*keys, "id").agg(F.min("at").alias("at"))
    who = top_k(first, keys, [F.col("at"), F.col("id")], 9, rank="position")
    ids = who.select(*keys, "id")
    kept = steps.join(ids.withColumnRenamed("id", "from"), [*keys, "from"], "left_semi").join(ids.withColumnRenamed("id", "to"), [*keys, "to"], "left_semi")
    numbered = top_k(kept.select(*keys, "from", "to", "label", F.col("step").alias("_s")), keys, [F.col("_s")], 24, rank="step").drop("_s")
    names = nodes.select(*keys, "id", "name", "kind")
    return who.drop("at").join(names, [*keys, "id"]), numbered.select(*keys, "step", F.col("from").alias("source"), F.col("to").alias("target"), "label")


# Words of first and last states.
TERMINAL = ("completed", "complete", "done", "closed", "failed", "error", "cancelled", "canceled", "rejected", "expired", "archived",
            "deleted", "finished", "succeeded")
INITIAL = ("new", "created", "draft", "pending", "initial", "init", "idle", "queued", "unknown", "none")


def view_state(nodes, edges, f: Filters = Filters(), keys: Sequence[str] = KEYS, ranks=None):
    """States and inferred transitions of the largest state enumeration."""
    enums = _kinds(nodes, "enum").withColumn("n", F.greatest(F.size("attr.members"), F.lit(0)))
    tier = F.when(F.coalesce("attr.is_state_machine", F.lit(False)), F.when(
        F.lower("name").contains(f.focus.lower()) if f.focus else F.lit(True), 0).otherwise(1)).when(F.col("n") >= 3, 2)
    best = top_k(enums.withColumn("tier", tier).filter("tier is not null"), keys, [F.col("tier"), F.desc("n"), F.col("id")], 1)
    rows = best.select(*keys, "id", "name", F.slice("attr.members", 1, 14).alias("s")).filter(F.size("s") >= 2)
    start = F.coalesce(F.try_element_at(F.filter("s", lambda x: F.lower(x).isin(*INITIAL)), F.lit(1)), F.col("s")[0])
    rows = rows.withColumn("initial", start).withColumn("ends", F.filter("s", lambda x: F.lower(x).isin(*TERMINAL)))
    rows = rows.withColumn("chain", F.concat(F.array("initial"), F.filter("s", lambda x: (x != F.col("initial")) & ~F.array_contains(F.col("ends"), x))))
    last = F.element_at("chain", -1)
    steps = F.zip_with(F.slice("chain", 1, F.size("chain") - 1), F.slice("chain", 2, F.size("chain")), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    finals = F.transform("ends", lambda e: F.struct(F.when(last != e, last).otherwise(F.col("initial")).alias("source"), e.alias("target")))
    low = F.lower("target")
    event = F.when(low.isin("failed", "error"), "on error").when(low.isin("cancelled", "canceled"), "cancel").when(
        low == "approved", "approve").when(low == "rejected", "reject").otherwise(F.substring(low, 1, 18))
    states = rows.select(*keys, "id", F.col("name").alias("machine"), F.posexplode("s").alias("pos", "state"), "initial", "ends").select(
        *keys, "id", "machine", "pos", "state", (F.col("state") == F.col("initial")).alias("is_initial"), F.array_contains("ends", F.col("state")).alias("is_terminal"))
    moves = rows.select(*keys, "id", F.inline(F.concat(steps, finals))).withColumn("event", event)
    return states, moves


def group_by_layer(view_nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """View nodes in layer order, then by name; external ones last."""
    order = F.array_position(F.array(*[F.lit(x) for x in (*LAYERS, "external")]), F.col("layer"))
    w = Window.partitionBy(*keys, "layer").orderBy(F.lower("name"), "id")  # a view is bounded by its budget
    return view_nodes.withColumns({"layer_order": order, "place": F.row_number().over(w)})


View = Callable[..., tuple[DataFrame, DataFrame]]
VIEWS: dict[str, View] = {
    "architecture": view_architecture, "component": view_component, "class": view_class, "dependency": view_dependency,
    "sequence": view_sequence, "dataflow": view_dataflow, "database": view_database, "deployment": view_deployment, "state": view_state,
}


def view_catalogue(nodes: DataFrame, edges: DataFrame, f: Filters = Filters(), keys: Sequence[str] = KEYS, kinds: Sequence[str] = tuple(VIEWS)) -> DataFrame:
    """How many elements each view of each project shows; a view with none says it is empty."""
    projects = nodes.select(*keys).distinct()
    out = []
    for kind in kinds:
        shown, _ = VIEWS[kind](nodes, edges, f, keys)
        n = shown.groupBy(*keys).agg(F.count("*").alias("elements"))
        out.append(projects.join(n, list(keys), "left").select(
            *keys, F.lit(kind).alias("view"), F.coalesce("elements", F.lit(0)).alias("elements"), F.col("elements").isNull().alias("empty")))
    return union_all(*out)
