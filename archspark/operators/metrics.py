"""Architecture metrics over the graph tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.frames import by_shuffle, half_even, ratio, top_k
from archspark.functions.paths import layer_rank
from archspark.operators.graph import with_degree
from archspark.schema import KEYS

# What counts as a dependency between modules.
MODULE_RELATIONS = (
    "imports", "uses", "calls", "depends_on", "composes", "inherits", "implements", "associates", "aggregates",
)
GOD_METHODS, GOD_DEPENDENCIES, HUB_DEGREE = 20, 12, 10


def module_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cross-module dependencies; the weight counts the edge rows."""
    module = F.when(F.coalesce("module", F.lit("")) == "", "(root)").otherwise(F.col("module"))
    src = nodes.select(*keys, F.col("id").alias("source"), module.alias("src_module"))
    dst = nodes.filter(~F.col("external")).select(*keys, F.col("id").alias("target"), module.alias("dst_module"))
    rows = edges.filter(F.col("kind").isin(*MODULE_RELATIONS)).select(*keys, "source", "target")
    joined = rows.join(by_shuffle(src), [*keys, "source"]).join(by_shuffle(dst), [*keys, "target"])
    return (
        joined.filter(F.col("src_module") != F.col("dst_module"))
        .groupBy(*keys, "src_module", "dst_module").agg(F.count("*").alias("weight"))
    )


def module_universe(nodes: DataFrame, mod_edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Declared modules and the ends of module edges."""
    shown = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))
    declared = nodes.filter(F.col("kind") == "module").select(*keys, shown.alias("module"))
    ends = mod_edges.select(*keys, F.explode(F.array("src_module", "dst_module")).alias("module"))
    return declared.union(ends).distinct()


def fan(mod_edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct neighbours in and out per module; module edges are unique, so rows are counted."""
    ends = mod_edges.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("src_module").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("dst_module").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )).alias("e"),
    )
    return ends.groupBy(*keys, F.col("e.module").alias("module")).agg(
        F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")
    )


def coupling(modules: DataFrame, mod_edges: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 25) -> DataFrame:
    joined = modules.join(by_shuffle(fan(mod_edges, keys)), [*keys, "module"], "left").fillna(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    rows = joined.withColumn("instability", half_even(ratio(F.col("fan_out"), total), 3)).withColumn("coupling", total)
    if limit is None:
        return rows
    return top_k(rows, keys, [F.desc("coupling"), F.col("module")], limit, rank="rank")


def god_classes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 15) -> DataFrame:
    kinds = ("calls", "uses", "composes", "depends_on")
    deps = (
        edges.filter(F.col("kind").isin(*kinds)).groupBy(*keys, F.col("source").alias("id"))
        .agg(F.count_distinct("target").alias("dependencies"))
    )
    types = nodes.filter(F.col("kind").isin("class", "abstract_class", "struct")).select(
        *keys, "id", "name", "file",
        F.greatest(F.size("attr.methods"), F.lit(0)).alias("methods"),
        F.greatest(F.size("attr.properties"), F.lit(0)).alias("properties"),
    )
    rows = types.join(by_shuffle(deps), [*keys, "id"], "left").fillna(0, ["dependencies"])
    score = F.col("methods") / GOD_METHODS + F.col("dependencies") / GOD_DEPENDENCIES + F.col("properties") / 30
    hit = rows.filter((F.col("methods") >= GOD_METHODS) | (F.col("dependencies") >= GOD_DEPENDENCIES))
    hit = hit.withColumn("severity", half_even(F.least(score, F.lit(3.0)), 2))
    return hit if limit is None else top_k(hit, keys, [F.desc("severity"), F.col("id")], limit, rank="rank")


def hub_nodes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 15) -> DataFrame:
    rows = with_degree(nodes.filter(~F.col("external") & ~F.col("kind").isin("file", "module")), edges, keys)
    hubs = rows.filter(F.col("degree") >= HUB_DEGREE).select(*keys, "id", "name", "kind", "degree", "file")
    return hubs if limit is None else top_k(hubs, keys, [F.desc("degree"), F.col("id")], limit, rank="rank")


def layering_violations(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 25) -> DataFrame:
    """Dependencies that point from an inner layer to an outer one."""
    shown = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))
    layer = F.coalesce("attr.layer", F.lit("unassigned"))
    assigned = nodes.withColumn("_layer", layer).filter(F.col("_layer") != "unassigned")
    src = assigned.select(*keys, F.col("id").alias("source"), shown.alias("from"), F.col("_layer").alias("from_layer"), "file")
    dst = assigned.filter(~F.col("external")).select(
        *keys, F.col("id").alias("target"), shown.alias("to"), F.col("_layer").alias("to_layer")
    )
    rows = edges.filter(F.col("kind").isin("imports", "uses", "calls", "depends_on")).select(*keys, "source", "target", "kind")
    bad = rows.join(by_shuffle(src), [*keys, "source"]).join(by_shuffle(dst), [*keys, "target"]).filter(
        layer_rank(F.col("to_layer")) < layer_rank(F.col("from_layer"))
    ).select(*keys, "from", "from_layer", "to", "to_layer", "kind", "file")
    if limit is None:
        return bad
    order = ("from", "to", "kind", "from_layer", "to_layer", "file")  # names may be null or repeat
    return top_k(bad, keys, [F.col(c) for c in order], limit, rank="rank")


def orphan_modules(modules: DataFrame, mod_edges: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 15) -> DataFrame:
    ends = mod_edges.select(*keys, F.explode(F.array("src_module", "dst_module")).alias("module"))
    lone = modules.join(by_shuffle(ends), [*keys, "module"], "left_anti")
    return lone if limit is None else top_k(lone, keys, [F.col("module")], limit, rank="rank")


def graph_shape(modules: DataFrame, mod_edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Module count, dependency count and density."""
    m = modules.groupBy(*keys).agg(F.count("*").alias("module_count"))
    e = mod_edges.groupBy(*keys).agg(F.count("*").alias("module_dependency_count"))
    joined = m.join(e, list(keys), "left").fillna(0, ["module_dependency_count"])
    n = F.col("module_count")
    return joined.withColumn(
        "density", half_even(F.when(n > 1, F.col("module_dependency_count") / (n * (n - 1))).otherwise(F.lit(0.0)), 4)
    )


def abstraction_ratio(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    interfaces = F.count_if(F.col("kind") == "interface")
    types = F.greatest(F.count_if(F.col("kind").isin("class", "abstract_class", "struct")), F.lit(1))
    return nodes.groupBy(*keys).agg(half_even(interfaces / (interfaces + types), 3).alias("abstraction_ratio"))


def average_instability(coupling_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over the shown coupling list, summed as decimals so that row order cannot move it."""
    mean = F.sum(F.col("instability").cast("decimal(18,3)")).cast("double") / F.count("*")
    return coupling_rows.groupBy(*keys).agg(
        F.bround(mean.cast("decimal(18,9)"), 3).cast("double").alias("average_instability")
    )


def layer_summary(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    layer = F.coalesce("attr.layer", F.lit("unassigned"))
    return nodes.filter(F.col("kind") == "module").groupBy(*keys, layer.alias("layer")).agg(F.count("*").alias("modules"))


def detect_patterns(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Naming and structure hints of ten patterns with a confidence; weak ones are left out."""
    typed = F.col("kind").isin("class", "interface", "abstract_class", "struct")
    stereo = lambda s: F.count_if(typed & (F.col("attr.stereotype") == s)).alias(s)
    instance = F.exists("attr.methods", lambda m: m["name"].isin("get_instance", "getInstance", "instance"))
    counted = nodes.groupBy(*keys).agg(
        *[stereo(s) for s in ("repository", "controller", "service", "factory", "adapter", "middleware")],
        F.count_if(F.col("kind") == "interface").alias("interfaces"),
        F.count_if(F.lower("name").rlike("observer|listener|subscriber|handler")).alias("observers"),
        F.count_if((F.col("kind") == "class") & F.coalesce(instance, F.lit(False))).alias("singletons"),
        F.count_if(F.col("kind") == "queue").alias("queues"),
        F.count_if(F.col("kind") == "container").alias("containers"),
    )
    impl = edges.filter(F.col("kind") == "implements").groupBy(*keys).agg(F.count("*").alias("implementations"))
    row = counted.join(impl, list(keys), "left").fillna(0, ["implementations"])
    c = F.col
    up_to = lambda x, n: F.least(x, F.lit(n))
    # Pattern, condition, confidence.
    table = (
        ("Repository", c("repository") > 0, 0.5 + 0.1 * up_to(c("repository"), 4), c("repository")),
        ("MVC / Layered", (c("controller") > 0) & (c("service") > 0),
         0.5 + 0.05 * up_to(c("controller") + c("service"), 8), c("controller") + c("service")),
        ("Factory", c("factory") > 0, 0.4 + 0.1 * up_to(c("factory"), 3), c("factory")),
        ("Adapter", c("adapter") > 0, 0.4 + 0.1 * up_to(c("adapter"), 3), c("adapter")),
        ("Chain of Responsibility", c("middleware") > 0, F.lit(0.4), c("middleware")),
        ("Dependency Inversion / DI", (c("interfaces") > 0) & (c("implementations") > 0),
         0.4 + 0.02 * up_to(c("implementations"), 20), c("implementations")),
        ("Observer / Event-driven", c("observers") >= 3, F.lit(0.45), c("observers")),
        ("Singleton", c("singletons") > 0, F.lit(0.55), c("singletons")),
        ("Message-driven integration", c("queues") > 0, F.lit(0.6), c("queues")),
        ("Microservices / Containerised deployment", c("containers") >= 3, F.lit(0.55), c("containers")),
    )
    found = F.array_compact(F.array(*[
        F.when(
            when & (conf >= 0.35),
            F.struct(
                F.lit(name).alias("pattern"), half_even(F.least(conf, F.lit(0.99)), 2).alias("confidence"),
                n.cast("bigint").alias("count"),
            ),
        )
        for name, when, conf, n in table
    ]))
    return row.select(*keys, F.inline(found))


def base_score(counts: DataFrame) -> DataFrame:
    """First score from the penalties of one metric row per key.

    Needs cycles, god_classes, violations, density, hubs and abstraction_ratio.
    """
    c = F.col
    out = counts.withColumns({
        "penalty_cycles": F.least(c("cycles") * 6, F.lit(25)),
        "penalty_god_classes": F.least(c("god_classes") * 4, F.lit(16)),
        "penalty_layering": F.least(c("violations") * 3, F.lit(18)),
        "penalty_coupling": F.least(F.floor(c("density") * 100), F.lit(15)),
        "penalty_hubs": F.least(c("hubs") * 2, F.lit(10)),
    })
    lost = sum((c(f"penalty_{n}") for n in ("god_classes", "layering", "coupling", "hubs")), c("penalty_cycles"))
    score = F.least(F.greatest(F.lit(100) - lost, F.lit(0)) + F.when(c("abstraction_ratio") > 0.15, 5).otherwise(0), F.lit(100))
    return out.withColumn("base_score", score.cast("int")).withColumn("base_grade", base_grade(c("base_score")))


def base_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("E")


def entropy(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy in bits of positive counts.

    Sum and sum of v*log2(v) are enough: H = log2(T) - S/T, one pass without a join.
    """
    v = F.col(value).cast("double")
    positive = values.filter(v > 0)
    agg = positive.groupBy(*keys).agg(F.sum(v).alias("t"), F.sum(v * F.log2(v)).alias("s"))
    return agg.select(*keys, F.abs(half_even(F.log2("t") - F.col("s") / F.col("t"), 3)).alias("entropy"))


def metric_row(
    nodes: DataFrame, edges: DataFrame, cycles: DataFrame, keys: Sequence[str] = KEYS,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """All scalar metrics of a run in one row, counted over whole lists; ``cycles`` has one row per cycle or component."""
    mod = stage(module_edges(edges, nodes, keys), "metric_edges")
    modules = stage(module_universe(nodes, mod, keys), "metric_modules")
    shape = stage(graph_shape(modules, mod, keys), "metric_shape")
    coupled = stage(coupling(modules, mod, keys, None), "metric_coupling")
    hubs = stage(hub_nodes(nodes, edges, keys, None), "metric_hubs")
    lists = (
        (cycles, "cycles"), (god_classes(nodes, edges, keys, None), "god_classes"), (hubs, "hubs"),
        (layering_violations(edges, nodes, keys, None), "violations"), (orphan_modules(modules, mod, keys, None), "orphans"),
    )
    out = nodes.select(*keys).distinct().join(shape, list(keys), "left")
    out = out.join(abstraction_ratio(nodes, keys), list(keys), "left")
    out = out.join(average_instability(coupled, keys), list(keys), "left")
    heavy = hubs.filter("degree >= 15")
    for frame, name in (*lists, (heavy, "heavy_hubs")):
        out = out.join(stage(frame.groupBy(*keys).agg(F.count("*").alias(name)), f"count_{name}"), list(keys), "left")
    populated = layer_summary(nodes, keys).groupBy(*keys).agg(F.count("*").alias("layer_count"))
    strong = stage(detect_patterns(nodes, edges, keys), "patterns").groupBy(*keys).agg(
        F.count("*").alias("patterns"), F.count_if(F.col("confidence") >= 0.5).alias("strong_patterns")
    )
    risky = coupled.groupBy(*keys).agg(
        F.count_if((F.col("instability") > 0.85) & (F.col("fan_in") >= 3)).alias("unstable_modules"),
        F.count_if(F.col("coupling") >= 15).alias("coupled_modules"),
    )
    out = out.join(populated, list(keys), "left").join(strong, list(keys), "left").join(risky, list(keys), "left")
    counts = [c for c in out.columns if c not in keys]
    return base_score(out.fillna(0, counts))


