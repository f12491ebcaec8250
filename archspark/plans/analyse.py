"""The whole analysis of many projects as one batch job with written stages.

Each stage is a table under ``work``: a lost executor repeats tasks of one stage,
and later stages read narrow tables instead of the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.functions.paths import project_file_flags
from archspark.operators import graph as g
from archspark.operators import history as h
from archspark.operators import iterate as it
from archspark.operators import metrics as m
from archspark.operators import quality as q
from archspark.operators import resolve as rs
from archspark.operators import score as sc
from archspark.operators.extract import extract_all
from archspark.schema import KEYS


@dataclass
class Analysis:
    """Tables of a run set, by name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError as exc:
            raise AttributeError(name) from exc


class Stages:
    """Write a table partitioned by the keys and read it back."""

    def __init__(self, spark: SparkSession, work: str, keys: Sequence[str]):
        self.spark, self.work, self.keys = spark, work.rstrip("/"), list(keys)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.work}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        return back.select(*df.columns)


def enrich(nodes: DataFrame, edges: DataFrame, stage: Stages, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Layers, components, services, derived reads, the user, and state machines.

    Each step reads the nodes of the one before several times, so they are staged.
    """
    nodes = stage(g.assign_layers(nodes, edges, keys), "layered_nodes")
    components, contains = g.build_components(nodes, edges, keys)
    components, contains = stage(components, "components"), stage(contains, "component_edges")
    nodes = stage(g.merge_nodes(nodes, components, keys=keys), "component_nodes")
    lifted = stage(g.lift_edges(edges, nodes, nodes.filter(F.col("kind") == "component"), keys), "lifted_edges")
    nodes, deploys = g.mark_services(nodes, keys)
    nodes, deploys = stage(nodes, "service_nodes"), stage(deploys, "deploy_edges")
    actor, actor_edges = g.derive_actor(nodes, keys)
    reads, reach = stage(g.derive_reads(edges, nodes, keys), "read_edges"), stage(it.endpoint_store_reads(edges, nodes, keys), "reach_edges")
    nodes = g.mark_state_machines(nodes.unionByName(actor))
    return nodes, g.merge_edges(edges, contains, lifted, deploys, reads, reach, actor_edges, keys=keys)


def analyse(
    spark: SparkSession, files: DataFrame, work: str, commits: DataFrame | None = None,
    weights: DataFrame | None = None, keys: Sequence[str] = KEYS,
) -> Analysis:
    """From files (and commits) to graph, findings, metrics, history and scorecard."""
    keys, stage = list(keys), Stages(spark, work, keys)
    files = stage(files, "files")
    raw = extract_all(files, keys, stage)
    nodes = stage(raw.nodes, "raw_nodes")
    edges = stage(g.merge_edges(g.link(stage(raw.edges, "found_edges"), nodes, keys), keys=keys), "raw_edges")
    columns, fks, indexes = stage(raw.columns, "table_columns"), stage(raw.fks, "table_fks"), stage(raw.indexes, "table_indexes")
    ext_nodes, resolved, resolution = rs.resolve_all(nodes, edges, stage(raw.refs, "refs"), keys, stage)
    ext_nodes, resolved = stage(ext_nodes, "external_nodes"), stage(resolved, "made_edges")
    nodes = stage(g.merge_nodes(nodes, ext_nodes, keys=keys), "named_nodes")
    edges = stage(g.merge_edges(edges, g.link(resolved, nodes, keys), keys=keys), "resolved_edges")
    nodes, edges = enrich(nodes, edges, stage, keys)
    nodes, edges = stage(nodes, "enriched_nodes"), stage(edges, "edges")

    profiled = stage(q.profile_files(files, keys), "profiled")
    profiles = q.file_profiles(profiled)
    nodes = q.annotate_quality(nodes, profiles, keys)
    out: dict[str, DataFrame] = {}
    if commits is not None:
        touches = h.touches_from_commits(commits, keys)
        churn = stage(h.file_churn(touches, keys), "file_churn")
        parts = stage(h.component_churn(touches, keys, None), "component_churn")
        nodes = h.annotate_history(nodes, churn, parts, keys)
        out["hotspots"] = h.hotspot_risk(churn, keys)
        out["history_risks"] = h.history_risks(parts, out["hotspots"], keys)
        out["temporal_coupling"] = h.co_change(touches, keys)
    nodes = stage(nodes, "nodes")
    findings, markers = q.findings_of(profiled, keys), q.markers_of(profiled, keys)
    kept, marks = stage(q.top_findings(findings, keys), "findings"), stage(q.top_markers(markers, keys), "markers")
    mod = stage(m.module_edges(edges, nodes, keys), "module_edges")
    cycles = stage(it.find_cycles(mod, keys), "cycles")
    cyclic = stage(it.cyclic_components(mod, keys), "cyclic_components")
    metrics = stage(m.metric_row(nodes, edges, it.counted_cycles(cyclic, keys), keys, stage), "metrics")
    unindexed = sc.unindexed_foreign_keys(fks, indexes, columns, keys)

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(name))

    prefix = {"security": "sec", "performance": "perf", "debt": "debt"}
    by_kind = findings.groupBy(*keys).agg(*[
        F.count_if((F.col("category") == c) & (F.col("severity") == s)).alias(f"{p}_{s}")
        for c, p in prefix.items() for s in ("critical", "high", "medium", "low")])
    parts = [
        q.quality_totals(profiles, keys), q.doc_totals(files, keys), q.complexity_profile(nodes, keys), q.symbol_doc_coverage(nodes, keys),
        project_file_flags(files, keys), by_kind, count(q.untested_modules(profiles, keys), "untested"),
        profiles.filter(~F.col("is_test")).groupBy(*keys).agg(F.count_distinct("module").alias("source_modules")),
        count(q.wide_signatures(nodes, keys), "wide"), count(markers, "markers"), count(unindexed, "unindexed"),
    ]
    if commits is not None:
        parts.append(out["hotspots"].groupBy(*keys).agg(F.count("*").alias("hotspots"), F.count_if(F.col("risk") == "high").alias("risky_hotspots")))
    facts = metrics
    for i, part in enumerate(parts):
        facts = facts.join(stage(part, f"score_part_{i}"), keys, "left")
    facts = stage(sc.fact_row(facts, keys), "score_facts")
    signals = stage(sc.score_signals(facts, keys), "signals")
    resolution, warnings = stage(resolution, "resolution"), stage(raw.warnings, "warnings")
    active = sc.normalise_weights(weights) if weights is not None else sc.default_weights(spark)
    cats = stage(sc.category_scores(signals, facts, active, keys, sc.confidence(facts, keys)), "category_scores")
    recommendations = stage(sc.recommendation_rows(signals, keys=keys), "recommendations")
    actions = sc.roadmap(recommendations, active, keys)
    out.update(
        files=files, nodes=nodes, edges=edges, file_profiles=profiles, findings=kept, markers=marks, module_edges=mod, cycles=cycles, cyclic_components=cyclic, metrics=metrics,
        table_columns=columns, table_fks=fks, table_indexes=indexes, signals=signals, category_scores=cats,
        scorecard=sc.overall_score(cats, keys), recommendations=recommendations, roadmap=actions,
        resolution=resolution, warnings=warnings, unindexed=unindexed,
    )
    return Analysis(out)


def run_stats(a: Analysis, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of a run: files, nodes of the main kinds, warnings, resolution and main language."""
    keys = list(keys)
    kind = F.col("kind")
    nodes = a.nodes.groupBy(*keys).agg(
        F.count_if(kind == "component").alias("components"), F.count_if(kind == "api_endpoint").alias("endpoints"),
        F.count_if(kind == "table").alias("tables"), F.count_if(kind == "container").alias("containers"), F.count("*").alias("node_count"))
    files = a.files.groupBy(*keys, "language").agg(F.count("*").alias("n"))
    files = files.groupBy(*keys).agg(F.sum("n").alias("files_scanned"), F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("primary_language"))
    warned = a.warnings.groupBy(*keys).agg(F.count("*").alias("warnings"))
    return files.join(nodes, keys, "left").join(a.resolution, keys, "left").join(warned, keys, "left").fillna(0, ["warnings"])
