"""Churn, ownership, co-change and commit-graph measures over commit tables."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions.frames import half_even, top_k
from archspark.functions.paths import component_of
from archspark.schema import KEYS
from archspark.session import cut_lineage, staged

PAIR_COMMIT_FILES = 25


def touches_from_commits(commits: DataFrame, keys: Sequence[str] = KEYS, per_commit: int | None = None) -> DataFrame:
    """One row per (commit, file) from commits that carry a ``files`` array: no shuffle."""
    files = F.col("files") if per_commit is None else F.slice("files", 1, per_commit)
    return commits.select(*keys, "sha", "author", "ts", F.explode(files).alias("path"))


def touches_from_files(
    commits: DataFrame, commit_files: DataFrame, keys: Sequence[str] = KEYS, per_commit: int | None = None
) -> DataFrame:
    """One row per (commit, file) from a child table; of each commit the first ``per_commit`` paths, if given."""
    order = [F.col("pos")] if "pos" in commit_files.columns else [F.col("path")]
    kept = commit_files if per_commit is None else top_k(commit_files, [*keys, "sha"], order, per_commit)
    return kept.join(commits.select(*keys, "sha", "author", "ts"), [*keys, "sha"]).select(
        *keys, "sha", "author", "ts", "path"
    )


def file_churn(touches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes, distinct authors, primary owner and last change per file.

    The first aggregate is by (file, author), so a file that every commit touches
    is reduced on the map side before its rows meet.
    """
    by_author = touches.groupBy(*keys, "path", "author").agg(
        F.count("*").alias("n"), F.max("ts").alias("last")
    )
    return by_author.groupBy(*keys, "path").agg(
        F.sum("n").alias("changes"),
        F.count("*").alias("authors"),
        F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("primary_owner"),
        F.max("last").alias("last_changed"),
    )


def hotspot_risk(churn: DataFrame, keys: Sequence[str] = KEYS, limit: int = 25) -> DataFrame:
    """Most changed files with a risk word relative to the busiest file of the key."""
    top = top_k(churn, keys, [F.desc("changes"), F.col("path")], limit, rank="rank")
    # at most ``limit`` rows per key are left, the busiest file among them
    share = F.col("changes") / F.greatest(F.max("changes").over(Window.partitionBy(*keys)), F.lit(1))
    return top.withColumn(
        "risk",
        F.when((share > 0.6) & (F.col("authors") <= 2), "high").when(share > 0.4, "medium").otherwise("low"),
    )


def component_churn(touches: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 12) -> DataFrame:
    """Changes, contributors and primary owner per component (first path segment)."""
    by_author = (
        touches.withColumn("component", component_of(F.col("path")))
        .groupBy(*keys, "component", "author")
        .agg(F.count("*").alias("n"))
    )
    out = by_author.groupBy(*keys, "component").agg(
        F.sum("n").alias("changes"),
        F.count("*").alias("contributors"),
        F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("primary_owner"),
    )
    return out if limit is None else top_k(out, keys, [F.desc("changes"), F.col("component")], limit)


def author_commits(commits: DataFrame, keys: Sequence[str] = KEYS, limit: int = 10) -> DataFrame:
    counted = commits.groupBy(*keys, "author").agg(F.count("*").alias("commits"))
    return top_k(counted, keys, [F.desc("commits"), F.col("author")], limit)


def contributor_share(top: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the shown total; ``top`` is the short list of :func:`author_commits`."""
    total = F.sum("commits").over(Window.partitionBy(*keys))
    return top.withColumn("share", half_even(F.col("commits") / total, 4))


def activity_by_month(commits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return commits.groupBy(*keys, F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("commits")
    )


def history_summary(commits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return commits.groupBy(*keys).agg(
        F.count("*").alias("commit_count"),
        F.min("ts").alias("first_commit"),
        F.max("ts").alias("last_commit"),
        F.count_distinct("author").alias("contributors"),
    )


def co_change(
    touches: DataFrame,
    keys: Sequence[str] = KEYS,
    min_together: int = 3,
    limit: int = 15,
    max_files: int = PAIR_COMMIT_FILES,
) -> DataFrame:
    """File pairs that change in the same commit, over commits of 2..``max_files`` touched files.

    A wider commit carries no pair by definition.  Its rows are cut to
    ``max_files + 1`` per task before the shuffle, which is all that is needed to
    see that it is too wide, so a commit of any size costs a bounded amount.
    """
    narrow = top_k(touches, [*keys, "sha"], [F.col("path")], max_files + 1)
    grouped = (
        narrow.groupBy(*keys, "sha")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .filter(F.size("paths").between(2, max_files))
    )
    first = grouped.select(*keys, "paths", F.posexplode("paths").alias("pos", "file_a"))
    pairs = first.select(
        *keys, "file_a", F.explode(F.expr("slice(paths, pos + 2, size(paths))")).alias("file_b")
    )
    # a commit of n files makes n * (n - 1) / 2 pairs, few of them equal within a task: the tables that count them are sized by the pairs
    # themselves, not by the commits; a pair comes once a commit, so none has more rows than there are commits
    pairs = pairs.repartition(*keys, "file_a", "file_b")
    counted = pairs.groupBy(*keys, "file_a", "file_b").agg(F.count("*").alias("together"))
    return top_k(
        counted.filter(F.col("together") >= min_together),
        keys, [F.desc("together"), F.col("file_a"), F.col("file_b")], limit,
    )


def history_risks(
    components: DataFrame, hotspots: DataFrame, keys: Sequence[str] = KEYS, limit: int = 10
) -> DataFrame:
    """Change magnets, single-owner components and risky hotspots, in that order.

    ``components`` is :func:`component_churn` without its limit.
    """
    totals = components.groupBy(*keys).agg(
        F.sum("changes").alias("total"),
        F.min(F.struct((-F.col("changes")).alias("neg"), F.col("component"))).alias("top"),
    )
    share = -F.col("top.neg") / F.col("total")
    percent = F.format_string("%.0f", F.bround(share * 100, 0))
    magnet = totals.filter(share > 0.35).select(
        *keys, F.lit(1).alias("section"), F.lit("high").alias("severity"),
        F.col("top.component").alias("area"), F.col("top.neg").alias("ord"),
        F.concat(percent, F.lit(" percent of the changes went to "), F.col("top.component")).alias("message"),
    )
    bus = components.filter((F.col("changes") >= 20) & (F.col("contributors") == 1)).select(
        *keys, F.lit(2).alias("section"), F.lit("medium").alias("severity"),
        F.col("component").alias("area"), (-F.col("changes")).alias("ord"),
        F.concat(F.lit("only "), F.col("primary_owner").cast("string"), F.lit(" changes "), F.col("component")).alias("message"),
    )
    hot = hotspots.filter((F.col("rank") <= 3) & (F.col("risk") == "high")).select(
        *keys, F.lit(3).alias("section"), F.lit("medium").alias("severity"),
        F.col("path").alias("area"), (-F.col("changes")).alias("ord"),
        F.concat(F.col("path"), F.lit(": "), F.col("changes").cast("string"), F.lit(" changes, authors: "), F.col("authors").cast("string")).alias("message"),
    )
    rows = magnet.unionByName(bus).unionByName(hot)
    return top_k(rows, keys, [F.col("section"), F.col("ord"), F.col("area")], limit, rank="seq").select(
        *keys, "seq", "severity", "area", "message"
    )


def annotate_history(
    nodes: DataFrame, churn: DataFrame, components: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Change counts on file nodes (by path) and component nodes (by name)."""
    files = churn.select(
        *keys, F.lit("file").alias("kind"), F.col("path").alias("_name"),
        F.col("changes").alias("change_count"), F.col("authors").alias("_authors"), "last_changed",
    )
    parts = components.select(
        *keys, F.lit("component").alias("kind"), F.col("component").alias("_name"),
        F.col("changes").alias("change_count"), F.col("contributors").alias("_authors"),
        F.lit(None).cast("timestamp").alias("last_changed"),
    )
    named = nodes.withColumn(
        "_name", F.when(F.col("kind") == "file", F.col("qualified_name")).otherwise(F.col("name"))
    )
    joined = named.join(files.unionByName(parts), [*keys, "kind", "_name"], "left")
    known = F.col("change_count").isNotNull()
    extra = F.coalesce(F.col("attr.extra"), F.create_map().cast("map<string,string>"))
    attr = (
        F.col("attr")
        .withField("change_count", F.coalesce("change_count", F.col("attr.change_count")))
        .withField("authors", F.coalesce("_authors", F.col("attr.authors")))
        .withField(
            "extra",
            F.when(
                known & F.col("last_changed").isNotNull(),
                F.map_concat(
                    F.map_filter(extra, lambda k, _: k != "last_changed"),
                    F.create_map(F.lit("last_changed"), F.col("last_changed").cast("string")),
                ),
            ).otherwise(F.col("attr.extra")),
        )
    )
    return joined.withColumn("attr", attr).select(*nodes.columns)


# --------------------------------------------------------------------------- commit graph


def commit_parent_edges(dag: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(commit, parent) rows; ``truncated`` marks parents outside the window."""
    links = dag.select(
        *keys, "sha", (F.size("parents") > 1).alias("is_merge"),
        F.posexplode("parents").alias("pos", "parent"),
    ).withColumn("continues", F.col("pos") == 0)
    known = dag.select(*keys, F.col("sha").alias("parent"), F.lit(True).alias("known")).distinct()
    return links.join(known, [*keys, "parent"], "left").select(
        *keys, "sha", "parent", "pos", "continues", "is_merge", F.col("known").isNull().alias("truncated")
    )


def classify_refs(dag: DataFrame, keys: Sequence[str] = KEYS, decoration: str = "decoration") -> DataFrame:
    """Split a decoration list into (name, kind) rows: head, tag, remote or branch."""
    items = dag.select(*keys, "sha", F.explode(F.split(F.coalesce(F.col(decoration), F.lit("")), ",")).alias("raw"))
    item = F.trim("raw")
    return (
        items.withColumn("item", item)
        .filter(F.col("item") != "")
        .select(
            *keys, "sha",
            F.regexp_replace("item", r"^(HEAD -> |tag: )", "").alias("name"),
            F.when(F.col("item").startswith("HEAD -> ") | (F.col("item") == "HEAD"), "head")
            .when(F.col("item").startswith("tag: "), "tag")
            .when(F.col("item").startswith("origin/"), "remote")
            .otherwise("branch").alias("kind"),
        )
    )


def ref_names(refs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct branch (head or branch) and tag names."""
    group = F.when(F.col("kind") == "tag", "tag").when(F.col("kind").isin("branch", "head"), "branch")
    return refs.select(*keys, group.alias("kind"), "name").filter("kind is not null").distinct()


class LaneBoard:
    """Which lanes await which commit, and which are free; the lowest lane always goes first."""

    def __init__(self):
        self.awaiting: dict[str, set[int]] = {}
        self.free: list[int] = []
        self.width = 0

    def lane_of(self, sha: str) -> int:
        """The lane that awaits the commit, or one that from now on does."""
        if sha not in self.awaiting:
            if not self.free:
                heapq.heappush(self.free, self.width)
                self.width += 1
            self.awaiting[sha] = {heapq.heappop(self.free)}
        return min(self.awaiting[sha])

    def place(self, sha: str, parents: list[str]) -> tuple[int, list[int]]:
        """Lane of a commit and the lanes of its parents: the first goes on in the commit's lane."""
        lane = self.lane_of(sha)
        ended = self.awaiting.pop(sha) - ({lane} if parents else set())
        for other in ended:
            heapq.heappush(self.free, other)
        if not parents:
            return lane, []
        self.awaiting.setdefault(parents[0], set()).add(lane)
        return lane, [lane, *(self.lane_of(p) for p in parents[1:])]

    def open_lanes(self) -> list[int]:
        return sorted(lane for lanes in self.awaiting.values() for lane in lanes)

    def state(self) -> dict:
        awaiting = [{"sha": sha, "lanes": sorted(lanes)} for sha, lanes in sorted(self.awaiting.items())]
        return {"awaiting": awaiting, "free": sorted(self.free), "width": self.width}

    @classmethod
    def resumed(cls, state) -> LaneBoard:
        board = cls()
        board.awaiting = {a["sha"]: set(a["lanes"]) for a in state["awaiting"]}
        board.free = list(state["free"])
        board.width = int(state["width"])
        return board


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row") -> DataFrame:
    """Number the rows of each key from 1 in the given order, without a task that holds a whole key.

    Rows are dealt by ranges of key and order and numbered in their range; the ranges of a key, at most one per partition, are counted
    and summed up.
    """
    keys = list(keys)
    dealt = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("part_", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    within = dealt.withColumn("rank_", F.row_number().over(Window.partitionBy("part_", *keys).orderBy(*order)))
    sizes = dealt.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "part_", F.coalesce(upto, F.lit(0)).alias("before_"))
    joined = within.join(offsets, [*keys, "part_"])
    return joined.withColumn(name, (F.col("before_") + F.col("rank_")).cast("int")).drop("part_", "rank_", "before_", "n_")


_LINKS = "array<struct<from:int,to:int,parent:string>>"
_STATE = "struct<awaiting:array<struct<sha:string,lanes:array<int>>>,free:array<int>,width:int>"


def assign_lanes(
    dag: DataFrame, keys: Sequence[str] = KEYS, max_commits: int | None = None, order: str = "seq", block: int = 100_000
) -> DataFrame:
    """Lane of every commit of each repository, newest first (of the newest ``max_commits``, if given).

    A lane depends on every commit before it, so commits go through in blocks of ``block``: each round takes the next block of all
    repositories at once, and hands the lanes that are open or free at its end to the next round through a written table. A task
    holds one block and the open lanes of a repository. There are as many rounds as the largest repository has blocks.
    """
    names = list(keys)
    if max_commits is None:
        ranked = number_rows(dag.select(*names, order, "sha", "parents"), names, [order, "sha"])
    else:
        ranked = top_k(dag, names, [F.col(order), F.col("sha")], max_commits, rank="row")
    small = cut_lineage(ranked.select(*names, "row", "sha", "parents", F.floor((F.col("row") - 1) / block).cast("int").alias("block")))
    key_types = ", ".join(f"{n} {small.schema[n].dataType.simpleString()}" for n in names)
    columns = [*names, "row", "sha", "lane", "links", "open_lanes", "state"]

    def place(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=columns)
        board = LaneBoard() if before.empty else LaneBoard.resumed(before["state"].iloc[0])
        out = []
        for row in group.sort_values("row").to_dict("records"):
            parents = [] if row["parents"] is None else list(row["parents"])
            lane, targets = board.place(row["sha"], parents)
            links = [{"from": lane, "to": to, "parent": p} for to, p in zip(targets, parents)]
            out.append([*(row[n] for n in names), row["row"], row["sha"], lane, links, board.open_lanes(), None])
        out[-1][-1] = board.state()
        return pd.DataFrame(out, columns=columns)

    schema = f"{key_types}, row int, sha string, lane int, links {_LINKS}, open_lanes array<int>, state {_STATE}"
    rounds = (small.agg(F.max("block")).first()[0] or 0) + 1
    done, state = None, small.limit(0).select(*names, F.lit(None).cast(_STATE).alias("state"))
    for n in range(rounds):
        part = small.filter(F.col("block") == n).drop("block")
        placed = staged(part.groupBy(*names).cogroup(state.groupBy(*names)).applyInPandas(place, schema), "lanes")
        state = placed.filter("state IS NOT NULL").select(*names, "state")
        rows = placed.drop("state")
        done = rows if done is None else done.unionByName(rows)
    return done
