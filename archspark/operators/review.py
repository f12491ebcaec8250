"""Deterministic review tables: risks, advice, requests and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.frames import substring_pairs, top_k
from archspark.operators.graph import union_all, with_degree
from archspark.schema import KEYS


def _finding_rows(cycles, gods, violations, hubs, keys) -> DataFrame:
    """(section, rank, kind, severity, subject, evidence) of the worst findings."""

    def rows(df, order, n, section, kind, severity, subject, evidence):
        return top_k(df, keys, order, n, rank="_n").select(
            *keys, F.lit(section).alias("section"), F.col("_n").alias("rank"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
            subject.cast("string").alias("subject"), F.array(*[e.cast("string") for e in evidence]).alias("evidence"))

    parts = [
        rows(cycles, [F.col("length"), F.col("members")], 3, 1, "cycle", "high", F.array_join("members", " → "), [F.col("length")]),
        rows(gods, [F.desc("severity"), F.col("id")], 3, 2, "god_class", "medium", F.col("name"), [F.col("methods"), F.col("dependencies")]),
        rows(violations, [F.col("from"), F.col("to")], 3, 3, "layering", "medium", F.concat("from", F.lit(" → "), "to"), [F.col("from_layer"), F.col("to_layer")]),
    ]
    if hubs is not None:
        parts.append(rows(hubs, [F.desc("degree"), F.col("id")], 2, 4, "hub", "low", F.col("name"), [F.col("degree")]))
    return union_all(*parts)


def _with_default(rows: DataFrame, projects: DataFrame, keys, kind: str) -> DataFrame:
    """Projects without a finding get one row that says so."""
    clean = projects.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")
    none = clean.select(
        *keys, F.lit(9).alias("section"), F.lit(1).alias("rank"), F.lit(kind).alias("kind"), F.lit("low").alias("severity"),
        F.lit("").alias("subject"), F.expr("cast(array() as array<string>)").alias("evidence"))
    return rows.unionByName(none)


def risk_register(projects, cycles, gods, violations, hubs, keys: Sequence[str] = KEYS) -> DataFrame:
    """Up to three cycles, three god classes, three violations and two hubs, or one row for none."""
    return _with_default(_finding_rows(cycles, gods, violations, hubs, keys), projects, keys, "no_issue")


def improvements(metrics: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Advice keys of one metric row per project, in order."""
    c = F.col
    keys_ = F.array_compact(F.array(
        F.when(c("cycles") > 0, "cycle"), F.when(c("god_classes") > 0, "god"), F.when(c("violations") > 0, "layer"),
        F.when(F.coalesce("abstraction_ratio", F.lit(0.0)) < 0.1, "abstraction")))
    advice = F.when(F.size(keys_) > 0, keys_).otherwise(F.array(F.lit("docs")))
    return metrics.select(*keys, F.posexplode(advice).alias("pos", "advice"))


def architecture_review(metrics: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strength rows of a project."""
    facts = nodes.groupBy(*keys).agg(
        F.bool_or((F.col("kind") == "file") & F.lower(F.coalesce("module", F.lit(""))).contains("test")).alias("tests"),
        F.count_if(F.col("kind") == "container").alias("containers"),
        F.count_distinct(F.when((F.col("kind") == "module") & (F.coalesce("attr.layer", F.lit("unassigned")) != "unassigned"), F.col("attr.layer"))).alias("named_layers"))
    row = metrics.join(facts, list(keys))
    found = F.array_compact(F.array(
        F.when(F.col("named_layers") >= 3, "layers"), F.when(F.col("abstraction_ratio") >= 0.12, "abstraction"),
        F.when(F.col("cycles") == 0, "no_cycle"), F.when(F.col("tests"), "tests"), F.when(F.col("containers") > 0, "containers")))
    return row.select(*keys, F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("strength"))


def refactoring_suggestions(projects, cycles, gods, violations, keys: Sequence[str] = KEYS) -> DataFrame:
    """Three each of cycles, god classes and violations with impact and effort, or the default row."""
    rows = _with_default(_finding_rows(cycles, gods, violations, None, keys), projects, keys, "docs")
    kind = F.col("kind")
    return rows.withColumns({
        "impact": F.when(kind == "cycle", "high").when(kind == "docs", "low").otherwise("medium"),
        "effort": F.when(kind == "god_class", "L").when(kind == "docs", "S").otherwise("M")})


def corpus_summary(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, limit: int = 40) -> DataFrame:
    """Largest components, best connected types and the integration surface of a project."""
    files = F.coalesce(F.col("attr.extra")["file_count"].try_cast("int"), F.lit(0))
    components = top_k(nodes.filter(F.col("kind") == "component").withColumn("n", files), keys, [F.desc("n"), F.col("id")], limit, rank="rank")
    types = nodes.filter(F.col("kind").isin("class", "interface", "abstract_class", "struct"))
    types = top_k(with_degree(types, edges, keys).withColumn("n", F.col("degree")), keys, [F.desc("n"), F.col("id")], limit, rank="rank")
    surface = nodes.filter(F.col("kind").isin("api_endpoint", "table", "database", "queue", "external_api", "container"))
    surface = top_k(surface.withColumn("n", F.lit(0)), [*keys, "kind"], [F.col("name"), F.col("id")], limit, rank="rank")
    pick = lambda df, section: df.select(*keys, F.lit(section).alias("section"), "kind", "rank", "name", F.col("n").cast("bigint").alias("n"))
    return union_all(pick(components, "components"), pick(types, "types"), pick(surface, "surface"))


def explain_view(view_nodes: DataFrame, view_edges: DataFrame, nodes: DataFrame, patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of a view, its six components with most methods, and up to five patterns."""
    count = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, F.lit(s).alias("section"), F.lit(1).alias("rank"), F.lit("").alias("name"), "n")
    shown = nodes.join(view_nodes.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")
    key = top_k(shown.withColumn("n", F.greatest(F.size("attr.methods"), F.lit(0)).cast("bigint")), keys, [F.desc("n"), F.col("id")], 6, rank="rank")
    best = top_k(patterns, keys, [F.desc("confidence"), F.col("pattern")], 5, rank="rank")
    return union_all(
        count(view_nodes, "elements"), count(view_edges, "relationships"),
        key.select(*keys, F.lit("key_component").alias("section"), "rank", "name", "n"),
        best.select(*keys, F.lit("pattern").alias("section"), "rank", F.col("pattern").alias("name"), F.col("count").alias("n")))


# --------------------------------------------------------------------------- requests

# Words of a request, view by view in order, and sizes.
VIEW_WORDS = (
    ("sequence", ("sequence", "flow of", "call flow", "interaction", "login flow", "payment flow", "רצף", "זרימה")),
    ("database", ("database", "schema", "er ", "tables", "entity relationship", "בסיס נתונים", "טבלאות")),
    ("deployment", ("deploy", "kubernetes", "docker", "infrastructure", "runtime topology", "פריסה", "תשתית")),
    ("dependency", ("dependency", "dependencies", "coupling", "circular", "cycle", "תלות", "תלויות")),
    ("dataflow", ("data flow", "dataflow", "security boundar", "trust boundar", "privacy", "זרימת נתונים", "אבטחה")),
    ("class", ("class", "uml", "inheritance", "types", "מחלקות", "ירושה")),
    ("component", ("component", "module view", "boundaries", "interfaces", "רכיבים", "ממשקים")),
    ("state", ("state machine", "states", "lifecycle", "status", "מצבים", "מחזור חיים")),
    ("architecture", ("architecture", "overview", "high level", "system", "executive", "customer", "ארכיטקטורה", "מערכת")),
)
EXECUTIVE_WORDS = ("executive", "customer", "simplified", "high level", "overview", "מנהלים", "פשוט", "לקוח")
DETAILED_WORDS = ("detailed", "deep", "full", "everything", "מפורט")
SIZE_WORDS = (("small", 12), ("tiny", 8), ("minimal", 10), ("simple", 14), ("brief", 12), ("compact", 14), ("קטן", 12), ("פשוט", 14))
EXTERNAL_WORDS = ("external", "third party", "integration", "חיצוני")
STOP_WORDS = (
    "show", "create", "diagram", "only", "the", "for", "with", "please", "make", "view", "that", "this", "need", "want", "generate",
    "draw", "build", "architecture", "flow", "system", "customer", "facing", "simplified", "executive", "dependencies", "small", "tiny",
    "minimal", "simple", "brief", "compact", "large", "full", "detailed", "deep",
)


def _any(text: Column, words) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def classify_request(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """View kind, detail, node budget and external flag of each free-text request."""
    low = F.lower(prompt)
    kind = F.lit("architecture")
    for name, words in reversed(VIEW_WORDS):
        kind = F.when(_any(low, words), name).otherwise(kind)
    size = F.lit(None).cast("int")
    for word, n in reversed(SIZE_WORDS):
        size = F.when(low.contains(word), n).otherwise(size)
    base = F.when(_any(low, EXECUTIVE_WORDS), "executive").when(_any(low, DETAILED_WORDS), "detailed").otherwise("standard")
    return prompts.withColumns({
        "kind": kind, "detail": F.when(size.isNotNull() & (base == "standard"), "executive").otherwise(base),
        "max_nodes": F.least(F.when(base == "executive", 18).otherwise(60), F.coalesce(size, F.lit(60))),
        "include_external": _any(low, EXTERNAL_WORDS)})


def request_scope(prompts: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, prompt: str = "prompt") -> DataFrame:
    """Modules and focus word of each request, from the words it shares with component and module names.

    Names and requests meet on single words, an equi join; the whole name is then
    looked for in the request.
    """
    shown = F.when(F.coalesce("qualified_name", F.lit("")) != "", F.col("qualified_name")).otherwise(F.col("name"))
    known = nodes.filter(F.col("kind").isin("component", "module")).select(
        *keys, F.when(F.col("kind") == "component", F.col("name")).otherwise(shown).alias("module")).distinct()
    word = r"[^A-Za-z0-9_֐-׿]+"
    named = known.withColumn("token", F.explode(F.array_distinct(F.filter(F.split(F.lower("module"), word), lambda t: t != ""))))
    asked = prompts.withColumn("token", F.explode(F.array_distinct(F.filter(F.split(F.lower(prompt), word), lambda t: t != ""))))
    met = asked.join(named, [*keys, "token"])
    whole = F.lower(prompt).contains(F.lower("module"))
    focus_word = (F.char_length("token") > 3) & ~F.col("token").isin(*STOP_WORDS)
    modules = top_k(met.filter(whole).select(*keys, "id", "module").distinct(), [*keys, "id"], [F.col("module")], 5)
    modules = modules.groupBy(*keys, "id").agg(F.array_sort(F.collect_list("module")).alias("modules"))
    focus = met.filter(focus_word).groupBy(*keys, "id").agg(
        F.min_by("token", F.struct(F.instr(F.lower(prompt), F.col("token")), "token")).alias("focus"))
    return prompts.join(modules, [*keys, "id"], "left").join(focus, [*keys, "id"], "left")


def sanitize_filters(requests: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop a focus that no node's name, path or stereotype holds, and put known module names for the asked ones.

    A module is known by its name in any case, as the start of one, or as a part of one; the closest wins. Names and
    requests are reduced to distinct lower-cased words per key, which meet over an index of letter runs (``substring_pairs``).
    """
    keys = list(keys)
    shown = [F.col(c) for c in ("name", "qualified_name", "module", "file")] + [F.col("attr.stereotype")]
    names = nodes.select(*keys, F.explode(F.array_distinct(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in shown]))).alias("known"))
    asked = requests.select(*keys, F.lower("focus").alias("focus_lc"))
    borne = substring_pairs(asked, names, keys, "focus_lc", "known").select(*keys, "focus_lc").distinct().withColumn("borne", F.lit(True))
    out = requests.withColumn("focus_lc", F.lower("focus")).join(borne, [*keys, "focus_lc"], "left")
    out = out.withColumn("focus", F.when(F.col("borne"), F.col("focus")).otherwise("")).drop("focus_lc", "borne")
    real = nodes.filter(F.col("kind") == "module").select(*keys, F.col("module").alias("real"), F.lower("module").alias("low")).filter("real <> ''").distinct()
    words = requests.select(*keys, F.explode("modules").alias("m")).select(*keys, F.lower("m").alias("m"))
    met = substring_pairs(words, real, keys, "m", "low").join(real, [*keys, "low"])
    nearness = F.when(F.col("low") == F.col("m"), 0).when(F.col("low").startswith(F.col("m")), 1).otherwise(2)
    best = met.groupBy(*keys, "m").agg(
        F.min(F.struct(nearness.alias("near"), F.char_length("real").alias("size"), F.col("real").alias("real"))).alias("best"))
    wanted = requests.select(*keys, "id", F.explode("modules").alias("m")).withColumn("m", F.lower("m")).join(best, [*keys, "m"])
    kept = wanted.groupBy(*keys, "id").agg(F.array_sort(F.collect_set("best.real")).alias("kept"))
    return out.join(kept, [*keys, "id"], "left").withColumn("modules", F.coalesce("kept", F.expr("cast(array() as array<string>)"))).drop("kept")


__all__ = [
    "architecture_review", "classify_request", "corpus_summary", "explain_view", "improvements", "refactoring_suggestions",
    "request_scope", "risk_register", "sanitize_filters",
]
