"""The whole scorecard over one fact row per customer, in which every threshold of the eight categories is crossed.

The facts are whole-number arithmetic on the customer's key and number of orders, the same text in both engines. The SQL states each signal
by itself: condition, points, severity and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import score as sc
from archspark.queries.registry import query, table

K = ["project_id"]

FACTS = {
    "cycles": "(k + n) % 8", "violations": "(k * 3 + n) % 11", "hubs": "k % 5", "heavy_hubs": "n % 4", "orphans": "(k + 2 * n) % 7",
    "density": "((k * 7 + n) % 40) / 100.0", "module_count": "k % 12", "abstraction_ratio": "(k % 40) / 100.0", "strong_patterns": "n % 5",
    "layer_count": "k % 6", "measured": "((k * 5) % 60) * (k % 4)", "average": "(k % 23) / 2.0", "over_threshold": "n % 9",
    "max": "(k * 3) % 55", "wide": "k % 9", "code_lines": "(k * 11 + n * 37) % 5000", "long_lines": "(k + n * 13) % 400",
    "huge_files": "k % 4", "large_files": "n % 6", "files": "k % 50", "loc": "(k * 29 + n) % 9000", "comment_lines": "(k * 3 + n) % 500",
    "source_files": "(k + n) % 30", "test_files": "k % 11", "source_loc": "(k * 17) % 9000", "test_loc": "(n * 97) % 2500",
    "assertions": "(k * 2 + n) % 40", "documented_modules": "n % 20", "deprecated": "k % 10", "doc_pages": "n % 3",
    "doc_words": "(k * 13) % 900", "public_symbols": "k % 7", "coverage": "((k * 3 + n) % 100) / 100.0", "untested": "n % 8",
    "source_modules": "(k + n) % 13", "god_classes": "k % 8", "coupled_modules": "n % 9", "unstable_modules": "(k + n) % 6",
    "hotspots": "k % 3", "risky_hotspots": "((n * 2 + k) % 8) * (k % 2)",
    "sec_critical": "CASE WHEN k % 4 = 0 THEN n % 5 ELSE 0 END", "sec_high": "CASE WHEN k % 3 = 0 THEN n % 6 ELSE 0 END",
    "sec_medium": "CASE WHEN k % 5 < 2 THEN n % 7 ELSE 0 END", "sec_low": "CASE WHEN k % 7 < 3 THEN n % 9 ELSE 0 END",
    "perf_high": "CASE WHEN k % 5 = 1 THEN n % 5 ELSE 0 END", "perf_medium": "CASE WHEN k % 3 = 1 THEN n % 8 ELSE 0 END",
    "perf_low": "CASE WHEN k % 4 = 2 THEN n % 9 ELSE 0 END", "unindexed": "CASE WHEN k % 6 < 3 THEN n % 7 ELSE 0 END",
    "markers": "CASE WHEN k % 8 = 0 THEN 0 ELSE (k + n) % 40 END", "debt_high": "CASE WHEN k % 5 = 2 THEN n % 6 ELSE 0 END",
    "debt_medium": "n % 8", "debt_low": "k % 11",
}
FLAGS = {"ci": "k % 3 = 0", "coverage_config": "n % 2 = 0", "readme": "k % 4 <> 1", "license": "n % 3 <> 0"}

# category | signal | condition | points | severity (info: a credit) | value
SIGNALS = """
architecture | arch.cycles | cycles > 0 | least(cycles * 5, 28) | CASE WHEN cycles > 2 THEN 'high' ELSE 'medium' END | cycles
architecture | arch.acyclic | cycles = 0 | 3 | 'info' | NULL
architecture | arch.layering | violations > 0 | least(violations * 3, 22) | CASE WHEN violations > 6 THEN 'high' ELSE 'medium' END | violations
architecture | arch.hubs | hubs > 0 | least(hubs * 2 + heavy_hubs * 1.5, 14) | 'medium' | hubs
architecture | arch.orphans | orphans > 0 | least(orphans * 1.5, 8) | 'low' | orphans
architecture | arch.density | density > 0.12 AND module_count > 5 | least((density - 0.12) * 180, 12) | 'medium' | density
architecture | arch.patterns | strong_patterns >= 3 | 5 | 'info' | strong_patterns
architecture | arch.layered | layer_count >= 4 | 4 | 'info' | layer_count
architecture | arch.abstraction | abstraction_ratio > 0.15 | 3 | 'info' | abstraction_ratio
code_quality | quality.average_complexity | measured > 0 AND average > 6 | least((average - 6) * 4, 18) | 'medium' | average
code_quality | quality.complex_functions | measured > 0 AND over_threshold > 0 | least(over_threshold / measured * 130, 24) | CASE WHEN over_threshold / measured > 0.15 THEN 'high' ELSE 'medium' END | over_threshold
code_quality | quality.peak_complexity | measured > 0 AND max >= 25 | CASE WHEN max >= 40 THEN 8 ELSE 4 END | CASE WHEN max >= 40 THEN 'high' ELSE 'medium' END | max
code_quality | quality.simple | measured > 0 AND average <= 4 AND over_threshold = 0 | 5 | 'info' | NULL
code_quality | quality.wide_signatures | wide > 0 | least(wide * 1.5, 9) | 'low' | wide
code_quality | quality.file_size | huge_files + large_files > 0 | least(huge_files * 3 + large_files * 1.2, 14) | CASE WHEN huge_files > 0 THEN 'medium' ELSE 'low' END | huge_files + large_files
code_quality | quality.long_lines | code_lines > 0 AND long_lines / code_lines > 0.05 | least(long_lines / code_lines * 60, 6) | 'low' | long_lines
security | security.critical | sec_critical > 0 | least(sec_critical * 20, 60) | 'critical' | sec_critical
security | security.high | sec_high > 0 | least(sec_high * 9, 32) | 'high' | sec_high
security | security.medium | sec_medium > 0 | least(sec_medium * 3, 16) | 'medium' | sec_medium
security | security.low | sec_low > 0 | least(sec_low, 6) | 'low' | sec_low
security | security.clean | sec_critical + sec_high + sec_medium + sec_low = 0 AND files > 0 | 6 | 'info' | NULL
testing | testing.none | source_files > 0 AND test_files = 0 | 50 | 'critical' | 0
testing | testing.coverage_breadth | source_files > 0 AND test_files > 0 AND fr < 0.25 | least((0.25 - fr) / 0.25 * 40, 40) | CASE WHEN fr < 0.1 THEN 'high' ELSE 'medium' END | round_even(fr, 4)
testing | testing.breadth | source_files > 0 AND test_files > 0 AND fr >= 0.25 | 4 | 'info' | round_even(fr, 4)
testing | testing.depth | source_files > 0 AND test_files > 0 AND lr < 0.2 | least((0.2 - lr) / 0.2 * 16, 16) | 'medium' | round_even(lr, 4)
testing | testing.assertions | source_files > 0 AND test_files > 0 AND assertions / test_files < 3 | least((3 - assertions / test_files) * 3, 9) | 'low' | round_even(assertions / test_files, 1)
testing | testing.untested_modules | source_files > 0 AND source_modules > 0 AND untested > 0 | least(untested / source_modules * 24, 18) | 'medium' | untested
testing | testing.ci | source_files > 0 AND NOT ci | 12 | 'medium' | NULL
testing | testing.ci_present | source_files > 0 AND ci | 3 | 'info' | NULL
testing | testing.coverage_tooling | source_files > 0 AND NOT coverage_config | 5 | 'low' | NULL
documentation | docs.symbol_coverage | public_symbols > 0 AND coverage < 0.7 | least((0.7 - coverage) / 0.7 * 40, 40) | CASE WHEN coverage < 0.25 THEN 'high' ELSE 'medium' END | coverage
documentation | docs.api | public_symbols > 0 AND coverage >= 0.7 | 5 | 'info' | coverage
documentation | docs.readme | NOT readme | 20 | 'high' | NULL
documentation | docs.readme_present | readme | 3 | 'info' | NULL
documentation | docs.pages | doc_pages = 0 | 10 | 'medium' | NULL
documentation | docs.depth | doc_pages > 0 AND doc_words < 400 | 5 | 'low' | doc_words
documentation | docs.module_headers | source_files > 0 AND documented_modules / source_files < 0.4 | least((0.4 - documented_modules / source_files) / 0.4 * 12, 12) | 'low' | round_even(documented_modules / source_files, 4)
documentation | docs.comments | comments < 0.05 | 6 | 'low' | round_even(comments, 4)
documentation | docs.license | NOT license | 4 | 'low' | NULL
maintainability | maint.god_classes | god_classes > 0 | least(god_classes * 4, 24) | CASE WHEN god_classes > 3 THEN 'high' ELSE 'medium' END | god_classes
maintainability | maint.coupling | coupled_modules > 0 | least(coupled_modules * 2, 14) | 'medium' | coupled_modules
maintainability | maint.instability | unstable_modules > 0 | least(unstable_modules * 2, 10) | 'medium' | unstable_modules
maintainability | maint.file_size | source_files > 0 AND source_loc / source_files > 250 | least((source_loc / source_files - 250) / 25, 10) | 'low' | round_even(source_loc / source_files, 1)
maintainability | maint.file_size_ok | source_files > 0 AND source_loc / source_files <= 250 | 3 | 'info' | NULL
maintainability | maint.hotspots | risky_hotspots > 0 | least(risky_hotspots * 2.5, 14) | CASE WHEN risky_hotspots > 4 THEN 'high' ELSE 'medium' END | risky_hotspots
performance | perf.high | perf_high > 0 | least(perf_high * 11, 36) | 'high' | perf_high
performance | perf.medium | perf_medium > 0 | least(perf_medium * 4, 24) | 'medium' | perf_medium
performance | perf.low | perf_low > 0 | least(perf_low * 1.5, 10) | 'low' | perf_low
performance | perf.missing_indexes | unindexed > 0 | least(unindexed * 3, 15) | 'medium' | unindexed
performance | perf.clean | perf_high + perf_medium + perf_low = 0 AND unindexed = 0 | 6 | 'info' | NULL
technical_debt | debt.markers | markers > 0 | least(per_kloc * 7, 30) | CASE WHEN per_kloc > 2 THEN 'medium' ELSE 'low' END | markers
technical_debt | debt.no_markers | markers = 0 | 6 | 'info' | NULL
technical_debt | debt.high | debt_high > 0 | least(debt_high * 6, 24) | 'high' | debt_high
technical_debt | debt.medium | debt_medium > 0 | least(debt_medium * 2.5, 15) | 'medium' | debt_medium
technical_debt | debt.low | debt_low > 0 | least(debt_low, 8) | 'low' | debt_low
technical_debt | debt.deprecated | deprecated > 0 | least(deprecated * 1.5, 10) | 'low' | deprecated
"""


def half(value: str, digits: int) -> str:
    """Half to even of the number as it is written, which is how Spark rounds; ``round_even`` scales the binary number first."""
    exact = f"(CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,17)) * {10 ** digits})"
    up = f"CASE WHEN {exact} - floor({exact}) > 0.5 OR ({exact} - floor({exact}) = 0.5 AND floor({exact}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CAST(floor({exact}) + {up} AS DOUBLE) / {10 ** digits})"


def _raw() -> str:
    parts = []
    for line in SIGNALS.strip().splitlines():
        category, signal, when, points, severity, value = (p.strip() for p in line.split("|"))
        parts.append(
            f"SELECT project_id, '{category}' AS category, '{signal}' AS signal, {severity} AS severity, "
            f"CAST({points} AS DOUBLE) AS points, CAST({value} AS DOUBLE) AS value FROM facts WHERE {when}")
    return "\n  UNION ALL ".join(parts)


# Recommendation per signal: id, title, effort (a pair: up to that value low or medium, else the other), trust.
PLANS = """
arch.cycles | arch.break_cycles | Break the dependency cycles | CASE WHEN value <= 3 THEN 'medium' ELSE 'high' END | 1.0 | 0.8
arch.layering | arch.restore_layering | Restore the layer boundaries | 'medium' | 1.0 | 0.8
arch.hubs | arch.split_hubs | Split the highest-traffic hubs | 'high' | 0.7 | 0.8
arch.density | arch.reduce_density | Reduce cross-module coupling | 'high' | 1.0 | 0.8
quality.complex_functions | quality.decompose_functions | Decompose the most complex functions | CASE WHEN value <= 5 THEN 'low' ELSE 'medium' END | 1.0 | 0.8
quality.file_size | quality.split_files | Split the largest source files | 'medium' | 1.0 | 0.8
security.critical | security.fix_critical | Remediate the critical security findings | CASE WHEN value <= 3 THEN 'low' ELSE 'medium' END | 1.0 | 0.75
security.high | security.fix_high | Remediate the high security findings | CASE WHEN value <= 3 THEN 'low' ELSE 'medium' END | 1.0 | 0.75
testing.none | testing.bootstrap | Establish an automated test suite | 'high' | 1.0 | 0.9
testing.coverage_breadth | testing.expand | Expand test coverage on the least-covered modules | 'medium' | 1.0 | 0.8
testing.ci | testing.add_ci | Add a CI pipeline that runs the suite | 'low' | 1.0 | 0.9
docs.symbol_coverage | docs.document_api | Document the public API surface | 'low' | 1.0 | 0.8
docs.readme | docs.add_readme | Write a README | 'low' | 1.0 | 0.95
maint.god_classes | maint.split_god_classes | Split the god classes by responsibility | 'high' | 1.0 | 0.8
maint.hotspots | maint.stabilise_hotspots | Stabilise the change hotspots | 'medium' | 1.0 | 0.8
perf.high | perf.fix_hot_paths | Fix the high-impact performance issues | 'medium' | 1.0 | 0.7
perf.missing_indexes | perf.add_indexes | Index the foreign key columns | 'low' | 1.0 | 0.8
debt.markers | debt.triage_markers | Triage the TODO/FIXME backlog | 'low' | 1.0 | 0.8
debt.high | debt.fix_silent_failures | Stop swallowing errors | 'low' | 1.0 | 0.8
"""


def _plans() -> str:
    parts = []
    for line in PLANS.strip().splitlines():
        signal, rec, title, effort, share, trust = (p.strip() for p in line.split("|"))
        parts.append(
            f"SELECT project_id, category, signal, '{rec}' AS recommendation, '{title}' AS title, {effort} AS effort, "
            f"round_even(-impact * {share}, 1) AS category_gain, CAST({trust} AS DOUBLE) AS confidence FROM signals WHERE signal = '{signal}'")
    return "\n  UNION ALL ".join(parts)


def _grade(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {low} THEN '{word}'" for low, word in (
        (95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (60, "D"), (50, "E"))) + " ELSE 'F' END"


def _band(value: str) -> str:
    return f"CASE WHEN {value} >= 90 THEN 'excellent' WHEN {value} >= 75 THEN 'good' WHEN {value} >= 60 THEN 'fair' WHEN {value} >= 40 THEN 'poor' ELSE 'critical' END"


DEFAULTS = (("architecture", 0.20), ("code_quality", 0.15), ("security", 0.20), ("testing", 0.12), ("documentation", 0.08),
            ("maintainability", 0.12), ("performance", 0.08), ("technical_debt", 0.05))
# Other weights, as a user types them: 3 and 1 are held at 1, the unreadable one is the default, and all are scaled to one.
TYPED = (("security", "3"), ("testing", "0.5"), ("documentation", "much"), ("performance", "-1"), ("technical_debt", "1"))


def score_sql(weights=DEFAULTS) -> str:
    named = ", ".join(f"('{c}', {w}, {i})" for i, (c, w) in enumerate(weights))
    numbers = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FACTS.items())
    flags = ", ".join(f"{e} AS {n}" for n, e in FLAGS.items())
    return f"""
base AS (SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
given AS (SELECT k AS project_id, {numbers}, {flags} FROM base),
facts AS (
  SELECT *, CASE WHEN source_files > 0 THEN test_files / source_files ELSE 0.0::DOUBLE END AS fr, CASE WHEN source_loc > 0 THEN test_loc / source_loc ELSE 0.0::DOUBLE END AS lr,
         CASE WHEN code_lines > 0 THEN comment_lines / code_lines ELSE 0.0::DOUBLE END AS comments, CASE WHEN loc > 0 THEN markers / (loc / 1000) ELSE 0.0::DOUBLE END AS per_kloc
  FROM given
),
raw AS (
  {_raw()}
),
signals AS (
  SELECT project_id, category, signal, severity, round_even(CASE WHEN severity = 'info' THEN points ELSE -points END, 1) AS impact, value,
         CASE WHEN severity IN ('critical', 'high') THEN 'fail' WHEN severity = 'info' THEN 'pass' ELSE 'warn' END AS status
  FROM raw WHERE round_even(points, 1) > 0
),
weights(category, weight, ord) AS (VALUES {named}),
trust AS (
  SELECT project_id, unnest([
    {{category: 'architecture', c: CASE WHEN module_count < 3 THEN 0.5 ELSE 0.9 END}}, {{category: 'code_quality', c: CASE WHEN measured > 0 THEN 0.9 ELSE 0.4 END}},
    {{category: 'security', c: CASE WHEN files > 0 THEN 0.7 ELSE 0.3 END}}, {{category: 'testing', c: CASE WHEN source_files > 0 THEN 0.65 ELSE 0.25 END}},
    {{category: 'documentation', c: CASE WHEN public_symbols > 0 THEN 0.9 ELSE 0.5 END}}, {{category: 'maintainability', c: CASE WHEN risky_hotspots > 0 OR hotspots > 0 THEN 0.9 ELSE 0.75 END}},
    {{category: 'performance', c: 0.6}}, {{category: 'technical_debt', c: 0.9}}], recursive := true) FROM facts
),
summed AS (
  SELECT f.project_id, w.category, w.ord, CAST(w.weight AS DOUBLE) AS weight, CAST(t.c AS DOUBLE) AS confidence,
         round_even(greatest(0.0, least(100.0, 100.0 + coalesce(sum(CAST(s.impact AS DECIMAL(18,1))), 0)::DOUBLE)), 1) AS score_exact,
         count(s.signal) FILTER (s.severity <> 'info') AS issue_count, first(s.signal ORDER BY s.impact, s.signal) FILTER (s.severity <> 'info') AS worst_issue
  FROM facts f JOIN weights w ON TRUE JOIN trust t ON t.project_id = f.project_id AND t.category = w.category
  LEFT JOIN signals s ON s.project_id = f.project_id AND s.category = w.category GROUP BY ALL
),
cats AS (
  SELECT *, CAST(round_even(score_exact, 0) AS INTEGER) AS score, {_grade('score_exact')} AS grade, {_band('score_exact')} AS band,
         {half('score_exact * weight', 2)} AS contribution, {half('(100 - score_exact) * weight', 2)} AS lost_points
  FROM summed
),
totals AS (
  SELECT project_id, CAST(sum(CAST(score_exact * weight AS DECIMAL(28,8))) AS DOUBLE) AS exact,
         {half('CAST(sum(CAST(confidence * weight AS DECIMAL(28,8))) AS DOUBLE)', 2)} AS confidence,
         first(category ORDER BY score_exact, ord) AS weakest, first(category ORDER BY score_exact DESC, ord) AS strongest
  FROM cats GROUP BY project_id
),
overall AS (SELECT *, CAST(round_even(greatest(0.0, least(100.0, exact)), 0) AS INTEGER) AS overall FROM totals),
plans AS (
  {_plans()}
),
gains AS (SELECT p.*, {half('category_gain * w.weight::DOUBLE', 1)} AS overall_gain FROM plans p JOIN weights w USING (category) WHERE category_gain > 0),
actions AS (
  SELECT *, {half("overall_gain / CASE effort WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END", 2)} AS roi,
         CASE WHEN overall_gain >= 4 AND effort = 'low' THEN 'critical' WHEN overall_gain >= 3 OR (overall_gain >= 1.5 AND effort = 'low') THEN 'high'
              WHEN overall_gain >= 0.8 THEN 'medium' ELSE 'low' END AS priority,
         CASE effort WHEN 'low' THEN 'quick' WHEN 'medium' THEN 'medium' ELSE 'long' END AS horizon
  FROM gains
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY roi DESC, overall_gain DESC, recommendation) AS INTEGER) AS rank FROM actions)"""


def card_facts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    base = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").select(
        F.col("c_custkey").alias("k"), F.coalesce("n", F.lit(0)).alias("n"))
    # one key becomes some 25 signals: spread the keys before they grow
    base = base.repartition(max(spark.sparkContext.defaultParallelism, 1), "k")
    return base.select(F.col("k").alias("project_id"), *[F.expr(e).cast("double").alias(n) for n, e in FACTS.items()], *[F.expr(e).alias(n) for n, e in FLAGS.items()])


def _signals(spark, sf):
    return sc.score_signals(card_facts(spark, sf), K)


def _categories(spark, sf):
    facts = card_facts(spark, sf)
    return sc.category_scores(sc.score_signals(facts, K), facts, sc.default_weights(spark), K, sc.confidence(facts, K))


@query("card_signals", f"WITH {score_sql()} SELECT * FROM signals")
def card_signals(spark, sf):
    return _signals(spark, sf).drop("label")


@query("card_categories", f"WITH {score_sql()} SELECT * EXCLUDE (ord) FROM cats")
def card_categories(spark, sf):
    return _categories(spark, sf)


STATE = """CASE WHEN overall >= 90 THEN 'in excellent health' WHEN overall >= 75 THEN 'healthy with a few gaps' WHEN overall >= 60 THEN 'workable but carrying real risk'
  WHEN overall >= 40 THEN 'under strain' ELSE 'in critical condition' END"""
OVERALL = f"""SELECT project_id, overall, {half('exact', 2)} AS overall_exact, {_grade('overall')} AS grade, {_band('overall')} AS band, confidence, weakest, strongest,
  {STATE} AS state FROM overall"""


@query("card_overall", f"WITH {score_sql()} {OVERALL}")
def card_overall(spark, sf):
    return sc.overall_score(_categories(spark, sf), K)


@query("card_roadmap", f"WITH {score_sql()} SELECT * FROM ranked")
def card_roadmap(spark, sf):
    return sc.roadmap(sc.recommendation_rows(_signals(spark, sf), keys=K), sc.default_weights(spark), K)


@query("card_horizons", f"""WITH {score_sql()}
SELECT project_id, horizon, recommendation, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY project_id, horizon ORDER BY rank) <= 2""")
def card_horizons(spark, sf):
    actions = sc.roadmap(sc.recommendation_rows(_signals(spark, sf), keys=K), sc.default_weights(spark), K)
    return sc.roadmap_horizons(actions, K, limit=2).select("project_id", "horizon", "recommendation", "rank")


@query("card_potential", f"""WITH {score_sql()},
g AS (SELECT project_id, round_even(CAST(sum(CAST(overall_gain AS DECIMAL(18,1))) AS DOUBLE), 1) AS total_gain FROM ranked GROUP BY project_id)
SELECT project_id, overall, coalesce(total_gain, 0.0) AS total_gain,
       CAST(round_even(greatest(0.0, least(100.0, overall + coalesce(total_gain, 0.0))), 0) AS INTEGER) AS potential
FROM overall LEFT JOIN g USING (project_id)""")
def card_potential(spark, sf):
    actions = sc.roadmap(sc.recommendation_rows(_signals(spark, sf), keys=K), sc.default_weights(spark), K)
    return sc.potential_score(sc.overall_score(_categories(spark, sf), K), actions, K)


@query("card_remediation", f"""WITH {score_sql()}
SELECT s.*, r.recommendation AS remediation FROM signals s LEFT JOIN ranked r USING (project_id, signal)""")
def card_remediation(spark, sf):
    signals = _signals(spark, sf)
    return sc.signal_remediation(signals, sc.recommendation_rows(signals, keys=K), K).drop("label")


@query("card_issues", f"""WITH {score_sql()}
SELECT s.*, {half('abs(impact) * weight::DOUBLE', 2)} AS weighted_impact,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY {half('abs(impact) * weight::DOUBLE', 2)} DESC,
         CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, signal) AS INTEGER) AS rank
FROM signals s JOIN weights USING (category) WHERE status <> 'pass' QUALIFY rank <= 12""")
def card_issues(spark, sf):
    return sc.top_issues(_signals(spark, sf), sc.default_weights(spark), K).drop("label").select(
        "project_id", "category", "signal", "severity", "impact", "value", "status", "weighted_impact", "rank")


@query("card_strengths", f"""WITH {score_sql()}
SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY impact DESC, signal) AS INTEGER) AS rank
FROM signals WHERE status = 'pass' QUALIFY rank <= 10""")
def card_strengths(spark, sf):
    return sc.strengths(_signals(spark, sf), K).drop("label")


# What the typed weights come to: 0.2, 0.15, 1, 0.5, 0.08, 0.12, 0, 1 over 3.05.
SCALED = (("architecture", 0.0656), ("code_quality", 0.0492), ("security", 0.3279), ("testing", 0.1639), ("documentation", 0.0262),
          ("maintainability", 0.0393), ("performance", 0.0), ("technical_debt", 0.3279))


def _rescored(spark, sf):
    facts = card_facts(spark, sf)
    typed = spark.createDataFrame(list(TYPED), "category string, weight string")
    return sc.rescore(sc.score_signals(facts, K), facts, typed, K, sc.confidence(facts, K))


@query("card_rescored", f"WITH {score_sql(SCALED)} {OVERALL}")
def card_rescored(spark, sf):
    return _rescored(spark, sf)[1]


@query("card_replanned", f"WITH {score_sql(SCALED)} SELECT * FROM ranked")
def card_replanned(spark, sf):
    return _rescored(spark, sf)[2]


@query("card_evidence", f"""WITH {score_sql()},
shown AS (
  SELECT project_id, signal, rank, 'f' || rank AS file FROM signals, unnest(range(1, 1 + CAST(value AS BIGINT) * 3)) AS r(rank)
  WHERE signal IN ('security.high', 'arch.hubs', 'perf.high') AND rank <= 12 AND (project_id + rank) % 4 > 0
),
files AS (SELECT project_id, signal, list(file ORDER BY rank) AS files FROM (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY project_id, signal ORDER BY rank) <= 8) GROUP BY ALL)
SELECT r.project_id, r.signal, r.recommendation, array_to_string(f.files, ',') AS files FROM plans r LEFT JOIN files f USING (project_id, signal) WHERE r.category_gain > 0""")
def card_evidence(spark, sf):
    """Evidence of three signals, three files per unit of the value and some without a file; twelve are kept and eight shown."""
    signals = _signals(spark, sf)
    ranks = F.explode(F.sequence(F.lit(1), (F.col("value") * 3).cast("int")))
    rows = signals.filter("value > 0").select(*K, "signal", ranks.alias("rank"))
    named = rows.withColumns({"label": F.lit("x"), "line": F.col("rank"),
                              "file": F.when((F.col("project_id") + F.col("rank")) % 4 > 0, F.concat(F.lit("f"), F.col("rank"))).otherwise("")})
    sources = {s: named.filter(F.col("signal") == s).drop("signal") for s in ("security.high", "arch.hubs", "perf.high")}
    evidence = sc.score_evidence(sources, K)
    made = sc.recommendation_rows(signals, evidence, K)
    return made.select("project_id", "signal", "recommendation", F.array_join("files", ",").alias("files"))
