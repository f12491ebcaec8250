"""Repair proposals: text rules that report, and mechanical rules that also rewrite."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archspark.functions import matching as mt
from archspark.functions.frames import rank_in, top_k
from archspark.functions.text import content_digest, text_lines
from archspark.operators.graph import union_all
from archspark.schema import KEYS, SEVERITIES

PY, JS = ("python",), ("javascript", "typescript")


@dataclass(frozen=True)
class Fix:
    """A rule.  ``rewrite`` holds line substitutions, ``pattern`` a line detector."""

    id: str
    severity: str
    effort: str
    confidence: float
    languages: tuple[str, ...] = ()
    rewrite: tuple[tuple[str, str], ...] = ()
    pattern: str = ""
    cosmetic: bool = False
    how: str = "line"  # line, js, whole: how the rule reads the text


# Renamed assertion methods.
ALIASES = (
    ("assertEquals", "assertEqual"), ("assertNotEquals", "assertNotEqual"), ("assertAlmostEquals", "assertAlmostEqual"),
    ("assertNotAlmostEquals", "assertNotAlmostEqual"), ("assertRegexpMatches", "assertRegex"), ("assertNotRegexpMatches", "assertNotRegex"),
    ("assertRaisesRegexp", "assertRaisesRegex"), ("failUnless", "assertTrue"), ("failIf", "assertFalse"),
    ("failUnlessEqual", "assertEqual"), ("failIfEqual", "assertNotEqual"), ("failUnlessRaises", "assertRaises"),
)
# Mechanical rules.
REWRITES = (
    Fix("bare-except", "high", "S", 0.95, PY, ((r"(?<![\w.])except\s*:", "except Exception:"),)),
    Fix("none-identity", "low", "S", 0.97, PY, ((r"!=\s*None\b", "is not None"), (r"(?<![=!<>])==\s*None\b", "is None"))),
    Fix("yaml-unsafe-load", "critical", "S", 0.9, PY, ((r"\byaml\.load\s*\(", "yaml.safe_load("),)),
    Fix("debugger-statement", "medium", "S", 0.99, JS, ((r"^\s*debugger\s*;?\s*$", ""),), how="delete"),
    Fix("trailing-whitespace", "low", "S", 1.0, (), ((r"[ \t]+(?=\r?\n|$)", ""),), cosmetic=True),
    Fix("missing-final-newline", "low", "S", 1.0, (), cosmetic=True, how="final-newline"),
    Fix("py2-except-syntax", "critical", "S", 1.0, PY, ((r"^(\s*except\s+[\w.()\[\], ]+?)\s*,\s*([A-Za-z_]\w*)\s*:", "$1 as $2:"),)),
    Fix("deprecated-unittest-alias", "high", "S", 1.0, PY, tuple((rf"(?<!\w){a}(?=\s*\()", b) for a, b in ALIASES)),
    Fix("invalid-escape-sequence", "medium", "S", 0.9, PY, how="escape"),
    Fix("typeof-loose-equality", "low", "S", 1.0, JS, ((r"(typeof\s+[^=!\n]+?)(==|!=)(?!=)(\s*(['\"])[a-z]+\4)", "$1$2=$3"),)),
    Fix("js-wrapper-constructor", "low", "S", 0.95, JS, ((r"\bnew\s+Array\s*\(\s*\)", "[]"), (r"\bnew\s+Object\s*\(\s*\)", "{}"))),
    Fix("trailing-blank-lines", "low", "S", 1.0, (), cosmetic=True, how="blank-tail"),
)
# Advisory rules.
SECRET = (
    r"(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|private[_-]?key)\b\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']"
)
SECRET_PLACEHOLDERS = ("your", "xxx", "changeme", "example", "placeholder", "todo", "dummy", "insert")
SQL_WORDS = r"(?i)\b(?:select\s+.+\s+from|insert\s+into|update\s+\w+\s+set|delete\s+from)\b"
SQL_JOINED = r"""(?i)(?:execute\w*\s*\(\s*f["'])|(?:["']\s*(?:\+|%)\s*\w)|(?:\.format\s*\()"""
EXCEPT_PASS = r"(?m)^[ \t]*except\b[^\n]*:[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*(?:pass|\.\.\.)[ \t]*\r?$"
REQUEST = r"\brequests\.(?:get|post|put|patch|delete|head|options|request)\s*\("
ADVISORIES = (
    Fix("subprocess-shell", "critical", "M", 0.8, PY, pattern=r"\bshell\s*=\s*True\b"),
    Fix("innerhtml-sink", "high", "M", 0.6, JS, pattern=r"""\.innerHTML\s*=\s*(?!['"`]\s*['"`])"""),
    Fix("mutable-default-arg", "high", "S", 0.9, PY, pattern=r"\bdef\s+\w+\s*\([^)]*=\s*(?:\[\s*\]|\{\s*\}|set\(\)|list\(\)|dict\(\))"),
    Fix("except-pass", "high", "S", 0.9, PY, how="except-pass"),
    Fix("star-import", "medium", "S", 0.95, PY, pattern=r"^\s*from\s+[\w.]+\s+import\s+\*"),
    Fix("lambda-assignment", "low", "S", 0.9, PY, pattern=r"^\s*[A-Za-z_]\w*\s*(?::[^=]+)?=\s*lambda\b"),
    Fix("unclosed-file", "medium", "S", 0.75, PY, pattern=r"^\s*[A-Za-z_]\w*\s*=\s*open\s*\("),
    Fix("naive-utcnow", "medium", "S", 0.95, PY, pattern=r"\bdatetime\.utcnow\s*\(\s*\)"),
    Fix("request-without-timeout", "medium", "S", 0.85, PY, how="request"),
    Fix("loose-equality", "medium", "S", 0.7, JS, pattern=r"(?<![=!<>])==(?!=)|(?<!!)!=(?!=)", how="js"),
    Fix("var-declaration", "low", "S", 0.9, JS, pattern=r"(?<![\w.$])var\s+[A-Za-z_$]", how="js"),
    Fix("dynamic-eval", "critical", "M", 0.8, PY + JS, pattern=r"(?<![\w.])(?:eval|exec)\s*\("),
    Fix("unsafe-deserialisation", "critical", "M", 0.85, PY, pattern=r"\bpickle\.loads?\s*\("),
    Fix("os-command", "critical", "M", 0.9, PY, pattern=r"\bos\.(?:system|popen)\s*\("),
    Fix("weak-hash", "high", "S", 0.7, PY, pattern=r"\bhashlib\.(?:md5|sha1)\s*\("),
    Fix("sql-string-building", "critical", "M", 0.7, PY, how="sql"),
    Fix("hardcoded-secret", "critical", "M", 0.6, (), how="secret"),
    Fix("document-write", "high", "M", 0.85, JS, pattern=r"\bdocument\.write(?:ln)?\s*\(", how="js"),
    Fix("timer-string-body", "high", "S", 0.9, JS, pattern=r"""\b(?:setTimeout|setInterval)\s*\(\s*["'`]""", how="js"),
    Fix("merge-conflict-marker", "critical", "S", 1.0, (), pattern=r"^(?:<{7}|>{7})[ \t]"),
)
RULES = {r.id: r for r in (*REWRITES, *ADVISORIES)}
LINE = r"[^\n]*\n|[^\n]+\z"


# --------------------------------------------------------------------------- rewriting

# Fixed value: what may follow a backslash in a string literal; blanks count as known.
KNOWN_ESCAPES = frozenset("\n \t\\'\"abfnrtvxNuU01234567")


def _raw_line(line: str) -> str:
    """Prefix ``r`` to each literal that ends on the line and whose escapes are all unknown; comments stay."""
    out, at, size = [], 0, len(line)
    while at < size:
        c = line[at]
        if c == "#":
            break
        if c not in "\"'":
            out.append(line[at : at + 2] if c == "\\" else c)
            at += len(out[-1])
            continue
        quote = line[at : at + 3] if line[at : at + 3] in ('"""', "\'\'\'") else c
        end, escapes = at + len(quote), set()
        while end < size and not line.startswith(quote, end):
            if line[end] == "\\":
                escapes.add(line[end + 1 : end + 2])
                end += 1
            end += 1
        if end >= size:
            break
        prefix = 0
        while prefix < 2 and prefix < len(out) and out[-1 - prefix] in tuple("rbuf"):
            prefix += 1
        before = out[-1 - prefix][-1] if len(out) > prefix else " "
        plain = "r" not in out[len(out) - prefix :] and not (before.isalnum() or before in "_\"'")
        if escapes and plain and not any(e in KNOWN_ESCAPES for e in escapes):
            out.insert(len(out) - prefix, "r")
        out.append(line[at : end + len(quote)])
        at = end + len(quote)
    return "".join(out) + line[at:]


@F.pandas_udf(T.ArrayType(T.StringType()))
def raw_strings(lines: pd.Series) -> pd.Series:
    """Lines with unknown escapes turned into raw literals."""
    return lines.map(lambda rows: [_raw_line(x) if "\\" in x else x for x in rows])


def kept_lines(text: Column) -> Column:
    """Lines with their line ends."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def _rewritten_lines(rule: Fix, lines: Column) -> Column:
    if rule.how == "escape":
        return raw_strings(lines)
    if rule.how == "delete":
        return F.transform(lines, lambda x: F.when(F.regexp_replace(x, r"\r?\n$", "").rlike(rule.rewrite[0][0]), "").otherwise(x))

    def one(x: Column) -> Column:
        for pattern, replacement in rule.rewrite:
            x = F.regexp_replace(x, pattern, replacement)
        return x

    return F.transform(lines, one)


def rewrite_text(rule: Fix, text: Column) -> Column:
    """The text after one rule; applying it twice changes nothing more."""
    if rule.how == "final-newline":
        return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    if rule.how == "blank-tail":
        return F.regexp_replace(text, r"(\r?\n)(?:[ \t]*\r?\n)+\z", "$1")
    return F.array_join(_rewritten_lines(rule, kept_lines(text)), "")


def touched_lines(rule: Fix, before: Column, after: Column) -> Column:
    """Numbers of the lines one rule changes."""
    if rule.how in ("final-newline", "blank-tail"):
        n = F.size(kept_lines(after if rule.how == "blank-tail" else before))
        return F.when(before != after, F.array(n + (1 if rule.how == "blank-tail" else 0))).otherwise(F.expr("cast(array() as array<int>)"))
    old = kept_lines(before)
    new = _rewritten_lines(rule, old)
    pairs = F.zip_with(old, new, lambda a, b: ~a.eqNullSafe(b))
    numbered = F.transform(pairs, lambda changed, i: F.when(changed, i + 1))
    return F.array_compact(numbered)


def _applies(rule: Fix) -> Column:
    return F.col("language").isin(*rule.languages) if rule.languages else F.lit(True)


def _with_escapes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that the escape rule may change, which alone go through Python, and the rest."""
    may = F.coalesce((F.col("language") == "python") & F.contains("text", F.lit("\\")), F.lit(False))
    return files.filter(may), files.filter(~may)


def _apart(files: DataFrame, rules: Sequence[Fix], run) -> DataFrame:
    """``run(files, rules)``, with the escape rule only for the files that need it."""
    others = [r for r in rules if r.how != "escape"]
    if len(others) == len(rules):
        return run(files, rules)
    needy, rest = _with_escapes(files)
    return run(needy, rules).unionByName(run(rest, others))


def rewrite_lines(files: DataFrame, rules: Iterable[str] | None = None, cosmetic: bool = False) -> DataFrame:
    """Files with ``new_text`` after the rules in table order; one column step per rule, no shuffle."""
    wanted = set(rules) if rules is not None else {r.id for r in REWRITES if cosmetic or not r.cosmetic}

    def run(part: DataFrame, own: Sequence[Fix]) -> DataFrame:
        out = part.withColumn("new_text", F.col("text"))
        for rule in own:
            out = out.withColumn("new_text", F.when(_applies(rule), rewrite_text(rule, F.col("new_text"))).otherwise(F.col("new_text")))
        return out

    return _apart(files, [r for r in REWRITES if r.id in wanted], run)


def change_rows(rewritten: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lines that differ between ``text`` and ``new_text`` of rewrites that keep the line count,
    and delete or add rows at the end of those that do not."""
    old, new = kept_lines(F.col("text")), kept_lines(F.col("new_text"))
    n = F.greatest(F.size(old), F.size(new))
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("line"), F.try_element_at(old, i).alias("before"), F.try_element_at(new, i).alias("after")))
    changed = F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"]))
    return rewritten.filter(F.col("text") != F.col("new_text")).select(*keys, "path", F.inline(changed))


def preview(files: DataFrame, path: str, rules: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One file after the given rules, with a changed flag."""
    one = rewrite_lines(files.filter(F.col("path") == path), rules)
    return one.select(*keys, "path", "text", "new_text", (F.col("text") != F.col("new_text")).alias("changed"))


# --------------------------------------------------------------------------- detection


def _bracket_arguments(text: Column, stop: Column) -> Column:
    """Arguments of a call from behind its opening bracket; null when it is never closed."""
    rest = F.substring(text, stop + 1, F.lit(1 << 30))
    pieces = F.regexp_extract_all(rest, F.lit(r"[^()\[\]{}]*[()\[\]{}]"), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.rlike(r"[(\[{]$"), 1).otherwise(-1)
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(depth.alias("depth"), (acc["size"] + F.char_length(piece)).alias("size")))

    end = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size")), step)
    return F.when(end["depth"] == 0, F.substring(rest, F.lit(1), end["size"] - 1))


def _hit_lines(rule: Fix, text: Column, lines: Column) -> Column:
    """Line numbers an advisory rule reports."""
    if rule.how == "except-pass":
        return F.transform(mt.matches(text, EXCEPT_PASS), lambda h: h["line"])
    if rule.how == "request":
        calls = F.transform(mt.matches(text, REQUEST), lambda h: F.struct(h["line"].alias("line"), _bracket_arguments(text, h["stop"]).alias("args")))
        return F.transform(F.filter(calls, lambda c: c["args"].isNotNull() & ~c["args"].contains("timeout")), lambda c: c["line"])

    def test(x: Column) -> Column:
        if rule.how == "sql":
            return x.rlike(SQL_WORDS) & x.rlike(SQL_JOINED)
        if rule.how == "secret":
            value = F.regexp_extract(x, SECRET, 1)
            letters = F.size(F.array_distinct(F.split(value, "")))
            return (value != "") & ~F.lower(value).rlike("|".join(SECRET_PLACEHOLDERS)) & ~value.rlike(r"[{}<>$]") & (letters > 2)
        if rule.how == "js":
            bare = F.regexp_replace(F.regexp_replace(x, r"//.*$", ""), r"""'[^'\n]*'|"[^"\n]*"|`[^`\n]*`""", "''")
            return bare.rlike(rule.pattern)
        return x.rlike(rule.pattern)

    return F.array_compact(F.transform(lines, lambda x, i: F.when(test(x), i + 1)))


PROPOSAL = "struct<rule:string,severity:string,effort:string,confidence:double,auto:boolean,occurrences:int,lines:array<int>>"


def _proposal(rule: Fix, lines: Column, auto: bool) -> Column:
    row = F.struct(
        F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.effort).alias("effort"),
        F.lit(rule.confidence).alias("confidence"), F.lit(auto).alias("auto"), F.size(lines).alias("occurrences"),
        lines.alias("lines"),
    ).cast(PROPOSAL)
    return F.when(F.size(lines) > 0, row)


def detect_issues(files: DataFrame, keys: Sequence[str] = KEYS, rules: Iterable[str] | None = None) -> DataFrame:
    """Advisory findings, one row per file and rule."""
    wanted = set(rules) if rules is not None else None
    staged = files.withColumn("lines", text_lines(F.col("text")))
    found = [
        F.when(_applies(r), _proposal(r, _hit_lines(r, F.col("text"), F.col("lines")), False))
        for r in ADVISORIES if wanted is None or r.id in wanted
    ]
    return staged.select(*keys, "path", content_digest(F.col("text")).alias("digest"), F.explode(F.array_compact(F.array(*found))).alias("p")).select(
        *keys, "path", "digest", "p.*")


def propose_rewrites(files: DataFrame, keys: Sequence[str] = KEYS, rules: Iterable[str] | None = None, cosmetic: bool = False) -> DataFrame:
    """Mechanical proposals, one row per file and rule, each against the untouched text."""
    wanted = set(rules) if rules is not None else {r.id for r in REWRITES if cosmetic or not r.cosmetic}

    def run(part: DataFrame, own: Sequence[Fix]) -> DataFrame:
        names = []
        for i, rule in enumerate(own):
            lines = touched_lines(rule, F.col("text"), rewrite_text(rule, F.col("text")))
            part = part.withColumn(f"p{i}", F.when(_applies(rule), _proposal(rule, lines, True)))
            names.append(f"p{i}")
        found = F.explode(F.array_compact(F.array(*names)) if names else F.array().cast(f"array<{PROPOSAL}>"))
        return part.select(*keys, "path", content_digest(F.col("text")).alias("digest"), found.alias("p")).select(*keys, "path", "digest", "p.*")

    return _apart(files, [r for r in REWRITES if r.id in wanted], run)


def propose(files: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None, rules: Iterable[str] | None = None,
            cosmetic: bool = False, structural: DataFrame | None = None) -> DataFrame:
    """All proposals; with a ``limit`` the first ones, structural before text, then by severity, file and rule, and ``truncated`` marks a cut."""
    rows = detect_issues(files, keys, rules).unionByName(propose_rewrites(files, keys, rules, cosmetic)).withColumn("kind", F.lit("text"))
    if structural is not None and rules is None:
        rows = structural.withColumn("kind", F.lit("structural")).unionByName(rows, allowMissingColumns=True)
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    order = [F.col("kind") != "structural", rank_in(F.col("severity"), SEVERITIES), F.col("path"), F.col("rule")]
    return top_k(rows, keys, order, limit, rank="seq").join(totals, list(keys)).withColumn("truncated", F.col("total") > limit).drop("total")


def proposal_counts(proposals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return proposals.groupBy(*keys).agg(
        F.count("*").alias("proposals"), F.count_if(F.col("auto")).alias("auto_fixable"),
        F.count_if((F.col("kind") == "text") & ~F.col("auto")).alias("advisory"),
        F.count_if(F.col("kind") == "structural").alias("structural"), F.count_distinct("path").alias("files"))


def structural_proposals(
    cycles: DataFrame, gods: DataFrame, violations: DataFrame, offenders: DataFrame, untested: DataFrame,
    oversized: DataFrame, undocumented: DataFrame, keys: Sequence[str] = KEYS, limit: int = 25,
) -> DataFrame:
    """Whole-project proposals from the metric tables, most severe first."""

    def rows(df: DataFrame, rule: str, path: Column, severity, effort: str, occurrences: Column) -> DataFrame:
        return df.select(
            *keys, F.lit(rule).alias("rule"), path.cast("string").alias("path"),
            (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(effort).alias("effort"),
            occurrences.cast("int").alias("occurrences"), F.lit(False).alias("auto"))

    pairs = violations.groupBy(*keys, "from_layer", "to_layer").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    untested_n = untested.groupBy(*keys).agg(F.count("*").alias("n"), F.min("module").alias("module"))
    plain_n = undocumented.groupBy(*keys).agg(F.count("*").alias("n"), F.min("file").alias("file")).filter("n >= 5")
    many = lambda df, order, n: top_k(df, keys, order, n)
    out = union_all(
        rows(many(cycles, [F.col("length"), F.col("members")], 5), "dependency-cycle", F.col("members")[0], "high", "L", F.col("length")),
        rows(many(gods, [F.desc("severity"), F.col("id")], 5), "god-class", F.col("file"), F.when(F.col("methods") >= 30, "high").otherwise("medium"), "L", F.col("methods")),
        rows(many(pairs, [F.desc("n"), F.col("from_layer"), F.col("to_layer")], 4), "layering-violation", F.col("file"), "high", "M", F.col("n")),
        rows(many(offenders, [F.desc("complexity"), F.col("name")], 6), "complex-function", F.col("file"), F.when(F.col("complexity") >= 21, "high").otherwise("medium"), "M", F.col("complexity")),
        rows(untested_n, "untested-module", F.col("module"), "high", "M", F.col("n")),
        rows(many(oversized.filter("loc >= 600"), [F.desc("loc"), F.col("path")], 4), "oversized-file", F.col("path"), "medium", "M", F.col("loc")),
        rows(plain_n, "undocumented-api", F.col("file"), "low", "S", F.col("n")),
    )
    return top_k(out, keys, [rank_in(F.col("severity"), SEVERITIES), F.col("rule"), F.col("path")], limit, rank="seq").drop("seq")


# --------------------------------------------------------------------------- apply


def apply_rewrites(files: DataFrame, selections: DataFrame, keys: Sequence[str] = KEYS, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """New file versions and one status row per selected file.

    ``selections`` has path, rule and digest.  A file is rewritten only when its
    text still has the digest the proposal was made for and all its selected rules
    are mechanical; otherwise it is kept and the status says why.
    """
    if not confirm:
        raise ValueError("rewrites must be confirmed explicitly")
    known = [r.id for r in REWRITES]
    at = [*keys, "path"]
    asked = selections.groupBy(*at).agg(
        F.collect_set("rule").alias("rules"), F.collect_set(F.coalesce("digest", F.lit(""))).alias("digests"))
    joined = files.withColumn("digest", content_digest(F.col("text"))).join(asked, at, "full_outer")
    bad = F.exists("rules", lambda r: ~r.isin(*known))
    reason = (
        F.when(F.col("rules").isNull(), F.lit(None)).when(F.col("text").isNull(), "no such file")
        .when(~F.array_contains("digests", F.col("digest")), "text differs from the digest")
        .when(bad, "rule has no rewrite")
    )
    staged = joined.withColumn("reason", reason).withColumn("new_text", F.col("text")).withColumn("applied", F.expr("cast(array() as array<string>)"))

    def run(part: DataFrame, own: Sequence[Fix]) -> DataFrame:
        for rule in own:
            chosen = F.col("reason").isNull() & F.coalesce(F.array_contains("rules", rule.id), F.lit(False))
            part = part.withColumn("next_text", F.when(chosen, rewrite_text(rule, F.col("new_text"))).otherwise(F.col("new_text")))
            part = part.withColumn("applied", F.when(F.col("next_text") != F.col("new_text"), F.array_append("applied", F.lit(rule.id))).otherwise(F.col("applied")))
            part = part.withColumn("new_text", F.col("next_text")).drop("next_text")
        return part

    staged = _apart(staged, REWRITES, run)
    versions = staged.filter(F.col("text").isNotNull()).select(*[c for c in files.columns if c != "text"], F.col("new_text").alias("text"))
    status = staged.filter(F.col("rules").isNotNull()).select(
        *at, F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("")).alias("error"), "applied",
        F.when(F.col("reason").isNull(), content_digest(F.col("new_text"))).alias("new_digest"))
    return versions, status
