"""Line and text measures as in-row expressions: one row per file, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line boundaries.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Characters stripped from both ends of a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# A word is a run of anything but blanks of any script.
WORD = "[^\\s\\x0b\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
MAX_LINE = 120
LARGE_FILE, HUGE_FILE = 600, 1000

# Languages that are scanned as code.
CODE_LANGUAGES = (
    "python", "javascript", "typescript", "java", "csharp", "go", "rust", "c", "cpp", "shell", "powershell",
)
# Line-comment prefixes; other languages use // and #.
HASH_COMMENT = ("python", "shell", "powershell", "yaml")
SLASH_COMMENT = ("javascript", "typescript", "java", "csharp", "go", "rust", "c", "cpp")
DASH_COMMENT = ("sql",)
# Text patterns.
DEPRECATED = r"(?i)@?\bdeprecated\b"
ASSERTION = (
    r"\b(?:assert\w*|expect|assertThat|assertEquals|verify|require)\s*[(\s]"
    r"|\.should\b|\bAssert\.\w+\(|\bt\.(?:Errorf|Fatalf)\("
)
GO_DOC = r"(?m)^\s*//\s*(?:Package|[A-Z]\w+)\s"
XML_DOC = r"(?m)^\s*///"


def text_lines(text: Column) -> Column:
    """Lines of a text; a closing line break ends the last line and opens no new one."""
    parts = F.split(text, LINE_BREAK)
    trailing = (F.size(parts) > 0) & (F.element_at(parts, -1) == "")
    return F.when(trailing, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def with_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """Attach the line array once so several measures share one split."""
    return files.withColumn("lines", text_lines(F.col(text)))


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with its 1-based number."""
    kept = [c for c in files.columns if c != text]
    return files.select(
        *kept, F.posexplode(text_lines(F.col(text))).alias("_pos", "content")
    ).select(*kept, (F.col("_pos") + 1).alias("line"), "content")


def strip_comments(text: Column, prefix: str | None = "//", block: bool = True) -> Column:
    """Block comments, then line comments, become one blank."""
    out = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ") if block else text
    return F.regexp_replace(out, prefix + "[^\n]*", " ") if prefix else out


def _is_comment(line: Column, language: Column) -> Column:
    return (
        F.when(language.isin(*HASH_COMMENT), line.startswith("#"))
        .when(language.isin(*SLASH_COMMENT), line.startswith("//"))
        .when(language.isin(*DASH_COMMENT), line.startswith("--"))
        .otherwise(line.startswith("//") | line.startswith("#"))
    )


def line_stats(lines: Column, language: Column) -> Column:
    """Struct (code, comment, blank): a fold that carries the open-block state over the lines."""

    def step(acc: Column, raw: Column) -> Column:
        line = F.btrim(raw, F.lit(BLANKS))
        quote = F.substring(line, 1, 3).isin('"""', "'''")
        opens = line.startswith("/*") | quote
        body = F.when(quote, F.substring(line, 4, 1 << 30)).otherwise(F.substring(line, 3, 1 << 30))
        closer = F.when(quote, F.substring(line, 1, 3)).otherwise(F.lit("*/"))
        closes = line.contains("*/") | line.endswith('"""') | line.endswith("'''")
        inside, blank = acc["inside"], line == ""
        comment = _is_comment(line, language)
        is_comment = inside | (~blank & (comment | opens))
        return F.struct(
            F.when(inside, ~closes)
            .otherwise(~blank & ~comment & opens & ~body.contains(closer))
            .alias("inside"),
            (acc["code"] + F.when(inside | blank | comment | opens, 0).otherwise(1)).alias("code"),
            (acc["comment"] + F.when(is_comment, 1).otherwise(0)).alias("comment"),
            (acc["blank"] + F.when(~inside & blank, 1).otherwise(0)).alias("blank"),
        )

    start = F.struct(
        F.lit(False).alias("inside"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank")
    )
    return F.aggregate(
        lines, start, step,
        lambda acc: F.struct(acc["code"].alias("code"), acc["comment"].alias("comment"), acc["blank"].alias("blank")),
    )


def has_module_doc(text: Column, language: Column) -> Column:
    head = F.substring(text, 1, 2000)
    # first line that is neither blank nor a comment in the first column
    opening = F.try_element_at(
        F.filter(
            F.split(F.regexp_replace(text, r"^\s+", ""), "\n"),
            lambda x: ~x.rlike(r"^\s*$") & ~x.startswith("#"),
        ),
        F.lit(1),
    )
    return (
        F.when(language == "python", F.coalesce(opening.rlike(r"^\s*(?:\"{3}|'{3})"), F.lit(False)))
        .when(language.isin("javascript", "typescript", "java"), head.contains("/**"))
        .when(language == "csharp", head.rlike(XML_DOC))
        .when(language == "go", F.substring(text, 1, 600).rlike(GO_DOC))
        .otherwise(F.lit(False))
    )


def long_lines(lines: Column, limit: int = MAX_LINE) -> Column:
    return F.size(F.filter(lines, lambda x: F.char_length(x) > limit))


def deprecated_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DEPRECATED))


def assertion_count(text: Column, is_test: Column) -> Column:
    return F.when(is_test, F.regexp_count(text, F.lit(ASSERTION))).otherwise(F.lit(0))


def doc_words(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(text, F.lit(WORD))


def content_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def excerpt(lines: DataFrame, marks: DataFrame, on: list[str], context: int = 3, head: int = 12, width: int = 400) -> DataFrame:
    """Lines around each mark; a mark with no line shows the first ``head`` lines.

    The span is exploded into line numbers, at most ``max(2 * context + 1, head)``
    per mark, so the range join is a plain equi join that shuffles on (file, line).
    """
    span = F.when(F.col("line") <= 0, F.sequence(F.lit(1), F.lit(head))).otherwise(
        F.sequence(F.greatest(F.col("line") - context, F.lit(1)), F.col("line") + context)
    )
    wanted = marks.select(*on, F.col("line").alias("mark"), F.explode(span).alias("line"))
    return wanted.join(lines, [*on, "line"]).select(
        *on, "mark", "line", F.substring("content", 1, width).alias("content"),
        (F.col("line") == F.col("mark")).alias("is_mark"),
    )
