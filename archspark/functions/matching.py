"""Regular-expression matches with positions, and brace blocks, as in-row expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from archspark.functions.frames import let, running

HIT = "array<struct<match:string,line:int,start:int,stop:int,before:string>>"


def feeds(text: Column) -> Column:
    """Line feeds in a text."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """All matches in order with their line, the offsets of their start and end, and the text since the match before.

    Spark gives matched strings only, so the text in front of each is captured too
    and the lengths are added up.  ``\\G`` ties a search to the end of the last
    match, which keeps the scan linear.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.regexp_extract_all(text, F.lit(rf"\G(?s:(.*?))(?:{pattern})"), F.lit(1))

    def sums(held: Column) -> Column:
        size = lambda measure: running(F.zip_with(held["before"], held["found"], lambda b, m: measure(b) + measure(m)))
        ends = F.arrays_zip(held["found"].alias("match"), held["before"].alias("before"),
                            size(F.char_length).alias("stop"), size(feeds).alias("feeds"))
        return F.transform(ends, lambda e: F.struct(
            e["match"].alias("match"), (e["feeds"] - feeds(e["match"]) + 1).alias("line"),
            (e["stop"] - F.char_length(e["match"])).alias("start"), e["stop"].alias("stop"), e["before"].alias("before")))

    held = F.struct(found.alias("found"), before.alias("before"))
    return F.when(text.rlike(pattern), let(held, sums)).otherwise(F.expr(f"cast(array() as {HIT})"))


def _partners(pieces: Column) -> Column:
    """Per piece the number of the piece that closes its brace; null where it closes one itself or has no partner.

    A piece is a text up to and with its brace. On one level of nesting, opening and closing braces
    take turns, so sorted by level and place the partner of an opening brace is the next one, if that is of its level.
    """
    steps = F.transform(pieces, lambda p: F.when(p.endswith("{"), F.lit(1)).otherwise(F.lit(-1)))

    def pair(held: Column) -> Column:
        placed = F.zip_with(held["steps"], held["depth"], lambda s, d: F.struct(
            (d + F.when(s == 1, 0).otherwise(1)).alias("level"), (s == 1).alias("opens")))
        ordered = F.array_sort(F.transform(placed, lambda p, i: F.struct(p["level"].alias("level"), i.alias("piece"), p["opens"].alias("opens"))))

        def next_of(rows: Column) -> Column:
            after = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
            closes = F.zip_with(rows, after, lambda a, b: F.struct(
                a["piece"].alias("piece"), F.when(a["opens"] & (a["level"] == b["level"]), b["piece"]).alias("close")))
            return F.transform(F.array_sort(closes), lambda c: c["close"])

        return let(ordered, next_of)

    return let(steps, lambda s: let(F.struct(s.alias("steps"), running(s).alias("depth")), pair))


def blocks(text: Column, pattern: str) -> Column:
    """Declarations whose pattern ends at an opening brace, with their brace body.

    The body runs to the partner of that brace, or to the end of the text where it has none. All braces of the text are
    paired at once, so nested and repeated declarations don't search it again.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^{}]*[{}]"), F.lit(0))
    braces = lambda s: F.char_length(s) - F.char_length(F.translate(s, "{}", ""))

    def bodies(held: Column) -> Column:
        def row(hit: Column, count: Column) -> Column:
            close = held["partners"][count - 1]
            last = F.coalesce(close, F.size(held["pieces"]) - 1)
            inner = F.array_join(F.slice(held["pieces"], count + 1, last - count + 1), "")
            return F.struct(
                hit["match"].alias("header"), hit["line"].alias("line"), hit["start"].alias("start"), hit["stop"].alias("stop"),
                hit["before"].alias("before"),
                F.when(close.isNull(), F.concat(inner, F.element_at(F.split(text, "[{}]"), -1)))
                .otherwise(F.substring(inner, F.lit(1), F.char_length(inner) - 1)).alias("body"),
            )

        counts = running(F.transform(held["hits"], lambda h: braces(h["before"]) + braces(h["match"])))
        return F.zip_with(held["hits"], counts, row)

    def paired(held: Column) -> Column:
        return let(F.struct(held["hits"].alias("hits"), held["pieces"].alias("pieces"), _partners(held["pieces"]).alias("partners")), bodies)

    none = F.expr("cast(array() as array<struct<header:string,line:int,start:int,stop:int,before:string,body:string>>)")
    held = F.struct(matches(text, pattern).alias("hits"), pieces.alias("pieces"))
    return F.when(text.rlike(pattern), let(held, paired)).otherwise(none)


def group(text: Column, pattern: str, index: int) -> Column:
    """One group of the first match; blank where it took no part."""
    return F.regexp_extract(text, pattern, index)


def first_by(items: Column, field: str) -> Column:
    """Keep the first struct of each value of ``field``."""
    names = F.transform(items, lambda x: x[field])
    return F.filter(items, lambda x, i: F.array_position(names, x[field]) == i + 1)


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


# Words that look like a call or a method but are control flow.
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "return", "foreach", "using", "lock", "do", "else")
CALL = r"(?U)(?:([A-Za-z_]\w*)\s*(?:\.|->|::))?([A-Za-z_]\w*)\s*\("
METHOD = (
    r"(?U)((?:\b(?:public|private|protected|internal|static|final|abstract|virtual|override|async|extern|unsafe"
    r"|sealed|partial)\b\s+)*)([A-Za-z_][\w<>,\[\].?* ]*?)\s+([A-Za-z_]\w*)\s*\(([^;{)]*)\)\s*(?:const\s*)?"
    r"(?:->[^{;]+)?(?:\{|;)"
)
FIELD = (
    r"(?U)((?:\b(?:public|private|protected|internal|static|final|readonly|const|volatile|mutable)\b\s+)+)"
    r"([A-Za-z_][\w<>,\[\].?*]*)\s+([A-Za-z_]\w*)\s*(?:=[^;]+)?;"
)


def calls(body: Column) -> Column:
    """Callee names of the distinct (receiver, callee) pairs."""
    pairs = F.transform(
        F.regexp_extract_all(body, F.lit(CALL), F.lit(0)),
        lambda c: F.struct(group(c, CALL, 1).alias("receiver"), group(c, CALL, 2).alias("callee")),
    )
    real = F.filter(pairs, lambda p: ~p["callee"].isin(*CONTROL_WORDS) & (F.char_length(p["callee"]) >= 3))
    return F.transform(F.array_distinct(real), lambda p: p["callee"])


def visibility_of(modifiers: Column, default: str) -> Column:
    low = F.lower(modifiers)
    return (
        F.when(low.rlike(r"\bpublic\b"), "public").when(low.rlike(r"\bprivate\b"), "private")
        .when(low.rlike(r"\bprotected\b"), "protected").when(low.rlike(r"\binternal\b"), "package")
        .otherwise(default)
    )


def split_top(raw: Column, brackets: str = "<>") -> Column:
    """Split at commas outside brackets."""
    o, c = brackets

    def step(acc: Column, piece: Column) -> Column:
        # a piece continues the last part while a bracket is open in it
        last = F.element_at(acc, -1)
        opened = F.char_length(last) - F.char_length(F.replace(last, F.lit(o), F.lit("")))
        closed = F.char_length(last) - F.char_length(F.replace(last, F.lit(c), F.lit("")))
        joined = F.concat(last, F.lit(","), piece)
        return F.when(F.size(acc) == 0, F.array(piece)).when(
            opened > closed, F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)
        ).otherwise(F.array_append(acc, piece))

    return F.aggregate(F.split(raw, ","), F.expr("cast(array() as array<string>)"), step)


def parse_params(raw: Column) -> Column:
    """(name, type) of each parameter; the last token is the name."""
    words = F.transform(
        split_top(raw), lambda p: F.filter(
            F.split(F.trim(F.replace(p, F.lit("*"), F.lit("* "))), r"\s+"),
            lambda t: (t != "") & ~t.isin("final", "const", "in", "out", "ref", "params"),
        ),
    )
    return F.transform(
        F.filter(words, lambda w: F.size(w) > 0),
        lambda w: F.struct(
            F.when(F.size(w) == 1, w[0]).otherwise(F.regexp_replace(F.element_at(w, -1), r"^[&*]+|[&*]+$", "")).alias("name"),
            F.when(F.size(w) == 1, "").otherwise(F.array_join(F.slice(w, 1, F.size(w) - 1), " ")).alias("type"),
        ),
    )


def param_count(raw: Column) -> Column:
    return F.size(parse_params(raw))


def type_names(raw: Column) -> Column:
    """Names of an inheritance clause: no constraints, modifiers, generics or packages."""
    bare = F.regexp_replace(raw, r"(?s)\bwhere\b.*$", "")
    names = F.transform(
        split_top(bare),
        lambda p: F.trim(F.element_at(F.split(F.regexp_replace(F.trim(p), r"^(?:public|private|protected|virtual)\s+", ""), "<"), 1)),
    )
    kept = F.filter(names, lambda n: n.rlike(r"^(?:\p{L}|_)"))
    return F.transform(kept, lambda n: F.element_at(F.split(n, r"\."), -1))


def methods(body: Column, default: str) -> Column:
    """Method structs of a body, first of each name."""
    rows = F.transform(
        F.regexp_extract_all(body, F.lit(METHOD), F.lit(0)),
        lambda m: F.struct(
            group(m, METHOD, 3).alias("name"), visibility_of(group(m, METHOD, 1), default).alias("visibility"),
            F.element_at(F.split(F.trim(group(m, METHOD, 2)), r"\s+"), -1).alias("returns"),
            parse_params(group(m, METHOD, 4)).alias("params"),
            group(m, METHOD, 1).contains("static").alias("is_static"),
            group(m, METHOD, 1).contains("abstract").alias("is_abstract"),
            group(m, METHOD, 1).contains("async").alias("is_async"),
            F.trim(group(m, METHOD, 2)).alias("ret"),
        ),
    )
    real = F.filter(rows, lambda r: ~r["name"].isin(*CONTROL_WORDS) & ~r["ret"].isin(*CONTROL_WORDS) & (r["ret"] != ""))
    kept = first_by(real, "name")
    return F.transform(kept, lambda r: F.struct(*[r[c].alias(c) for c in (
        "name", "visibility", "returns", "params", "is_static", "is_abstract", "is_async")]))


def fields(body: Column, default: str = "private") -> Column:
    """Property structs of a body, first of each name."""
    rows = F.transform(
        F.regexp_extract_all(body, F.lit(FIELD), F.lit(0)),
        lambda m: F.struct(
            group(m, FIELD, 3).alias("name"), group(m, FIELD, 2).alias("type"),
            visibility_of(group(m, FIELD, 1), default).alias("visibility"),
        ),
    )
    return first_by(rows, "name")


def hints(names: Column, table: Sequence[tuple[str, str, str]], how: str = "contains") -> Column:
    """(kind, label) of the first table row each name meets, in table order."""

    def look(name: Column) -> Column:
        low = F.lower(name)
        out = F.lit(None).cast("struct<kind:string,label:string>")
        for token, kind, label in reversed(table):
            test = low.contains(token) if how == "contains" else low == token
            out = F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.array_compact(F.transform(names, look))
