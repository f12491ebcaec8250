"""Small DataFrame helpers: ranks, safe ratios, key handling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.session import staged


def cols(names: Sequence[str], alias: str | None = None) -> list[Column]:
    return [F.col(f"{alias}.{n}" if alias else n) for n in names]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str | None = None) -> DataFrame:
    """First ``limit`` rows per key.

    Spark turns the filter on ``row_number`` into a window group limit before the
    shuffle, so a key that holds most of the rows sends ``limit`` rows per task.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)
    return out if rank else out.drop(name)


def with_key_total(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add per-key aggregates by aggregate and join; a window would pull a hot key into one task."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, list(keys))


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: its rows meet the other side by a shuffle.

    The planner takes the size of a table from its files and the share of its columns by their type. A few short columns of a wide,
    well compressed table look like a few MB, so millions of rows would go through the driver to every executor.
    """
    return df.hint("merge")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as the measures are defined."""
    return F.bround(value.cast("double"), digits)


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def first_match(value: Column, table, contains: bool = True, default: Column | None = None) -> Column:
    """Ordered lookup: result of the first (token, result) pair the value contains."""
    expr = None
    for token, result in table:
        test = value.contains(token) if contains else value == token
        expr = F.when(test, F.lit(result)) if expr is None else expr.when(test, F.lit(result))
    return expr.otherwise(F.lit("") if default is None else default)


def rank_in(value: Column, ordered: Sequence[str], default: int = 99) -> Column:
    """Position of the value in a fixed order."""
    expr = F.lit(default)
    for i, item in reversed(list(enumerate(ordered))):
        expr = F.when(value == item, F.lit(i)).otherwise(expr)
    return expr


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also inside its lambdas.

    An expression in a lambda is evaluated for each element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """Running sums of an array of ints.

    A fold copies its state at each element, so one that grows a list costs quadratic time. Here the array is added to itself,
    moved by 1, 2, 4, ... places: as many passes as its length has binary digits.
    """

    def add(sums: Column, move: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), F.least(move, F.size(sums))), F.slice(sums, F.lit(1), F.greatest(F.size(sums) - move, F.lit(0))))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    digits = F.length(F.bin(F.size(values)))
    return F.aggregate(F.sequence(F.lit(0), digits - 1), values, lambda sums, k: add(sums, F.pow(F.lit(2), k).cast("int")))


def substring_pairs(needles: DataFrame, names: DataFrame, keys: Sequence[str], needle: str = "needle", name: str = "name", size: int = 3) -> DataFrame:
    """(keys, needle, name) where the name holds the needle, both of the same keys; distinct rows in, distinct rows out.

    Names are indexed by their runs of ``size`` letters (needles that are shorter, by runs of their length). A needle meets only the
    names that share its rarest run, and those are compared in full. Runs that no needle has are dropped before any shuffle by name, and a
    needle with a run that no name has meets nothing. Empty needles meet nothing.
    """
    keys = list(keys)

    def runs(text: str, length: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - length + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, length)))

    asked = needles.filter(F.col(needle) != "").select(*keys, F.col(needle).alias("needle")).distinct()
    asked = asked.withColumn("gram", F.explode(runs("needle", F.least(F.char_length("needle"), F.lit(size)))))
    wanted = asked.select(*keys, "gram").distinct()
    held = names.select(*keys, F.col(name).alias("name")).distinct()
    index = held.withColumn("length", F.explode(F.sequence(F.lit(1), F.lit(size)))).filter(F.char_length("name") >= F.col("length"))
    index = index.withColumn("gram", F.explode(runs("name", F.col("length")))).select(*keys, "name", "gram").join(wanted, [*keys, "gram"], "left_semi")
    counts = index.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, [*keys, "gram"], "left").groupBy(*keys, "needle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    # written, so that the planner knows how few they are and the index of all names need not be shuffled to meet them
    rarest = staged(rarest.select(*keys, "needle", F.col("r.gram").alias("gram")), "rarest-grams")
    met = index.join(rarest, [*keys, "gram"])
    return met.filter(F.contains("name", "needle")).select(*keys, F.col("needle").alias(needle), F.col("name").alias(name))
