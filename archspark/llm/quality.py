"""Quality scores from overlapping heuristic labellers.

Labellers look at surface measures of a text and vote good (1), bad (0) or nothing (-1). Rows are counted by vote pattern over all
documents; expectation-maximisation on the counts estimates each labeller's accuracy for either class and the share of good texts,
with no labels given. Each pattern's posterior is the target of a hashed linear scorer over character shapes and words,
so texts on which labellers say little are still told apart.

The scorer is fitted on ``max_rows`` documents at most, drawn in equal parts (as far as they reach) from rows that the
labellers call good and bad, by smallest hash of id and text. Votes, counts, posteriors and scores cover all rows.

Defined results: null and empty texts get the bad vote of the length labeller; repeated rows count as often as they occur;
rows with a null id are scored like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import raw_texts, slices, staged

BITS = 14
#: Fixed list: frequent function words of the four languages.
STOPWORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his this are or had at from which but have an "
    "der die und das von zu den mit ist des sich ein nicht auch auf eine dem im als für es werden "
    "le la les et des de un une que en dans du est pour qui sur pas par plus il au se "
    "el los las y que del se por con una su para es al lo como más pero sus".split()
)
#: Words a Python worker keeps, about 100 MB; the facts of further words are worked out each time.
KNOWN_WORDS = 500_000


class WordFacts:
    """Facts of words as rows of a matrix; words recur across documents, so each Python worker keeps a bounded number of them.

    Columns: length, letters and digits, letters, capitals, marked, bar, function word; hash buckets of shape, end and
    function word (or -1).
    """

    def __init__(self):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, 10), np.int32)

    @staticmethod
    def facts(word: str) -> tuple[int, ...]:
        capitals, letters = sum(map(str.isupper, word)), sum(map(str.isalpha, word))
        low = word.lower()
        shape = re.sub(r"(.)\1+", r"\1+", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:40]))
        return (
            len(word),
            sum(map(str.isalnum, word)),
            letters,
            capitals,
            len(word) > 2 and not word[-1].isalnum() and word[-1] == word[-2],
            word in ("|", "»", "·", ">", "•"),
            low.strip(".,;:!?") in STOPWORDS,
            zlib.crc32(b"s" + shape.encode()) >> 32 - BITS,
            zlib.crc32(b"e" + word[-2:].encode()) >> 32 - BITS,
            zlib.crc32(b"w" + low.encode()) >> 32 - BITS if low in STOPWORDS else -1,
        )

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, facts) of the distinct words."""
        counts = Counter(words)
        at = np.array([self.place.get(w, -1) for w in counts], np.int64)
        unknown = np.flatnonzero(at < 0)
        out = self.rows[at]
        if len(unknown):
            names = list(counts)
            fresh = [names[i] for i in unknown]
            made = np.array([self.facts(w) for w in fresh], np.int32)
            out[unknown] = made
            kept = min(len(fresh), KNOWN_WORDS - len(self.place))
            if kept > 0:
                self._keep(fresh[:kept], made[:kept])
        return np.fromiter(counts.values(), np.float64, len(counts)), out

    def _keep(self, words: list[str], made: np.ndarray) -> None:
        first = len(self.place)
        need = first + len(words)
        if need > len(self.rows):
            size = min(KNOWN_WORDS, max(need, len(self.rows) * 3 // 2))
            self.rows = np.concatenate([self.rows, np.zeros((size - len(self.rows), 10), np.int32)])
        self.rows[first:need] = made
        self.place.update(zip(words, range(first, need)))


_facts = WordFacts()


def measures(text: str) -> dict[str, float]:
    words = text.split()
    counts, facts = _facts.of(words)
    length, plain, letters, capitals, marked, bars, stop = counts @ facts[:, :7]
    n, chars = max(1, len(words)), max(1.0, length)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return {
        "words": len(words),
        "letters": plain / chars,
        "capitals": capitals / max(1.0, letters),
        "marked": marked / n,
        "bars": bars / n,
        "stop": stop / n,
        "distinct": len(counts) / n,
        "run": counts.max(initial=0) / n,
        "echo": sum(map(operator.eq, words, words[1:])) / n,
        "ended": sum(x[-1] in ".!?:\"'" for x in lines) / max(1, len(lines)),
        "mean": chars / n,
        "lines": len(set(lines)) / max(1, len(lines)),
    }


def _between(value: float, bad: float, good: float) -> int:
    """Good beyond ``good``, bad beyond ``bad``, silent between."""
    if bad < good:
        return 1 if value >= good else 0 if value <= bad else -1
    return 1 if value <= good else 0 if value >= bad else -1


def votes(text: str) -> list[int]:
    """One vote per labeller, in the order of LABELLERS."""
    m = measures(text)
    words, short = m["words"], m["words"] < 8
    return [
        0 if not words else 1 if words >= 30 else -1,
        -1 if short else _between(m["letters"], 0.8, 0.93),
        _between(m["capitals"], 0.4, 0.12),
        _between(m["marked"], 0.2, 0.02),
        _between(m["bars"], 0.15, 0.01),
        -1 if short else _between(m["stop"], 0.05, 0.15),
        -1 if short else _between(m["run"], 0.4, 0.15),
        -1 if short else _between(m["echo"], 0.08, 0.02),
        -1 if short else _between(m["distinct"], 0.15, 0.35),
        -1 if short else _between(m["ended"], 0.2, 0.6),
        _between(m["mean"], 14.0, 9.0),
        -1 if short else _between(m["lines"], 0.4, 0.8),
    ]


LABELLERS = ("length", "letters", "capitals", "marked", "bars", "stop", "run", "echo", "distinct", "ended", "mean", "lines")


@dataclass
class LabelModel:
    """P(vote | class, a vote is cast) per labeller, and the share of class 1; silence (1 for either class) tells nothing."""

    share: float
    tables: np.ndarray  # labeller x class x (silence, bad, good)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes); patterns are rows of votes."""
        logs = np.log(self.tables)
        z = np.array([math.log(1 - self.share), math.log(self.share)]) + sum(logs[j, :, patterns[:, j] + 1] for j in range(patterns.shape[1]))
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e[:, 1] / e.sum(axis=1)

    @property
    def accuracies(self) -> np.ndarray:
        """Share of right votes among the votes that each labeller casts."""
        prior = np.array([1 - self.share, self.share])
        cast = (prior[None, :, None] * self.tables[:, :, 1:]).sum(axis=(1, 2))
        right = prior[0] * self.tables[:, 0, 1] + prior[1] * self.tables[:, 1, 2]
        return right / np.maximum(cast, 1e-12)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation; the start takes any bad vote as a fault, since each labeller knows few of them."""
    k = patterns.shape[1] if len(patterns) else len(LABELLERS)
    if not len(patterns):
        return LabelModel(0.5, np.ones((k, 2, 3)))
    p = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.ones((k, 2, 3)))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p], axis=1)
        share = float(np.clip((weight[:, 1].sum() + smooth) / (counts.sum() + 2 * smooth), 0.01, 0.99))
        tables = np.ones((k, 2, 3))
        for j in range(k):
            for v in (1, 2):
                tables[j, :, v] = smooth + weight[patterns[:, j] + 1 == v].sum(axis=0)
            tables[j, :, 1:] /= tables[j, :, 1:].sum(axis=1, keepdims=True)
        model = LabelModel(share, tables)
        now = model.posterior(patterns)
        if np.abs(now - p).max() < 1e-7:
            break
        p = now
    return model


def hashed_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): root shares of hashed words' shapes, ends and frequent words, unit length in all."""
    counts, facts = _facts.of(text.split())
    buckets, weight = facts[:, 7:].T.ravel(), np.tile(counts, 3)
    used = buckets >= 0
    sums = np.bincount(buckets[used], weight[used], minlength=1 << BITS)
    at = np.flatnonzero(sums).astype(np.int32)
    values = np.sqrt(sums[at])
    return at, values / max(1e-9, float(np.sqrt((values * values).sum())))


@dataclass
class QualityModel:
    bias: float
    weights: np.ndarray = field(repr=False)

    def score(self, text: str) -> float:
        at, values = hashed_shares(text)
        z = self.bias + float(self.weights[at] @ values)
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score(t or "") for t in texts], dtype="float64")

        return score(text)


def vote_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written (id, key, pattern): votes as text, key a hash of id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            patterns = ["".join("-01"[v + 1] for v in votes(t.decode())) for t in raw_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(patterns)], ["id", "key", "pattern"])

    keyed = rows.withColumn("key", _row_key("id", "text"))
    return staged(keyed.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key bigint, pattern string"), "quality-votes")


def fit_scorer(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, ridge: float = 1e-4, rounds: int = 300) -> QualityModel:
    """Logistic fit on the hashed shares of the bounded rows in ``targets`` (key, target)."""
    rows = docs.select(_row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [hashed_shares(t.decode()) for t in raw_texts(part.column("text"))]
            cells = [part.column("target"), pa.array([a for a, _ in own], pa.list_(pa.int32())), pa.array([v for _, v in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cells, ["target", "at", "shares"])

    chosen = rows.join(F.broadcast(targets), "key").dropDuplicates(["key"]).select("key", "text", "target")
    data = chosen.select("text", "target").mapInArrow(run, "target double, at array<int>, shares array<double>").toArrow()
    weights, bias = np.zeros(1 << BITS), 0.0
    n = data.num_rows
    if not n:
        return QualityModel(bias, weights)
    at, shares = data["at"].combine_chunks(), data["shares"].combine_chunks()
    cols, values = at.flatten().to_numpy(), shares.flatten().to_numpy()
    lengths = np.diff(at.offsets.to_numpy())
    row = np.repeat(np.arange(n), lengths)
    y = data["target"].to_numpy()
    momentum, slope = np.zeros_like(weights), 0.0
    for _ in range(rounds):  # accelerated gradient steps; rows have unit length, so the step is safe
        ahead, ahead_bias = weights + 0.9 * momentum, bias + 0.9 * slope
        z = np.bincount(row, values * ahead[cols], minlength=n) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        momentum = 0.9 * momentum - 2.0 * (np.bincount(cols, values * error[row], minlength=len(weights)) + ridge * ahead)
        slope = 0.9 * slope - 2.0 * error.sum()
        weights, bias = weights + momentum, bias + slope
    return QualityModel(round(float(bias), 5), np.round(weights, 5))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000) -> DataFrame:
    """One row per document: id, pattern (votes), posterior (labellers), score (linear scorer), keep."""
    cast = vote_table(docs, id_col, text_col)
    counted = cast.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3**labellers rows at most
    patterns = np.array([["-01".index(c) - 1 for c in r["pattern"]] for r in counted], np.int64).reshape(len(counted), len(LABELLERS))
    model = fit_labels(patterns, np.array([r["n"] for r in counted], np.float64))
    known = {r["pattern"]: round(float(p), 6) for r, p in zip(counted, model.posterior(patterns) if len(counted) else ())}

    @F.pandas_udf("double")
    def posterior(patterns: pd.Series) -> pd.Series:
        return patterns.map(known).astype("float64")

    judged = cast.withColumn("target", posterior("pattern"))
    half = max_rows // 2
    targets = None
    for side in (F.col("target") >= 0.5, F.col("target") < 0.5):
        part = judged.filter(side).select("key", "target").orderBy(F.xxhash64("key"), "key").limit(half)
        targets = part if targets is None else targets.unionAll(part)
    targets = staged(targets.dropDuplicates(["key"]), "quality-targets")
    scorer = fit_scorer(docs, targets, id_col, text_col)

    scored = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("key"), scorer.column(F.col(text_col)).alias("score"))
    voted = staged(judged.select(F.col("key").alias("voted_key"), "pattern", F.col("target").alias("posterior")).distinct(), "quality-judged")
    rows = scored.join(voted, F.col("key") == F.col("voted_key"))
    return rows.select("id", "pattern", "posterior", "score", ((F.col("posterior") + F.col("score")) / 2 >= 0.5).alias("keep"))


def _row_key(id_col: str, text_col: str) -> Column:
    """A hash that tells a null from any text; xxhash64 passes over nulls."""
    columns = [F.col(id_col).cast("string"), F.col(text_col)]
    return F.xxhash64(*[c.isNull() for c in columns], *columns)
