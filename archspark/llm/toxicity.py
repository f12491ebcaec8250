"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are the shares (per 100 words) of words and of longer words' prefixes in a text, chosen by their correlation with the label.
Prefixes let inflected and compound forms count that no labelled row has. Identity terms are always features. In labelled
sentences that mention a group, the identity term is swapped for the others of its list; each swap adds the
squared change of the score to the loss, so that a group's mere mention can't move a score that the others' mention doesn't.
The model is linear, so the penalty is a quadratic form in the weights and the fit is by Newton steps.

The fit uses ``max_rows`` labelled rows at most (those of smallest hash of the id) and ``max_features`` features; scores are
of whole texts and of every row.

Defined results: null and empty texts get the score of a text without known words; rows without a label or with a null label aren't
learnt from; repeated labels of an id count once (toxic wins); without any usable label the score is the prior 1/11 for every row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import alnum_words, raw_texts, slices, staged

#: Fixed lists: identity terms that stand for one another, in the four languages of the corpus.
IDENTITY = (
    "women men girls boys people persons",
    "woman man girl boy person someone",
    "muslims christians jews hindus buddhists atheists believers",
    "muslim christian jewish hindu buddhist atheist religious",
    "black white asian african european hispanic latino indigenous",
    "gay straight lesbian bisexual heterosexual transgender queer",
    "immigrants refugees foreigners citizens locals migrants",
    "disabled deaf blind elderly young old",
    "frauen männer mädchen jungen menschen leute",
    "muslime christen juden hindus buddhisten atheisten",
    "femmes hommes filles garçons personnes gens",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "mujeres hombres niñas niños personas gente",
    "musulmanes cristianos judíos hindúes budistas ateos",
)
GROUPS = [[w.encode() for w in line.split()] for line in IDENTITY]
TERMS = sorted({w for g in GROUPS for w in g})
SENTENCE_END = b".!?\n"


PREFIXES = range(4, 9)
DAMP = 20
CACHE_WORDS = 300_000


def features(word: bytes) -> list[bytes]:
    """The word, and its proper prefixes of some lengths in bytes; ``*`` occurs in no word."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if k < len(word))]


def shares(words: list[bytes]) -> dict[bytes, float]:
    """Occurrences of each feature per 100 words; very short texts are damped."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features(word):
            out[f] += n
    scale = 100.0 / (len(words) + DAMP)
    return {f: n * scale for f, n in out.items()}


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "known": {}}

    def weight(self, word: bytes) -> float:
        """Sum over the word's features; recurring words are looked up in a bounded cache."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            get = self.weights.get
            found = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def score(self, text: bytes) -> float:
        words = alnum_words(text)
        z = self.bias + math.fsum(map(self.weight, words)) * 100.0 / (len(words) + DAMP)
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, z))))

    def column(self, text: Column) -> Column:
        """Score of a text column."""
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([model.score((t or "").encode()) for t in texts], dtype="float64")

        return score(text)


def swaps(text: bytes) -> dict[tuple[bytes, bytes], int]:
    """(term, its replacement) -> sentences in which the swap changes the text's words."""
    words = set(alnum_words(text))
    out: dict[tuple[bytes, bytes], int] = {}
    if words.isdisjoint(TERMS):
        return out
    for sentence in text.translate(bytes(10 if b in SENTENCE_END else b for b in range(256))).split(b"\n"):
        own = set(alnum_words(sentence))
        for group in GROUPS:
            for term in own.intersection(group):
                for other in group:
                    if other not in own:
                        out[term, other] = out.get((term, other), 0) + 1
    return out


def labelled_shares(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Written table of the bounded training rows: y, features with their shares, swaps (flat pairs with counts)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select((F.col("y") > 0).cast("int").alias("y"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = raw_texts(part.column(1))
            changed = [swaps(t) for t in texts]
            own = [shares(alnum_words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([list(o) for o in own], pa.list_(pa.binary())),
                    pa.array([list(o.values()) for o in own], pa.list_(pa.float32())),
                    pa.array([[x for pair in c for x in pair] for c in changed], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in changed], pa.list_(pa.int64())),
                ],
                ["y", "names", "shares", "pairs", "times"],
            )

    schema = "y int, names array<binary>, shares array<float>, pairs array<binary>, times array<bigint>"
    return staged(rows.mapInArrow(run, schema), "toxic-rows")


def choose_features(rows: DataFrame, n: int, n1: int, max_features: int, min_docs: int) -> list[bytes]:
    """Features whose shares correlate most with the label, ties by name."""
    seen = rows.select("y", F.explode(F.arrays_zip("names", "shares")).alias("f"))
    v = F.col("f.shares").cast("double")
    seen = seen.groupBy(F.col("f.names").alias("name")).agg(
        F.count("*").alias("docs"), F.sum(v).alias("v"), F.sum(v * v).alias("vv"), F.sum(v * F.col("y")).alias("vy")
    )
    covariance = n * F.col("vy") - F.col("v") * n1
    spread = n * F.col("vv") - F.col("v") * F.col("v")
    best = (
        seen.filter((F.col("docs") >= min_docs) & (spread > 1e-9))
        .withColumn("r2", F.round(covariance * F.abs(covariance) / spread, 6))
        .orderBy(F.col("r2").desc(), "name")
        .limit(max_features)
    )
    return [bytes(r["name"]) for r in best.select("name").collect()]


def newton_fit(x: np.ndarray, y: np.ndarray, ridge: float, penalty: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights (bias last, not penalised) of the logistic loss with ridge and a quadratic penalty."""
    n, k = x.shape
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    extra = np.zeros((k + 1, k + 1))
    extra[:k, :k] = penalty + ridge * np.eye(k)
    extra[k, k] = 1e-6
    w = np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (p - y) + extra @ w
        h = x1.T @ (x1 * (p * (1 - p) + 1e-9)[:, None]) + extra
        move = np.linalg.solve(h, gradient)
        w = w - move * min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12000,
    max_features: int = 300,
    min_docs: int = 4,
    ridge: float = 0.05,
    swap_weight: float = 0.1,
) -> ToxicityModel:
    rows = labelled_shares(docs, labels, max_rows, id_col, text_col, label_col)
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not n1 or n1 == n:
        p = (n1 + 0.1) / (n + 1.1)
        return ToxicityModel(math.log(p / (1 - p)))
    names = sorted({*choose_features(rows, n, n1, max_features, min_docs), *TERMS})
    place = {w: i for i, w in enumerate(names)}

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            pairs = [[(place[w], v) for w, v in zip(ws, vs) if w in place] for ws, vs in zip(part.column("names").to_pylist(), part.column("shares").to_pylist())]
            cells = [
                part.column("y"),
                pa.array([[i for i, _ in p] for p in pairs], pa.list_(pa.int32())),
                pa.array([[v for _, v in p] for p in pairs], pa.list_(pa.float32())),
                part.column("pairs"),
                part.column("times"),
            ]
            yield pa.RecordBatch.from_arrays(cells, ["y", "at", "shares", "pairs", "times"])

    data = rows.mapInArrow(known, "y int, at array<int>, shares array<float>, pairs array<binary>, times array<bigint>").toArrow()
    x = np.zeros((data.num_rows, len(names)), np.float32)
    penalty = np.zeros((len(names), len(names)))
    for i, (at, values, pairs, times) in enumerate(zip(*(data[c].to_pylist() for c in ("at", "shares", "pairs", "times")))):
        x[i, at] = values
        for a, b, t in zip(pairs[::2], pairs[1::2], times):
            change = np.zeros(len(names))
            for word, sign in ((a, 1.0), (b, -1.0)):
                for f in features(word):
                    if f in place:
                        change[place[f]] += sign
            used = np.flatnonzero(change)
            penalty[np.ix_(used, used)] += swap_weight * t * np.outer(change[used], change[used])
    w = np.round(newton_fit(x, data["y"].to_numpy().astype(float), ridge, penalty), 4)
    return ToxicityModel(float(w[-1]), {name: float(v) for name, v in zip(names, w[:-1]) if v})


def held_out(id_column: Column, parts: int = 5) -> Column:
    """A null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % parts == 0, F.lit(False))

