"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: the model of each sees the words of a text and
the probabilities of all earlier categories.  When the chain is fitted, those probabilities
come from models that did not see the row (out-of-fold, ``FOLDS`` folds by a hash of the id),
so that later models meet inputs as uncertain as they will be in use.

The chain is fitted on the driver on at most ``MAX_LABELLED`` labelled rows, those with the
smallest hash of their id; of a text only the set of its features travels, as 32-bit
checksums: words, and stems of words by their share of the text, since a single word of a
frequent family says little and many of them say much.  Every document is scored.  A document is rejected at the threshold that out-of-fold scores found best.

Defined results: a null or empty text has no words and gets the base rates; labels that
repeat for an id count once (the largest wins); null labels are left out; with no labels, or
no positive or negative ones, a category is constant and rejects nothing; repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored by ``score``
and kept by ``reject``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain as chain_of
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches

MAX_LABELLED = 8000
FOLDS = 5
#: Words that a model may use: those with the strongest association, seen in enough rows.
MAX_WORDS, LEAST_ROWS = 3000, 4
#: In the order of the chain; ``unfit`` is either of the other two, and ``toxic`` sees both before it.
CATEGORIES = ("low_quality", "unfit", "toxic")
#: Letters of a stem, and the share of a text's words from which it counts.
STEMS, RATE = (4, 5), 0.004
WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> np.ndarray:
    """Checksums of the features of a text, in ascending order: its distinct words, and stems
    (the first letters of longer words) that it has at a RATE and, apart, at that rate twice or more."""
    words = WORDS(text.lower()) if text else []
    found = {w: n for w, n in Counter(words).items()}
    stems: Counter = Counter()
    for w, n in found.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    marks = []
    for stem, n in stems.items():
        if n >= RATE * len(words):
            marks.append(stem + "+")
            if n > 1:
                marks.append(stem + "++")
    return np.unique(np.fromiter(map(crc32, map(str.encode, chain_of(found, marks))), np.uint32, len(found) + len(marks)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Logistic regression on the presence of words and on earlier probabilities."""

    words: np.ndarray  # ascending
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, words: np.ndarray, earlier: list[float]) -> float:
        z = self.bias + float(np.dot(self.earlier, earlier))
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            z += float(self.weights[at[self.words[at] == words]].sum())
        return float(sigmoid(z))


def choose(row, col, y, n_words) -> np.ndarray:
    """The columns with the strongest association, by the z-score of smoothed log odds."""
    pos = np.bincount(col, weights=y[row], minlength=n_words)
    total = np.bincount(col, minlength=n_words)
    n1, n0 = y.sum() + 2, len(y) - y.sum() + 2
    a, b = pos + 0.5, total - pos + 0.5
    z = (np.log(a / (n1 - a)) - np.log(b / (n0 - b))) / np.sqrt(1 / a + 1 / b)
    z[total < LEAST_ROWS] = 0
    order = np.argsort(-np.abs(z), kind="stable")[:MAX_WORDS]
    return order[np.abs(z[order]) > 2]


def fit_linear(row, col, y, earlier, vocabulary, rounds: int = 120, decay: float = 1e-3) -> Linear:
    """Full-batch Adam; sparse rows as (row, col) pairs."""
    if not 0 < y.sum() < len(y):
        none = np.zeros(0)
        return Linear(none.astype(np.uint32), none, np.zeros(earlier.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))) if len(y) else -13.8)
    chosen = choose(row, col, y, len(vocabulary))
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[col] >= 0
    r, c, k = row[keep], place[col[keep]], len(chosen)
    w = np.zeros(k + earlier.shape[1] + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(r, weights=w[c], minlength=len(y)) + earlier @ w[k:-1] + w[-1]
        d = (sigmoid(z) - y) / len(y)
        g = np.concatenate([np.bincount(c, weights=d[r], minlength=k), d @ earlier, [d.sum()]]) + decay * w * np.append(np.ones(len(w) - 1), 0) / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    order = np.argsort(chosen)
    return Linear(vocabulary[chosen[order]], w[:k][order], w[k:-1].copy(), float(w[-1]))


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    limits: dict[str, float]

    def score(self, words: np.ndarray) -> list[float]:
        out: list[float] = []
        for model in self.models:
            out.append(model.score(words, out))
        return out


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the largest F1, halfway to the next lower score; over 1 if none is positive."""
    if not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else 0)) / 2)


def fit(rows: list[tuple[np.ndarray, int, tuple[int, ...]]], categories=CATEGORIES) -> Chain:
    """rows: (words, fold, one 0/1 label for each category)"""
    sizes = np.array([len(words) for words, _, _ in rows], np.int64)
    everything = np.concatenate([np.zeros(0, np.uint32), *(words for words, _, _ in rows)])
    vocabulary, col, counts = np.unique(everything, return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(rows)), sizes), counts >= LEAST_ROWS
    place = np.cumsum(often) - 1
    row, col, vocabulary = row[often[col]], place[col[often[col]]], vocabulary[often]
    fold = np.array([f for _, f, _ in rows], np.int64)
    labels = np.array([y for _, _, y in rows], float).reshape(len(rows), len(categories))
    held = np.zeros((len(rows), 0))
    chain = Chain(tuple(categories), [], {})
    for k, name in enumerate(categories):
        y, own = labels[:, k], np.zeros(len(rows))
        for f in range(FOLDS):
            out = fold == f
            new = np.cumsum(~out) - 1
            part = ~out[row]
            model = fit_linear(new[row[part]], col[part], y[~out], held[~out], vocabulary)
            own[out] = [model.score(rows[i][0], held[i]) for i in np.flatnonzero(out)]
        chain.models.append(fit_linear(row, col, y, held, vocabulary))
        chain.limits[name] = best_limit(own, y)
        held = np.column_stack([held, own])
    return chain


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELLED) -> Chain:
    """Fit on at most ``bound`` labelled rows, the same ones on every run."""
    given = (
        labels.select(F.col(id_col).alias("id"), (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
        .where("id IS NOT NULL AND low IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(bound)
    )

    def rows(it):
        for batch in it:
            yield batch.select(["id", "low", "toxic"]).append_column("words", pa.array([words_of(t).tobytes() for t in batch["text"].to_pylist()], pa.binary()))

    # ``given`` has at most ``bound`` rows of three numbers, so it may be broadcast.
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(given), "id")
    # Documents that repeat an id count once, the one with the least text.
    src = src.groupBy("id", "low", "toxic").agg(F.min("text").alias("text"))
    found = sorted(src.mapInArrow(rows, "id long, low int, toxic int, words binary").collect())
    return fit([(np.frombuffer(r["words"], np.uint32), (r["id"] * 2654435761 % 4294967296 >> 16) % FOLDS, (r["low"], r["low"] | r["toxic"], r["toxic"])) for r in found])


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., toxic): toxic where the chain rejects the text."""
    names = [f"p_{c}" for c in chain.categories]

    def rows(it):
        schema = pa.schema([("id", pa.int64()), *((n, pa.float64()) for n in names), ("toxic", pa.bool_())])

        def fn(c):
            table = [chain.score(words_of(t)) for t in c["text"]]
            res = {"id": c["id"]} | {n: [p[k] for p in table] for k, n in enumerate(names)}
            return res | {"toxic": [rejected(chain, p) for p in table]}

        return batches(it, fn, schema)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean").withColumnRenamed("id", id_col)


def rejected(chain: Chain, p: list[float]) -> bool:
    k = chain.categories.index("toxic")
    return p[k] >= chain.limits["toxic"]


def reject(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the chain does not reject."""

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: not rejected(chain, chain.score(words_of(t))))

    return docs.where(clean(F.col(text_col)))
