"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(w.x - theta_k): one weight per term, shared by all thresholds, which stay ordered. The
expected severity is the sum of these over k >= 1. Terms are lower-cased words without the punctuation around them, and
the beginnings of words (PREFIXES letters, marked by a final *), so that inflected and compound forms share weight. A term
gives two features: log(1 + count), and count / (count + 1% of the words), which tells a chance word of a long text from a
tone. Terms are screened by their covariance with the class, and an L1 penalty leaves few with weight.

Training uses a bounded sample of labelled rows (FIT_ROWS, the smallest digests of the id): documents labelled toxic get
the grade 1, 2 or 3 by thirds of how many of their words lean to the toxic class, all others grade 0. Every document is
scored over its whole text.

Defined cases: null or empty text has no feature and gets the model's base severity, which is below the threshold; rows
are scored one by one, whatever their ids; without usable labels (none of one class) all severities are 0. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import digest_sample, small_batches

FIT_ROWS = 5000
MIN_ROWS_OF_TERM = 5
SIGMAS = 8.0
PENALTY = 2e-3
STEPS = 800
PREFIXES = (3, 4, 5, 6, 7)
KNOWN = 200_000
REJECT = 0.5
EDGES = "\"'`.,;:!?()[]{}<>|/\\*&%$#@~^_=+-«»“”„‘’…–—"


def terms(text: str | None) -> Counter:
    """Counts of the words."""
    out: Counter = Counter()
    for raw, n in Counter((text or "").lower().split()).items():
        if w := raw.strip(EDGES):
            out[w] += n
    return out


def forms(word: str) -> list[str]:
    """The terms of a word: itself and its beginnings."""
    return [word, *[f"{word[:k]}*" for k in PREFIXES if len(word) >= k]]


def values(n: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log1p(n), n / (n + 0.01 * length)


@dataclass
class Model:
    """Weights of the two features of each term, and ordered thresholds; severity() gives the expected grade."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def found(self, raw: str) -> tuple[str, ...]:
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known[raw] = out = tuple(t for t in forms(raw.strip(EDGES)) if t in self.weights)
        return out

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        words = (text or "").lower().split()
        counts: Counter = Counter()
        known = self.known
        for raw, n in Counter(words).items():
            hit = known.get(raw)
            for t in self.found(raw) if hit is None else hit:
                counts[t] += n
        z = 0.0
        for t, n in sorted(counts.items()):
            a, b = self.weights[t]
            z += a * math.log1p(n) + b * n / (n + 0.01 * len(words))
        return float(sum(1 / (1 + math.exp(min(50.0, max(-50.0, theta - z)))) for theta in self.thresholds))


def grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """0 for clean rows; 1 to 3 for toxic ones by thirds of their number of terms that lean to the toxic class."""
    inside = np.bincount(cols, weights=toxic[rows], minlength=width)
    share, base = (inside + 0.5) / (np.bincount(cols, minlength=width) + 1), toxic.mean()
    leaning = np.bincount(rows, weights=(share > 0.5 + base / 2)[cols], minlength=len(toxic))
    found = leaning[(toxic == 1) & (leaning > 0)]
    cuts = np.quantile(found, [1 / 3, 2 / 3]) if len(found) else np.array([1.0, 2.0])
    return np.where(toxic == 1, 1 + (leaning > cuts[0]).astype(int) + (leaning > cuts[1]), 0)


class Sparse:
    """Features as (row, column, value), seen as standardised columns: none of the implied zeros is ever stored."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.x, (self.n, self.width) = rows, cols, x, shape
        self.centre = np.bincount(cols, x, self.width) / self.n
        self.scale = np.sqrt(np.maximum(np.bincount(cols, x * x, self.width) / self.n - self.centre**2, 1e-300))

    def times(self, v: np.ndarray) -> np.ndarray:
        u = v / self.scale
        return np.bincount(self.rows, self.x * u[self.cols], self.n) - self.centre @ u

    def back(self, e: np.ndarray) -> np.ndarray:
        return (np.bincount(self.cols, self.x * e[self.rows], self.width) - self.centre * e.sum()) / self.scale

    def norm(self, steps: int = 40) -> float:
        """Largest singular value, by the power method."""
        v, size = np.ones(self.width) / np.sqrt(self.width), 1.0
        for _ in range(steps):
            v = self.back(self.times(v))
            size = np.linalg.norm(v)
            v = v / max(size, 1e-300)
        return float(np.sqrt(size))


def _hashed(words: str, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the terms of a bag of words, and their counts."""
    one: Counter = Counter()
    for w, c in zip(words.split(" "), counts.tolist()):
        for t in forms(w):
            one[xxhash.xxh64_intdigest(t)] += c
    return np.fromiter(one.keys(), np.uint64, len(one)), np.fromiter(one.values(), np.float32, len(one))


def fit(bags: list[tuple[str, np.ndarray]], toxic: list[int]) -> Model:
    """Fit on bags of words (terms joined by spaces, and their counts): accelerated proximal gradient on the cumulative-link
    likelihood; plain numpy, no randomness. Terms are numbers until the few with weight are named again."""
    y = np.asarray(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model()
    n, lengths = len(y), np.array([c.sum() for _, c in bags], dtype=np.float32)
    found = [_hashed(*bag) for bag in bags]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(k) for k, _ in found])
    amount = np.concatenate([c for _, c in found])
    terms_of, cols = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    cols = cols.astype(np.int32)
    del found
    width = len(terms_of)
    held = np.bincount(cols, minlength=width)
    common = ((held >= MIN_ROWS_OF_TERM) & (held <= n / 2))[cols]  # a term of most documents tells nothing of one
    rows, cols, amount = rows[common], cols[common], amount[common]
    both = values(amount, lengths[rows])
    grade = grades(rows, cols, y, width)
    strong = np.zeros(width, dtype=bool)
    for x in both:  # terms whose covariance with the class is far from chance
        total, square = np.bincount(cols, x, width), np.bincount(cols, x * x, width)
        spread = np.sqrt(np.maximum(square - total * total / n, 0) * n) * y.std()
        strong |= (np.abs(np.bincount(cols, x * (y - y.mean())[rows], width)) * np.sqrt(n) > SIGMAS * spread) & (spread > 0)
    chosen = np.flatnonzero(strong)
    if not len(chosen):
        return Model()
    wanted = {int(h): k for k, h in enumerate(terms_of[chosen])}
    names: list[str] = [""] * len(chosen)
    for words, _ in bags:
        for w in words.split(" "):
            for t in forms(w):
                if (k := wanted.get(xxhash.xxh64_intdigest(t))) is not None:
                    names[k] = t
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    own = np.flatnonzero(place[cols] >= 0)
    at = place[cols[own]]
    x = Sparse(np.tile(rows[own], 2), np.concatenate([at, at + len(chosen)]), np.concatenate([b[own] for b in both]).astype(np.float64), (n, 2 * len(chosen)))
    levels = [k for k in range(1, 4) if (grade >= k).any()]
    targets = np.stack([(grade >= k).astype(float) for k in levels])
    theta = -np.log(targets.mean(1) / (1 - targets.mean(1)))
    w, v, seen, u = np.zeros(x.width), np.zeros(x.width), theta.copy(), 1.0
    step = 4.0 / len(levels) / max(1.0, 1.05 * x.norm() ** 2 / n)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(np.clip(seen[:, None] - x.times(v), -50, 50))) - targets
        after = v - step * x.back(error.sum(0)) / n
        after = np.sign(after) * np.maximum(np.abs(after) - step * PENALTY, 0)
        moved = np.maximum.accumulate(seen + min(1.0, step) * error.mean(1))  # thresholds stay ordered
        nxt = (1 + np.sqrt(1 + 4 * u * u)) / 2
        v, seen = after + (u - 1) / nxt * (after - w), moved + (u - 1) / nxt * (moved - theta)
        w, theta, u = after, moved, nxt
    weights = w / x.scale
    pairs = weights.reshape(2, -1)
    keep = np.flatnonzero(pairs.any(0))
    theta = theta + x.centre @ weights
    return Model({names[k]: (float(pairs[0, k]), float(pairs[1, k])) for k in keep}, [float(t) for t in theta])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled documents; only their bags of words reach the driver. Of rows that repeat an id the
    text of smallest digest counts, so no id has more than one."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("id"), "toxic")
    chosen = digest_sample(chosen, F.xxhash64("id"), rows, "id")  # at most `rows` slim rows: broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([" ".join(b) for b in bags])]
            columns.append(pa.array([np.array(list(b.values()), "<i4").tobytes() for b in bags], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "toxic", "words", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    bags = sample.select("id", "toxic", "text").mapInArrow(run, f"id {kind}, toxic int, words string, counts binary")
    got = sorted(bags.toLocalIterator(), key=lambda r: (r.id, r.toxic))
    return fit([(r.words, np.frombuffer(r.counts, "<i4")) for r in got], [int(r.toxic > 0) for r in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "severity") -> DataFrame:
    """Adds the expected grade (six decimals) to docs as column `out`."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: round(model.severity(t), 6))

    return docs.withColumn(out, severity(F.col(text_col)))


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """One row per document: id_col, severity, grade (rounded), toxic (rejected)."""
    scored = score(docs.select(F.col(id_col), F.col(text_col).alias("text")), model).drop("text")
    return scored.withColumn("grade", F.round("severity").cast("int")).withColumn("toxic", F.col("severity") >= reject)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs below the threshold, with the columns of docs."""
    scored = score(docs, model, text_col, "__helixmill_severity")
    return scored.where(F.col("__helixmill_severity") < reject).select(*docs.columns)
