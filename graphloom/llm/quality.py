"""Quality rules: plain statistics of a text with fixed limits, and a logistic regression on hashed word and character
n-grams, trained on labelled rows, calibrated to probabilities and scored in Arrow batches against a fixed threshold.

Features are words, pairs of neighbouring words and the character n-grams of words (each with a blank on either side),
hashed into a fixed number of buckets; a text's value of a bucket is its share of the text's features of that kind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, least_hashes

SYMBOLS = b"#*$%&|<>"  # fixed values: the characters that count as symbols
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BITS = 18
BUCKETS = 1 << BITS
SCALE = 20.0


@dataclass
class Model:
    """Weights by bucket, bias, and the calibration p = sigmoid(a * z + b)."""

    weights: np.ndarray
    bias: float
    a: float
    b: float


def mixed(keys: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit keys: the leading bits of a product."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, of pairs of neighbouring words, and of character n-grams of three and four bytes; an n-gram
    lies within a word and the blanks beside it."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    s = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    inner = s != 32
    three = s[:-2] | (s[1:-1] << np.uint64(8)) | (s[2:] << np.uint64(16))
    four = three[:-1] | (s[3:] << np.uint64(24))
    chars = np.concatenate([three[inner[1:-1]] | np.uint64(3 << 40), four[inner[1:-2] & inner[2:-1]] | np.uint64(4 << 40)])
    pairs = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[1:]
    return mixed(h | np.uint64(1 << 40)), mixed(pairs), mixed(chars)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, ascending, and their values."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    parts = [p for p in feature_buckets(words) if len(p)]
    found, at = np.unique(np.concatenate(parts), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate([np.full(len(p), SCALE / len(p)) for p in parts]))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], good: int, bad: int, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, every: int = 5) -> Model:
    """AdaGrad over the rows (buckets, values, 0 or 1) in a fixed order; each ``every``-th row only calibrates.
    good and bad: how many labels there are of either kind."""
    weights, bias = np.zeros(BUCKETS), 0.0
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    learn = [r for i, r in enumerate(rows) if i % every]
    share = sum(y for *_, y in learn) / max(1, len(learn))
    if 0 < share < 1:
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for i in rng.permutation(len(learn)):
                k, v, y = learn[i]
                p = 1 / (1 + np.exp(-np.clip(weights[k] @ v + bias, -30, 30)))
                g = (p - y) * (0.5 / share if y else 0.5 / (1 - share))
                gk = g * v + decay * weights[k]
                seen[k] += gk * gk
                weights[k] -= rate * gk / np.sqrt(seen[k])
                seen_bias += g * g
                bias -= rate * g / np.sqrt(seen_bias)
    # the calibration holds for the sample's share of good rows; the prior shifts it to the labels'
    z = np.array([weights[k] @ v + bias for k, v, _ in rows[::every]])
    y = np.array([y for *_, y in rows[::every]], dtype=float)
    a, b = calibrate(z, y)
    if 0 < y.sum() < len(y) and good and bad:
        b += np.log(good / bad) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(weights, float(bias), a, float(b))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a and b of sigmoid(a * z + b) by Newton's method, on smoothed targets."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * theta)
        theta = theta - np.clip(step, -1, 1)
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 2000) -> Model:
    """Fits on at most ``most`` labelled rows of each class, those with the smallest hash of doc_id, whole texts. Rows
    without doc_id, text or a label of 0 or 1 are left out, as are rows whose doc_id has both labels. The driver gets
    these rows' features, computed on the executors; ``most`` bounds them."""
    y = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y"))
    y = y.filter("y = _y").select("doc_id", "y").withColumn("h", F.xxhash64("doc_id"))
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # the smallest hashes of each class
    chosen = least_hashes(y.filter("y = 0"), "h", n.get(0, 0), most).unionByName(least_hashes(y.filter("y = 1"), "h", n.get(1, 0), most))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in each_text(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({
                "h": batch.column("h"), "y": batch.column("y"),
                "k": pa.array([k.astype(np.int32).tobytes() for k, _ in rows], pa.binary()),
                "v": pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()),
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("h", "y", "text")  # chosen has at most 2 * most rows
    found = sorted((r["h"], bytes(r["k"]), r["y"], bytes(r["v"])) for r in rows.mapInArrow(compute, "h long, y int, k binary, v binary").collect())
    return fit([(np.frombuffer(k, dtype=np.int32).astype(np.int64), np.frombuffer(v, dtype=np.float32).astype(float), y) for _, k, y, v in found], n.get(1, 0), n.get(0, 0))


class Scorer:
    """Probabilities of texts under a model, and their plain statistics."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: str | None) -> tuple[int, int, int, int, int, float]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the probability that the text is good."""
        data = (text or "").encode()
        words = data.split()
        n_symbols = len(data) - len(data.translate(None, SYMBOLS))
        if not words:
            return 0, 0, n_symbols, 0, 0, self._probability(0.0)
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        z = SCALE * sum(float(self.model.weights[p].mean()) for p in feature_buckets(words) if len(p))
        n_chars = len(text) - (len(data) - len(data.translate(None, BLANKS)))
        return len(words), n_chars, n_symbols, duplicate_lines(data), repeated_words(ids), self._probability(z)

    def _probability(self, z: float) -> float:
        m = self.model
        return float(1 / (1 + np.exp(-np.clip(m.a * (z + m.bias) + m.b, -30, 30))))


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.split(None, 1)]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in windows of three words that occur twice or more; equal words have equal ids."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if ids.max() >= 1 << 21:  # over two million distinct words: name the pairs first
        pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * (ids.max() + 1) + ids[2:]
    else:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : n + shift] |= twice
    return int(covered.sum())


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50, label: str = "quality", most: int = 2000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability.

    base_failed: fewer than least_words words, or over most_repeated percent of them repeated. kept: not base_failed and
    a probability of at least threshold. docs needs doc_id and text, labels doc_id and the label; other columns are
    ignored. A null or wordless text has no words and fails; every row gives a row; with no labels of both kinds every
    probability is one half; an empty table gives no rows."""
    model = train(docs, labels, label, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            rows = [score(t) for t in each_text(batch.column("text"))]
            n_words, chars, symbols, lines, repeated, p = (np.array(x) for x in zip(*rows)) if rows else [np.zeros(0, dtype=np.int64)] * 5 + [np.zeros(0)]
            failed = (n_words < least_words) | (100 * repeated > most_repeated * n_words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "word_chars": pa.array(chars, pa.int64()),
                "n_symbols": pa.array(symbols, pa.int64()), "n_dup_lines": pa.array(lines, pa.int64()), "n_repeat_words": pa.array(repeated, pa.int64()),
                "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= threshold)), "probability": pa.array(p, pa.float64()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
