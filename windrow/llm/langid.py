"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL.

Training is follow-the-regularised-leader, proximal form, per coordinate, with an elastic net (L1 and L2); the scores are
then calibrated by one temperature, fitted on a held-back part of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column_rows, remainder

_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Features:
    """Lower-cased character n-grams, n = 1 .. longest, hashed to 2**bits buckets."""

    longest: int = 3
    bits: int = 14

    def counts(self, text: str) -> np.ndarray:
        total = np.zeros(1 << self.bits, np.int64)
        text = text.lower()
        for start in range(0, len(text), _BLOCK):  # blocks overlap, so that each n-gram is counted once
            block = np.frombuffer(text[start : start + _BLOCK + self.longest - 1].encode("utf-32-le", "surrogatepass"), "<u4")
            h = np.zeros(len(block), np.uint32)
            for n in range(1, self.longest + 1):
                if len(block) < n:
                    break
                h = h[: len(block) - n + 1] * np.uint32(0x01000193) + (block[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
                first = h[:_BLOCK]
                total += np.bincount((first ^ (first >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.bits), minlength=1 << self.bits)
        return total


@dataclass
class LanguageModel:
    features: Features
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x class
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = self.features.counts(text)
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return at, x / norm if norm > 0 else x

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ("und", 0) for a null text, one without a letter, or a model without classes."""
        if not text or not self.classes or not _LETTER.search(text):
            return "und", 0.0
        at, x = self.vector(text)
        p = _softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, dims: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, rounds: int = 3, seed: int = 0) -> np.ndarray:
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))
    one = np.eye(classes)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(xs)):
            at, x = xs[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            g = np.outer(x, _softmax(x @ w) - one[ys[i]])
            root = np.sqrt(na + g * g)
            z[at] = za + g - (root - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return weights(z, n)


def calibrate(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm; 1 without rows."""
    if len(ys) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(_softmax(logits / np.exp(log_t))[np.arange(len(ys)), ys] + 1e-12).mean()

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, features: Features) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents), over every row with a text.  Tasks emit sums of all their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << features.bits, np.int64), 0
        for batch in batches:
            for text in column_rows(batch.column(0)):
                df += features.counts(text) > 0
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([rows, *df[at]], pa.int64())], ["bucket", "n"])

    found = docs.where("text is not null").select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, rows = np.zeros(1 << features.bits, np.int64), 0
    for bucket, n in found.collect():  # 2**bits + 1 rows at most
        if bucket < 0:
            rows = n
        else:
            df[bucket] = n
    return df, rows


def train(docs: DataFrame, sample: int = 6000, max_chars: int = 8_000, most_classes: int = 500, features: Features = Features()) -> LanguageModel:
    """Learn from rows with a text and a lang: document frequencies from all of them, weights from a bounded sample.

    The sample is some ``sample`` rows, an equal share of each lang (all rows of a rarer one), by hashed ids among texts
    of up to ``max_chars`` code points, without repeated texts; a fifth of it is held back to fit the temperature.  The
    model has a weight for each bucket and lang, so more than ``most_classes`` langs are an error; labels in disorder are
    told so, not dropped.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    df, rows = document_frequencies(known, features)
    small = known.where(F.length("text") <= max_chars)
    counts = small.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_classes + 1).collect()  # a row a language
    if len(counts) > most_classes:
        raise ValueError(f"more than {most_classes} languages")
    each = sample / max(1, len(counts))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * F.create_map(*[F.lit(x) for r in counts for x in (r.lang, float(r["count"]))])[F.col("lang")] if counts else F.lit(0.0)
    got = small.where(part < each).orderBy(*order, "text").limit(2 * sample).select("text", "lang").collect()
    got = [(t, c) for t, c in dict((r.text, r.lang) for r in got).items() if _LETTER.search(t)]
    classes = sorted({c for _, c in got})
    idf = np.log((1 + rows) / (1 + df)) + 0.1
    model = LanguageModel(features, classes, idf, np.zeros((1 << features.bits, len(classes)), np.float32))
    if classes:
        xs, ys = [model.vector(t) for t, _ in got], np.array([classes.index(c) for _, c in got])
        held = np.arange(len(xs)) % 5 == 4
        model.weights = ftrl([x for x, h in zip(xs, held) if not h], ys[~held], len(idf), len(classes)).astype(np.float32)
        model.temperature = calibrate(np.array([x @ model.weights[at] for (at, x), h in zip(xs, held) if h]).reshape(-1, len(classes)), ys[held])
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) per row; null texts and those without a letter give ("und", 0).  Other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in column_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_langid(docs: DataFrame) -> DataFrame:
    """``predict`` for every row, with the model of the rows whose id's checksum modulo 5 isn't 0."""
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
