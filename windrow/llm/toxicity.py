"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from labels of whole documents.

A sentence's probability is logistic in the words it holds and in the words' beginnings; a document is toxic unless none
of its sentences is: P = 1 - prod(1 - p).  The gradient of the log-likelihood by a sentence's logit is p * (1 - P) / P
for a toxic document and -p for a clean one, so blame goes to the sentences that already look worst.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import column_rows, remainder

_END = re.compile(r"[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = re.compile(r"^\W+|\W+$")
#: Lengths of the beginnings of words that count as features beside the whole words.
PREFIXES = (4, 5, 6, 7, 8)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def word_features(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings; none for what has no letter or digit."""
    w = _EDGE.sub("", word)
    return [w + "$", *(w[:k] for k in PREFIXES if len(w) > k)] if w else []


@dataclass
class MilModel:
    weights: dict[str, float]
    bias: float
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": {}}

    def word(self, w: str) -> float:
        got = self._words.get(w)
        if got is None:
            if len(self._words) >= 200_000:
                self._words.clear()
            got = self._words[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return got

    def logits(self, text: str) -> list[float]:
        word, bias = self.word, self.bias
        return [bias + sum(map(word, words)) for s in _END.split(text.lower()) if (words := s.split())]

    def score(self, text: str | None) -> tuple[float, int]:
        """(noisy-or of the sentences, number of sentences); (0, 0) for a text without words."""
        z = np.array(self.logits(text or ""))
        return (float(-np.expm1(-np.logaddexp(0, z).sum())), len(z)) if len(z) else (0.0, 0)

    def spans(self, text: str, least: float) -> list[dict]:
        """Sentences with a probability of ``least`` or more, as code-point offsets into the text."""
        found = []
        for m in _SENTENCE.finditer(text):
            words = m.group().lower().split()
            p = 1 / (1 + math.exp(-min(700.0, max(-700.0, self.bias + sum(map(self.word, words)))))) if words else 0.0
            if p >= least:
                found.append({"start": m.start(), "end": m.end(), "score": p})
        return found


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.2, l1: float = 1e-2, l2: float = 1e-4, least_docs: int = 4) -> MilModel:
    """Fit on a bounded sample, both classes weighing alike in sum.  Without examples of both every sentence scores near 0."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return MilModel({}, -30.0)
    vocabulary: dict[str, int] = {}
    tokens, sentence_ends, docs = [], [], []
    for d, text in enumerate(texts):
        for s in _END.split(text.lower()):
            if words := s.split():
                tokens += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                sentence_ends.append(len(tokens))
                docs.append(d)
    tokens, docs = np.array(tokens), np.array(docs)
    sentence = np.repeat(np.arange(len(docs)), np.diff([0, *sentence_ends]))
    in_docs = Counter()
    by_doc = np.unique(docs[sentence] * len(vocabulary) + tokens) % len(vocabulary)
    words = list(vocabulary)
    for w, n in zip(*np.unique(by_doc, return_counts=True)):
        for f in word_features(words[w]):
            in_docs[f] += int(n)
    features = {f: i for i, f in enumerate(sorted(f for f, n in in_docs.items() if n >= least_docs))}
    pairs = [(w, features[f]) for w, text in enumerate(words) for f in word_features(text) if f in features]
    of_word, of_feature = np.array(pairs).reshape(-1, 2).T
    w, b = np.zeros(len(features)), -math.log(max(2.0, 3 * len(docs) / max(1.0, y.sum())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, len(y) - y.sum()))[docs]
    for t in range(1, rounds + 1):
        of_words = np.bincount(of_word, w[of_feature], len(words)) if len(w) else np.zeros(len(words))
        z = b + np.bincount(sentence, of_words[tokens], len(docs))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(-np.bincount(docs, np.logaddexp(0, z), len(y)))
        ratio = none / np.maximum(1e-9, 1 - none)
        g = -p * np.where(y > 0, ratio, -1.0)[docs] * share
        gb = g.sum()
        gw = np.bincount(of_feature, np.bincount(tokens, g[sentence], len(words))[of_word], len(w)) + l2 * w if len(w) else w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        step = rate * fix / (np.sqrt(v) + 1e-6)
        w = w - step * m
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * rate)
        b -= rate * fix * mb / (math.sqrt(vb) + 1e-6)
    return MilModel({f: float(w[i]) for f, i in features.items() if abs(w[i]) > 1e-4}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> list:
    """Up to ``per_class`` labelled (text, toxic) rows of each class, those with the least hashed ids.

    A doc_id labelled both ways counts as toxic.  Texts over ``max_chars`` code points aren't trained on, so the sample
    has a known size bound; ids of the sample (2 * per_class at most) are broadcast to find their texts.
    """
    one = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    one = one.where(remainder("doc_id", 3) != 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [one.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    got = texts.join(ids, "doc_id").orderBy(*order, "text").limit(2 * per_class)
    return got.select("text", "y").collect()


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 20_000) -> MilModel:
    rows = training_sample(docs, labels, per_class, max_chars)
    return fit([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: MilModel, locate: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, spans) per row: spans are the offending sentences, of probability ``locate`` or more.

    Null and empty texts, and texts without words, score 0 and have no span; repeated rows give repeated results; other
    columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in column_rows(batch.column(1)):
                p, n = model.score(text)
                scores.append(p)
                counts.append(n)
                spans.append(model.spans(text, locate) if p >= locate else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "score", "n_sentences", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("spans", SPAN)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def reject(docs: DataFrame, model: MilModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``; null and empty texts stay, repeated rows alike."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([model.score(t)[0] < threshold for t in column_rows(batch.column(at))], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``score`` of every row by the model of labelled rows whose id's checksum modulo 3 isn't 1; null and empty texts score 0.

    A doc_id labelled both ways is toxic; labels without an id or of other values don't count; without labels all score
    near 0.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "spans")
