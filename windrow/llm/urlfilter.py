"""URL filter: host and path rules, and for the rest logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import importlib.resources
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_ENDING = re.compile(r"(?:(?:/index)?\.(?:html?|php|aspx?|jsp))?/*\Z", re.I)

#: The labelled table that comes with the package: a label (1 unwanted, 0 wanted) and a URL a line.
LABELLED = "labelled_urls.txt"


def labelled_urls(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(url, unwanted) of the package's table, or of such a file at ``path``, which Spark reads."""
    if path is not None:
        parts = F.split("value", " ", 2)
        return spark.read.text(path).select(parts[1].alias("url"), parts[0].cast("int").alias("unwanted"))
    lines = importlib.resources.files("windrow.llm").joinpath(LABELLED).read_text().splitlines()
    return spark.createDataFrame([(u, int(y)) for y, _, u in (line.partition(" ") for line in lines)], "url string, unwanted int")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// with A-Z lower-cased; both empty without one."""
    rest = (url or "").partition("://")
    m = re.match(r"([^/?#]*)([^?#]*)", rest[2], re.S)
    return re.sub("[A-Z]+", lambda x: x.group().lower(), m[1]), m[2]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Columns host and path by SQL functions, as split_url gives them."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower())
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_column(rules=RULES):
    """The longest rule that fits (host, path), else null; of equally long ones the first in order of the alphabet."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, slash, path = rule.partition("/")
        host_fits = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        found = F.when(host_fits & F.startswith("path", F.lit(slash + path)), F.lit(rule)).otherwise(found)
    return found


@dataclass
class UrlModel:
    bits: int
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that the url is unwanted."""
        at, x = url_features(host, path, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ x, -30, 30))))


def url_features(host: str, path: str, bits: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the distinct character n-grams of host and of path, each part of length 1 as a vector.

    Ends of the parts are marked, and runs of digits are alike; a page's file ending and slashes at the end of a path don't
    count, so that a verdict doesn't hang on them.
    """
    path = _ENDING.sub("", path)
    found, values = [], []
    for kind, text in enumerate((f"^{host}$", f"^{path}$")):
        b = np.frombuffer(re.sub(r"\d+", "0", text.lower()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        h, grams = np.full(len(b), 7 + kind, np.uint32), []
        for n in range(1, max(sizes) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] * np.uint32(0x9E3779B1)
            if n in sizes:
                grams.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits))
        at = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint32)
        found.append(at)
        values.append(np.full(len(at), 1 / np.sqrt(max(1, len(at)))))
    return np.concatenate(found), np.concatenate(values)


def train(labelled: DataFrame, bits: int = 16, most: int = 20_000, **how) -> UrlModel:
    """The model of a small labelled table (url, unwanted); of more than ``most`` rows those whose urls have the least hashes.

    Rows without a label don't count; a null url counts as one without host and path.
    """
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("unwanted").cast("int").alias("unwanted")).where("unwanted is not null")
    return fit([(r.url, r.unwanted) for r in rows.orderBy(F.xxhash64("url"), "url", "unwanted").limit(most).collect()], bits, **how)


def fit(labelled: list[tuple[str, int]], bits: int = 16, rounds: int = 200, rate: float = 0.5, l2: float = 0.001) -> UrlModel:
    """Full-batch Adagrad on a small (url, unwanted) table; an empty one or one of a single class gives its share."""
    w, b = np.zeros(1 << bits), 0.0
    if labelled:
        rows = [url_features(*split_url(u), bits) for u, _ in labelled]
        y = np.array([v for _, v in labelled], float)
        at, x = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        seen, seen_b = np.full(len(w), 1e-8), 1e-8
        for _ in range(rounds):
            z = b + np.bincount(of, w[at] * x, len(rows))
            g = (1 / (1 + np.exp(-z)) - y) / len(rows)
            gw, gb = np.bincount(at, g[of] * x, len(w)) + l2 * w / len(rows), g.sum()
            seen, seen_b = seen + gw * gw, seen_b + gb * gb
            w, b = w - rate * gw / np.sqrt(seen), b - rate * gb / np.sqrt(seen_b)
    return UrlModel(bits, w.astype(np.float32), float(b))


def judge(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.7) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row: the rule's verdict, else block where the model says >= threshold.

    A null url, or one without "://", has empty host and path, so no rule, and the model judges the empty parts.
    Repeated rows give repeated results; other columns aren't read.
    """
    parts = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("rule", rule_column(rules))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "score"])

    scored = parts.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule").mapInArrow(run, "page_id long, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op10_urls(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``judge`` with the model of the labelled table, by default the package's."""
    return judge(pages, train(labelled_urls(pages.sparkSession) if labelled is None else labelled))
