"""Recursive forecasts in one job: tree ensembles as arrays, walked for many series at once, step by step of their horizon.

A series is one row: its state, and its windows in order with the features that don't depend on earlier forecasts.  A task
takes the series of a batch through their windows together; no step needs a shuffle, a job or a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import models
from windrow.params import LAG_FEATURES, LAGS
from windrow.shared import delete, scratch

KEYS = ["station", "species"]
LONGEST = max(LAGS)


@dataclass
class Flat:
    """The trees of an ensemble in arrays of nodes: a node that is a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    leaf: np.ndarray  # number of the leaf in its tree, from the left
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    @staticmethod
    def of(model) -> Flat:
        """From a fitted ensemble, by way of its saved form (trees * 2**(depth + 1) rows at most)."""
        spark = SparkSession.active()
        path = scratch(spark, "ensemble")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        delete(spark, path)
        first = {}
        for i, n in enumerate(nodes):
            first.setdefault(n.treeID, i)
        start = np.array([first[n.treeID] for n in nodes])
        inner = np.array([n.leftChild >= 0 for n in nodes])
        at = np.arange(len(nodes))
        leaves = np.cumsum(~inner)
        before = np.array([leaves[i - 1] if i else 0 for i in start])
        return Flat(
            np.array([n.split.featureIndex if n.leftChild >= 0 else 0 for n in nodes]), np.array([n.split.leftCategoriesOrThreshold[0] if n.leftChild >= 0 else 0.0 for n in nodes]),
            np.where(inner, start + np.array([n.leftChild for n in nodes]), at), np.where(inner, start + np.array([n.rightChild for n in nodes]), at),
            np.array([n.prediction for n in nodes]), leaves - before - 1, np.array(sorted(first.values())), np.array(model.treeWeights), max(t.depth for t in model.trees),
        )

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each row in each tree."""
        at = np.repeat(self.roots[None], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def total(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(x)] @ self.weights


@dataclass
class FlatModel:
    """A staged model's three ensembles; ``quantiles``: of each tree the leaves' quantiles, nan where a leaf has none."""

    features: list[str]
    active: Flat
    forest: Flat
    quantiles: np.ndarray
    extreme: Flat | None

    @staticmethod
    def of(model: models.Staged) -> FlatModel:
        rows = model.leaves.collect()  # trees * 2**depth rows at most
        forest = Flat.of(model.forest)
        table = np.full((len(forest.roots), int(forest.leaf.max()) + 1), np.nan)
        for r in rows:
            table[r.tree, int(r.leaf)] = r.q
        return FlatModel(model.assembler.getInputCols(), Flat.of(model.active), forest, table, None if model.extreme is None else Flat.of(model.extreme))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """As operators.models.predict: probability, mean of the leaves' quantiles, extreme, blended."""
        p = 1 - 1 / (1 + np.exp(2 * self.active.total(x)))
        q = self.quantiles[np.arange(len(self.forest.roots))[None], self.forest.leaf[self.forest.nodes(x)]]
        known = ~np.isnan(q)
        with np.errstate(invalid="ignore"):
            regression = np.expm1(np.where(known, q, 0.0).sum(1) / known.sum(1))
        y = np.maximum(0.0, np.where(p < 0.3, 0.0, regression * np.clip(p, 0.5, 1.0)))
        if self.extreme is None:
            return y
        w = np.clip((p - 0.6) / 0.4, 0.0, 1.0)
        return np.maximum(0.0, (1 - 0.7 * w) * y + 0.7 * w * np.expm1(self.extreme.total(x)))


def flatten(model: models.Staged | models.Classes) -> dict[str, FlatModel]:
    """By name of the tuning class; a single model has the name ''."""
    return {name: FlatModel.of(m) for name, m in (model.models if isinstance(model, models.Classes) else {"": model}).items()}


def _lag_values(logs: np.ndarray, run: np.ndarray, today: np.ndarray, n_today: np.ndarray) -> dict[str, np.ndarray]:
    """Each lag feature of a step; sums go from the oldest on, as a fold over the state does."""
    found = {f"lag_{k}": logs[:, -k] for k in LAGS}
    for n in (8, LONGEST):
        total = np.zeros(len(logs))
        for k in range(n, 0, -1):
            total = total + logs[:, -k]
        found[f"rolling_{n}"], found[f"max_{n}"] = total / n, logs[:, -n:].max(1)
    return found | {"morning_avg": np.where(n_today > 0, today / np.maximum(n_today, 1), 0.0), "windows_since_active": np.where(run < 0, 999.0, run)}


def fold(flat: dict[str, FlatModel], static: list[str], names: list[str], lengths: np.ndarray, x: np.ndarray, day: np.ndarray, open_: np.ndarray, observed: np.ndarray, logs: np.ndarray, run: np.ndarray, today: list[list[float]], state_day: np.ndarray, decay: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, whether a model made it) of every window, the series standing one behind the other.

    ``run``: rows since the last active one, -1 where there is none yet; ``today``: the logs of the state's day so far.
    In a step the order is observe or predict, gate, append; the state gets the gated value.
    """
    first = np.cumsum(lengths) - lengths
    predicted, made = np.zeros(len(x)), np.zeros(len(x), bool)
    sums, counts, current = np.array([sum(t, 0.0) for t in today]), np.array([len(t) for t in today]), state_day.copy()
    column = {c: i for i, c in enumerate(static)}
    for k in range(int(lengths.max(initial=0))):
        s = np.flatnonzero(lengths > k)
        at = first[s] + k
        new_day = current[s] != day[at]
        sums[s], counts[s], current[s] = np.where(new_day, 0.0, sums[s]), np.where(new_day, 0, counts[s]), day[at]
        lag = _lag_values(logs[s], run[s], sums[s], counts[s])
        guess = decay * np.expm1(logs[s, -1])
        for name, model in flat.items():
            own = np.flatnonzero([n == name for n in (names[i] for i in s.tolist())]) if name else np.arange(len(s))
            if len(own):
                guess[own] = model.predict(np.stack([lag[c][own] if c in lag else x[at[own], column[c]] for c in model.features], 1))
                made[at[own]] = True
        predicted[at] = guess
        kept = np.where(open_[at], np.where(np.isnan(observed[at]), guess, observed[at]), 0.0)
        log = np.log1p(kept)
        logs[s] = np.concatenate([logs[s, 1:], log[:, None]], 1)
        run[s] = np.where(log > 0, 0, np.maximum(run[s], 0) + 1)
        sums[s] += log
        counts[s] += 1
    return predicted, made


def forecast(model: models.Staged | models.Classes, windows: DataFrame, state: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``windows`` with predicted and has_model, one job for all series and steps.

    ``windows``: (station, species, ts, open, observed, features ...), a horizon's rows a series, which stand in one row
    of an array; other columns come along.  ``state``: (station, species, logs, run, today, day) of operators.forecast.
    Series without a state are left out.  ``keys`` tell series apart, the species among them.  The models' trees are broadcast: classes * trees * 2**(depth + 1) nodes.
    """
    flat = flatten(model)
    static = sorted({c for m in flat.values() for c in m.features} - set(LAG_FEATURES))
    shared = windows.sparkSession.sparkContext.broadcast(flat)
    along = [c for c in windows.columns if c not in (*keys, "ts")]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in static]) if static else F.array().cast("array<double>")
    rows = windows.select(*keys, F.struct("ts", *along).alias("w"), x.alias("x"))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("w.ts").alias("ts"), "w", "x"))).alias("s"))
    rows = rows.join(state.select(*keys, "logs", "run", "today", "day"), keys)
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    part = lambda f: F.transform("s", f)
    rows = rows.select(
        *keys, models.tuning_class(F.col("species")).alias("class"), part(lambda e: e["w"]).alias("w"), part(lambda e: e["x"]).alias("x"), part(lambda e: days(F.to_date(e["ts"]))).alias("days"), part(lambda e: F.coalesce(e["w"]["open"], F.lit(False))).alias("open"),
        part(lambda e: e["w"]["observed"].cast("double")).alias("observed"), "logs", F.coalesce(F.col("run").cast("long"), F.lit(-1)).alias("run"), F.coalesce("today", F.array().cast("array<double>")).alias("today"), F.coalesce(days(F.col("day")), F.lit(-(10**6))).alias("state_day"),
    )
    shape = rows.select(*keys, "w").withColumn("predicted", F.array().cast("array<double>")).withColumn("made", F.array().cast("array<boolean>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lengths = col["w"].value_lengths().to_numpy(zero_copy_only=False)
            flat_ = lambda n: col[n].flatten()
            features = flat_("x").flatten().to_numpy(zero_copy_only=False).reshape(int(lengths.sum()), len(static))
            logs = col["logs"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, LONGEST).copy()
            got, made = fold(
                shared.value, static, col["class"].to_pylist(), lengths, features, flat_("days").to_numpy(), flat_("open").to_numpy(zero_copy_only=False),
                flat_("observed").to_numpy(zero_copy_only=False).astype(float), logs, col["run"].to_numpy().copy(), col["today"].to_pylist(), col["state_day"].to_numpy().copy(),
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(col[k] for k in keys), col["w"], pa.ListArray.from_arrays(ends, pa.array(got)), pa.ListArray.from_arrays(ends, pa.array(made))], [*keys, "w", "predicted", "made"])

    done = rows.mapInArrow(run, shape).select(*keys, F.explode(F.arrays_zip("w", "predicted", "made")).alias("z"))
    return done.select(*keys, "z.w.*", F.col("z.predicted").alias("predicted"), F.col("z.made").alias("has_model"))
