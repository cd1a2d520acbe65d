"""The three-stage model on MLlib trees: activity, a quantile of the amount, and an extreme stage; one model a tuning class."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.scalar import regression_weight, stage_blend
from windrow.shared import exists, small

# Tuning classes of species as (classifier depth, regressor depth, quantile).
TUNING = {
    "Corylus": (5, 7, 0.92), "Alnus": (5, 7, 0.92), "Urtica": (5, 6, 0.90), "Poaceae": (5, 6, 0.90), "Quercus": (5, 6, 0.88), "Populus": (4, 6, 0.88),
}
DEFAULT_TUNING = (4, 5, 0.85)
#: The classes of TUNING and what falls to none of them, by name.
CLASSES = {f"{a}-{r}-{round(100 * q)}": (a, r, q) for a, r, q in sorted({*TUNING.values(), DEFAULT_TUNING})}
LEAST_ROWS, LEAST_SAMPLES, EXTREME_OVER, LEAST_EXTREME = 50, 14, 50.0, 10


def eligibility(frame: DataFrame, least: int = LEAST_SAMPLES) -> DataFrame:
    """(species, n, positives, positive_weight, eligible): enough rows, and both classes."""
    counts = frame.groupBy("species").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("positives"))
    negatives = F.col("n") - F.col("positives")
    weight = F.greatest(F.lit(1.0), negatives / F.greatest(F.lit(1), F.col("positives")))
    return counts.withColumn("positive_weight", weight).withColumn("eligible", (F.col("n") >= least) & (F.col("positives") > 0) & (negatives > 0))


@dataclass
class Staged:
    """Fitted stages; ``leaves`` holds each leaf's weighted quantile of the quantile stage's forest (trees * 2**depth rows at most)."""

    assembler: VectorAssembler
    active: GBTClassificationModel
    forest: RandomForestRegressionModel
    leaves: DataFrame
    extreme: GBTRegressionModel | None

    def leaf_table(self) -> str:
        """JSON of each tree's array of quantiles by leaf, null where a leaf has none."""
        table: list[list[float | None]] = []
        for r in self.leaves.orderBy("tree", "leaf").collect():
            while len(table) <= r.tree:
                table.append([])
            row = table[r.tree]
            row += [None] * (int(r.leaf) + 1 - len(row))
            row[int(r.leaf)] = r.q
        return json.dumps(table)

    def save(self, folder: str) -> None:
        PipelineModel([self.assembler, self.active, self.forest]).write().overwrite().save(f"{folder}/stages")
        self.leaves.write.mode("overwrite").parquet(f"{folder}/leaves")
        if self.extreme is not None:
            self.extreme.write().overwrite().save(f"{folder}/extreme")

    @staticmethod
    def load(spark, folder: str) -> Staged:
        stages = PipelineModel.load(f"{folder}/stages").stages
        extreme = GBTRegressionModel.load(f"{folder}/extreme") if exists(spark, f"{folder}/extreme") else None
        return Staged(stages[0], stages[1], stages[2], spark.read.parquet(f"{folder}/leaves"), extreme)


def weighted_quantiles(rows: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, q): the least label at which a group's cumulative weight reaches ``alpha`` of its weight.

    Labels of a group are first summed by value, so its window runs over distinct labels.
    """
    each = rows.groupBy(*keys, "label").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy(*keys)
    each = each.withColumn("share", F.sum("weight").over(w.orderBy("label")) / F.sum("weight").over(w))
    return each.where(F.col("share") >= alpha - 1e-12).groupBy(*keys).agg(F.min("label").alias("q"))


def weighted_leaf_quantiles(scored: DataFrame, alpha: float) -> DataFrame:
    """(tree, leaf, q) of a scored training frame."""
    each = scored.select(F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"), "label", "weight")
    return weighted_quantiles(each, ["tree", "leaf"], alpha)


def fit(frame: DataFrame, features: list[str], iterations: int = 20, trees: int = 20, depth: int = DEFAULT_TUNING[1], alpha: float = DEFAULT_TUNING[2], active_depth: int = DEFAULT_TUNING[0], seed: int = 42) -> Staged | Classes:
    """Fit on rows of (value, species, features) without nulls; species that aren't eligible don't count.

    Where none is, as in a table whose values are all over 0, there is nothing to tell apart: the model is one of no class,
    which predicts null.
    """
    weight = F.when(F.col("value") > 0, F.col("positive_weight")).otherwise(1.0)
    fit_for = eligibility(frame).where("eligible and species is not null").select("species", "positive_weight")
    if fit_for.isEmpty():
        return Classes({})
    rows = frame.join(small(fit_for), "species")
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    rows = assembler.transform(rows.withColumns({"active": (F.col("value") > 0).cast("double"), "label": F.log1p("value"), "class_weight": weight, "weight": regression_weight(F.col("value"))}))
    rows = rows.select("species", "value", "features", "active", "label", "class_weight", "weight").persist()
    try:
        active = GBTClassifier(labelCol="active", weightCol="class_weight", maxIter=iterations, maxDepth=active_depth, stepSize=0.08, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(rows)
        forest = RandomForestRegressor(labelCol="label", weightCol="weight", leafCol="leaf", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=seed).fit(rows)
        leaves = weighted_leaf_quantiles(forest.transform(rows), alpha)
        leaves = frame.sparkSession.createDataFrame(leaves.collect(), leaves.schema)  # trees * 2**depth rows at most
        high = rows.where(F.col("value") > EXTREME_OVER)
        extreme = None
        if high.limit(LEAST_EXTREME).count() == LEAST_EXTREME:
            extreme = GBTRegressor(labelCol="label", weightCol="extreme_weight", maxIter=iterations, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed).fit(high.withColumn("extreme_weight", 1 + F.sqrt("value")))
    finally:
        rows.unpersist()
    return Staged(assembler, active, forest, leaves, extreme)


def predict(model: Staged | Classes, rows: DataFrame, key: list[str] = ()) -> DataFrame:
    """``rows`` with p, regression, extreme and predicted, looked up row by row without a shuffle.

    Rows of equal ``key`` stay apart.  A model of tuning classes predicts each species by its class; a species whose
    class wasn't fitted has null in all four.
    """
    if isinstance(model, Classes):
        return model.predict(rows)
    x = model.assembler.transform(rows)
    x = model.forest.transform(model.active.transform(x.drop("prediction")).withColumn("p", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction")).drop("prediction")
    x = model.extreme.transform(x).withColumn("extreme", F.expm1("prediction")).drop("prediction") if model.extreme is not None else x.withColumn("extreme", F.lit(None).cast("double"))
    quantiles = F.from_json(F.lit(model.leaf_table()), "array<array<double>>")
    each = F.filter(F.zip_with(quantiles, vector_to_array("leaf"), lambda t, leaf: F.get(t, leaf.cast("int"))), lambda q: q.isNotNull())
    x = x.withColumn("regression", F.expm1(F.aggregate(each, F.lit(0.0), lambda a, q: a + q) / F.nullif(F.size(each), F.lit(0))))
    return x.drop("features", "leaf").withColumn("predicted", stage_blend(F.col("p"), F.col("regression"), F.col("extreme")))


def tuning_class(species: Column) -> Column:
    """The name of a species' tuning class."""
    names = {v: k for k, v in CLASSES.items()}
    known = F.create_map(*[F.lit(x) for k, v in TUNING.items() for x in (k, names[v])])
    return F.coalesce(known[species], F.lit(names[DEFAULT_TUNING]))


@dataclass
class Classes:
    """A Staged model for each tuning class that had rows enough."""

    models: dict[str, Staged]

    def predict(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_class", tuning_class(F.col("species")))
        parts = [predict(m, rows.where(F.col("_class") == name)) for name, m in sorted(self.models.items())]
        parts.append(rows.where(~F.col("_class").isin(sorted(self.models))).withColumns({c: F.lit(None).cast("double") for c in ("p", "extreme", "regression", "predicted")}))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.drop("_class")

    def save(self, folder: str) -> None:
        for name, model in self.models.items():
            model.save(f"{folder}/{name}")

    @staticmethod
    def load(spark, folder: str) -> Classes:
        return Classes({name: Staged.load(spark, f"{folder}/{name}") for name in CLASSES if exists(spark, f"{folder}/{name}/stages")})


def fit_classes(frame: DataFrame, features: list[str], least_rows: int = LEAST_ROWS, **how) -> Classes:
    """Fit each tuning class on its species, with its depths and quantile (``how``: iterations, trees, seed, or others in their place).

    A class without an eligible species isn't fitted, nor any where the frame has under ``least_rows`` rows.
    """
    named = frame.withColumn("_class", tuning_class(F.col("species")))
    counts = eligibility(frame).where("eligible and species is not null").groupBy(tuning_class(F.col("species")).alias("_class")).agg(F.sum("n").alias("n")).collect()  # a row a class
    if frame.limit(least_rows).count() < least_rows:
        return Classes({})
    found = {}
    for name in sorted(r["_class"] for r in counts):
        active_depth, depth, alpha = CLASSES[name]
        found[name] = fit(named.where(F.col("_class") == name), features, **{"active_depth": active_depth, "depth": depth, "alpha": alpha} | how)
    return Classes(found)


def fit_summary(results: DataFrame) -> DataFrame:
    """(n, rmse, accuracy): error, and how often activity was told right, on rows of (actual, predicted)."""
    error = F.col("predicted") - F.col("actual")
    right = (F.col("actual") > 0) == (F.col("predicted") > 0)
    return results.agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(right.cast("double")).alias("accuracy"))


__all__ = ["Classes", "Staged", "eligibility", "fit", "fit_classes", "predict", "tuning_class", "weighted_leaf_quantiles"]
