"""Backtest results: folds, error metrics, the head-to-head with the expert index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.functions.scalar import level_number
from windrow.shared import written

NUMBER = level_number


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.col("predicted") - F.col("actual")).withColumn("abs_error", F.abs("error"))


_GRID = [i / 100 for i in range(101)]


def _brackets(value: Column, accuracy: int) -> Column:
    """An approximate quantile's two sides of the middle."""
    return F.percentile_approx(value, [max(0.0, 0.5 - 2 / accuracy), min(1.0, 0.5 + 2 / accuracy)], accuracy)


def _beside(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their group's n, lo and hi."""
    named = bounds.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", "_lo", "_hi")
    if by:
        return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])
    one = named.first()
    return rows.withColumns({"_n": F.lit(one["_n"]), "_lo": F.lit(one["_lo"]).cast("double"), "_hi": F.lit(one["_hi"]).cast("double")})


def _narrowed(rows: DataFrame, bounds: DataFrame, by: list[str], most: int, accuracy: int) -> DataFrame:
    """``bounds`` of fewer than some ``most`` distinct values each: each pass over the rows keeps a few hundredths of a bracket."""
    size = None
    while True:
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        sums = _beside(rows, bounds, by).where(F.col("_v") <= F.col("_hi")).groupBy(*by, "_n", "_lo", "_hi").agg(
            F.count_if(~inside).alias("_below"), F.count_if(inside).alias("_c"), F.approx_count_distinct(F.when(inside, F.col("_v"))).alias("_d"), F.percentile_approx(F.when(inside, F.col("_v")), _GRID, accuracy).alias("_q"),
        )
        sums = written(sums, "brackets")  # a row a group
        largest = sums.agg(F.max("_d")).first()[0] or 0
        if largest <= most or largest == size:
            return bounds
        size = largest
        share = lambda rank: (rank - F.col("_below")) / F.col("_c") * 100
        lo = F.greatest(F.lit(0), F.floor(share(F.floor((F.col("_n") - 1) / 2))).cast("int") - 1)
        hi = F.least(F.lit(100), F.ceil(share(F.floor(F.col("_n") / 2) + 1)).cast("int") + 1)
        bounds = sums.select(*by, "_n", F.when(F.col("_d") > most, F.get("_q", lo)).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_d") > most, F.get("_q", hi)).otherwise(F.col("_hi")).alias("_hi"))


def medians(rows: DataFrame, value: str, by: list[str] = (), accuracy: int = 10_000, most: int = 10_000, bounds: DataFrame | None = None) -> DataFrame:
    """(by, median): exact, the mean of the middle two of an even number; nulls don't count.

    An approximate quantile brackets the middle, at first within some thousandths of a group's values; passes over the
    rows narrow the bracket until ``most`` distinct values or so are inside, which alone are counted exactly.  So no task
    holds more of a group, however large it is.  ``bounds``: (by, _n, _lo, _hi), if the caller has them.
    """
    by = list(by)
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if bounds is None:
        bounds = rows.groupBy(*by).agg(_brackets(F.col("_v"), accuracy).alias("_b"), F.count("*").alias("_n")).select(*by, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
        bounds = written(bounds, "brackets")
    if (bounds.agg(F.max("_n")).first()[0] or 0) * 8 / accuracy > most:  # at most as many are inside otherwise
        bounds = _narrowed(rows, bounds, by, most, accuracy)
    joined = _beside(rows, bounds, by)
    inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
    counts = joined.where(F.col("_v") <= F.col("_hi")).groupBy(*by, "_n", inside.alias("_v")).agg(F.count("*").alias("c"))
    found = counts.groupBy(*by, "_n").agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "c")))).alias("s"))

    def at(rank):
        return F.aggregate("s", F.struct(F.col("below").alias("k"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["k"] + x["c"]).alias("k"), F.when(a["v"].isNull() & (a["k"] + x["c"] > rank), x["_v"]).otherwise(a["v"]).alias("v")))["v"]

    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2
    return found.select(*by, middle.alias("median"))


def metrics(results: DataFrame, by: list[str] = (), where: Column | None = None) -> DataFrame:
    """n, mae, rmse, median_ae, level_accuracy, max_actual, bias, over all rows or by columns.

    One pass makes all but the median, and its bracket; a second one the median.
    """
    by = list(by)
    rows = results if where is None else results.where(where)
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg((F.col("level_actual") == F.col("level_predicted")).cast("double")).alias("level_accuracy"), F.max("actual").alias("max_actual"), F.avg("error").alias("bias"),
        F.count("abs_error").alias("_n"), _brackets(F.col("abs_error").cast("double"), 10_000).alias("_b"),
    )
    found = written(found, "metrics")  # a row a group
    bounds = found.where("_n > 0").select(*by, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    found = found.drop("_n", "_b")
    if not by and bounds.isEmpty():
        return found.withColumn("median_ae", F.lit(None).cast("double"))
    middle = medians(rows, "abs_error", by, bounds=bounds).withColumnRenamed("median", "median_ae")
    if not by:
        return found.withColumn("median_ae", F.lit(middle.first().median_ae).cast("double"))
    named = middle.select(*[F.col(c).alias(f"_{c}") for c in by], "median_ae")
    return found.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def bias_report(results: DataFrame, over: float = 1.0) -> DataFrame:
    """(species, bias, direction) where the mean error is beyond ``over``."""
    bias = results.groupBy("species").agg(F.avg("error").alias("bias")).where(F.abs("bias") > over)
    return bias.withColumn("direction", F.when(F.col("bias") > 0, "OVER").otherwise("UNDER"))


def worst(results: DataFrame, n: int = 10) -> DataFrame:
    return results.orderBy(F.desc("abs_error"), "species", "ts", "station").limit(n)


def fold_table(history: DataFrame, test_days: int = 0, n_folds: int | None = None) -> DataFrame:
    """(fold, month_start): months with enough distinct earlier days, of which ``n_folds`` evenly spaced ones are kept.

    The windows run over calendar months, a few hundred rows after aggregation.
    """
    days = history.select(F.to_date("ts").alias("day")).distinct()
    months = days.groupBy(F.to_date(F.trunc("day", "month")).alias("month_start")).agg(F.count("*").alias("days"))
    w = Window.partitionBy(F.lit(0)).orderBy("month_start")
    months = months.withColumn("before", F.sum("days").over(w) - F.col("days")).agg(F.sort_array(F.collect_list(F.struct("month_start", "before", "days"))).alias("m"), F.sum("days").alias("total"))
    least = F.greatest(F.lit(60), F.floor(F.col("total") / 5))
    eligible = months.select(F.filter("m", lambda m: m["before"] >= least).alias("m")).select("*", F.size("m").alias("k")).select("k", F.posexplode("m").alias("rank", "e"))
    rows = eligible.select("rank", "k", F.col("e.month_start").alias("month_start"))
    if n_folds is not None:
        spots = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: F.floor(i * (F.col("k") - 1) / F.lit(max(1, n_folds - 1))).cast("int"))
        rows = rows.where((F.col("k") <= n_folds) | F.array_contains(spots, F.col("rank")))
    return rows.select(F.col("rank").alias("fold"), "month_start")


def head_to_head(results: DataFrame, expert: DataFrame) -> DataFrame:
    """(species, total, ours_right, expert_right, both_right, winner): the first window of each day against the expert level."""
    first = results.groupBy("species", F.to_date("ts").alias("date")).agg(F.min_by(F.struct("level_actual", "level_predicted"), F.struct("ts", "station")).alias("r"))
    joined = first.join(expert.select("species", "date", F.bround("level", 0).cast("int").alias("expert")), ["species", "date"])
    truth = NUMBER(F.col("r.level_actual"))
    ours, theirs = NUMBER(F.col("r.level_predicted")) == truth, F.col("expert") == truth
    counts = joined.groupBy("species").agg(F.count("*").alias("total"), F.count_if(ours).alias("ours_right"), F.count_if(theirs).alias("expert_right"), F.count_if(ours & theirs).alias("both_right"))
    winner = F.when(F.col("ours_right") > F.col("expert_right"), "ours").when(F.col("ours_right") < F.col("expert_right"), "expert").otherwise("tie")
    return counts.withColumn("winner", winner)


def daily_top(df: DataFrame, n: int = 3) -> DataFrame:
    """(day, species, peak, rank): each species' daily peak, the ``n`` highest a day."""
    peak = df.groupBy(F.to_date("ts").alias("day"), "species").agg(F.max("value").alias("peak"))
    w = Window.partitionBy("day").orderBy(F.desc("peak"), "species")
    return peak.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
