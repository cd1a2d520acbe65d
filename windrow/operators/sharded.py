"""Windows over long series in shards of time: no task holds a whole series.

A shard is ``days`` calendar days of one series.  Frames that count rows get a halo: copies of the rows that stand before
the shard, from as many earlier shards as it takes.  Runs without a bound (streaks) are counted within the shard, and a
carry pass over one row a shard tells what the run before it brings along.  Keys may be null, as in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD, HALO = "_shard", "_halo"


def shard_of(ts: Column, days: int) -> Column:
    """The number of the shard that a time falls in; shards begin at midnight."""
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / days).cast("int")


def with_shards(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn(SHARD, shard_of(F.col("ts"), days))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are equal; the right side's keys go."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def _sources(rows: DataFrame, keys: list[str], halo: int) -> DataFrame:
    """(keys, _shard, target, rank): how many of a shard's last rows stand among the ``halo`` rows before another shard."""
    counts = rows.groupBy(*keys, SHARD).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(-halo, -1)  # a row a shard, and each has a row of the series at least
    counts = counts.withColumn("_before", F.reverse(F.collect_list(F.struct(SHARD, "_n")).over(before)))
    none = F.array().cast("array<struct<source: int, rank: bigint>>")
    start = F.struct(F.lit(halo).cast("bigint").alias("left"), none.alias("out"))
    take = lambda acc, s: F.struct((acc["left"] - s["_n"]).alias("left"), F.when(acc["left"] > 0, F.concat(acc["out"], F.array(F.struct(s[SHARD].alias("source"), acc["left"].alias("rank"))))).otherwise(acc["out"]).alias("out"))
    found = counts.select(*keys, F.col(SHARD).alias("_target"), F.explode(F.aggregate("_before", start, take)["out"]).alias("_s"))
    return found.select(*keys, F.col("_s.source").alias(SHARD), "_target", F.col("_s.rank").alias("_rank"))


def with_halo(df: DataFrame, keys: list[str], days: int, halo: int) -> DataFrame:
    """Every row with its shard, and copies of the ``halo`` rows of its series before each shard, which ``_halo`` marks.

    The copies are a shard's last rows, picked before the shuffle; their number doesn't follow the length of a shard.
    """
    rows = with_shards(df, days)
    last = Window.partitionBy(*keys, SHARD).orderBy(F.desc("ts"))
    ends = rows.withColumn("_at", F.row_number().over(last)).where(F.col("_at") <= halo)
    copies = same_keys(ends, _sources(rows, keys, halo), [*keys, SHARD]).where("_at <= _rank").withColumn(SHARD, F.col("_target")).drop("_at", "_rank", "_target")
    return rows.withColumn(HALO, F.lit(False)).unionByName(copies.withColumn(HALO, F.lit(True)))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, SHARD)


def carries(rows: DataFrame, holds: Column, keys: list[str]) -> DataFrame:
    """(keys, _shard, carry, before): the length of the run of rows that hold up to the shard's beginning, and how many rows stand before it.

    ``rows`` have shards.  Each shard is summed up as its rows and those after its last row that doesn't hold.
    """
    own = Window.partitionBy(*keys, SHARD)
    m = rows.select(*keys, SHARD, "ts", F.coalesce(holds, F.lit(False)).alias("_m"))
    m = m.withColumn("_break", F.max(F.when(~F.col("_m"), F.col("ts"))).over(own))
    sums = m.groupBy(*keys, SHARD).agg(F.count("*").alias("_n"), F.count_if(F.col("_break").isNull() | (F.col("ts") > F.col("_break"))).alias("_run"))
    shards = Window.partitionBy(*keys).orderBy(SHARD)  # a row a shard
    sums = sums.withColumn("_total", F.sum("_n").over(shards.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("_anchor", F.when(F.col("_run") < F.col("_n"), F.col("_run") - F.col("_total")))
    before = F.col("_total") - F.col("_n")
    carry = before + F.coalesce(F.last("_anchor", ignorenulls=True).over(shards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, SHARD, carry.alias("carry"), before.alias("before"))


def streak(df: DataFrame, holds: Column, name: str, keys: list[str], days: int) -> DataFrame:
    """As operators.features.streak, by shards."""
    rows = with_shards(df.withColumn("_m", F.coalesce(holds, F.lit(False)).cast("int")), days)
    rows = same_keys(rows, carries(rows, F.col("_m") == 1, keys).drop("before"), [*keys, SHARD])
    upto = Window.partitionBy(*keys, SHARD).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(1 - F.col("_m")).over(upto))
    within = Window.partitionBy(*keys, SHARD, "_island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("_m").over(within) + F.when(F.col("_island") == 0, F.col("carry")).otherwise(0)
    return rows.withColumn(name, own.cast("double")).drop("_m", "_island", "carry", SHARD)


def since_active(df: DataFrame, keys: list[str], days: int, name: str = "windows_since_active") -> DataFrame:
    """Rows since the last one of a positive value, 999 at a series' first row: the run of other rows up to the one before."""
    rows = with_shards(df.withColumn("_m", (~F.coalesce(F.col("value") > 0, F.lit(False))).cast("int")), days)
    rows = same_keys(rows, carries(rows, F.col("_m") == 1, keys), [*keys, SHARD])
    past = Window.partitionBy(*keys, SHARD).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(*keys, SHARD).orderBy("ts"))
    rows = rows.withColumn("_rn", place).withColumn("_last", F.max(F.when(F.col("_m") == 0, F.col("_rn"))).over(past))
    since = F.when(F.col("_last").isNotNull(), F.col("_rn") - 1 - F.col("_last")).otherwise(F.col("_rn") - 1 + F.col("carry"))
    since = F.when((F.col("_rn") == 1) & (F.col("before") == 0), F.lit(999)).otherwise(since)
    return rows.withColumn(name, since.cast("double")).drop("_m", "_rn", "_last", "carry", "before", SHARD)


def with_time_halo(df: DataFrame, days: int, seconds: int) -> DataFrame:
    """Every row with its shard, and copies for each later shard that begins within ``seconds`` after the row, which ``_halo`` marks."""
    own = shard_of(F.col("ts"), days)
    late = shard_of(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + seconds), days)
    rows = df.withColumn("_to", F.sequence(own, late)).withColumn("_own", own).withColumn(SHARD, F.explode("_to"))
    return rows.withColumn(HALO, F.col(SHARD) != F.col("_own")).drop("_to", "_own")


def with_ends(df: DataFrame, active: Column, keys: list[str], days: int) -> DataFrame:
    """``df`` (with _epoch) and, of the rows in earlier shards, the last active one's time and the first one's: _active_before, _first_before."""
    rows = with_shards(df, days)
    before = Window.partitionBy(*keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    ends = rows.groupBy(*keys, SHARD).agg(F.max(active).alias("_a"), F.min("_epoch").alias("_f"))
    ends = ends.select(*keys, SHARD, F.max("_a").over(before).alias("_active_before"), F.min("_f").over(before).alias("_first_before"))
    return same_keys(rows, ends, [*keys, SHARD]).drop(SHARD)
