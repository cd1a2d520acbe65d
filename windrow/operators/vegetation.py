"""Vegetation composites every 16 days to daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_composites(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union by (station, date), fresh ones winning."""
    from windrow.operators.align import prefer

    return prefer(fresh, cached, ["station", "date"])


def daily(composites: DataFrame, value: str, method: str = "hermite") -> DataFrame:
    """(station, date, value): one row per day between a station's first and last composite.

    "linear" goes straight from knot to knot.  "hermite" is a local cubic with finite-difference slopes, from the two
    knots on either side; "spline" is the cubic with two continuous derivatives, whose outer two pieces on either end are
    one (not-a-knot).  A station with fewer than four knots is taken linearly by either.
    """
    if method not in ("linear", "hermite", "spline"):
        raise ValueError(f"no method {method!r}")
    knots = composites.where(F.col(value).isNotNull()).select("station", F.col("date").alias("d1"), F.col(value).alias("y1"))
    w = Window.partitionBy("station").orderBy("d1")
    for name, k in (("0", -1), ("2", 1), ("3", 2)):
        knots = knots.withColumn(f"d{name}", F.lead("d1", k).over(w)).withColumn(f"y{name}", F.lead("y1", k).over(w))
    knots = knots.withColumn("n", F.count("*").over(Window.partitionBy("station")))
    last = F.coalesce(F.date_add("d2", -1), F.col("d1"))
    days = knots.withColumn("date", F.explode(F.sequence("d1", last)))
    gap = lambda a, b: F.datediff(b, a).cast("double")
    h = gap("d1", "d2")
    t = F.when(F.col("d2").isNull(), 0.0).otherwise(gap("d1", "date") / h)
    straight = F.when(F.col("d2").isNull(), F.col("y1")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * t)
    if method == "linear":
        return days.select("station", "date", straight.alias(value))
    if method == "spline":
        return _spline(composites, value)
    m1 = F.when(F.col("d0").isNull(), (F.col("y2") - F.col("y1")) / h).otherwise((F.col("y2") - F.col("y0")) / gap("d0", "d2"))
    m2 = F.when(F.col("d3").isNull(), (F.col("y2") - F.col("y1")) / h).otherwise((F.col("y3") - F.col("y1")) / gap("d1", "d3"))
    t2, t3 = t * t, t * t * t
    curve = (2 * t3 - 3 * t2 + 1) * F.col("y1") + (t3 - 2 * t2 + t) * h * m1 + (3 * t2 - 2 * t3) * F.col("y2") + (t3 - t2) * h * m2
    smooth = F.when(F.col("d2").isNull(), F.col("y1")).when(F.col("n") < 4, straight).otherwise(curve)
    return days.select("station", "date", smooth.alias(value))


def spline_slopes(composites: DataFrame, value: str) -> DataFrame:
    """(station, d1, y1, s1, n): the not-a-knot spline's slope at each knot, for stations of four knots or more.

    The slopes solve a tridiagonal system, by elimination down a station's knots and substitution back up, each a fold
    over one array; a station has some 23 knots a year.
    """
    rows = composites.where(F.col(value).isNotNull()).groupBy("station", F.col("date").alias("d1")).agg(F.max(value).alias("y1"))
    rows = rows.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("d1", "y1"))).alias("k")).where(F.size("k") >= 4).withColumn("n", F.size("k"))
    steps = F.sequence(F.lit(0), F.col("n") - 2)
    rows = rows.withColumn("h", F.transform(steps, lambda i: F.datediff(F.col("k")[i + 1]["d1"], F.col("k")[i]["d1"]).cast("double")))
    rows = rows.withColumn("m", F.transform(steps, lambda i: (F.col("k")[i + 1]["y1"] - F.col("k")[i]["y1"]) / F.col("h")[i]))
    h, m, n = (lambda i: F.col("h")[i]), (lambda i: F.col("m")[i]), F.col("n")

    def line(i):
        """The system's row: factors of the slopes before, at and after a knot, and the right side."""
        d, e = h(F.lit(0)) + h(F.lit(1)), h(n - 2) + h(n - 3)
        first = ((h(F.lit(0)) + 2 * d) * h(F.lit(1)) * m(F.lit(0)) + h(F.lit(0)) * h(F.lit(0)) * m(F.lit(1))) / d
        last = (h(n - 2) * h(n - 2) * m(n - 3) + (2 * e + h(n - 2)) * h(n - 3) * m(n - 2)) / e
        pick = lambda a, b, c: F.when(i == 0, a).when(i == n - 1, b).otherwise(c)
        at = lambda f, j: F.get(F.col(f), j)
        return F.struct(
            pick(F.lit(0.0), e, at("h", i)).alias("a"), pick(h(F.lit(1)), h(n - 3), 2 * (at("h", i - 1) + at("h", i))).alias("b"),
            pick(d, F.lit(0.0), at("h", i - 1)).alias("c"), pick(first, last, 3 * (at("h", i) * at("m", i - 1) + at("h", i - 1) * at("m", i))).alias("r"),
        )

    rows = rows.withColumn("lines", F.transform(F.sequence(F.lit(0), n - 1), line))
    none = F.array().cast("array<struct<c: double, r: double>>")

    def down(acc, x):
        under = x["b"] - x["a"] * acc["c"]
        c, r = x["c"] / under, (x["r"] - x["a"] * acc["r"]) / under
        return F.struct(c.alias("c"), r.alias("r"), F.concat(acc["out"], F.array(F.struct(c.alias("c"), r.alias("r")))).alias("out"))

    def up(acc, x):
        s = x["r"] - x["c"] * acc["s"]
        return F.struct(s.alias("s"), F.concat(F.array(s), acc["out"]).alias("out"))

    rows = rows.withColumn("down", F.aggregate("lines", F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("r"), none.alias("out")), down)["out"])
    rows = rows.withColumn("s", F.aggregate(F.reverse("down"), F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out")), up)["out"])
    return rows.select("station", "n", F.explode(F.arrays_zip("k", "s")).alias("z")).select("station", F.col("z.k.d1").alias("d1"), F.col("z.k.y1").alias("y1"), F.col("z.s").alias("s1"), "n")


def _spline(composites: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("station").orderBy("d1")
    knots = spline_slopes(composites, value).withColumns({f"{c}2": F.lead(f"{c}1").over(w) for c in "dys"})
    days = knots.withColumn("date", F.explode(F.sequence("d1", F.coalesce(F.date_add("d2", -1), F.col("d1")))))
    h = F.datediff("d2", "d1").cast("double")
    t = F.datediff("date", "d1") / h
    t2, t3 = t * t, t * t * t
    curve = (2 * t3 - 3 * t2 + 1) * F.col("y1") + (t3 - 2 * t2 + t) * h * F.col("s1") + (3 * t2 - 2 * t3) * F.col("y2") + (t3 - t2) * h * F.col("s2")
    smooth = days.select("station", "date", F.when(F.col("d2").isNull(), F.col("y1")).otherwise(curve).alias(value))
    few = composites.where(F.col(value).isNotNull()).groupBy("station").agg(F.count_distinct("date").alias("n")).where("n < 4").select("station")
    return smooth.unionByName(daily(composites.join(few, "station", "left_semi"), value, "linear"))


def valid(composites: DataFrame) -> DataFrame:
    return composites.where((F.col("ndvi") > -0.2) & (F.col("ndvi") < 1.0))


def interpolate(composites: DataFrame, method: str = "hermite") -> DataFrame:
    """(station, date, ndvi, evi, ndvi_delta) by day; ndvi from valid composites, evi from all."""
    both = daily(valid(composites), "ndvi", method).join(daily(composites, "evi", method), ["station", "date"], "left")
    w = Window.partitionBy("station").orderBy("date")
    return both.withColumn("ndvi_delta", F.coalesce(F.col("ndvi") - F.lag("ndvi").over(w), F.lit(0.0)))


def reindex(days: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted (station, date) rows with the latest earlier values, 0 before the first."""
    w = Window.partitionBy("station").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = wanted.select("station", "date").distinct().withColumn("_wanted", F.lit(True)).join(days.select("station", "date", *columns), ["station", "date"], "full")
    filled = joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})
    return filled.where("_wanted").drop("_wanted")
