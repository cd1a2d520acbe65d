"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import written
from windrow.shared import discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node that can be reached.

    After Kiveris et al., "Connected Components in MapReduce and Beyond": a large star links each node's greater
    neighbours to its least neighbour, a small star its lesser ones; both keep the components, and the edges become
    stars around the least nodes after about log(nodes) rounds; a round's tables go when the next one's edges are written.  Minima are aggregated map-side and written, so that in
    the join back the neighbours of a hub are split over tasks.  Null ends and loops are dropped; no edges, no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and u != v").distinct()
    e = written(e, "edges")
    size = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        least = low.withColumn("m", F.least("m", "u"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low_large = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low_large, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        before, e = e, written(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u != v").distinct(), "small")
        discard(before, low, large, low_large)  # the next round reads only e
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == size:
            break
        size = (now.n, now.h)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
