"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A document's vector is the lane-wise sum, modulo powers of two, of wide vectors hashed from its paragraphs: eight lanes
of 32 bits that hold the paragraph's hashes, and 252 lanes of 20 bits that count the set bits in the hashes of its
clauses, with a lane that counts the clauses.  Sums don't depend on the order of paragraphs; a paragraph is inserted or
deleted by adding or subtracting its vector.  The first lanes tell equality, the others likeness: centred on half the
clauses they are a random projection of the multiset of clauses, so their cosine estimates how much two texts share.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.common import written

EXACT = 8  # lanes modulo 2**32
PACKED = 84  # longs with three lanes modulo 2**20 each, 21 bits apart; 21 longs of each hash of a clause
_THREE = (1 << 0) | (1 << 21) | (1 << 42)
_LANES = _THREE * ((1 << 20) - 1)
_GUARDS = _THREE << 20
_LOW32, _LOW20 = (1 << 32) - 1, (1 << 20) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _and(column: Column, mask: int) -> Column:
    return column.bitwiseAND(_long(mask))


def vector(text: Column) -> Column:
    """array<bigint>: 8 exact lanes, 84 longs of three likeness lanes, the number of clauses; zeros for null or empty."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, r"\n+"), lambda p: p != "")
    clauses = F.filter(F.transform(F.split(text, r"[\n.,;:!?|]+"), lambda c: F.trim(c)), lambda c: c != "")

    def exact(acc: Column, h: Column) -> Column:
        return F.array(*[_and(acc[k] + _and(F.shiftright(h[k // 2], 32 * (k % 2)), _LOW32), _LOW32) for k in range(EXACT)])

    def near(acc: Column, h: Column) -> Column:
        return F.array(*[_and(acc[k] + _and(F.shiftright(h[k // 21], k % 21), _THREE), _LANES) for k in range(PACKED)], _and(acc[PACKED] + 1, _LOW20))

    wide = F.transform(paragraphs, lambda p: F.array(*[F.xxhash64(p, F.lit(k)) for k in range(EXACT // 2)]))
    zeros = lambda n: F.array(*[_long(0)] * n)
    first = F.aggregate(wide, zeros(EXACT), exact)
    second = F.aggregate(F.transform(clauses, lambda c: F.array(*[F.xxhash64(c, F.lit(k)) for k in range(PACKED // 21)])), zeros(PACKED + 1), near)
    return F.concat(first, second)


def insert(a: Column, b: Column) -> Column:
    """The vector of both multisets together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _masks(), lambda x, m: x.bitwiseAND(m))


def delete(a: Column, b: Column) -> Column:
    """The vector of a without b.  Guard bits above each lane take the borrow."""
    return F.zip_with(F.zip_with(F.zip_with(a, _guards(), lambda x, g: x.bitwiseOR(g)), b, lambda x, y: x - y), _masks(), lambda x, m: x.bitwiseAND(m))


def _masks() -> Column:
    return F.array(*[_long(_LOW32)] * EXACT, *[_long(_LANES)] * PACKED, _long(_LOW20))


def _guards() -> Column:
    return F.array(*[_long(1 << 32)] * EXACT, *[_long(_GUARDS)] * PACKED, _long(1 << 20))


def as_hex(vec: Column) -> Column:
    """Lower-case hex: 8 digits an exact lane, 16 a packed long, 8 for the count."""
    wide = lambda x, i: F.when((i >= EXACT) & (i < EXACT + PACKED), F.lpad(F.hex(x), 16, "0")).otherwise(F.lpad(F.hex(x), 8, "0"))
    return F.lower(F.array_join(F.transform(vec, wide), ""))


def _centred(vec: Column) -> Column:
    """The 252 likeness lanes as doubles, twice the count of set bits less the number of clauses."""
    n = vec[EXACT + PACKED]
    packed = F.slice(vec, EXACT + 1, PACKED)
    lanes = F.flatten(F.transform(packed, lambda x: F.array(*[_and(F.shiftright(x, s), _LOW20) for s in (0, 21, 42)])))
    return F.transform(lanes, lambda c: (c * 2 - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, lanes_a: Column, lanes_b: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the cosine of the centred lanes (0 if one has no clause, or it is negative)."""
    product = F.sqrt(_dot(lanes_a, lanes_a)) * F.sqrt(_dot(lanes_b, lanes_b))
    cosine = F.when(product > 0, _dot(lanes_a, lanes_b) / product).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def with_next(rows: DataFrame, key: str, order: list[str], carried: list[str], rows_per_bucket: int = 200, most_segments: int = 4096, most_buckets: int = 2_000_000) -> DataFrame:
    """Each row with ``next``, a struct of the ``carried`` columns of the row after it by (key, order); the last has the first's.

    One shuffle of the rows, no global window: the key's quantiles (``most_segments`` at most) cut the rows into segments,
    each segment is cut into equal ranges of the key, or of the first column of ``order``, a 64-bit hash, where one key
    fills it, and each such bucket also gets a copy of the first row of the next one.  Those first rows' keys are
    broadcast; beyond ``most_buckets`` buckets grow instead of them.  ``key`` is a long without nulls.
    """
    n = rows.count()
    per_bucket = max(rows_per_bucket, n // most_buckets)
    wanted = max(1, min(most_segments, n // per_bucket))
    cuts = [int(x) for x in rows.approxQuantile(key, [i / wanted for i in range(1, wanted)], 0.2 / wanted)] if wanted > 1 else []
    times = Counter(cuts)
    parts = max(1, -(-n // (wanted * per_bucket)))  # buckets of a segment
    bounds: dict[int, int] = {}  # first key of a segment -> how many buckets, negative where they are ranges of the hash
    for c in sorted(times):
        bounds[c] = parts if times[c] == 1 else -parts * times[c]
        if times[c] > 1:
            bounds.setdefault(c + 1, parts)
    lows = sorted(bounds)
    longs = lambda xs: F.array(*[_long(x) for x in xs])
    if lows:  # two levels, so that each row is held against some 256 numbers at most
        groups = [lows[i : i + 64] for i in range(0, len(lows), 64)]
        at = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= F.col(key)))
        within = F.size(F.filter(F.element_at(F.array(*map(longs, groups)), F.greatest(at, F.lit(1))), lambda b: b <= F.col(key)))
        segment = F.greatest(at - 1, F.lit(0)) * 64 + within
    else:
        segment = F.lit(0)
    low, high = [-(2**63), *lows], [*lows, 2**63 - 1]
    many = [parts, *(bounds[x] for x in lows)]
    rows = rows.withColumn("segment", segment.cast("int"))
    spot = F.col("segment") + 1
    ranges = F.element_at(longs(many), spot)
    lo, hi = (F.element_at(longs(x), spot).cast("double") for x in (low, high))
    if not lows or parts > 1:  # the outer segments end where the keys do
        ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        lo, hi = F.greatest(lo, F.lit(float(ends.a if ends.a is not None else 0))), F.least(hi, F.lit(float(ends.b if ends.b is not None else 0)) + 1)
    share = F.when(ranges < 0, F.col(order[0]).cast("double") / 2.0**64 + 0.5).otherwise((F.col(key).cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)))
    sub = F.least(F.greatest(F.floor(share * F.abs(ranges)), F.lit(0)), F.abs(ranges) - 1).cast("long")
    rows = rows.withColumn("sub", sub)
    where = ["segment", "sub"]
    firsts = written(rows.groupBy(*where).agg(F.min(F.struct(key, *order)).alias("f")), "bucket-firsts")
    edges = firsts.groupBy("segment").agg(F.min("sub").alias("first"), F.max("sub").alias("last")).orderBy("segment").collect()  # a row a segment
    if not edges:
        return rows.withColumn("next", F.struct(*carried)).drop(*where)
    spark = rows.sparkSession
    over = [(r.segment, r.first, edges[i - 1].segment, edges[i - 1]["last"]) for i, r in enumerate(edges)]  # the first one's goes to the last
    over = spark.createDataFrame([(a, b, c, d) for a, b, c, d in over], "segment int, sub long, home int, home_sub long")
    before = F.lag("sub").over(Window.partitionBy("segment").orderBy("sub"))
    starts = firsts.withColumn("before", before).join(F.broadcast(over), where, "left")
    home = F.struct(F.coalesce("home", "segment").alias("segment"), F.coalesce("home_sub", "before").alias("sub"))
    last = edges[-1]
    wraps = (F.col("home") == last.segment) & (F.col("home_sub") == last["last"]) & (F.col("segment") == edges[0].segment)
    starts = starts.select("f.*", home.alias("to"), F.when(wraps, 2).otherwise(1).alias("copy"))  # the copy of the very first row stands after all others
    marked = rows.join(F.broadcast(starts), [key, *order], "left")
    homes = F.array(F.struct(F.struct(*where).alias("at"), F.lit(0).alias("copy")))
    also = F.when(F.col("to").isNotNull(), F.array(F.struct(F.col("to").alias("at"), F.col("copy"))))
    marked = marked.withColumn("home", F.explode(F.concat(homes, F.coalesce(also, F.slice(homes, 1, 0)))))
    w = Window.partitionBy("home.at").orderBy(F.col("home.copy") > 0, key, *order)
    led = marked.withColumn("next", F.lead(F.struct(*carried)).over(w)).where("home.copy = 0")
    return led.drop(*where, "to", "copy", "home")


def _repeated(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows with n, None), or where some (key, tie, text) stand more than ``most`` times, those once with their number, the rest with 1."""
    counts = written(rows.groupBy("key", "tie").agg(F.count("*").alias("n")).where(F.col("n") > most), "repeated")
    if counts.isEmpty():
        return rows.withColumn("n", _long(1)), None
    hot = rows.join(counts.select("key", "tie"), ["key", "tie"], "left_semi").groupBy("doc_id", "key", "tie", "text").agg(F.count("*").alias("n"))
    plain = rows.join(counts.select("key", "tie"), ["key", "tie"], "left_anti").withColumn("n", _long(1))
    return plain.unionByName(hot), counts


def _times(rows: DataFrame, n: str, block: int = 10_000) -> DataFrame:
    """Each row ``n`` times, dealt out over tasks by blocks."""
    blocks = rows.withColumn("_b", F.explode(F.sequence(_long(0), F.floor((F.col(n) - 1) / block)))).hint("rebalance")
    left = F.least(_long(block), F.col(n) - F.col("_b") * block)
    return blocks.withColumn("_c", F.explode(F.sequence(_long(1), left))).drop("_b", "_c", n)


def op8_fingerprint(docs: DataFrame, most_repeats: int = 1000) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likeness; null texts count as empty.

    Rows follow each other by (doc_id, hash of the text), null ids first, so repeated rows are each other's next; a sole
    row is its own next.  A row that stands more than ``most_repeats`` times is fingerprinted once, as its own next and
    before the next other row, and the results are repeated.  Other columns aren't read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", _long(-(2**63))).alias("key"), F.xxhash64("text").alias("tie"), "text")
    rows, hot = _repeated(rows, most_repeats)
    both = with_next(rows.withColumn("vec", vector(F.col("text"))), "key", ["tie"], ["text", "vec"])
    if hot is not None:  # all but the last of equal rows are followed by themselves
        pairs = F.array(F.struct(F.col("next").alias("next"), _long(1).alias("n")), F.struct(F.struct("text", "vec").alias("next"), (F.col("n") - 1).alias("n")))
        both = both.withColumn("_p", F.explode(F.filter(pairs, lambda p: p["n"] > 0))).withColumns({"next": F.col("_p.next"), "n": F.col("_p.n")}).drop("_p")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    both = both.select("doc_id", "n", n.cast("long").alias("n_chars"), "vec", F.col("next.vec").alias("next_vec"), edited.alias("edited"))
    both = both.select("doc_id", "n", "n_chars", "vec", "next_vec", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_vec"))
    lanes = both.select("*", _centred(F.col("vec")).alias("a"), _centred(F.col("edited_vec")).alias("b"), _centred(F.col("next_vec")).alias("c"))
    found = lanes.select(
        "doc_id", "n", "n_chars", "edited_sha256", as_hex(F.col("vec")).alias("fingerprint"), as_hex(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec"), F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec"), F.col("a"), F.col("c")).alias("near_next"),
    )
    return found.drop("n") if hot is None else _times(found, "n")
