"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from windrow.llm.common import as_bytes, column_rows, written
from windrow.llm.components import connected_components
from windrow.llm.substring import grams, word_codes
from windrow.shared import tidy

BITS = 64
_BLOCK = 1 << 15


def simhash(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text as an unsigned number; 0 for a text without words."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and the six white-space characters of ASCII
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - words_per_shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = hashes[start : start + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp): every row's 64-bit SimHash as a signed long; null texts count as empty (fingerprint 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t, words_per_shingle) for t in column_rows(as_bytes(batch.column(1)))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())]))


def ball_flips(radius: int) -> tuple[list[int], list[int]]:
    """Flips that make the variants of (every fingerprint, those of odd weight beside), coded i + 64 * j for bits i <= j.

    For a radius r of 1 to 3, two fingerprints at distance d <= r meet at a variant that lies within floor(r / 2) flips
    of the one and ceil(r / 2) flips of the other.  Two savings keep this exact: at d = 3 the two weights differ in
    parity, so only odd ones flip two bits; and of any three bits two lie in the same half of the word, so only pairs
    within a half are flipped.  -1 is no flip.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    half = BITS // 2
    two = [i + BITS * j for lo in (0, half) for i, j in combinations(range(lo, lo + half), 2)] if radius == 3 else []
    return [-1, *(i + BITS * i for i in range(BITS))], two


def _mask(flips):
    """The bits that a coded flip turns."""
    one = F.lit(1).cast("long")
    i, j = F.expr("cast(flips % 64 as int)"), F.expr("cast(flips div 64 as int)")
    bits = F.call_function("shiftleft", one, i).bitwiseOR(F.call_function("shiftleft", one, j))
    return F.when(flips < 0, F.lit(0).cast("long")).otherwise(bits)


def near_edges(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all pairs within ``radius`` bits.

    ``fps`` has one row per distinct ``fp``.  Variants are shuffled on their value, each with its coded flips, from which
    the fingerprint is made again (two bytes that compress to less than eight).  A bucket holds at most 2,081
    fingerprints (those within two flips of its value), whatever the input.  Its least member within one flip is linked
    to each other member: 1 + 2 <= 3 bits, so links need no pair search within a bucket; each is still verified.
    """
    spark = fps.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, min(100_000, fps.count() // 20_000))
    every, odd = ball_flips(radius)
    codes = F.when(F.bit_count("fp") % 2 == 1, F.array(*map(F.lit, every + odd))).otherwise(F.array(*map(F.lit, every)))
    v = fps.repartition(tasks, "fp").select("fp", F.explode(codes).alias("flips"))
    flips = F.col("flips")
    v = v.select(F.col("fp").bitwiseXOR(_mask(flips)).alias("key"), "flips").repartition("key")
    v = v.withColumn("fp", F.col("key").bitwiseXOR(_mask(flips)))
    close = F.when((flips < 0) | F.expr("flips % 64 = flips div 64"), F.col("fp"))
    v = v.withColumn("rep", F.min(close).over(Window.partitionBy("key"))).where("rep is not null and rep != fp")
    v = v.where(F.bit_count(F.col("rep").bitwiseXOR(F.col("fp"))) <= radius)
    return v.select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct()


SKETCH = "id long, tie long, fp long, wide long, n int, keys array<long>"


def sketch(text: str, k: int = 5, block_words: int = 16, most_keys: int = 6) -> tuple[int, int, np.ndarray]:
    """(SimHash, number, least block hashes) of the distinct word ``k``-grams of a text; all 0 or empty without words.

    Blocks end after words that hash so, of some ``block_words`` words each, so that an edit spoils its own block only.
    """
    codes = word_codes(text)
    if not len(codes):
        return 0, 0, np.zeros(0, np.int64)
    h = np.unique(grams(codes, min(k, len(codes))))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(h), _BLOCK):
        counts += np.unpackbits(h[start : start + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    two = grams(codes, 2) if len(codes) > 1 else codes
    starts = np.append(0, np.flatnonzero(two[:-1] <= np.uint64((2**64 - 1) // block_words)) + 1)
    blocks = np.unique(grams(np.add.reduceat(two, starts), 1))[:most_keys]
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]), len(h), blocks.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, tie, fp, wide, n, keys): a row's fingerprint, and the sketch of its words; tie is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, made = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(column_rows(batch.column(2))):
                fps[i] = simhash((text or "").encode("utf-8", "surrogatepass"), words_per_shingle)
                made.append(sketch(text or ""))
            wide = np.array([m[0] for m in made], np.uint64).view(np.int64)
            cells = [pa.array(fps.view(np.int64)), pa.array(wide), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], ["id", "tie", "fp", "wide", "n", "keys"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, SKETCH)


def like_edges(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, k: int = 5, most_bits: int = 22, together: int = 1000) -> DataFrame:
    """(a, b): edges between fingerprints whose texts share ``similarity`` of their distinct word ``k``-grams (Jaccard).

    Candidates have a block in common.  Of a block's holders each is held against the one whose blocks most others have
    (what edited copies are copies of), and against the one before it in an order of chance (in parts of some ``together``
    holders), so that a block that a third of the texts have costs two pairs each.  Those whose SimHash of the k-grams
    differs in over ``most_bits`` bits (some ten at a similarity of 0.8, 32 at none) or whose numbers of k-grams are too
    unlike are left out; all others are verified on their whole texts.
    """
    nodes = written(found.groupBy("fp").agg(F.min(F.struct("id", "tie", "wide", "n", "keys")).alias("r")).select("fp", "r.*"), "like-nodes")
    keyed = nodes.select("fp", "wide", "n", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "like-keys")
    held = written(keyed.join(shared, "key"), "like-held")
    liked = written(held.groupBy("fp").agg(F.sum("many").alias("liked")), "like-counts")
    held = written(held.join(liked, "fp"), "like-liked")
    first = written(held.groupBy("key").agg(F.max(F.struct("liked", "fp", "wide", "n")).alias("f")).select("key", "f.*"), "like-firsts")
    first = first.select("key", F.struct("fp", "wide", "n").alias("first"))
    held = held.join(first, "key").withColumn("chance", F.xxhash64("fp", "key")).withColumn("part", F.pmod(F.xxhash64("chance"), F.ceil(F.col("many") / together)))
    before = F.lag(F.struct("fp", "wide", "n")).over(Window.partitionBy("key", "part").orderBy("chance"))
    held = held.repartition("key", "part")  # else the window would take the join's partitioning, by the key alone
    pairs = held.withColumn("before", before).select("fp", "wide", "n", F.explode(F.array("first", "before")).alias("o"))
    near = F.bit_count(F.col("wide").bitwiseXOR(F.col("o.wide"))) <= most_bits
    pairs = pairs.where((F.col("fp") != F.col("o.fp")) & near & (F.least("n", "o.n") >= similarity * F.greatest("n", "o.n")))
    pairs = written(pairs.select(F.least("fp", "o.fp").alias("a"), F.greatest("fp", "o.fp").alias("b")).distinct(), "like-pairs")

    return verified(pairs, nodes.select(F.col("fp").alias("key"), "id", "tie"), docs, id_col, text_col, similarity, k)


def verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, k: int = 5) -> DataFrame:
    """The ``pairs`` (a, b) whose whole texts share ``similarity`` of their distinct word ``k``-grams; ``named``: (key, id, tie) of the text that a key stands for."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in ((batch.column(c).slice(s, 256) for c in (0, 1)) for s in range(0, batch.num_rows, 256)):
                codes = map(word_codes, texts.to_pylist())
                sets = [np.unique(grams(c, min(k, len(c)))).tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.binary())], ["key", "grams"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(named, "key")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    sets = asked.join(texts, ["id", "tie"]).dropDuplicates(["key"]).select("key", "text").mapInArrow(shingles, "key long, grams binary")
    sets = written(sets, "like-grams")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(column_rows(batch.column(2), 64), column_rows(batch.column(3), 64)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(same >= similarity * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "ga", "gb").mapInArrow(verify, "a long, b long")


def parities(h: np.ndarray) -> bytes:
    """Parity bits of a set of hashes, by their lower bits: as many bits as hashes or up to twice as many, a power of two, 64 at least.

    Bits that differ between two sets, the longer map folded to the length of the other, are no more than the hashes that
    only one of them has.
    """
    size = max(64, 1 << (len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Of how many elements two sets differ at least, from their ``parities``."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def near_enough(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) without those that are less alike than ``similarity`` by their ``bits`` (tie, n, bits) already; none is lost.

    Sets of n and m elements of that similarity differ in (n + m) * (1 - similarity) / (1 + similarity) at most.  A map
    has an eighth of a byte or a quarter for a gram, which has eight bytes, so that few texts meet with all their grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            least = np.array([apart(x, y) for x, y in zip(column_rows(batch.column(4)), column_rows(batch.column(5)))], np.int64)
            told = least * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(told, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(bits.select(F.col("tie").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def prefixes(docs: DataFrame, similarity: float, k: int, common=None) -> DataFrame:
    """(tie, n, tokens, bits): of each row's distinct ``k``-grams their number, the first n - ceil(similarity * n) + 1 in one order of all k-grams, and the ``parities`` of all.

    Two sets of that similarity have one of these in common, whatever the order (prefix filter).  ``common``: a broadcast
    pair of arrays, sorted hashes and counts, of grams that come last, the most frequent at the end; without it all
    grams are given, and no parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ties, texts in ((batch.column(c).slice(s, 256) for c in (0, 1)) for s in range(0, batch.num_rows, 256)):
                sizes, tokens, bits = [], [], []
                for text in texts.to_pylist():
                    codes = word_codes(text or "")
                    h = np.unique(grams(codes, min(k, len(codes)))) if len(codes) else codes
                    sizes.append(len(h))
                    bits.append(None if common is None else parities(h))
                    if common is not None:
                        hashes, counts = common.value
                        if len(hashes):
                            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                            h = h[np.lexsort((h, np.where(hashes[at] == h, counts[at], 0)))]
                        h = h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
                    tokens.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([ties, pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["tie", "n", "tokens", "bits"])

    return docs.select("tie", "text").mapInArrow(run, "tie long, n int, tokens array<long>, bits binary")


def rest_edges(found: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, k: int = 5, one_doc_in: int = 4, least: int = 2, most: int = 100_000) -> DataFrame:
    """(a, b): edges between fingerprints for all pairs of texts of ``similarity`` that ``roots`` (fp, root) hasn't in one component yet.

    Exact: every two such texts share a k-gram of their prefixes, and all pairs of different components that share one
    and have sizes and ``parities`` near enough are verified on their whole texts.  Grams that are frequent in one of
    ``one_doc_in`` documents come last in the order, which only saves candidates.  Copies and near copies that are linked already are
    one component, so what is left to pair is what ``like_edges`` missed and what is merely similar.
    """
    rows = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("tie"), F.col(text_col).cast("string").alias("text"))
    some = prefixes(rows.where(F.pmod(F.xxhash64("tie"), F.lit(one_doc_in)) == 0), similarity, k).dropDuplicates(["tie"])
    counts = some.select(F.explode("tokens").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    with tidy(docs.sparkSession):
        often = counts.orderBy(F.desc("count"), "h").limit(most).collect()
    often = sorted((np.int64(r.h).view(np.uint64), r["count"]) for r in often)
    common = docs.sparkSession.sparkContext.broadcast((np.array([h for h, _ in often], np.uint64), np.array([n for _, n in often], np.int64)))
    texts = found.groupBy("tie").agg(F.min(F.struct("id", "fp")).alias("r")).select("tie", "r.*")
    texts = written(texts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rest-texts")
    held = prefixes(rows, similarity, k, common).dropDuplicates(["tie"]).where("n > 0").join(texts, "tie")
    grammed = written(held.select("tie", "root", "n", "tokens", "bits"), "rest-prefixes")
    held = grammed.select("tie", "root", "n", F.explode("tokens").alias("token"))
    shared = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    held = written(held.join(written(shared, "rest-tokens"), "token"), "rest-held")
    of = held.groupBy("token", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = (of.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "lo", "hi")]) for side in "xy")
    meet = x.join(y, "token").where((F.col("root_x") < F.col("root_y")) & (F.col("hi_x") >= similarity * F.col("lo_y")) & (F.col("hi_y") >= similarity * F.col("lo_x")))
    meet = written(meet.select("token", "root_x", "root_y"), "rest-meet")
    for side in "xy":
        meet = meet.join(held.select("token", F.col("root").alias(f"root_{side}"), F.col("tie").alias(f"tie_{side}"), F.col("n").alias(f"n_{side}")), ["token", f"root_{side}"])
    meet = meet.where(F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y"))
    pairs = written(meet.select(F.col("tie_x").alias("a"), F.col("tie_y").alias("b")).distinct(), "rest-pairs")
    pairs = written(near_enough(pairs, grammed, similarity), "rest-near")
    alike = verified(pairs, texts.select(F.col("tie").alias("key"), "id", "tie"), docs, id_col, text_col, similarity, k)
    for side in "ab":
        alike = alike.join(texts.select(F.col("tie").alias(side), F.col("fp").alias(f"fp_{side}")), side)
    return alike.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, words_per_shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id reachable over links of <= radius bits.

    With a ``similarity``, texts that share so much of their word 5-grams are linked too, whatever their fingerprints,
    and a column tie has the text's hash; rows without an id then take no part in these links.  Equal fingerprints are
    one node, so a third of all rows being copies costs no more than one of them.  Repeated rows give repeated results;
    null texts have fingerprint 0; a component whose ids are all null has the component null; an empty table gives no
    rows.  Other columns are not read.
    """
    found = fingerprints(docs, id_col, text_col, words_per_shingle) if similarity is None else sketches(docs, id_col, text_col, words_per_shingle)
    found = written(found, "simhash")
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    edges = near_edges(nodes.select("fp"), radius)
    if similarity is not None:
        edges = written(edges, "near-edges").unionByName(like_edges(found, docs, id_col, text_col, similarity))
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    if similarity is not None:
        roots = written(roots, "near-roots")
        rest = rest_edges(found, roots, docs, id_col, text_col, similarity)
        roots = connected_components(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(rest)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    groups = written(rooted.groupBy("root").agg(F.min("least").alias("component")), "simhash-groups")
    named = written(rooted.join(groups, "root").select("fp", "component"), "simhash-named")
    return found.join(named, "fp").select("id", *([] if similarity is None else ["tie"]), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their near-duplicate group; repeated rows of that id and text stay once.

    Groups are made of links within ``radius`` bits and of those of ``similarity`` in word 5-grams.  Of several texts of
    the least id in a group the one with the least hash stays.  Rows without an id can't stand for a group: they take no
    part and stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    found = near_duplicates(named, id_col, text_col, radius, similarity=similarity).where(F.col("id") == F.col("component"))
    found = found.groupBy("component").agg(F.min("tie").alias("_tie")).select(F.col("component").alias(id_col), "_tie")
    named = named.withColumn("_tie", F.xxhash64(F.col(text_col).cast("string")))
    kept = named.join(found.distinct(), [id_col, "_tie"], "left_semi").dropDuplicates([id_col, "_tie"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op4_simhash(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` within three bits: a row per row, null and empty texts with fingerprint zero."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
