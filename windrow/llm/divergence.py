"""Audit of how far the sources of a language differ in their words.

1. Terms: texts are written by language, and split into terms by whoever reads them: that costs less than to write and read the terms.
2. Vectors: a CountVectorizer for each language, with a least document frequency and no limit on its vocabulary, turns
   documents into exact sparse count vectors.  Only sums of vectors are asked for, so a source's texts are folded first,
   a few MB at a time, into a document for each binary digit of their counts, which has each term once (``folded``).  A fit
   holds its vocabulary on the driver and hands it to all tasks, so its size is checked first, from one term in 256: a
   larger one is split by hashed terms into blocks, each with a fit of its own.
3. Group sums: vectors, times their weights, are added up by (language, source), entry by entry, in each task before they
   are shuffled.
4. Pairs: a divergence between two groups is a sum over all terms; with f00 the part of a term that neither has,

       value(s, t) = V * f00 + sum over s's terms of (f(s, 0) - f00) + sum over t's terms of (f(0, t) - f00)
                   + sum over common terms of (f(s, t) - f(s, 0) - f(0, t) + f00)

   The first sums follow from the numbers of terms of each count; only the last needs pairs, and there a term's groups meet
   in small matrices which tasks add up, so no row is made for a pair and a term.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.common import as_bytes, column_rows, written
from windrow.shared import discard, scratch

#: Letters in lower case, other characters of ASCII as blanks, all else as it is.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalpha() else 0x20 if c < 0x80 else c for c in range(256))
#: Stands in some documents of each fit, so that no vocabulary is empty; no term holds it.
_SENTINEL = "\x00"


def terms_of(texts: list[bytes]) -> pa.ListArray:
    """list<string> of the runs of letters and of characters beyond ASCII of each text, lower-cased in A-Z."""
    b = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = b != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(b[inside[1:-1]]))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, firsts).astype(np.int32)), words)


def _split(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array, pa.ListArray]]:
    """lang, source and terms of rows (lang, source, text), some ``size`` bytes of text at a time."""
    for batch in batches:
        held, n, begin = [], 0, 0
        for i, text in enumerate(column_rows(as_bytes(batch.column(2)))):
            held.append(text)
            n += len(text)
            if n >= size or i + 1 == batch.num_rows:
                lang, source = (batch.column(c).slice(begin, len(held)) for c in (0, 1))
                yield lang, source, terms_of(held)
                held, n, begin = [], 0, i + 1


def tokenised(docs: DataFrame, one_in: int = 0, size: int = 1 << 22) -> DataFrame:
    """(lang, source, terms) of each row of (lang, source, text), some ``size`` bytes of text at a time.

    With ``one_in`` (lang, term) instead: every occurrence of one term in so many, by its hash.
    """

    def some(lang: pa.Array, terms: pa.ListArray) -> pa.RecordBatch:
        words = terms.values.dictionary_encode()
        told = np.array([zlib.crc32(w.encode()) % one_in == 0 for w in words.dictionary.to_pylist()], bool)
        at = np.flatnonzero(told[words.indices.to_numpy()])
        row = np.searchsorted(terms.offsets.to_numpy(), at, "right") - 1
        return pa.RecordBatch.from_arrays([lang.take(pa.array(row)), terms.values.take(pa.array(at))], ["lang", "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, source, terms in _split(batches, size):
            yield some(lang, terms) if one_in else pa.RecordBatch.from_arrays([lang, source, terms], ["lang", "source", "terms"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string" if one_in else "lang string, source string, terms array<string>")


def folded(docs: DataFrame, min_df: int = 0, size: int = 1 << 22) -> DataFrame:
    """(source, weight, terms): documents of different terms that stand for all rows of (lang, source, text), one language's, some ``size`` bytes of text at a time.

    A source's document for binary digit d of its counts has the terms whose count has that digit, and weighs 2**d: its
    documents' vectors, times their weights, add up to those of its texts.  With ``min_df`` instead, for a fit: document j
    of the first ``min_df`` has the terms that more than j texts have, so that as many texts as documents have a term, or
    at least ``min_df`` both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, source, terms in _split(batches, size):
            words, names = terms.values.dictionary_encode(), source.dictionary_encode()
            many, row = len(words.dictionary), np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
            made: list[tuple[str, int, np.ndarray]] = []
            if min_df:
                n = np.bincount(np.unique(row * many + words.indices.to_numpy()) % max(1, many), minlength=many)
                made += [("", 1, np.flatnonzero(n > j)) for j in range(min(min_df, int(n.max(initial=0))))]
            else:
                key = names.indices.to_numpy()[row].astype(np.int64) * many + words.indices.to_numpy()
                if many * len(names.dictionary) <= 4 * len(key):  # counting costs less than sorting
                    n = np.bincount(key)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(len(names.dictionary) + 1) * many)
                for name, first, lo, hi in zip(names.dictionary.to_pylist(), range(0, many * len(names.dictionary), many or 1), ends[:-1], ends[1:]):
                    digits = range(int(n[lo:hi].max(initial=0)).bit_length())
                    made += [(name, 1 << d, key[lo:hi][n[lo:hi] >> d & 1 == 1] - first) for d in digits]
            for name, weight, at in made:
                found = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), words.dictionary.take(pa.array(at)))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weight]), found], ["source", "weight", "terms"])

    return docs.select("lang", "source", "text").mapInArrow(run, "source string, weight long, terms array<string>")


def _folder(lang: str) -> str:
    """A name of one length, as those of folders know neither case nor emptiness nor any length."""
    return hashlib.sha1(lang.encode()).hexdigest()


def _vocabulary_sizes(texts: DataFrame, min_df: int, one_in: int = 256) -> dict[str, tuple[int, int]]:
    """lang -> (documents, about how many terms it keeps, rather too many), for languages of ``min_df`` documents or more; a row a language."""
    rows = texts.groupBy("lang").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_df)
    kept = tokenised(texts, one_in).groupBy("lang", "term").count().where(F.col("count") >= min_df).groupBy("lang").agg((F.count("*") * one_in).alias("terms"))
    return {r.lang: (r.docs, r.terms or 0) for r in rows.join(kept, "lang", "left").collect()}


def _in_blocks(tokens: DataFrame, blocks: int) -> DataFrame:
    """(source, weight, block, terms): each document's terms dealt out by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, weight, words in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                of: dict[int, list[str]] = {}
                for w in words:
                    of.setdefault(zlib.crc32(w.encode()) % blocks, []).append(w)
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(of), pa.string()), pa.array([weight] * len(of), pa.int64()), pa.array(list(of), pa.int32()), pa.array(list(of.values()), pa.list_(pa.string()))], ["source", "weight", "block", "terms"])

    return tokens.select("source", "weight", "terms").mapInArrow(run, "source string, weight long, block int, terms array<string>")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different indices, sorted, and the sums of their numbers."""
    index, n = (np.concatenate(x) for x in zip(*parts))
    at, of = np.unique(index, return_inverse=True)
    return at, np.bincount(of, n, len(at)).astype(np.int64)  # exact: sums of whole numbers far below 2**53


def _added_up(vectors: DataFrame, most: int = 4_000_000, wide: int = 1 << 11) -> DataFrame:
    """(source, index, n): the vectors of each source, times their column weight if there is one, added up, entries that aren't zero only; ``most`` entries at once in a task, before they meet.

    Sums are shuffled as arrays, a row for a source and ``wide`` indices, and meet there in numpy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for source, parts in held.items():
                at, sums = _summed(parts)
                firsts = np.flatnonzero(np.diff(at // wide, prepend=-1))
                ends = pa.array(np.append(firsts, len(at)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(at, pa.int32()), pa.array(sums))]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(firsts), pa.string()), pa.array(at[firsts] // wide, pa.int32()), *lists], ["source", "part", "index", "n"])
            held.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            index, n = (batch.column(1).field(c) for c in ("indices", "values"))
            ends, index, n = index.offsets.to_numpy(), index.values.to_numpy(), n.values.to_numpy()
            for source, weight, lo, hi in zip(names, batch.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held.setdefault(source, []).append((index[lo:hi], n[lo:hi] * weight))
            many += int(ends[-1] - ends[0])
            if many > most:
                yield from flush()
                many = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        many = kept = 0
        for batch in batches:
            index, n = batch.column(2), batch.column(3)
            ends, index, n = index.offsets.to_numpy(), index.values.to_numpy(), n.values.to_numpy()
            for source, part, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                held.setdefault((source, part), []).append((index[lo:hi], n[lo:hi]))
            many += int(ends[-1] - ends[0])
            if many > most + kept:
                held = {key: [_summed(parts)] for key, parts in held.items()}
                many, kept = 0, sum(len(parts[0][0]) for parts in held.values())
        for (source, _), parts in held.items():
            at, sums = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums)], ["source", "index", "n"])

    weight = F.col("weight") if "weight" in vectors.columns else F.lit(1)
    found = vectors.select("source", "features", weight.alias("weight")).mapInArrow(run, "source string, part int, index array<int>, n array<long>")
    return found.repartition("source", "part").mapInArrow(meet, "source string, index int, n long")


def group_sums(texts: DataFrame, min_df: int, most_terms: int = 1_000_000) -> tuple[DataFrame | None, DataFrame | None]:
    """(sums, vocabulary) of a written table (lang, source, text, folder), which has a folder a language: (lang, block, index, source, n) and (lang, block, index, term).

    A language's terms in ``min_df`` or more of its documents are kept, all of them, and the vectors of its ``folded``
    documents added up by (lang, source), entries that aren't zero only.  A vocabulary of over ``most_terms`` has several blocks.  None and None
    where no language has ``min_df`` documents.
    """
    spark = texts.sparkSession
    paths, vocabularies = [], []
    for lang, (_, size) in sorted(_vocabulary_sizes(texts, min_df).items()):
        own = texts.where((F.col("folder") == _folder(lang)) & (F.col("lang") == lang))
        own = [folded(own, min_df), folded(own)]
        blocks = max(1, -(-size // most_terms))
        if blocks > 1:
            own = [written(_in_blocks(x, blocks), "blocks") for x in own]
        for block in range(blocks):
            to_fit, docs = (x.where(F.col("block") == block) if blocks > 1 else x for x in own)
            some = spark.range(0, min_df, 1, 1).select(F.array(F.lit(_SENTINEL)).alias("terms"))
            model = CountVectorizer(inputCol="terms", outputCol="features", minDF=float(min_df), vocabSize=2**31 - 1).fit(to_fit.select("terms").unionByName(some))
            sums = _added_up(model.transform(docs.select("source", "weight", "terms"))).select(F.lit(lang).alias("lang"), F.lit(block).alias("block"), "index", "source", "n")
            paths.append(written(sums, "sums").written_to)
            model.write().save(path := scratch(spark, "vocabulary"))
            words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "term")).where(F.col("term") != _SENTINEL)
            vocabularies.append(words.select(F.lit(lang).alias("lang"), F.lit(block).alias("block"), "index", "term"))
        if blocks > 1:
            discard(*own)
    if not paths:
        return None, None
    return spark.read.schema("lang string, block int, index int, source string, n long").parquet(*paths), written(reduce(DataFrame.unionByName, vocabularies), "vocabulary")


def _share(n: str) -> Column:
    """p of a count, in parts of a thousand million; ``total`` is the group's count of all kept terms, ``kept`` their number."""
    return F.expr(f"1L + (cast({n} as decimal(20, 0)) + 2) * cast(1000000000 as decimal(10, 0)) div (cast(total as decimal(20, 0)) + 2 * cast(kept as decimal(20, 0)))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _meeting(cells: DataFrame, block: int = 256, most: int = 64) -> DataFrame:
    """(lang, a, b, value) for numbers a < b of groups: over their common terms, f(s, t) - f(s, 0) - f(0, t) + f00.

    ``cells``: (lang, term id columns, g, p, p0).  A term's groups stand in one row, as many as the language has sources at
    most; they are cut into ranges of ``block`` numbers, and a task holds ``most`` matrices of two ranges.
    """
    rows = cells.groupBy("lang", "block", "index").agg(F.sort_array(F.collect_list(F.struct("g", "p", "p0"))).alias("cells")).where(F.size("cells") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), m in held.items():
                a, b = np.nonzero(m)
                cells = [pa.array([lang] * len(a), pa.string()), pa.array(a + i * block), pa.array(b + j * block), pa.array(m[a, b])]
                yield pa.RecordBatch.from_arrays(cells, ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            flat = batch.column(1).flatten()
            g, p, zero = (flat.field(k).to_numpy() for k in range(3))
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            for lang, lo, hi in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                parts = np.split(np.arange(lo, hi), np.flatnonzero(np.diff(g[lo:hi] // block)) + 1)
                for x, left in enumerate(parts):
                    for right in parts[x:]:
                        ps, zs, pt, zt = p[left][:, None], zero[left][:, None], p[right][None], zero[right][None]
                        value = _floor(ps, pt) - _floor(ps, zt) - _floor(zs, pt) + _floor(zs, zt)
                        key = (lang, int(g[left[0]]) // block, int(g[right[0]]) // block)
                        if key not in held:
                            if len(held) >= most:
                                yield from flush()
                            held[key] = np.zeros((block, block), np.int64)
                        held[key][np.ix_(g[left] % block, g[right] % block)] += value
        yield from flush()

    found = rows.select("lang", "cells").mapInArrow(run, "lang string, a long, b long, value long")
    return found.where("a < b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergence(docs: DataFrame, min_df: int = 10, first: int = 10, most_terms: int = 1_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group (lang, source) differs from the others of its language.

    Part ``pair``: every other source of the language, with the divergence of the two, ranked from the most unlike.  Part
    ``term``: the ``first`` terms that the group has more of than its language has.  With count the occurrences of a term
    that ``min_df`` or more documents of the language have, N their sum and V the number of such terms, a share is
    1 + floor(10^9 * (count + 2) / (N + 2 * V)), and a term adds floor((p - q)^2 / (p + q)).

    Null texts, languages and sources count as empty; a group without terms has its pairs, a language without kept terms
    values of 0; repeated rows count each; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    path = scratch(spark, "texts")
    rows = docs.select(*plain, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows.withColumn("folder", F.sha1("lang")).write.partitionBy("folder").parquet(path)
    everything = spark.read.schema("lang string, source string, text string, folder string").parquet(path)
    groups = everything.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.select("lang", "source", numbered.cast("long").alias("g")), "groups")  # a row a group
    sums, vocabulary = group_sums(everything, min_df, most_terms)
    if sums is None:
        sums = spark.createDataFrame([], "lang string, block int, index int, source string, n long")
        vocabulary = spark.createDataFrame([], "lang string, block int, index int, term string")
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"])
    groups = written(groups.withColumn("p0", F.when(F.col("kept") > 0, _share("0"))), "totals")

    cells = written(sums.join(groups, ["lang", "source"]).withColumn("p", _share("n")), "cells")
    other = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", F.col("g").alias("a"), "source", "p0", "kept").join(other, "lang").where("a != b")
    # what a group's own terms add, by the number of terms of each share
    numbers = cells.groupBy("lang", F.col("g").alias("a"), "p").agg(F.count("*").alias("n"), F.first("p0").alias("p0"))
    alone = numbers.join(other.drop("item"), "lang").where("a != b")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (_f("p", "q0") - _f("p0", "q0"))).alias("alone"))
    alone = written(alone, "alone")  # it and the next have a row a pair, and are read twice
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("against"))
    meeting = written(_meeting(cells.select("lang", "block", "index", "g", "p", "p0")), "meeting")
    both = meeting.unionByName(meeting.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "value")).withColumnRenamed("value", "both")
    pairs = pairs.join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * _f("p0", "q0"), F.lit(0))
    for c in ("alone", "against", "both"):
        value = value + F.coalesce(F.col(c), F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(order))

    of_lang = sums.groupBy("lang", "block", "index").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    of_lang = of_lang.join(langs, "lang").select("lang", "block", "index", _share("n").alias("q"))
    more = cells.select("lang", "source", "block", "index", "p").join(of_lang, ["lang", "block", "index"]).where("p > q").withColumn("value", _f("p", "q"))
    near = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    more = more.withColumn("near", near).where(F.col("near") <= first).join(vocabulary, ["lang", "block", "index"])  # ties too, until the terms tell
    found = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return pairs.unionByName(found)


def op13_divergence(docs: DataFrame) -> DataFrame:
    """``divergence`` of all documents, with the parameters of the contract."""
    return divergence(docs)


#: The same over every term of every pair.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, CAST(count(term) AS BIGINT) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), s AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n, sum(coalesce(c, 0)) OVER (PARTITION BY lang, term) AS lc, v
  FROM (SELECT DISTINCT lang, source FROM d) JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (n + 2 * v) AS p, 1 + 1000000000::HUGEINT * (lc + 2) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM s
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""
