"""Phrase collocations of each language by best-first branch and bound over prefixes.

A phrase grows from its prefix word by word.  With a the count of a phrase P and f1 that of its first word, no phrase that
begins with P scores more than B(P) = floor(scale * a / (f1 + a)): it occurs at most a times, and cut after the first word
its rest occurs as often as itself at least.  So prefix counts give admissible bounds:

1. Words are counted, then the pairs of words that are themselves frequent: a word's bound is the greatest score, so none
   may be left out.
2. Of each language the prefixes of the best bounds, some ``frontier`` of them, are expanded: triples, then quadruples,
   are counted that begin with a prefix whose bound reaches the language's theta, the least bound expanded; and those that
   add a word before a phrase that scores theta or more, as such a phrase may be dropped for a longer one.
3. All phrases that score theta or more are then known with their drops.  A language is settled if ``top`` of them survive
   or nothing is left to expand; for the others the frontier grows fourfold.

Tasks know words and phrases by 64-bit codes, and sets of phrases by Bloom filters of a fixed size: what passes falsely is
counted too and falls out in the joins, which are exact.  Codes of frequent words are checked against all words; were
two to share one, another seed is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.common import as_bytes, column_rows, written
from windrow.llm.substring import powers

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 26
_KEYS = ["h1", "h2", "h3", "h4"]


@cache
def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


def blocks(texts: pa.Array, langs: list, size: int = 1 << 20) -> Iterator[tuple[list[bytes], list]]:
    """Texts and their languages, some ``size`` bytes at a time; a longer text is cut between pieces."""
    held, of, n = [], [], 0
    for text, lang in zip(column_rows(as_bytes(texts)), langs, strict=True):
        at = 0
        while True:
            end = len(text)
            if end - at > size:
                m = _BREAK.search(text, at + size)
                end = m.end() if m else end
            held.append(text[at:end])
            of.append(lang)
            n += end - at
            at = end
            if n >= size:
                yield held, of
                held, of, n = [], [], 0
            if at >= len(text):
                break
    if held:
        yield held, of


def encode(texts: list[bytes], langs: np.ndarray, seed: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded text, starts, ends, text number, code of every word, whether the next word stands in the same piece)."""
    text = b"\n".join(texts).translate(_FOLD)
    b = np.frombuffer(text, np.uint8)
    kind = _KIND[b]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(max(12, len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_values(seed)[b] * power[: len(b)], out=sums[1:])
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    of = np.searchsorted(first, starts, "right") - 1
    h = (sums[ends] - sums[starts]) * inverse[starts] ^ langs[of]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    return text, starts, ends, of, h, piece[1:] == piece[:-1]


def _alike(text: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> bool:
    """Whether every word is byte for byte the one at its number in ``first``."""
    sizes = ends - starts
    if (sizes != sizes[first]).any():
        return False
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_KIND[b] == 0)
    return bool((b[at] == b[at + np.repeat(starts[first] - starts, sizes)]).all())


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each phrase, given its first words' codes, its second ones', ..."""
    k = np.zeros(len(columns[0]), np.uint64)
    for h in columns:
        k = (k ^ h) * _MIX
        k ^= k >> np.uint64(29)
    return k


def _spots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - _FILTER_BITS), keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _FILTER_BITS)


class Filter:
    """A Bloom filter of phrases: 2**26 bits, whatever it holds."""

    def __init__(self, phrases: DataFrame, keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(_spots(chained([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])))
                slots, where = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(slots), np.uint64)
                np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

        found = phrases.select(*keys).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**20 rows at most
        self.words = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
        self.words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in _spots(keys):
            out &= self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0
        return out


def word_counts(docs: DataFrame, seed: int, together: int = 300_000) -> DataFrame:
    """(lang, word, h, f) of every word; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list) -> pa.RecordBatch:
            h, n, words, langs = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [w for x in held for w in x[2]], np.concatenate([x[3] for x in held])
            _, at, where = np.unique(h, return_index=True, return_inverse=True)
            n_all, first = np.bincount(where, n, len(at)).astype(np.int64), at[where].tolist()
            if any(words[i] != w for i, w in zip(first, words, strict=True)) or (langs != langs[at[where]]).any():
                at, n_all = np.arange(len(h)), n  # two words share a code: each stays for itself, so that it shows
            cells = [pa.array(langs[at], pa.string()), pa.array([words[i] for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(h[at].view(np.int64)), pa.array(n_all)]
            return pa.RecordBatch.from_arrays(cells, ["lang", "word", "h", "n"])

        held, many = [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts, of in blocks(batch.column(2), list(zip(names, batch.column(1).to_pylist(), strict=True))):
                text, starts, ends, doc, h, _ = encode(texts, np.array([x[1] for x in of], np.int64).view(np.uint64), seed)
                number = {}
                own = np.array([number.setdefault(x[0], len(number)) for x in of])
                codes, (h, at, where, n) = h, np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if not _alike(text, starts, ends, at[where]) or (own[doc] != own[doc[at[where]]]).any():
                    h, at, n = codes, np.arange(len(codes)), np.ones(len(codes), np.int64)
                held.append((h, n, [text[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], np.array([x[0] for x in of], object)[doc[at]]))
                many += len(h)
                if many > together:
                    yield merged(held)
                    held, many = [], 0
        if held:
            yield merged(held)

    return docs.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("f"))


def pair_counts(docs: DataFrame, seed: int, frequent: Filter) -> DataFrame:
    """(h1, h2, f) of the pairs of words that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, of in blocks(batch.column(2), batch.column(1).to_pylist()):
                *_, h, joined = encode(texts, np.array(of, np.int64).view(np.uint64), seed)
                known = shared.value.has(chained([h]))
                i = np.flatnonzero(joined & known[:-1] & known[1:])
                yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(h[i + 1].view(np.int64))], ["h1", "h2"])

    return docs.mapInArrow(run, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("f"))


def _grams(docs: DataFrame, seed: int, filters: dict[str, Filter], chosen) -> DataFrame:
    """(h1, h2, h3, h4, f) of the phrases that ``chosen`` picks; h4 is null for triples.

    ``chosen`` gets the filters, the codes of words, and of each word whether a frequent pair begins there; it tells where
    triples and where quadruples to count begin.  What it tells must depend on the phrase alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, of in blocks(batch.column(2), batch.column(1).to_pylist()):
                *_, h, joined = encode(texts, np.array(of, np.int64).view(np.uint64), seed)
                if len(h) < 3:
                    continue
                pairs = joined & shared.value["pairs"].has(chained([h[:-1], h[1:]]))
                three, four = chosen(shared.value, h, joined, pairs)
                codes = h.view(np.int64)
                cells = [pa.array(np.concatenate([codes[three + k], codes[four + k]])) for k in range(3)]
                cells.append(pa.array(np.concatenate([np.zeros(len(three), np.int64), codes[four + 3]]), mask=np.arange(len(three) + len(four)) < len(three)))
                yield pa.RecordBatch.from_arrays(cells, _KEYS)

    return docs.mapInArrow(run, "h1 long, h2 long, h3 long, h4 long").groupBy(*_KEYS).agg(F.count("*").alias("f"))


def _triples(filters, h, joined, pairs):
    both = np.flatnonzero(pairs[:-1] & pairs[1:])
    key = lambda i: chained([h[i], h[i + 1]])
    return both[filters["grown"].has(key(both)) | filters["scored"].has(key(both + 1))], np.zeros(0, np.int64)


def _quadruples(filters, h, joined, pairs):
    """Quadruples of a grown triple, or that end in a scored one; and triples that are the rest of such a quadruple."""
    both = np.flatnonzero(pairs[:-1] & pairs[1:])
    rest = both[filters["rests"].has(chained([h[both], h[both + 1]]))]
    i = np.flatnonzero(pairs[:-2] & joined[1:-1] & pairs[2:]) if len(h) > 3 else np.zeros(0, np.int64)
    key = lambda i: chained([h[i], h[i + 1], h[i + 2]])
    return rest, i[filters["grown"].has(key(i)) | filters["scored"].has(key(i + 1))]


def _ratio(scale: int, a: str, rest: str) -> Column:
    """floor(scale * a / rest), exactly: the product may pass 64 bits."""
    return F.expr(f"(cast({a} as decimal(20, 0)) * cast({scale} as decimal(10, 0))) div cast({rest} as decimal(20, 0))")


def _least_cut(*cuts: tuple[int, str, str], scale: int) -> Column:
    """struct(score, cut, l, r) of the lowest-scoring cut, ties to the smallest."""
    found = [F.struct(_ratio(scale, "a", f"{left} + {right}").alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r")) for k, left, right in cuts]
    return F.least(*found) if len(found) > 1 else found[0]


def _thetas(bounds: DataFrame, frontier: int, scale: int) -> DataFrame:
    """(lang, theta): the greatest multiple of a thousandth of the top bound that some ``frontier`` bounds reach, 0 if fewer do."""
    step = max(1, scale // 2000)
    bins = bounds.groupBy("lang", F.expr(f"bound div {step}").alias("bin")).agg(F.count("*").alias("n"))  # some 1,000 rows a language
    reached = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bin")))
    found = bins.withColumn("reached", reached).groupBy("lang").agg(F.max(F.when(F.col("reached") >= frontier, F.col("bin"))).alias("bin"))
    return found.select("lang", F.coalesce(F.col("bin") * step, F.lit(0)).alias("theta"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, absorbed: int = 80, scale: int = 2_000_000, frontier: int = 16_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of two to four words.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and tabs.  A
    phrase counts from ``least`` occurrences on; its score is that of its lowest-scoring cut; it is dropped if a longer one
    of ``absorbed`` per cent of its count or more holds it.  Null texts count as empty, null languages as ``und``;
    repeated rows count each; an empty table gives no rows; columns but lang and text aren't read.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for seed in range(8):
        words = written(word_counts(rows, seed), "words")
        if not words.groupBy("h").agg(F.count("*").alias("many"), F.max("f").alias("f")).where(f"many > 1 and f >= {least}").take(1):
            break
    else:
        raise ValueError("words share codes whatever the seed")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(words.where(F.col("f") >= least), "frequent-words")
    counts = pair_counts(rows, seed, Filter(words, ["h"])).where(F.col("f") >= least)
    first, second = (words.select(F.col("h").alias(f"h{k}"), F.col("f").alias(f"f{k}"), *["lang"] * (k == 1)) for k in (1, 2))
    pairs = counts.withColumnRenamed("f", "a").join(first, "h1").join(second, "h2")
    pairs = pairs.select("lang", "h1", "h2", "a", "f1", "f2", _ratio(scale, "a", "f1 + a").alias("bound"), _least_cut((1, "f1", "f2"), scale=scale).alias("best"))
    pairs = written(pairs, "pairs")
    known = Filter(pairs, ["h1", "h2"])
    while True:
        thetas = written(_thetas(pairs, frontier, scale), "thetas")  # a row a language
        own = lambda df: df.join(thetas, "lang")
        grown, scored = own(pairs).where("bound >= theta"), own(pairs).where("best.score >= theta")
        filters = {"pairs": known, "grown": Filter(grown, ["h1", "h2"]), "scored": Filter(scored, ["h1", "h2"])}
        counts = _grams(rows, seed, filters, _triples).where(F.col("f") >= least).drop("h4").withColumnRenamed("f", "a")
        ends = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
        triples = counts.join(pairs.select("lang", "h1", "h2", F.col("a").alias("f12"), "f1"), ["h1", "h2"]).join(ends, ["h2", "h3"])
        cuts = _least_cut((1, "f1", "f23"), (2, "f12", "f3"), scale=scale)
        triples = written(triples.select("lang", "h1", "h2", "h3", "a", "f1", "f12", _ratio(scale, "a", "f1 + a").alias("bound"), cuts.alias("best")), "triples")
        long_grown, long_scored = own(triples).where("bound >= theta"), own(triples).where("best.score >= theta")
        filters = {"pairs": known, "grown": Filter(long_grown, ["h1", "h2", "h3"]), "scored": Filter(long_scored, ["h1", "h2", "h3"]), "rests": Filter(long_grown.select("h2", "h3").distinct(), ["h2", "h3"])}
        counts = written(_grams(rows, seed, filters, _quadruples).where(F.col("f") >= least), "quadruples")
        four, three = counts.where("h4 is not null"), counts.where("h4 is null")
        rests = three.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("h3").alias("h4"), F.col("f").alias("f234"))
        ends = pairs.select(F.col("h1").alias("h3"), F.col("h2").alias("h4"), F.col("a").alias("f34"), F.col("f2").alias("f4"))
        begins = long_grown.select("lang", "theta", "h1", "h2", "h3", F.col("a").alias("f123"), "f1", "f12")
        quads = four.withColumnRenamed("f", "a").join(begins, ["h1", "h2", "h3"]).join(rests, ["h2", "h3", "h4"]).join(ends, ["h3", "h4"])
        quads = quads.withColumn("best", _least_cut((1, "f1", "f234"), (2, "f12", "f34"), (3, "f123", "f4"), scale=scale)).where("best.score >= theta")
        over2 = _holders(triples.withColumnRenamed("a", "f"), 2)
        over3 = _holders(four, 3)
        kept = [
            _surviving(scored, over2, 2, absorbed).withColumns({"h3": F.lit(None).cast("long"), "h4": F.lit(None).cast("long")}),
            _surviving(long_scored, over3, 3, absorbed).withColumn("h4", F.lit(None).cast("long")),
            quads,
        ]
        found = written(reduce(DataFrame.unionByName, [k.select("lang", *_KEYS, "a", "best.l", "best.r", "best.score") for k in kept]), "survivors")
        many = found.groupBy("lang").agg(F.count("*").alias("many"))
        open_ = thetas.where("theta > 0").join(many, "lang", "left").where(F.coalesce("many", F.lit(0)) < top)
        if not open_.take(1):
            break
        frontier *= 4
    for k in _KEYS:
        found = found.join(words.select(F.col("h").alias(k), F.col("word").alias(f"w{k[1]}")), k, "left")
    least_score = _thetas(found.withColumn("bound", F.col("score")), top, scale)  # so that few more than ``top`` rows are ranked
    found = found.join(least_score, "lang").where("score >= theta").drop("theta")
    phrases = found.join(totals, "lang").select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return phrases.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _holders(longer: DataFrame, k: int) -> DataFrame:
    """(h1, ..., hk, over): the greatest count of a phrase that has one word more, before or after."""
    keys = _KEYS[:k]
    sides = [longer.select(*keys, "f"), longer.select(*[F.col(f"h{i + 2}").alias(f"h{i + 1}") for i in range(k)], "f")]
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("f").alias("over"))


def _surviving(phrases: DataFrame, over: DataFrame, k: int, absorbed: int) -> DataFrame:
    """Those that no phrase of one more word takes in; a longer one that does so holds one that does."""
    held = phrases.join(over, _KEYS[:k], "left")
    share = F.expr(f"cast(over as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {absorbed}")
    return held.where(~F.coalesce(share, F.lit(False))).drop("over")


def op11_phrases(docs: DataFrame) -> DataFrame:
    """``collocations`` of all documents, with the parameters of the contract."""
    return collocations(docs)


#: The same by counting every phrase.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), q AS (
  SELECT lang, w, len(w) AS m FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
  ) WHERE len(w) > 0
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, m - k + 1)) AS i FROM (SELECT lang, w, m, unnest([1, 2, 3, 4]) AS k FROM q) WHERE m >= k)
  GROUP BY ALL HAVING count(*) >= 30
), total AS (
  SELECT lang, CAST(sum(m) AS BIGINT) AS n FROM q GROUP BY lang
), c AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, k, w, unnest(generate_series(1, k - 1)) AS cut FROM c
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.cut, gl.f AS l, gr.f AS r, CAST(2000000::HUGEINT * a // (gl.f + gr.f) AS BIGINT) AS score
  FROM cuts
  JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = array_to_string(cuts.w[1:cut], ' ')
  JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = array_to_string(cuts.w[cut + 1:], ' ')
), best AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), dropped AS (
  SELECT DISTINCT y.lang, x.phrase FROM (
    SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS part, a FROM (SELECT lang, w, a, k, j, unnest(generate_series(1, k - j + 1)) AS i FROM (SELECT lang, w, a, k, unnest(generate_series(2, k - 1)) AS j FROM c WHERE k > 2))
  ) y JOIN c x ON x.lang = y.lang AND x.phrase = y.part WHERE 100 * y.a >= 80 * x.a
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN dropped USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
