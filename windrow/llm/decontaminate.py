"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, runs of numbers or of capitalised words one each; windows of five
tokens of the templates are hash-joined between documents and benchmark items; for the pairs found, the values in the
slots must go over consistently (one document value for each item value that comes again), so that a question with new
numbers or names is caught and a chance likeness of templates isn't.  A text has a second template in which capitalised
words are literal, in lower case, so that a copy in other letter case is caught too.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windrow.llm.common import column_rows, written
from windrow.llm.substring import characters, powers

#: Words for numbers and units of measure that count as such.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "half": 0.5, "quarter": 0.25, "dozen": 12}
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros usd percent kmh mph degree degrees meter meters metre metres kilometer kilometers watt watts volt volts joule joules newton newtons byte bytes kb mb gb % $ \u20ac \u00a3".split())
_VALUES = {w: i for i, w in enumerate(NUMBER_WORDS)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | SCALES
_SPACE = re.compile(r"\s")
_PIECE = 1 << 18
_OTHER, _LETTER, _DIGIT, _SIGN, _BEFORE = range(5)  # classes of characters; signs of currency stand before numbers
_LITERAL, _NUMBER, _UNIT, _NAME, _MONEY = range(5)  # kinds of tokens
_PLACEHOLDER = np.array([0, 0x9D5C0C5F7A3B1E11, 0x6B2F8E93D04C7723, 0xC3A1579E2B6D8F35, 0x6B2F8E93D04C7723], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    word, _ = characters()
    kinds = np.where(word, _LETTER, _OTHER).astype(np.int8)
    for c in np.flatnonzero(word).tolist():
        if chr(c).isdecimal():
            kinds[c] = _DIGIT
    kinds[ord("_")] = _OTHER
    kinds[ord("%")] = _SIGN
    for c in "$\u20ac\u00a3":
        kinds[ord(c)] = _BEFORE
    return kinds


@functools.cache
def _marks() -> np.ndarray:
    """1 for the code points that can stand within a number, 2 for a space and a hyphen, else 0."""
    found = np.zeros(0x110000, np.int8)
    found[[ord(c) for c in ".,:/"]], found[[ord(c) for c in " -"]] = 1, 2
    return found


@functools.cache
def _capitals() -> np.ndarray:
    """Which code points are capital letters."""
    return np.fromiter((c.isupper() or c.istitle() for c in map(chr, range(0x110000))), bool, 0x110000)


def _pieces(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, code points) of pieces of some length that end at white space."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield at, np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4")
        at = end


def _tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of the lower case, kind, whether a lone space or hyphen parts it from the one before) of each token."""
    found: list[tuple] = []
    for offset, points in _pieces(text):
        kind = np.zeros(len(points) + 2, np.int8)
        kind[1:-1] = _classes()[points]
        marks, digit = _marks()[points], kind == _DIGIT
        kind[1:-1][(marks == 1) & digit[:-2] & digit[2:]] = _DIGIT  # 1,000 or 2.5 is one number
        cut = (kind[1:] != kind[:-1]) | (kind[1:] >= _SIGN)
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        inside = kind[start + 1] != _OTHER
        start, end = start[inside], end[inside]
        power, inverse = powers(max(12, len(points).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(characters()[1][points] * power[: len(points)], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        upper = np.concatenate([[0], np.cumsum(_capitals()[points])])
        what = kind[start + 1]
        name = (what == _LETTER) & (upper[start + 1] > upper[start]) & (upper[end] == upper[start + 1]) & (end - start > 1)  # not all in capitals
        token = np.where(what == _DIGIT, _NUMBER, np.where(what == _BEFORE, _MONEY, np.where(name, _NAME, _LITERAL)))
        token[_among(h, _number_hashes()) & (what == _LETTER)] = _NUMBER
        token[_among(h, _unit_hashes()) & (token != _NUMBER) & (token != _MONEY)] = _UNIT
        lone = np.zeros(len(start), bool)
        lone[1:] = (start[1:] - end[:-1] == 1) & (marks[np.minimum(end[:-1], len(points) - 1)] == 2)
        found.append((start + offset, end + offset, h, token, lone))
    if not found:
        return (*(np.zeros(0, int) for _ in range(2)), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _word_hash(word: str) -> int:
    _, points = next(_pieces(word))
    power, _ = powers(12)
    h = (characters()[1][points] * power[: len(points)]).sum(dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return int(h ^ (h >> np.uint64(29)))


@functools.cache
def _number_hashes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sort(np.array([_word_hash(w) for w in _VALUES], np.uint64))


@functools.cache
def _unit_hashes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sort(np.array([_word_hash(w) for w in UNITS], np.uint64))


def number_value(text: str) -> str:
    """The value of a number in figures or words: "1,000", "1000.0" and "one thousand" are all "1000"."""
    total, part = 0.0, None
    for word in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+", text.lower()):
        if word[0].isdecimal():
            plain = word.replace(",", "") if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", word) else word.replace(",", ".")
            try:
                value = float(plain)
            except ValueError:  # a time, a date, a fraction
                return text.lower()
            part = value if part is None else part + value
        elif word in SCALES:
            part = (1 if part is None else part) * SCALES[word]
            if SCALES[word] >= 1000:
                total, part = total + part, None
        else:
            part = (part or 0) + _VALUES.get(word, 0)
    return f"{total + (part or 0):.10g}"


class Template:
    """A text's tokens with placeholders: ``code``, ``slot`` (whether it is one), ``raw`` (number of its first token), ``start``, ``end`` in the text.

    A unit counts only beside a number; the sign of a currency before a number comes after it, as its name would.
    ``names``: whether capitalised words are placeholders.
    """

    def __init__(self, text: str, tokens: tuple, names: bool = True):
        start, end, h, kind, lone = tokens
        kind = kind if names else np.where(kind == _NAME, _LITERAL, kind)
        same = np.zeros(len(kind), bool)
        same[1:] = lone[1:] & (kind[1:] == kind[:-1]) & ((kind[1:] == _NUMBER) | (kind[1:] == _NAME))
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(kind)) - 1
        kind, number = kind[first], np.append(kind[first] == _NUMBER, False)
        near = np.zeros(len(first) + 1, bool)  # whether nothing or one character parts it from the one before
        near[1:-1] = start[first[1:]] - end[last[:-1]] <= 1
        kind = np.where((kind == _UNIT) & ~(np.append(False, number[:-2]) & near[:-1] & (np.arange(len(kind)) > 0)), _LITERAL, kind)
        money = kind == _MONEY
        moved = money & number[1:] & near[1:]
        kind = np.where(money & ~moved, -1, kind)
        order = np.argsort(np.arange(len(first)) + 1.5 * moved, kind="stable")
        order = order[kind[order] >= 0]  # a sign without a number is no token
        kind = kind[order]
        self.text, self.kind, self.raw = text, kind, first[order]
        self.start, self.end = start[first[order]], end[last[order]]
        self.slot = kind != _LITERAL
        self.code = np.where(self.slot, _PLACEHOLDER[kind], h[first[order]])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of ``width`` tokens; none in a shorter text."""
        n = len(self.code) - width + 1
        h = np.full(max(0, n), width, np.uint64)
        for k in range(width if n > 0 else 0):
            h = h * _MIX + self.code[k : k + n]
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def values(self, at: int, width: int) -> list[tuple[int, str]]:
        """(number of its first token from the window's on, value) of each slot of the window at ``at``."""
        found = []
        for q in range(at, at + width):
            if self.slot[q]:
                surface = self.text[self.start[q] : self.end[q]]
                found.append((int(self.raw[q]), number_value(surface) if self.kind[q] == _NUMBER else surface.lower()))
        return found


def templates(text: str, tokens: tuple | None = None) -> list[Template]:
    """The text's template and, where it differs, the one with capitalised words as literals."""
    tokens = tokens or _tokens(text)
    both = [Template(text, tokens)]
    return both + [Template(text, tokens, names=False)] if (tokens[3] == _NAME).any() else both


WINDOWS = "id long, tie long, version int, width int, h long, pos int, slots array<struct<at: int, value: string>>, n int"


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())])), pa.int32())
    columns = zip(*out) if out else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], ["id", "tie", "version", "width", "h", "pos", "slots", "n"])


def _slots(template: Template, at: int, width: int) -> list[dict]:
    return [{"at": a, "value": v} for a, v in template.values(at, width)]


def windows(rows: DataFrame, id_col: str, text_col: str, width: int, short: tuple[int, ...] = (), item: bool = False, among=None) -> DataFrame:
    """(id, tie, version, width, h, pos, slots, n): a row per window of each of a text's templates.

    ``item``: windows with less than two literal tokens are left out, unless the text has no other (n is how many are
    left), and a text of fewer tokens than ``width`` is one window of its own length, without placeholders.  Else
    windows of each length in ``short`` are also made, without placeholders.  ``among``: a broadcast sorted array of
    hashes outside which windows are left out.
    """

    def plain(template: Template) -> Template:
        template.slot = np.zeros(len(template.code), bool)
        return template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(column_rows(batch.column(2))):
                tokens = _tokens(text or "")
                literal = (*tokens[:3], np.zeros(len(tokens[3]), int), tokens[4])
                made = [(v, t, width) for v, t in enumerate(templates(text or "", tokens))]
                if item and len(made[0][1].code) < width:
                    made = [(2, plain(Template(text or "", literal)), len(literal[0]))] if len(literal[0]) else []
                elif not item and short:
                    made += [(2, plain(Template(text or "", literal)), w) for w in short]
                for version, t, wide in made:
                    h = t.windows(wide)
                    at = np.arange(len(h))
                    if item and version < 2 and len(h):
                        literals = np.concatenate([[0], np.cumsum(~t.slot)])
                        enough = literals[at + wide] - literals[at] >= 2
                        at = at[enough] if enough.any() else at
                    n = len(at)
                    if among is not None and len(h):
                        at = at[_among(h[at], among.value)]
                    for p in at.tolist():
                        out.append((ids[i], ties[i], version, wide, int(h[p]), int(t.raw[p]), _slots(t, p, wide), n))
                        if len(out) > 20_000:
                            yield _batch(out)
                            out = []
            yield _batch(out)

    text = F.col(text_col).cast("string")
    return rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, WINDOWS)


def slot_agreement(pairs: list[tuple[str, str]]) -> tuple[int, int, int]:
    """(slots, those that follow their item value's commonest document value, those whose value is unchanged)."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for item, doc in pairs:
        seen[item][doc] += 1
    return len(pairs), sum(c.most_common(1)[0][1] for c in seen.values()), sum(a == b for a, b in pairs)


def alignment(h: np.ndarray, pos: np.ndarray, ih: np.ndarray, ipos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item window (ih, ipos) the document window of its hash on the best diagonal: (number or -1, windows on the diagonal, diagonal).

    A diagonal is a distance of positions; the best has most common windows, of equals it is the least.  Room and, beyond
    some products of repeated windows, time follow the two lengths, not the pairs of positions.
    """
    order = np.lexsort((pos, h))
    h, pos = h[order], pos[order]
    first, last = np.searchsorted(h, ih, "left"), np.searchsorted(h, ih, "right")
    low = int(pos.min() - ipos.max())
    much = np.zeros(int(pos.max() - ipos.min()) - low + 1, np.int64)
    by_hash = np.argsort(ih, kind="stable")
    for own in np.split(by_hash, np.flatnonzero(np.diff(ih[by_hash])) + 1):
        there, here = pos[first[own[0]] : last[own[0]]], ipos[own]
        if len(there) * len(here) > 50_000_000 and len(much) < 1 << 22:
            x, y = np.zeros(1 << len(much).bit_length()), np.zeros(1 << len(much).bit_length())
            x[there - there.min()], y[here - here.min()] = 1, 1
            both = np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), len(x))
            far = np.arange(here.min() - here.max(), there.max() - there.min() + 1)
            much[far + there.min() - here.min() - low] += np.rint(both[far]).astype(np.int64)
        else:
            for i in here.tolist():
                much[there - (i + low)] += 1
    top = np.argsort(-much, kind="stable")[:32] + low
    found, windows_, diagonal = np.full(len(ih), -1), np.zeros(len(ih), np.int64), np.zeros(len(ih), np.int64)
    for k, (lo, hi, i) in enumerate(zip(first.tolist(), last.tolist(), ipos.tolist(), strict=True)):
        if lo == hi:
            continue
        there = pos[lo:hi]
        at = np.minimum(np.searchsorted(there, top + i), hi - lo - 1)
        on = np.flatnonzero(there[at] == top + i)
        j = at[on[0]] if len(on) else np.argmax(much[there - (i + low)])
        found[k], diagonal[k] = order[lo + j], there[j] - i
        windows_[k] = much[diagonal[k] - low]
    return found, windows_, diagonal


def consistency(h: np.ndarray, pos: np.ndarray, slots: pa.Array, ih: np.ndarray, ipos: np.ndarray, islots: pa.Array) -> tuple[float, bool]:
    """(share of the slots that go over consistently, whether a value has changed) of a document's and an item's windows.

    Each slot of the item counts once, with the document's value on the best diagonal of its windows.  A slot whose item
    value doesn't come again can't be inconsistent; without slots the share is 1.
    """
    found, many, diagonal = alignment(h, pos, ih, ipos)
    k = np.flatnonzero(found >= 0)
    best: dict[int, tuple[tuple[int, int], str, str]] = {}
    for rank, x, y in zip(zip(many[k].tolist(), (-diagonal[k]).tolist()), islots.take(pa.array(k)).to_pylist(), slots.take(pa.array(found[k])).to_pylist(), strict=True):
        for a, b in zip(x, y):
            if a["at"] not in best or rank > best[a["at"]][0]:
                best[a["at"]] = (rank, a["value"], b["value"])
    slots_, held, same = slot_agreement([(a, b) for _, a, b in best.values()])
    return (held / slots_ if slots_ else 1.0), same < slots_


PAIRS = "doc_id long, tie long, item_id long, n_windows int, matched int, consistency double, reparameterised boolean"


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 5, containment: float = 0.8, consistent: float = 0.8, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, tie, item_id, matched, n_windows, containment, consistency, reparameterised) per contaminated pair.

    A document holds an item if ``containment`` of the distinct windows of one of the item's templates occur in it, and
    ``consistent`` of the slots whose value comes again go over consistently; of several templates the one with most
    containment is told.  An item of fewer than ``width`` tokens must occur word for word.  ``tie`` is the text's hash:
    rows of an equal doc_id and text, and those without an id, are told apart by it.  Null and empty texts and items
    match nothing; items of equal id are one item's variants; repeated rows count once.  The benchmark's window hashes
    are broadcast as a filter only if there are ``most_broadcast`` at most; beyond, all windows are shuffled, with the
    same result.  Pairs are looked for by an item's rarest windows, of which a document that holds it has at least one.
    """
    spark = docs.sparkSession
    items = written(windows(benchmark.where("item_id is not null and text is not null"), "item_id", "text", width, item=True), "bench-windows")
    hashes = written(items.select("h").distinct(), "bench-hashes")
    short = tuple(sorted(r.width for r in items.where("version = 2").select("width").distinct().collect()))  # less than width numbers
    among = None
    if hashes.count() <= most_broadcast:
        among = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in hashes.collect()], np.int64)))
    found = windows(docs.where("text is not null"), "doc_id", "text", width, short, among=among)
    found = found.select(F.col("id").alias("doc_id"), "tie", "h", "pos", "slots")
    found = written(found if among is not None else found.join(hashes, "h", "left_semi"), "doc-windows")
    parts = items.select("h", F.col("id").alias("item_id"), F.col("tie").alias("item_tie"), "version", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "n")
    item = ["item_id", "item_tie", "version"]
    n = parts.groupBy(*item, "h").agg(F.min("ipos").alias("ipos")).join(found.groupBy("h").agg(F.count("*").alias("docs")), "h", "left").fillna(0, ["docs"])
    of = Window.partitionBy(*item)
    n = n.select(*item, "h", F.count("*").over(of).alias("distinct"), F.row_number().over(of.orderBy("docs", "h")).alias("rank"))
    need = F.ceil(F.lit(containment) * F.col("distinct") - 1e-9)
    n = written(n.withColumn("need", need), "bench-ranks")
    rare = n.where(F.col("rank") <= F.col("distinct") - F.col("need") + 1).where("need > 0")
    doc = ["doc_id", "tie"]
    pairs = written(found.select(*doc, "h").join(rare.select("h", *item, "distinct", "need"), "h").select(*doc, *item, "distinct", "need").distinct(), "pairs-asked")
    of_docs = pairs.withColumnRenamed("doc_id", "d").withColumnRenamed("tie", "t")
    hits = found.join(of_docs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).drop("d", "t")
    hits = hits.join(parts.select(*item, "h").distinct(), [*item, "h"])
    lines = hits.groupBy(*doc, *item, "distinct", "need").agg(F.collect_set(F.struct("h", "pos", "slots")).alias("w"))
    lines = lines.withColumn("matched", F.size(F.array_distinct("w.h"))).where("matched >= need")
    whole = parts.groupBy(*item).agg(F.collect_set(F.struct("h", "ipos", "islots")).alias("v"))  # a row an item and template
    lines = lines.join(whole, item).select("doc_id", "tie", "item_id", F.col("distinct").cast("int"), F.col("matched").cast("int"), "w", "v")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = lambda cell: [cell.field(0).to_numpy(), cell.field(1).to_numpy().astype(np.int64), cell.field(2)]
        for batch in batches:
            judged = [consistency(*parts_of(w.values), *parts_of(v.values)) for w, v in zip(batch.column(5), batch.column(6), strict=True)]
            cells = [*batch.columns[:5], pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "tie", "item_id", "n_windows", "matched", "consistency", "reparameterised"])

    judged = lines.mapInArrow(agree, PAIRS).where(F.col("consistency") >= consistent).withColumn("containment", F.col("matched") / F.col("n_windows"))
    best = judged.groupBy(*doc, "item_id").agg(F.max(F.struct("containment", "consistency", "matched", "n_windows", (~F.col("reparameterised")).alias("same"))).alias("m"))
    return best.select(*doc, "item_id", "m.matched", "m.n_windows", "m.containment", "m.consistency", (~F.col("m.same")).alias("reparameterised"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; rows without an id or text are judged by their text alone."""
    bad = written(matches(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_bad_tie"])
    return docs.join(bad, same, "left_anti")


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``matches`` of all documents with all items, with its defaults."""
    return matches(docs, benchmark).drop("tie")
