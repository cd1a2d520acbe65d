"""Byte-level BPE as a tree reduction: halves are encoded on their own, neighbours joined by re-encoding their seam."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import column_rows


#: After this match a new pattern match always begins, whatever stands before it: of the public pattern's alternatives,
#: one with a non-space holds white space at its first place only, so none goes on from a non-space into a space.
CUT = re.compile(r"\S(?=[ \n])")


class TreeEncoder:
    """Encodes as the vocabulary's own left-to-right encoder would.

    A text is halved down to leaves, which are encoded on their own.  Two neighbours are joined by re-encoding a window
    around their seam.  It grows to the left, and to the right, until it ends at a place where a pattern match ends
    for sure, with sight of the next code point: tokens before the left end and after the right end are those that the
    joined text has, as matches are encoded separately and the pattern looks only ahead.  If there is no such place
    (a long run without a space) the window takes in the whole side.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 1024, cut: re.Pattern = CUT):
        if cut is CUT and pattern != public_tokenizers.PATTERN:
            raise ValueError("CUT holds for the public pattern only: give the places where matches of this pattern end for sure")
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars, self.cut = leaf_chars, cut
        self.bytes_of = {i: b for b, i in ranks.items()}

    def _before(self, text: str, lo: int, seam: int) -> int:
        width = 32
        while True:
            start = max(lo, seam - width)
            last = None
            for last in self.cut.finditer(text, start, seam):
                pass
            if last is not None or start == lo:
                return last.end() if last else lo
            width *= 2

    def _drop(self, tokens: list[int], n_bytes: int) -> int:
        """How many of the tokens remain without the last n_bytes bytes; these begin a token, as they begin a match."""
        k = len(tokens)
        while n_bytes > 0:
            k -= 1
            n_bytes -= len(self.bytes_of[tokens[k]])
        return k

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.core.encode_ordinary(text[lo:hi])
        seam = (lo + hi) // 2
        left, right = self._tree(text, lo, seam), self._tree(text, seam, hi)
        start = self._before(text, lo, seam)
        cut = self.cut.search(text, seam, hi)
        end = cut.end() if cut else hi
        del left[self._drop(left, len(text[start:seam].encode())) :]
        k, n = 0, len(text[seam:end].encode())
        while n > 0:
            n -= len(self.bytes_of[right[k]])
            k += 1
        left += self.core.encode_ordinary(text[start:end])
        left += right[k:]
        return left

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


class Vocabulary:
    """A vocabulary file's bytes (some MB at most), read once by the driver and broadcast.

    A pattern other than the public one needs a ``cut``, see TreeEncoder.
    """

    def __init__(self, spark, path: str, pattern: str, cut: re.Pattern = CUT):
        with open(path, "rb") as f:
            self.raw = spark.sparkContext.broadcast(f.read())
        self.pattern, self.cut = pattern, cut

    def encoder(self) -> TreeEncoder:
        """Made anew for each task, so that idle Python workers don't keep one."""
        return TreeEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.value.splitlines())}, self.pattern, cut=self.cut)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row; null texts count as empty and have no ids; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # so that the ids of long texts don't pile up
                part = batch.slice(start, 256)
                ids = [np.array(enc.encode(t or ""), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded binary) from (id, ids); null ids count as none.  ids_sha256 is over little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [x or [] for x in part.column(1).to_pylist()]
                cells = [part.column(0), pa.array(map(len, rows), pa.int64())]
                cells.append(pa.array([hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in rows], pa.string()))
                cells.append(pa.array([enc.decode(x) for x in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(cells, ["id", "n_tokens", "ids_sha256", "decoded"])

    fields = [("id", T.LongType()), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded", T.BinaryType())]
    return encoded.select("id", "ids").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encode and decode in one pass, so a task has one Python worker and ids don't travel.

    Null texts count as empty and have no tokens; repeated rows give repeated results; an empty table gives no rows; other
    columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder()
        for batch in batches:
            counts, ids_hash, decoded_hash = [], [], []
            for text in column_rows(batch.column(1)):
                ids = enc.encode(text or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            cells = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(cells, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``round_trip`` of every row."""
    return round_trip(docs, vocabulary).withColumnRenamed("id", "doc_id")
