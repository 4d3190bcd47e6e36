"""Chunks of token numbers: the form in which corpus counts are gathered and handed back.

A chunk holds about a million tokens of whole documents as numbers into its own vocabulary. What is counted over the
corpus (words, word pairs, shingles) is first made unique within a chunk, dealt out by hash to parts, summed there, and
the sums go back to the chunks that asked, in the order in which they asked. So no task sees more than a chunk or a part,
a frequent key weighs one entry per chunk, and each direction moves a few bytes per distinct key and chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import saved, ship

CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 1 << 20
CHUNK_SCHEMA = "chunk long, ids array<long>, marks array<long>, lens array<int>, vocab array<long>, tokens binary"
REPLY_SCHEMA = "chunk long, level int, part int, blob binary"
#: ASCII other than letters and digits becomes a space, capitals become small.
ALNUM = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
END = xxhash.xxh64_intdigest(b"\n") - (1 << 63)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or floats as one compressed value. Whole numbers take as many bytes as they need; the first
    bytes of all come first, then the second ones and so on, as those of high order are much alike."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        if a.dtype.kind in "iu" and len(a):
            top, low = int(a.max()), int(a.min())
            if low >= 0:
                a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + planes.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 12 + n * kind.itemsize
    return out


def lists(column: pa.ChunkedArray, i: int) -> np.ndarray:
    """The numbers in a cell: of a list, or packed."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return unpack(column[i].as_py())[0].astype(np.int32)
    return column[i].values.to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_mark(raw: bytes | None) -> int:
    """What Spark's xxhash64 gives for the text, so that results of chunks can be joined to rows."""
    x = 42 if raw is None else xxhash.xxh64_intdigest(raw, 42)
    return x - (1 << 64) if x >> 63 else x


def stage_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alnum: bool = False, end: bool = False) -> DataFrame:
    """Writes the chunks of ``docs`` to a table bucketed by chunk, so that later joins on the chunk move none of it.

    Words: runs without ASCII white space in lower case (A-Z), or with ``alnum`` runs of letters, digits and non-ASCII
    characters. ``end``: each document ends in a token of its own. A null text has no words; rows keep their order.
    """
    spark = docs.sparkSession
    ship(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        words, ids, marks, lens, tokens, n = _Vocabulary(), [], [], [], [], 0
        words[b"\n"]  # the end is number 0

        def row() -> pa.RecordBatch:
            names = list(words)
            vocab = np.fromiter((xxhash.xxh64_intdigest(w) - (1 << 63) for w in names), np.int64, len(names))
            joined = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, t))
            return pa.RecordBatch.from_arrays([pa.array([part << 16 | k], pa.int64()), one(ids, pa.int64()), one(marks, pa.int64()), one(lens, pa.int32()), one(vocab, pa.int64()), pa.array([pack(joined)], pa.binary())], ["chunk", "ids", "marks", "lens", "vocab", "tokens"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                raw = (text or "").encode("utf-8", "surrogatepass")
                marks.append(text_mark(raw if text is not None else None))
                split = (raw.translate(ALNUM) if alnum else raw.lower()).split()
                t = np.fromiter(map(words.__getitem__, split), np.int32, len(split))
                if end:
                    t = np.append(t, np.int32(0))
                ids.append(key)
                lens.append(len(t))
                tokens.append(t)
                n += len(t)
                if n >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield row()
                    k += 1
                    words, ids, marks, lens, tokens, n = _Vocabulary(), [], [], [], [], 0
                    words[b"\n"]
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, CHUNK_SCHEMA)
    return saved(rows, "tokens", "chunk")


def n_parts(tokens: int, per_part: int) -> int:
    return max(16, -(-tokens // per_part))


def binary_rows(**columns) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "level": pa.int32(), "part": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], list(columns))
