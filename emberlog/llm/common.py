"""Shared plumbing: session preparation, Arrow text access, numpy hashing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import forget, numbered, staged  # noqa: F401

#: Rows and bytes of one Arrow batch that Spark sends, and bytes of text that are looked at together.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 512, 16 << 20, 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The separators of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts in `column` make up about `most` bytes; a longer text is alone in its slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows or not batch.num_rows and lo == 0:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def gathered(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts in `column` make up about `most` bytes, and cut where they are more."""
    held, size = [], 0
    for batch in by_bytes(batches, column, most):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def held_out():
    """crc32(doc_id as text) mod 3 is 1: rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column (null: empty) and their n + 1 offsets."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n, at least."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of several texts, and each text's first word (n + 1 offsets)."""
    word = np.zeros(len(data) + 1, np.int8)
    word[:-1] = ~SPACE[data]
    step = np.diff(word, prepend=np.int8(0))
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[(word[cut] == 1) & (word[cut - 1] == 1)]  # two texts meet inside what looks like one word
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, off)


#: Lanes of 8 bytes of a word that are mixed in turn; longer words are hashed whole.
LANES = 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: 8 at a time, each lane mixed by a bijection, so that words of up to 8 bytes
    and equal lengths never collide."""
    lens = ends - starts
    out = mix(lens.astype(np.uint64) * _M1 + np.uint64(1))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((lens > 0) & (lens <= 8 * LANES))
    for i in range(LANES):
        if not len(left):
            break
        rest = lens[left] - 8 * i
        value = lanes[starts[left] + 8 * i] & (~np.uint64(0) >> (np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64)))
        out[left] = mix((out[left] ^ value) * _M2 + np.uint64(i))
        left = left[rest > 8]
    for i in np.flatnonzero(lens > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def digests(body: bytes | memoryview, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic digest of each stretch of `body`, as two longs: equal ones stand for equal bytes."""
    body = memoryview(body)
    raw = b"".join([blake2b(body[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values (wraparound polynomial, finalised)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def shingles(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive values, mixed one by one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(values[:n] * _M1 + np.uint64(width))
    for i in range(1, width):
        out = mix((out ^ values[i : i + n]) * _M2 + np.uint64(i))
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
