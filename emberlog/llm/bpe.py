"""Byte-level BPE encoding and decoding (operator 2).

Two tiers: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; the others are merged with a
heap over a doubly linked list of bytes.  What the two tiers have found is kept in a bounded cache of pre-tokens, as
words recur; it never changes a result.  Results equal those of the tiktoken library on the same ranks and pattern.
Null texts count as empty and give no ids; repeated rows give equal results, and nothing depends on ties; empty tables
give empty results.  Texts are looked at in slices of a few MB; a pre-token of n bytes takes some 200 n bytes while it is
merged.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import by_bytes, prepare

#: Pre-tokens that one worker remembers before it starts anew; bounds memory, never changes a result.
MEMO = 400_000
MEMO_BYTES = 64


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: n keys, n slots, one displacement per bucket.

    Buckets are placed from large to small, each at the first displacement that meets free slots only; buckets of one
    key then take the slots that are left, named directly.  A lookup compares the key itself, so strangers are told.
    """

    def __init__(self, keys: list[bytes], per_bucket: float = 1.5):
        self.keys, self.n = keys, len(keys)
        self.buckets = max(1, int(self.n / per_bucket))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        n, used = self.n, bytearray(self.n)
        self.shift, self.ids = [0] * self.buckets, [-1] * n
        for b in sorted((b for b in range(self.buckets) if len(members[b]) > 1), key=lambda b: -len(members[b])):
            halves = [((h := hashes[i]) >> 33, (h >> 3 & 0x3FFFFFFF) | 1) for i in members[b]]
            d = 0
            while True:
                slots = [(x + d * y + d * d) % n for x, y in halves]
                if not any(used[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(members[b], slots):
                used[s], self.ids[s] = 1, i
        free = (s for s in range(n) if not used[s])
        for b, (first, *more) in ((b, m) for b, m in enumerate(members) if m):
            if not more:
                s = next(free)
                self.shift[b], self.ids[s] = -s - 1, first

    def get(self, key: bytes) -> int:
        """The key's position in `keys`, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.ids[-d - 1 if d < 0 else ((h >> 33) + d * (h >> 3 & 0x3FFFFFFF | 1) + d * d) % self.n]
        return i if i >= 0 and self.keys[i] == key else -1


class Codec:
    """Encoder and decoder; cheap to send to workers, which build the hash once per process."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "_ready": False}

    def ready(self) -> Codec:
        if not self._ready:
            present = [i for i, t in enumerate(self.tokens) if t]
            self.hash = PerfectHash([self.tokens[i] for i in present])
            self.present = present
            self.pair_rank = {self.tokens[i]: i for i in present}  # of the parts that merges make
            self.find = splitter(self.pattern)
            self.memo = _Memo(self)
            self._ready = True
        return self

    def rank(self, piece: bytes) -> int:
        i = self.hash.get(piece)
        return self.present[i] if i >= 0 else -1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is in the vocabulary: O(n log n)."""
        n, rank = len(piece), self.pair_rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0 where it was merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, to = heappop(heap)
            j = after[i]
            if j >= n or end[i] != j or end[j] != to:
                continue  # one of the two parts has changed since
            end[i], end[j] = to, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := rank(piece[h:to])) is not None:
                heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        self.ready()
        return list(chain.from_iterable([x[1] for x in map(self.memo.__getitem__, self.find(text))]))

    def encode_joined(self, text: str) -> tuple[str, list[int]]:
        """The ids in decimal, joined by commas, and the ids."""
        self.ready()
        found = list(map(self.memo.__getitem__, self.find(text)))
        return ",".join([x[0] for x in found]), list(chain.from_iterable([x[1] for x in found]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Code points below this get the faster engine, with the classes of the other one written out.
PLAIN = 0x250


def splitter(pattern: str):
    """A function from text to its matches.  Texts of code points below PLAIN are split by `re`, whose classes are then
    explicit lists that `regex` itself has given, so the matches are the same; others are split by `regex`."""
    full = regex.compile(pattern).findall
    out, i, inside = [], 0, False
    while i < len(pattern):
        token = (re.match(r"\\p\{\w+\}|\\.|.", pattern[i:], re.S))[0]
        i += len(token)
        if token in "[]":
            inside = token == "["
        if token[:2] in ("\\p", "\\s", "\\S"):
            if inside and token == "\\S":
                return full
            is_in = regex.compile(token.replace("S", "s") if token == "\\S" else token).match
            points = [c for c in range(PLAIN) if is_in(chr(c))]
            ranges = "".join(f"\\u{c:04x}" for c in points)
            out.append(ranges if inside else f"[{'^' * (token == chr(92) + 'S')}{ranges}]")
        else:
            out.append(token)
    fast, beyond = re.compile("".join(out)).findall, re.compile(f"[^\\u0000-\\u{PLAIN - 1:04x}]").search
    return lambda text: full(text) if beyond(text) else fast(text)


class _Memo(dict):
    """Pre-token to its joined ids and its ids.  Long pre-tokens aren't kept, and a full memo starts anew."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[str, tuple[int, ...]]:
        raw = piece.encode()
        ids = tuple(self.codec.encode_piece(raw))
        found = ",".join(map(str, ids)), ids
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = found
        return found


_codecs: dict = {}


def shared_codec(sent: Codec) -> Codec:
    """One codec per worker process and vocabulary: the perfect hash is built once."""
    key = (len(sent.tokens), sent.pattern, hashlib.blake2b(b"\0".join(sent.tokens[:2000] + sent.tokens[-2000:]), digest_size=16).digest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = sent.ready()
    return _codecs[key]


def _encoder(spark, vocabulary: str, pattern: str):
    return spark.sparkContext.broadcast(Codec(load_ranks(vocabulary), pattern))  # a vocabulary file: about 1 MB


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append `out` array<int>, the token ids of the whole text (null: none)."""
    from pyspark.sql import functions as F

    sent = _encoder(df.sparkSession, vocabulary, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = shared_codec(sent.value)
        return texts.map(lambda t: codec.encode(t or ""))

    return df.withColumn(out, ids(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append `out` binary, the bytes that the ids stand for."""
    from pyspark.sql import functions as F

    sent = _encoder(df.sparkSession, vocabulary, pattern)

    @F.pandas_udf("binary")
    def raw(column):
        codec = shared_codec(sent.value)
        return column.map(lambda x: codec.decode(x if x is not None else ()))

    return df.withColumn(out, raw(F.col(ids)))


def digests(df: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 (of the decoded ids) for each row, in one pass."""
    sent = _encoder(prepare(df.sparkSession), vocabulary, pattern)
    df = df.select(*keep, df[text].cast("string").alias("_text"))
    fields = [f for f in df.schema if f.name != "_text"]

    def run(batches):
        gc.set_threshold(200_000, 50, 1000)  # the memo holds many tuples and no cycles
        codec = shared_codec(sent.value)
        for batch in by_bytes(batches, len(keep)):
            n, sha, back = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                joined, ids = codec.encode_joined(t or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
