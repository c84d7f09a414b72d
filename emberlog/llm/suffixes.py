"""Suffix-array dedup (operator 10) by longest-previous-factor arrays.

Windows are the 100-byte strings of all texts.  A window's anchor is the place of the least-ranked 32-byte string in
it, which equal windows share, so suffixes that agree on 100 bytes meet under one key.  Equal segments (by 128-bit
digests of their bytes) are one node of the suffix order, which stands at its earliest place: `repeats` settles keys
that are alone and the later occurrences of a node.  The suffixes of the nodes that are left are sorted within buckets.
In suffix order, the previous and next suffixes that stand earlier in the corpus (previous and next smaller values,
found with a stack) give each suffix its longest previous factor; one of 100 bytes or more is a later copy.

A bucket holds about BUCKET nodes.  A key of more nodes is dealt out over several buckets; what these leave of it is
dealt out once more, by the window itself, and goes through suffix order and factors again.

Earlier means a smaller doc_id, or the same document and an earlier start; null ids are greater than all others.
Repeated rows of one id are one document whose windows are told by their start only: the earliest start stays, and
rows of one id don't remove each other at equal starts.  Null texts count as empty.  Texts are looked at in pieces of
2 MB.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, by_bytes, digests, flat, mix, prepare, sliding_min, staged, window_hashes
from .repeats import SEGMENT, earlier, settle, told_apart

WIDTH, GRAM = 100, 32
#: Distinct segments that a bucket holds, about.
BUCKET = 4000
#: Bytes that are looked at together.
PIECE = 2 << 20
NULL_ID = (1 << 63) - 1
_RANK = np.uint64(0x165667B19E3779F9)


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each suffix, the most it has in common with a suffix of a smaller place.

    order: suffixes in suffix order; lcp[i]: what the suffixes order[i - 1] and order[i] have in common; place: the
    corpus order of the suffixes, in which equal places aren't earlier than each other.  The nearest smaller places
    before and after in suffix order decide.
    """
    out = np.zeros(len(order), np.int64)
    for ahead in (False, True):
        seq = order[::-1].tolist() if ahead else order.tolist()
        # common[i]: between seq[i - 1] and seq[i]
        common = [0, *lcp[1:][::-1].tolist()] if ahead else [0, *lcp[1:].tolist()]
        at, best = place[order[::-1] if ahead else order].tolist(), []
        stack: list[tuple[int, int]] = []  # places, growing, and what each has in common with the one below
        for p, c in zip(at, common):
            while stack and stack[-1][0] >= p:
                c = min(c, stack.pop()[1])
            best.append(c if stack else 0)
            stack.append((p, c))
        out[seq] = np.maximum(out[seq], best)
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their first `width` bytes, and neighbours' common bytes up to it."""
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 16):
        a, b = rows[order[i - 1 : i - 1 + (1 << 16)]], rows[order[i : i + (1 << 16)]]
        differ = a[: len(b)] != b
        lcp[i : i + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def segments_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, windows and key of each segment of one text's bytes."""
    grams = window_hashes(BYTE_VALUE[data], GRAM)
    bits = np.uint64(max(1, len(data).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    rank = (mix(grams ^ _RANK) & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(rank, WIDTH - GRAM + 1) & low).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return at, np.diff(np.append(at, len(anchor))), grams[anchor[at]]


def factors_of(parts: list[bytes], row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the part, start in it and longest previous factor (up to WIDTH) of each window of the parts."""
    lens = np.array([len(p) for p in parts])
    n, first = lens - WIDTH + 1, np.cumsum(lens) - lens
    own = np.repeat(np.arange(len(parts)), n)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    row, at = row[own], at[own] + inside
    place = np.empty(len(own), np.int64)
    ranked = np.lexsort((at, row))
    place[ranked] = np.cumsum(np.concatenate([[True], (row[ranked][1:] != row[ranked][:-1]) | (at[ranked][1:] != at[ranked][:-1])]))
    order, lcp = suffix_order(np.frombuffer(b"".join(parts), np.uint8), first[own] + inside, WIDTH)
    return own, inside, longest_previous_factors(order, lcp, place)


PART = "b int, row long, v long, at int, again boolean, part binary"


def copied(pdf: pd.DataFrame) -> pd.DataFrame:
    """The windows of a bucket's parts that are later copies; with `part`, those left of a key that other buckets hold."""
    parts, again = pdf["part"].tolist(), pdf["again"].to_numpy(bool)
    own, inside, factors = factors_of(parts, pdf["row"].to_numpy(), pdf["at"].to_numpy())
    gone = factors >= WIDTH
    told = np.flatnonzero(gone | again[own])
    left = [None if g else parts[p][i : i + WIDTH] for g, p, i in zip(gone[told].tolist(), own[told].tolist(), inside[told].tolist())]
    return pd.DataFrame({"row": pdf["row"].to_numpy()[own[told]], "v": pdf["v"].to_numpy()[own[told]], "at": (pdf["at"].to_numpy()[own[told]] + inside[told]).astype(np.int32), "part": pd.Series(left, dtype=object)})


def dedup_bytes(df: DataFrame, text: str = "text", key: str = "doc_id", with_bytes: bool = False, bucket: int = BUCKET, sieve: int = 64) -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans, kept_sha256 and, with `with_bytes`, kept (the bytes that stay).

    sieve: bits of the keys; fewer bring more together, with the same results.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    rows = told_apart(df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("row"), F.col(text).cast("string").alias("text")))

    def segments(batches):
        for batch in by_bytes(batches, 2):
            data, off = flat(batch.column(2))
            ids, variant, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [[] for _ in range(4)]
            for i in range(batch.num_rows):
                for lo in range(off[i], off[i + 1] - WIDTH + 1, PIECE):  # windows that start in a piece
                    at, n, k = segments_of(data[lo : min(lo + PIECE + WIDTH - 1, off[i + 1])])
                    for column, x in zip(out, (np.full(len(at), i), at + lo, n, (k >> np.uint64(64 - sieve)).view(np.int64))):
                        column.append(x)
            text, at, n, k = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in out)
            c1, c2 = digests(memoryview(data), at, at + n + WIDTH - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(variant[text]), pa.array(at - off[text], pa.int32()), pa.array(n, pa.int32()), pa.array(k), pa.array(c1), pa.array(c2)], ["row", "v", "at", "n", "key", "c1", "c2"])

    copies, rest = settle(rows.mapInArrow(segments, SEGMENT), within=True)
    buckets = F.lit(max(1, -(-rest.count() // bucket)))
    shares = F.ceil(F.col("several") / bucket)
    b = F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("row", "at"), shares)), buckets).cast("int")
    spans = rest.select("row", "v", F.struct("at", "n", b.alias("b"), (shares > 1).alias("again")).alias("s")).groupBy("row", "v").agg(F.collect_list("s").alias("spans"))  # a text's own segments

    def cut(batches):
        for batch in by_bytes(batches, 2):
            data, off = flat(batch.column(2))
            ids, variant, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[] for _ in range(6)]
            for i, own in enumerate(batch.column(3).to_pylist()):
                body = data[off[i] : off[i + 1]].tobytes()
                for s in own:
                    part = body[s["at"] : s["at"] + s["n"] + WIDTH - 1]
                    for column, x in zip(out, (s["b"], ids[i], variant[i], s["at"], s["again"], part)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], ["b", "row", "v", "at", "again", "part"])

    parts = rows.join(spans, ["row", "v"]).select("row", "v", "text", "spans").mapInArrow(cut, PART)
    once = staged(parts.groupBy("b").applyInPandas(copied, "row long, v long, at int, part binary"))
    left = once.where("part is not null").select(F.pmod(F.xxhash64("part"), buckets * 32).cast("int").alias("b"), "row", "v", "at", F.lit(False).alias("again"), "part")
    twice = left.groupBy("b").applyInPandas(copied, "row long, v long, at int, part binary")
    single = once.where("part is null").unionByName(twice).select("row", "v", "at", F.lit(1).alias("n"))
    gone = copies.unionByName(single).groupBy("row", "v").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def removed(batches):
        for batch in by_bytes(batches, 2):
            data, off = flat(batch.column(2))
            out: list[list] = [[] for _ in range(5)]
            for i, own in enumerate(batch.column(3)):
                body = data[off[i] : off[i + 1]]
                n = len(body)
                stays, spans = np.ones(n, bool), 0
                if own.is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    lo = own.values.field("at").to_numpy().astype(np.int64)
                    np.add.at(cover, np.minimum(lo, n), 1)
                    np.add.at(cover, np.minimum(lo + own.values.field("n").to_numpy() + WIDTH - 1, n), -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    spans = int((~stays & np.concatenate([[True], stays[:-1]])).sum())
                kept = body[stays].tobytes()
                for column, x in zip(out, (n, int(n - stays.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(x)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[4], pa.binary())] * with_bytes, ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    final = rows.join(gone, ["row", "v"], "left").select("row", "v", "text", "spans").mapInArrow(removed, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    return final.select(F.nullif("row", F.lit(NULL_ID)).cast(kind).alias(key), *final.columns[1:])
