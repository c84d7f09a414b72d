"""Substring dedup (operator 3) by recompression.

A document's words are symbols.  Rounds rename runs (a symbol that stands two to RUN times in a row) and pairs (a symbol
of the left class before one of the right class) until symbols stand for up to 16 words.  Names are global: a name is a
hash of what it stands for and classes are a hash of the name, so all tasks give equal names without a dictionary, and
a round decides by the symbols next to each other only.  Two equal windows of 50 words are thus parsed alike but for at
most 16 words at either end (4 from runs, then 8 and 16 from two rounds of pairs), and a symbol begins in each stretch
of 16 words; a longer run stays single symbols, as its ends may lie outside a window.  The symbol of least rank that
begins in a window's middle 18 words is its anchor; equal windows share it, with the 32 words about it, which lie in the
window.  Spark counts these shared symbols over all documents, which reveals what may repeat; `repeats` then verifies
segments, and the windows of what is left, by 128-bit digests of their words' bytes.  Colliding names can therefore not
remove anything.

Rows are told by `doc_id`; a window is removed if its words also start in a document of a smaller id.  Rows of one id
(repeated rows) are one place, so neither removes the other.  Null ids are greater than all others and equal among
themselves.  Null texts and texts of white space have no words.  Texts are looked at in slices of a few MB; a longer
text is alone in its slice and takes some 30 times its size.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, digests, flat, mix, prepare, sliding_min, window_hashes, word_hashes, words_of
from .repeats import SEGMENT, earlier, settle, told_apart

WIDTH = 50
RUN = 4  # words of a run that gets a name
LONGEST = 16  # words of a symbol
EDGE = 16  # words at either end of a window whose symbols may depend on what is outside it
CORE = WIDTH - 2 * EDGE
AROUND = EDGE
NULL_ID = (1 << 63) - 1
_PAIR, _RUN, _RANK = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def rounds(symbols: np.ndarray, text: np.ndarray, pairs: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and lengths of the symbols after one round of runs and `pairs` of pairs.

    symbols: a name for each word; text: the number of the text it stands in.
    """
    if not len(symbols):
        return symbols, np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(symbols)))
    named = (count > 1) & (count <= RUN)
    symbols, length = symbols.copy(), np.ones(len(symbols), np.int64)
    symbols[at[named]] = mix(symbols[at[named]] * _RUN + count[named].astype(np.uint64))
    length[at[named]] = count[named]
    start = np.flatnonzero(head | np.repeat(~named, count))
    symbols, length, text = symbols[start], length[start], text[start]
    for r in range(1, pairs + 1):
        right = (mix(symbols ^ np.uint64(r) * _RANK) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:] & (text[1:] == text[:-1]) & (length[:-1] + length[1:] <= LONGEST))
        symbols[at] = mix(symbols[at] * _PAIR + (symbols[at + 1] ^ np.uint64(r)))
        length[at] += length[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, start, length, text = symbols[keep], start[keep], length[keep], text[keep]
    return symbols, start, length


def segments_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the word names of several texts (offsets `first`): text, first window (among all words), windows and key of
    each segment."""
    none = np.zeros(0, np.int64)
    counts = np.diff(first)
    if len(words) < WIDTH or counts.max(initial=0) < WIDTH:
        return none, none, none, none.astype(np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    names, start, _ = rounds(words, text)
    place_bits = np.uint64(max(1, int(len(words)).bit_length()))
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    rank = np.full(len(words), ~np.uint64(0))
    rank[start] = (mix(names * _RANK) & ~low) | start.astype(np.uint64)
    least = sliding_min(rank, CORE)  # at i: of the places i .. i + CORE - 1
    windows = np.flatnonzero(text[: len(words) - WIDTH + 1] == text[WIDTH - 1 :])
    anchor = (least[windows + EDGE] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[windows[1:]] != text[windows[:-1]])]))
    at, n, x = windows[new], np.diff(np.append(new, len(windows))), anchor[new]
    around = window_hashes(words, 2 * AROUND)
    name_at = np.zeros(len(words), np.uint64)
    name_at[start] = names
    return text[at], at, n, mix(around[x - AROUND] + name_at[x])


class Words:
    """The words of a batch's texts: their bounds, each text's first word, names, and their bytes joined by spaces."""

    def __init__(self, batch, column: int):
        self.data, self.off = flat(batch.column(column))
        self.starts, self.ends, self.first = words_of(self.data, self.off)

    def names(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def digests(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the n words from `at` on."""
        raw, off = self.data.tobytes(), self.off.tolist()
        joined = b" ".join([b" ".join(raw[a:b].split()) for a, b, w in zip(off, off[1:], np.diff(self.first).tolist()) if w])
        size = self.ends - self.starts
        start = np.cumsum(size + 1) - (size + 1)
        return digests(joined, start[at], start[at + n - 1] + size[at + n - 1])


def dedup_words(df: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False, sieve: int = 64) -> DataFrame:
    """`key`, n_words, n_removed, kept_sha256 and, with `with_text`, kept (the words that stay, joined by one space).

    sieve: bits of the keys; fewer bring more together, with the same results.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    rows = told_apart(df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("row"), F.col(text).cast("string").alias("text")))

    def segments(batches):
        for batch in by_bytes(batches, 2):
            words = Words(batch, 2)
            t, at, n, k = segments_of(words.names(), words.first)
            c1, c2 = words.digests(at, n + WIDTH - 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[t]) for c in (0, 1)), pa.array(at - words.first[t], pa.int32()), pa.array(n, pa.int32()), pa.array((k >> np.uint64(64 - sieve)).view(np.int64)), pa.array(c1), pa.array(c2)], ["row", "v", "at", "n", "key", "c1", "c2"])

    copies, rest = settle(rows.mapInArrow(segments, SEGMENT), within=False)
    # Each text's open stretches of windows; a text has no more of them than words.
    stretches = rest.groupBy("row", "v").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def windows(batches):
        for batch in by_bytes(batches, 2):
            words = Words(batch, 2)
            places = []
            for i, own in enumerate(batch.column(3)):
                lo, n = (own.values.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
                at = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                places.append(at)
            text, at = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate([*places, np.zeros(0, np.int64)])
            c1, c2 = words.digests(words.first[text] + at, np.full(len(at), WIDTH))
            yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[text]) for c in (0, 1)), pa.array(at, pa.int32()), pa.array(c1), pa.array(c2)], ["row", "v", "at", "c1", "c2"])

    single = earlier(rows.join(stretches, ["row", "v"]).select("row", "v", "text", "spans").mapInArrow(windows, "row long, v long, at int, c1 long, c2 long"))
    gone = copies.unionByName(single.select("row", "v", "at", F.lit(1).alias("n")))
    gone = gone.groupBy("row", "v").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def removed(batches):
        for batch in by_bytes(batches, 2):
            words = Words(batch, 2)
            body = words.data.tobytes()
            out: list[list] = [[] for _ in range(4)]
            for i, own in enumerate(batch.column(3)):
                a, b = words.first[i], words.first[i + 1]
                n = int(b - a)
                cover = np.zeros(n + 1, np.int64)
                if own.is_valid:
                    lo = own.values.field("at").to_numpy().astype(np.int64)
                    np.add.at(cover, np.minimum(lo, n), 1)
                    np.add.at(cover, np.minimum(lo + own.values.field("n").to_numpy() + WIDTH - 1, n), -1)
                stays = np.cumsum(cover[:-1]) == 0
                kept = b" ".join([body[s:e] for s, e in zip(words.starts[a:b][stays].tolist(), words.ends[a:b][stays].tolist())])
                for column, x in zip(out, (n, int(n - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))):
                    column.append(x)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[3], pa.string())] * with_text, ["row", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    final = rows.join(gone, ["row", "v"], "left").select("row", "v", "text", "spans").mapInArrow(removed, "row long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return final.select(F.nullif("row", F.lit(NULL_ID)).cast(kind).alias(key), *final.columns[1:])
