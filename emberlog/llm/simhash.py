"""SimHash near-duplicates (operator 4) by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in at most two bits agree in one
segment up to one bit, so they share one of the 64 keys (segment, wildcard bit, segment without that bit); an equality
join on the keys finds the candidates, which are verified.  A key that more than `DENSE` fingerprints share gets no
pairs: its members are keyed again by thirds of the other segment, one of which is equal where two bits differ at most.
Where even such a key has more members, they are keyed by the other segment with one or two wildcards; each of these
keys, whose members are within two bits of each other by construction, links them to its least one.  No link is lost.

Only distinct fingerprints take part, so copies and repeated rows never make pairs.  Null texts count as empty; a text
without words has fingerprint zero.  A bit that half the shingles have is 0.  Rows with a null doc_id get a fingerprint
and never name a component.  Very long texts are hashed in stretches of 65536 shingles, with some 20 times a text's size
at hand.  Each aggregate is written before it is joined, so that Spark can split what a hot key has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import by_bytes, forget, fresh, prepare, staged

SEED = 42
SHINGLE = 3
#: Distinct fingerprints under one key beyond which the second level of wildcards replaces pairs.
DENSE = 24


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and split() at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        h = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # bounded memory on very long texts
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = SHINGLE) -> DataFrame:
    """`keep` and `fp` long (the fingerprint's bits) for each row."""
    prepare(df.sparkSession)
    df = df.select(*keep, df[text].cast("string").alias("_text"))

    def run(batches):
        for batch in by_bytes(batches, len(keep)):
            fp = np.array([fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fp)], [*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(run, f"{kinds}, fp long")


def _mask(bit):
    """1 << bit, of a column of bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _verified(members: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (a, b) of members of equal `by` that differ in at most two bits."""
    left, right = (members.select(*by, F.col("fp").alias(x)) for x in "ab")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return left.join(right, by).where(close).select("a", "b").distinct()


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of fingerprints of `distinct` (column fp) that connect what differs in at most two bits."""
    halves = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(b).alias("b")) for s in (0, 1) for b in range(32)))
    keyed = distinct.select("fp", F.explode(halves).alias("v")).select("fp", F.col("v.s").alias("s"), F.col("v.b").alias("b"))
    low = F.lit(0xFFFFFFFF).cast("long")
    part = F.when(F.col("s") == 0, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    # One long names segment, wildcard and the other 31 bits: 1 + 5 + 32 bits.
    key = part.bitwiseAND(F.bitwise_not(_mask(F.col("b")))) + F.col("s") * F.lit(1 << 32).cast("long") + F.col("b") * F.lit(1 << 33).cast("long")
    keyed = keyed.select("fp", key.alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = keyed.join(sizes, "key")
    held = staged(held)
    pairs = _verified(held.where(F.col("n") <= dense), ["key"])
    # Keys of many members: the other segment, of up to two differing bits, is cut in three, one of which is equal.
    many = held.where(F.col("n") > dense).select("fp", "key")
    other_half = F.when(F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(1).cast("long")) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(low))
    thirds = F.array(*(F.shiftrightunsigned(other_half, 11 * j).bitwiseAND(F.lit(2047).cast("long")) for j in range(3)))
    parts = many.select("fp", "key", F.posexplode(thirds).alias("j", "v"))
    counts = staged(parts.groupBy("key", "j", "v").agg(F.count("*").alias("n")).where("n > 1"))
    parts = staged(parts.join(counts, ["key", "j", "v"]))
    pairs = pairs.unionByName(_verified(parts.where(F.col("n") <= dense), ["key", "j", "v"]))
    many = parts.where(F.col("n") > dense).select("fp", "key").distinct()
    s = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(1).cast("long"))
    w = F.shiftrightunsigned("key", 33)
    own = F.when(s == 0, F.lit(0).cast("long")).otherwise(F.lit(32).cast("long")) + w
    other = F.when(s == 0, 32).otherwise(0)
    many = many.select("fp", _mask(own.cast("int")).alias("wild"), other.alias("o"), (w == 0).alias("whole"))
    # The other segment with one wildcard besides the key's, or (once per segment) with two and the key's own bit exact.
    one = many.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("wild").bitwiseOR(_mask(F.col("o") + i)))).alias("m"))
    two = F.array(*(F.lit((1 << i) | (1 << j)).cast("long") for i in range(32) for j in range(i)))
    two_high = F.array(*(F.lit(_signed(((1 << i) | (1 << j)) << 32)).cast("long") for i in range(32) for j in range(i)))
    both = many.where("whole").select("fp", F.explode(F.when(F.col("o") == 0, two).otherwise(two_high)).alias("m"))
    masked = one.unionByName(both).distinct().select("fp", "m", F.col("fp").bitwiseAND(F.bitwise_not("m")).alias("rest"))
    # Two bits are free, so a group has four members at most.
    least = masked.groupBy("m", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = least.select("a", F.explode("all").alias("b")).where(F.col("a") < F.col("b")).distinct()
    found = staged(pairs.unionByName(stars).distinct())
    forget(sizes, held, counts, parts)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node` and `root`, the least node it reaches, for every node of edges (a, b): large-star and small-star rounds."""
    edges = staged(edges.select("a", "b"))
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: greater neighbours go to the least of the neighbourhood.
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: of what is left, the smaller neighbours and the node itself go to the least.
        down = staged(large.where("a > b"))
        floor = staged(down.groupBy("a").agg(F.min("b").alias("m")))
        joined = down.join(floor, "a")
        told = Observation()  # what the written edges are is summed up as they are written
        made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = staged(made.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        forget(edges, least, down, floor)
        edges, now = new, told.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """`key`, `fp` long and `component` (least key reachable over links) for each row of `df`."""
    rows = staged(fingerprints(df, text, (key,), width))
    heads = staged(rows.groupBy("fp").agg(F.min(key).alias("head")))
    found = components(links(heads.select("fp"), dense))
    linked = found.join(heads, found["node"] == heads["fp"]).select("fp", "root", "head")
    named = linked.groupBy("root").agg(F.min("head").alias("component"))
    named = staged(linked.join(named, "root").select("fp", "component"))
    groups = heads.join(named, "fp", "left").select("fp", F.coalesce("component", "head").alias("component"))
    return rows.join(groups, "fp").select(key, "fp", "component")


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group stays: that of the least key; of rows that repeat a key, the one of least
    text.  Rows without a key can't be named and stay."""
    return stay(df, near_duplicates(df, text, key, width), text, key)


def stay(df: DataFrame, groups: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of `df` whose key names a component of `groups`, once for each key, and those without a key."""
    columns = df.columns
    found = groups.where(F.col(key) == F.col("component")).select(key).distinct()
    kept = df.join(found, key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last())
    nth = fresh(df, "_nth")
    kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*columns)
    return kept.unionByName(df.where(F.col(key).isNull()))
