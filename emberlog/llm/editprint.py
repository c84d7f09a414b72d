"""Document fingerprints (operator 9) by randomised edit embedding.

A random walk that all texts share moves over the characters: step j emits the current character and goes on to the next
one if a random bit of (j mod PERIOD, character class) is set.  Texts of small edit distance thus get emissions of small
Hamming distance, as walks that an edit has set apart meet again.  A fingerprint holds one hashed bit of the emission at
each of BITS sampled steps; slot k samples the step of least rank among those the walk has, so texts of different
lengths sample alike.  Likeness is the share of agreeing bits, with chance agreement taken as 0.  `search` finds near
fingerprints by bands of sampled bits, which are then verified; it works on distinct fingerprints, so that copies never
make pairs, and many near ones under a band are told by how far they are from one leader, so that `near_counts` makes
pairs only of what that leaves open.

Null texts count as empty; the empty text's fingerprint is all zeros.  Rows follow each other by descending key, null
keys last, repeated keys by text.  A task holds two texts at a time, each with some 40 times its size.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, prepare, staged

PERIOD, CLASSES, BITS = 4096, 64, 256
_state: dict = {}


def _shared():
    """Hops by class and step: how many steps until the walk leaves a character; sampled steps by slot."""
    if not _state:
        rng = np.random.default_rng(20240229)
        leave = rng.integers(0, 2, (CLASSES, PERIOD), np.uint8).astype(bool)
        leave[:, -1] = True
        at = np.where(leave, np.arange(PERIOD), PERIOD)
        first = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
        _state["hops"] = [row.tolist() for row in first - np.arange(PERIOD) + 1]
        # Steps at which a new least rank appears: after step p the next is beyond m with probability (p + 1) / (m + 1).
        steps = np.zeros((BITS, 60))
        for i in range(1, 60):
            steps[:, i] = np.minimum(np.floor((steps[:, i - 1] + 1) / rng.uniform(1e-6, 1, BITS)), 2.0**52)
        _state["steps"] = steps.astype(np.int64)
        _state["salt"] = mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return _state["hops"], _state["steps"], _state["salt"]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(chars: np.ndarray, at: int = 0) -> list[int]:
    """The step at which the walk has left each character, starting at step `at`."""
    hops, mask, out = _shared()[0], PERIOD - 1, []
    put = out.append
    for c in (chars * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.uint8).tobytes():
        at += hops[c][at & mask]
        put(at)
    return out


def bits_of(chars: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The fingerprint's bits from a text's characters and its walk."""
    _, steps, salt = _shared()
    if not len(chars):
        return np.zeros(BITS, bool)
    chosen = steps[np.arange(BITS), (steps < left[-1]).sum(1) - 1]
    seen = chars[np.searchsorted(left, chosen, "right")].astype(np.uint64)
    return (mix(seen * np.uint64(0x9E3779B97F4A7C15) ^ salt) >> np.uint64(63)).astype(bool)


def text_hex(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 2.0 * float((a == b).mean()) - 1.0)


def fingerprint(text: str | None) -> str:
    chars = points(text or "")
    return text_hex(bits_of(chars, np.array(walk(chars), np.int64)))


class Printed:
    """A text with its walk and fingerprint; what replaces its end walks on from where the rest has left."""

    def __init__(self, text: str):
        self.text, self.chars = text, points(text)
        self.left = np.array(walk(self.chars), np.int64)
        self.bits = bits_of(self.chars, self.left)

    def with_end(self, cut: int, other: Printed) -> tuple[str, np.ndarray]:
        """The text whose last `cut` characters are replaced by as many of `other`, and its fingerprint's bits."""
        keep, more = len(self.chars) - cut, other.chars[:cut]
        text = self.text[:keep] + other.text[:cut]
        left = np.concatenate([self.left[:keep], np.array(walk(more, int(self.left[keep - 1]) if keep else 0), np.int64)])
        return text, bits_of(np.concatenate([self.chars[:keep], more]), left)


def neighbours(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows in streams by descending key: `_bucket`, `_guest`, `_key`, `_null`, `_text`, sorted within partitions.

    Buckets are key ranges between approximate quantiles.  Each bucket also gets, as guest, the first row of the next
    bucket (of the first one, for the last), so that every row has its successor at hand.  What reaches the driver is
    one key for each bucket.
    """
    spark = prepare(df.sparkSession)
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(1 << 63))
    rows = df.select(F.coalesce(F.col(key).cast("long"), low).alias("_key"), F.col(key).isNull().alias("_null"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    cuts = sorted({int(x) for x in df.select(F.col(key).cast("double").alias("k")).stat.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n))}, reverse=True) if n > 1 else []
    # Cuts above the key, descending: first among every 128th, then in the stretch that follows the last of these.
    above = lambda some: F.size(F.filter(some, lambda c: c > F.col("_key"))).cast("int")
    start = F.greatest(above(F.array(*map(F.lit, cuts[::128]))) - 1, F.lit(0)) * 128 if cuts else None
    bucket = start + above(F.slice(F.array(*map(F.lit, cuts)), start + 1, F.lit(128))) if cuts else F.lit(0)
    rows = rows.withColumn("_bucket", bucket.cast("int")).withColumn("_guest", F.lit(False))
    heads = {r["_bucket"]: r["k"] for r in rows.groupBy("_bucket").agg(F.max("_key").alias("k")).collect()}
    order = sorted(heads)
    guests = [(heads[after], at) for at, after in zip(order, order[1:] + order[:1])]
    if guests:
        named = spark.createDataFrame(guests, "_key long, _at int")
        more = rows.join(F.broadcast(named), "_key").select("_key", "_null", "_text", F.col("_at").alias("_bucket"), F.lit(True).alias("_guest"))
        rows = rows.unionByName(more)
    # By number, not by hash: buckets are even and shouldn't meet in one task.
    return rows.repartitionById(n, "_bucket").sortWithinPartitions("_bucket", "_guest", F.col("_key").desc(), "_null", "_text")


def edited_prints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row its fingerprint, that of the row with its last third replaced by the next row's start, and both
    likenesses.  A task holds two texts at a time."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_guest", "_key", "_null", "_text")))

    def run(batches):
        out: list[list] = [[] for _ in range(7)]
        before, bucket, done = None, None, False

        def put(one, after):
            k, null, this = one
            n = len(this.chars)
            changed, bits = this.with_end(n // 3, after)
            got = (None if null else k, n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), text_hex(this.bits), text_hex(bits), likeness(this.bits, bits), likeness(this.bits, after.bits))
            for column, x in zip(out, got):
                column.append(x)

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.string()) for c in out[2:5]), *(pa.array(c, pa.float64()) for c in out[5:])], [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            for column in out:
                column.clear()
            return made

        for b, guest, k, null, t in rows(batches):
            if b != bucket:
                before, bucket, done = None, b, False
            if done:
                continue  # more rows of the guest's key
            now = Printed(t)
            if before:
                put(before, now)
            before, done = (k, null, now), guest
            if len(out[0]) >= 1000:
                yield flush()
        yield flush()

    return neighbours(df, text, key).mapInArrow(run, f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Bands, and sampled bits of each; fingerprints under one band beyond which they are told by a leader.
BANDS, BAND_BITS, DENSE = 60, 24, 8


def _apart(a: str, b: str):
    """Differing bits of two columns of fingerprints."""
    part = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(BITS // 64)), F.lit(0))


def _most(least: float) -> int:
    """Bits that may differ at a likeness of at least `least`."""
    return max((d for d in range(BITS + 1) if max(0.0, 1 - 2 * d / BITS) >= least), default=-1)


def _met(queries: DataFrame, rows: DataFrame, most: int, bands: int, width: int, seed: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """(query, lead, d) and (fingerprint, lead, r), staged: what shares a band with a query, by leaders.

    A fingerprint within three quarters of `most` bits of the least one under a dense band follows it, r bits away;
    others lead themselves.  A band holds a leader once, however many follow it there; d is how far a query is from the
    leader.
    """
    prepare(queries.sparkSession)
    radius = most - most // 4
    rng = np.random.default_rng(seed)
    places = np.array([np.sort(rng.choice(BITS, width, replace=False)) for _ in range(bands)])
    weight = np.int64(1) << np.arange(width, dtype=np.int64)

    def banded(batches):
        for batch in batches:
            prints = batch.column(0).to_pylist()
            bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(-1, BITS // 8), axis=1)
            values = np.stack([bits[:, p].astype(np.int64) @ weight for p in places], 1) * bands + np.arange(bands)
            take = np.repeat(np.arange(len(prints)), bands)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(take)), pa.array(values.ravel())], ["id", "band"])

    # Only a number of each fingerprint travels with its bands; should two have one number, both are verified.
    named = lambda df: staged(df.select("fingerprint").where("fingerprint is not null").distinct().withColumn("id", F.xxhash64("fingerprint")))
    one, two = named(queries), named(rows)
    asked = staged(one.mapInArrow(banded, "id long, band long").select(F.col("id").alias("qid"), "band"))
    # The queries' bands grow with the input, so they are dealt out at every size and never broadcast.
    held = staged(two.mapInArrow(banded, "id long, band long").join(asked.select("band").hint("merge"), "band", "left_semi"))
    keys = staged(held.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lid")).where(F.col("n") > dense))
    led = staged(held.join(keys, "band").where("id <> lid").select("id", "lid").distinct())
    led = led.join(two, "id").join(two.select(F.col("fingerprint").alias("lead"), F.col("id").alias("lid")), "lid")
    led = led.withColumn("r", _apart("fingerprint", "lead")).where(F.col("r") <= radius)
    # The least leader, so that few lead many.
    led = staged(led.groupBy("fingerprint").agg(F.min(F.struct("lid", "lead", "r")).alias("l")).select("fingerprint", "l.lead", "l.r"))
    seen = staged(held.select("id").distinct())
    members = staged(two.join(seen, "id").join(led, "fingerprint", "left").select("id", "fingerprint", F.coalesce("lead", "fingerprint").alias("lead"), F.coalesce("r", F.lit(0)).alias("r")))
    bands_of = staged(held.join(members.select("id", F.xxhash64("lead").alias("lid")), "id").select("lid", "band").distinct())
    met = staged(asked.join(bands_of.hint("merge"), "band").select("qid", "lid").distinct())
    leads = staged(members.select("lead").distinct().withColumn("lid", F.xxhash64("lead")))
    met = met.join(one.select(F.col("fingerprint").alias("query"), F.col("id").alias("qid")), "qid").join(leads, "lid")
    met = staged(met.select("query", "lead", _apart("query", "lead").alias("d")).where(F.col("d") <= most + radius))
    forget(asked, held, keys, led, seen, bands_of, leads)
    return met, members.drop("id")


def search(queries: DataFrame, rows: DataFrame, least: float = 0.8, bands: int = BANDS, width: int = BAND_BITS, seed: int = 5, dense: int = DENSE) -> DataFrame:
    """Pairs (query, fingerprint, likeness) of distinct fingerprints of two frames with a column `fingerprint`, of at
    least `least` likeness; a fingerprint that both have is its own partner.  Members follow by joining the frames.

    Banding by sampled bits: fingerprints that agree on all `width` bits of one of `bands` samples are verified on all
    bits, and so is what follows their leaders.  At 90 % agreeing bits (likeness 0.8) a pair is missed with probability
    (1 - 0.9^24)^60, below 0.01, and less often the nearer it is.
    """
    most = _most(least)
    met, members = _met(queries, rows, most, bands, width, seed, dense)
    pairs = met.join(members, "lead").where(F.col("d") - F.col("r") <= most).select("query", "fingerprint", _apart("query", "fingerprint").alias("d"))
    return pairs.where(F.col("d") <= most).select("query", "fingerprint", F.greatest(F.lit(0.0), 1 - 2 * F.col("d") / F.lit(float(BITS))).alias("likeness"))


def near_counts(prints: DataFrame, key: str = "doc_id", every: int = 100, least: float = 0.8, dense: int = DENSE) -> DataFrame:
    """`prints` (key, fingerprint, ...) with near_count: for rows whose key is divisible by `every`, the number of other
    rows of at least `least` likeness; null for the rest.

    What `search` finds, without its pairs where a leader decides: d bits from the leader to the query and r to a
    fingerprint leave them d + r apart at most and |d - r| at least.  Between these bounds pairs are verified.
    """
    asks = F.coalesce(F.col(key) % every == 0, F.lit(False))
    most = _most(least)
    met, members = _met(prints.where(asks), prints, most, BANDS, BAND_BITS, 5, dense)
    counts = staged(prints.groupBy("fingerprint").agg(F.count("*").alias("n")))
    members = staged(members.join(counts, "fingerprint"))
    by_r = members.groupBy("lead", "r").agg(F.sum("n").alias("n"))
    rings = staged(by_r.groupBy("lead").agg(F.collect_list(F.struct("r", "n")).alias("rings")))  # no more than the radius
    sure = F.aggregate(F.filter("rings", lambda x: x["r"] + F.col("d") <= most), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    open_ = lambda r: (r + F.col("d") > most) & (F.col("d") - r <= most)
    told = staged(met.join(rings, "lead").select("query", "lead", "d", sure.alias("n"), F.exists("rings", lambda x: open_(x["r"])).alias("more")))
    pairs = told.where("more").drop("n").join(members, "lead").where(open_(F.col("r")) & (_apart("query", "fingerprint") <= most))
    both = told.select("query", "n").unionByName(pairs.select("query", "n"))
    found = staged(both.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("_all")))
    return prints.join(found, "fingerprint", "left").withColumn("near_count", F.when(asks, F.col("_all") - 1)).select(*prints.columns, "near_count")
