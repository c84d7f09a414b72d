"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, found without loss.

SimHash links come first: fingerprints of the same shingles that differ in two bits at most (operator 4's deletion
variants) name pairs that are then verified on the whole sets.  At that radius SimHash misses similar pairs (at 0.83,
five words, 17 bits of 64 were seen), and a radius that lost none would need segments too short to tell texts apart.  So
what it hasn't linked is searched by prefixes: in any common order of all shingles, two sets of similarity 0.8 share one
of the first n - ceil(0.8 n) + 1 of each.  The order puts shingles last that a sample of the texts has often, then goes
by hash; it steers cost only.  Pairs that share a key are held against exact bounds (sizes, places of the key, parity
bits of the sets, first 256 and then two or more a shingle), and what is left is verified on the whole sets, which are
made anew from their texts and sent once for each pair.

Keys of more than DENSE sets aren't paired at once: their members are compared with one leader a key, and again with a
leader from outside the key's largest connected part; what then is outside is compared with all members.  Members of one
component need no pair.  Only distinct sets take part, and no link between two components is lost.  Sets are told by
64-bit digests.  Up to FEW pairs or links are dealt with in one task, as each turn of the distributed way makes a task
for each shuffle partition, which the driver has to keep a record of; more go the distributed way, to the same result.

Null and empty texts and texts of white space are one empty set, which is like itself only; a text of fewer words is one
shingle.  Rows without a key link nothing; repeated rows of a key are one document for each text.
"""

from __future__ import annotations

import gc
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, flat, forget, mix, prepare, shingles, staged, word_hashes, words_of
from .simhash import components, fingerprint, links, stay

WIDTH = 5
#: Sets under one key beyond which leaders come first, and how many leaders.
DENSE, LEADERS = 8, 3
#: A text in SHARE is counted; a shingle that OFTEN of them have goes last.
SHARE, OFTEN = 64, 4
#: Parity bits a shingle (about) by which candidates are told apart before their whole sets are read, and at most.
PER_SHINGLE, WIDEST = 2, 1 << 17
#: Sets that are held against one set in one stretch; names that all tasks get, where texts would travel to fewer, and
#: pairs that one task deals with.
STRETCH, FEW = 256, 100_000
QUARTERS = [f"q{i}" for i in range(4)]


def sets_of(column: pa.Array, width: int = WIDTH):
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, off = flat(column)
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    starts, ends, first = words_of(data, off)
    values = word_hashes(data, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(shingles(values[a:b], min(width, b - a))) if b > a else np.zeros(0, np.uint64)


def name_of(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) if len(found) else 0


def parity(found: np.ndarray, width: int = 256) -> np.ndarray:
    """Parity bits as longs: sets that differ in k shingles differ in k bits at most."""
    bits = np.bincount((mix(found) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _frequent(df: DataFrame, text: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in by_bytes(batches, 0):
            found = [*sets_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["s"])

    some = df.where(F.pmod(F.xxhash64(key, F.lit("frequent")), F.lit(SHARE)) == 0).select(F.col(text).cast("string"))
    got = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).toPandas()
    s, n = got["s"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _marked(df: DataFrame, text: str, key: str, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, set's name, fingerprint, size, parity and prefix of each row."""
    s, n = often

    def run(batches):
        for batch in by_bytes(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            prints = np.array([fingerprint(t, WIDTH) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            for found in sets_of(batch.column(1)):
                size = len(found)
                if len(s):
                    at = np.minimum(np.searchsorted(s, found), len(s) - 1)
                    ordered = found[np.argsort(np.where(s[at] == found, n[at], 0), kind="stable")]
                else:
                    ordered = found
                take = size - -(-4 * size // 5) + 1 if size else 0
                for column, x in zip(out, (name_of(found), size, *parity(found).tolist(), ordered[:take].view(np.int64))):
                    column.append(x)
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "fp", "sid", "n", *QUARTERS, "marks"])

    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long, sid long, n int, {', '.join(f'{q} long' for q in QUARTERS)}, marks array<long>")


def _pairs(left: DataFrame, right: DataFrame, where) -> DataFrame:
    """Pairs under one key that can be similar by their sizes and by what stands before and after the key."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    total, least, most = x("n") + y("n"), F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    shared = F.least(x("at"), y("at")) + F.least(x("n") - x("at"), y("n") - y("at"))
    can = (x("sid") != y("sid")) & (5 * least >= 4 * most) & (9 * shared >= 4 * total)
    met = left.alias("x").join(right.alias("y"), x("key") == y("key")).where(can & where)
    return met.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))


def _apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose parity bits let them be similar: sets that differ in k shingles differ in k bits at most."""
    one, two = (nodes.select(F.col("sid").alias(c), F.col("n").alias(f"{c}_n"), *(F.col(q).alias(f"{c}_{q}") for q in QUARTERS)) for c in "ab")
    apart = sum((F.bit_count(F.col(f"a_{q}").bitwiseXOR(F.col(f"b_{q}"))) for q in QUARTERS), F.lit(0))
    return pairs.join(one, "a").join(two, "b").where(9 * apart <= F.col("a_n") + F.col("b_n")).select("a", "b")


def wide_parity(found: np.ndarray) -> bytes:
    """Parity bits of a set, as many as suit its size."""
    return parity(found, min(WIDEST, max(256, 1 << (PER_SHINGLE * len(found) - 1).bit_length()))).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing parity bits of two sets; the wider parity is folded, as the place of a shingle is its hash's low bits."""
    x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _verified(pairs: DataFrame, df: DataFrame, nodes: DataFrame, text: str, key: str) -> DataFrame:
    """Of the pairs (a, b) of names, those whose whole sets have a similarity of at least 0.8."""
    _let_go(df.sparkSession)
    pairs, n = _counted(_apart(pairs.distinct(), nodes))
    if not n:
        return pairs
    wanted = Observation()
    sids = _gathered(pairs, n).select(F.explode(F.array("a", "b")).alias("sid")).distinct().observe(wanted, F.count("*").alias("n"))
    heads = staged(nodes.join(F.broadcast(sids) if n <= FEW else sids, "sid").select("sid", F.col("head").alias("id")))
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    def wide(batches):
        for batch in by_bytes(batches, 1):
            found = [*sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([wide_parity(x) for x in found], pa.binary())], ["sid", "n", "wide"])

    dealt = F.broadcast if wanted.get["n"] <= FEW else lambda names: names
    had = Observation()
    wides = staged(rows.join(dealt(heads.select("id")), "id", "left_semi").mapInArrow(wide, "sid long, n int, wide binary").observe(had, F.count("*").alias("n")))
    repeated = had.get["n"] > wanted.get["n"]  # rows of one key
    told = wides.dropDuplicates(["sid"]) if repeated else wides
    one, two = (told.select(F.col("sid").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")) for c in "ab")

    def close(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i) for i in range(6))
            most = n.to_numpy().astype(np.int64) + m.to_numpy()
            good = [9 * bits_apart(p.as_buffer(), q.as_buffer()) <= k for p, q, k in zip(x, y, most.tolist())]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Wide parities leave few pairs whose sets must meet.
    near, n = _counted(pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "b_n", "a_wide", "b_wide").mapInArrow(close, "a long, b long"))
    forget(pairs, wides)

    def whole(batches):
        for batch in by_bytes(batches, 2):
            out: list[list] = [[] for _ in range(5)]
            for sid, under, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2))):
                if name_of(found) == sid:  # rows of one key may have different texts
                    for u in under:
                        for column, x in zip(out, (u["a"], u["part"], u["first"], sid, found.tobytes())):
                            column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["a", "part", "first", "sid", "body"])

    def similar(batches):
        at, x = None, None
        for batch in batches:
            out: list[list] = [[], []]
            a, first, sid, body = (batch.column(c) for c in ("a", "first", "sid", "body"))
            for a, first, sid, body in zip(a.to_pylist(), first.to_pylist(), sid.to_pylist(), body):
                y = np.frombuffer(body.as_buffer(), np.uint64)
                if first:
                    at, x = a, y.copy()
                    continue
                assert a == at, "a pair's first set comes first"
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 5 * both >= 4 * (len(x) + len(y) - both):
                    out[0].append(a)
                    out[1].append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    def checked(pairs: DataFrame) -> DataFrame:
        """A set travels once for each pair as its second, and once for each STRETCH (about) of its pairs as their first."""
        pairs, names = _gathered(pairs, n), _gathered(heads, wanted.get["n"])
        counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
        parts = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STRETCH)).alias("part"))
        under = lambda c, first: F.struct(F.col(c).alias("sid"), "a", "part", F.lit(first).alias("first"))
        each = parts.select(F.explode(F.array(under("a", True), under("b", False))).alias("u")).select("u.*").distinct()
        sent = staged(each.groupBy("sid").agg(F.collect_list(F.struct("a", "part", "first")).alias("under")).join(names, "sid"))
        bodies = rows.join(dealt(sent), "id").select("sid", "under", "text").mapInArrow(whole, "a long, part long, first boolean, sid long, body binary")
        met = bodies.repartition("a", "part").sortWithinPartitions("a", "part", F.col("first").desc())
        good = met.mapInArrow(similar, "a long, b long")
        good = staged(good.distinct() if repeated else good)
        forget(sent)
        return good

    if n <= wanted.get["n"]:  # no more pairs than sets
        good = checked(near)
        forget(heads, near)
        return good
    # One pair of each name first: what these connect needs no more sets to travel.
    near_ = _gathered(near, n)
    first = near_.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = checked(first)
    roots = staged(_upward(good))
    linked = _gathered(roots, n)  # a root for each end of a pair of `first` at most
    one, two = (linked.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    rest = near_.join(first, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    more = checked(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    forget(heads, near, roots)
    return good.unionByName(more)


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` staged, and its rows, which are counted as they are written."""
    told = Observation()
    out = staged(df.observe(told, F.count("*").alias("n")))
    return out, told.get["n"]


def _let_go(spark: SparkSession) -> None:
    """Spark drops what finished plans have left (broadcasts, shuffles, metrics) when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _gathered(df: DataFrame, n: int) -> DataFrame:
    """`df` of `n` rows in one partition if they are few, so that nothing made of it alone is dealt out."""
    return df.coalesce(1) if n <= FEW else df


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _reached(edges: DataFrame) -> DataFrame:
    """`node` and `root`, the least node it reaches, of few edges: all in one task."""

    def run(batches):
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            nodes, roots = least_reached(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def _upward(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """`node` and a `root` that it reaches: of few edges the least node of all; else by going to the least neighbour,
    2^jumps times, a part of its component, which is all of it where edges point to few leaders."""
    edges, n = _counted(edges.select("a", "b"))
    if n <= FEW:
        return _reached(edges)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    for i in range(jumps):
        after = up.select(F.col("node").alias(f"n{i}"), F.col("root").alias(f"r{i}"))
        up = up.join(after, F.col("root") == F.col(f"n{i}"), "left").select("node", F.coalesce(f"r{i}", "root").alias("root"))
    return up


def _hashed(nodes: DataFrame, df: DataFrame, text: str, key: str) -> DataFrame:
    """Verified pairs among sets of equal fingerprints and of fingerprints that SimHash links."""
    reps = staged(nodes.groupBy("fp").agg(F.min("sid").alias("rep")))
    same = nodes.join(reps, "fp").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    one, two = (reps.select(F.col("fp").alias(f"{c}p"), F.col("rep").alias(c)) for c in "ab")
    near = links(reps.select("fp")).toDF("ap", "bp").join(one, "ap").join(two, "bp").select("a", "b")
    return _verified(same.unionByName(near), df, nodes, text, key)


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component as `root`."""
    return staged(members.drop("root").join(found, members["sid"] == found["node"], "left").drop("node").withColumn("root", F.coalesce("root", "sid")))


def similar_groups(df: DataFrame, text: str = "text", key: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """`key` and `component` (least key of the group) for each row of `df` that has a key."""
    prepare(df.sparkSession)
    rows = staged(_marked(df, text, key, _frequent(df, text, key)))
    nodes = staged(rows.groupBy("sid").agg(F.min("id").alias("head"), F.first("fp").alias("fp"), F.first("n").alias("n"), *(F.first(q).alias(q) for q in QUARTERS)))
    names = staged(rows.select("id", "sid"))
    one_each = rows.join(nodes.select("sid", F.col("head").alias("id")), ["sid", "id"])
    marks = staged(one_each.select("sid", F.posexplode("marks").alias("at", "key")).distinct())
    shared = staged(marks.groupBy("key").agg(F.count("*").alias("c"), F.min("sid").alias("leader")).where("c > 1"))
    held = staged(marks.join(shared, "key"))
    forget(rows, marks, shared)
    edges = _hashed(nodes, df, text, key)
    sized = held.join(nodes.select("sid", "n"), "sid")
    members = _rooted(sized, _upward(edges))
    forget(held)
    thin = members.where(F.col("c") <= dense)
    edges = edges.unionByName(_verified(_pairs(thin, thin, (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))), df, nodes, text, key))
    many = staged(members.where(F.col("c") > dense).drop("c"))
    forget(members)
    members = many
    if not members.isEmpty():
        firsts = members.where("sid = leader")
        for i in range(LEADERS + 1):
            edges = edges.unionByName(_verified(_pairs(members, firsts, F.col("x.root") != F.col("y.root")), df, nodes, text, key))
            if i == LEADERS:
                break
            before = members
            members = _rooted(before, _upward(edges, 3))
            forget(before)
            sizes = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"))
            outside = staged(members.join(sizes, "key").where("root <> most").drop("most"))
            if outside.isEmpty():
                break
            # The last turn compares all that is outside.
            leaders = outside.groupBy("key").agg(F.min_by("sid", F.xxhash64("sid", F.lit(i))).alias("now"))
            firsts = outside if i == LEADERS - 1 else outside.join(leaders, "key").where("sid = now").drop("now")
    edges, n = _counted(edges.select("a", "b"))
    found = staged(_reached(edges)) if n <= FEW else components(edges)
    linked = staged(found.join(nodes, found["node"] == nodes["sid"]).select("sid", "root", "head"))
    named = staged(linked.groupBy("root").agg(F.min("head").alias("component")))
    named = staged(linked.join(named, "root").select("sid", "component"))
    groups = staged(nodes.join(named, "sid", "left").select("sid", F.coalesce("component", "head").alias("component")))
    return names.select(F.col("id").alias(key), "sid").join(groups, "sid").select(key, "component")


def keep_first(df: DataFrame, text: str = "text", key: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """One row of each group stays: that of the least key; rows without a key stay and link nothing."""
    return stay(df, similar_groups(df, text, key, dense), text, key)
