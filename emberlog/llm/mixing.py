"""Mixing sources to target weights (operator 8) by Sainte-Lague apportionment.

Sizes are words.  Each source's weight gives it a share of `volume` times all words; shares above `cap` times the
source's own words stop there and the excess is shared anew by weight.  The targets are handed out as equal blocks of
words: seats of a Sainte-Lague apportionment among sources, then among each source's shards (hash classes of its rows
of a bounded expected size).  A block has at most `block` words, and so few that the smallest target has GRAIN of them.
Within a shard the rows form a stream in seeded order, which is cut into blocks; a quota of q words takes whole passes
over the stream and then blocks in a seeded order of their own, the last one in part.  A row is taken as often as there
are passes, plus what of it lies in the chosen blocks.

Null sources form a source of their own, ordered last; null and empty texts have size 0 and are never taken.  Ties of
the seeded order are broken by key and text, so that reruns agree; repeated rows count apart.  No text moves: only
numbers do.  Sources are numbered, filled and given seats by aggregations, however many there are, and a task holds one
source's shards or one shard's rows (those of one key and text share a shard).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, prepare, staged
from .common import mix as mixed

WEIGHTS = (3.0, 1.0, 2.0)
WORDS = r"[^\x20\x09-\x0D]+"
#: Words of a block at most, blocks of the smallest target at least, and words of a shard in expectation.
BLOCK, GRAIN, SHARD = 4096, 64, 1_000_000
#: Prices that one aggregation tries, and quotients that are ranked one by one.
PROBES, RANKED = 32, 100_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of `total` by weight, none above `cap` times its size; the excess is reshared among the others."""
    limit, target = sizes * cap, np.zeros(len(sizes))
    open_, left = sizes > 0, float(total)
    while open_.any() and left > 0:
        share = left * weights / weights[open_].sum()
        full = open_ & (share >= limit)
        if not full.any():
            target[open_] = share[open_]
            break
        target[full] = limit[full]
        left -= float(limit[full].sum())
        open_ &= ~full
    return target


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1); ties go to the first.

    A party has a seat for each quotient that reaches the price of the last seat, so the price is found by bisection
    and the few seats about it are settled one by one: the work doesn't grow with the number of seats.
    """
    votes = np.asarray(votes, float)
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)
    given = lambda price: np.floor(votes / price / 2 + 0.5).astype(np.int64)  # noqa: E731  quotients >= price
    lo, hi = votes.sum() / (2.0 * (seats + len(votes) + 1)), 2 * votes.max()
    lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if given(mid).sum() >= seats else (lo, mid)
    out = given(hi)
    while out.sum() < seats:
        out[int(np.argmax(votes / (2 * out + 1)))] += 1
    while out.sum() > seats:
        last = np.where(out > 0, votes / np.maximum(2 * out - 1, 1), np.inf)
        out[len(votes) - 1 - int(np.argmin(last[::-1]))] -= 1
    return out


def filled(sources: DataFrame, volume: float, cap: float) -> DataFrame:
    """`target` of sources (n, weight): what `water_fill` gives, by one aggregation a round."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    left, weight, full = float(volume * total), None, F.lit(False)
    while True:
        open_ = (F.col("n") > 0) & ~full
        spent, now = sources.agg(F.sum(F.when((F.col("n") > 0) & full, F.col("n") * cap)), F.sum(F.when(open_, F.col("weight")))).first()
        left = float(volume * total) - (spent or 0.0)
        if now is None or now == weight or left <= 0:
            break
        weight = now
        full = F.lit(left) * F.col("weight") / F.lit(weight) >= F.col("n") * cap
    share = F.lit(left) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
    return sources.withColumn("target", F.when(F.col("n") <= 0, F.lit(0.0)).when(full, F.col("n") * F.lit(float(cap))).otherwise(share).cast("double"))


def seated(parties: DataFrame, votes: str, order: str, seats: int) -> DataFrame:
    """`seats` of parties by the highest quotients votes / (2k + 1), ties to the first: what `sainte_lague` gives, for
    any number of parties.

    Each aggregation tries PROBES prices; the price's bounds close in until few quotients lie between them, and these
    are ranked.
    """
    v = F.col(votes)
    given = lambda price: F.when(v > 0, F.floor(v / price / 2 + 0.5)).otherwise(F.lit(0)).cast("long")  # noqa: E731  quotients >= price
    count, total, most = parties.where(v > 0).agg(F.count("*"), F.sum(v), F.max(v)).first()
    if seats <= 0 or not count:
        return parties.withColumn("seats", F.lit(0).cast("long"))
    lo, hi = total / (2.0 * (seats + count + 1)) / 2, 2.0 * most
    while True:
        prices = np.geomspace(lo, hi, PROBES + 2)[1:-1] if hi > 1.1 * lo else np.linspace(lo, hi, PROBES + 2)[1:-1]
        at = parties.agg(F.sum(given(F.lit(lo))), F.sum(given(F.lit(hi))), *(F.sum(given(F.lit(float(p)))) for p in prices)).first()
        if at[0] - at[1] <= RANKED:
            break
        before = lo, hi
        for p, n in zip(prices, at[2:]):
            if n >= seats:
                lo = max(lo, float(p))
            else:
                hi = min(hi, float(p))
        if (lo, hi) == before:
            break  # the prices are as close as numbers are: the rest are ties
    sure = parties.withColumn("sure", given(F.lit(hi)))
    asked = sure.where(given(F.lit(lo)) > F.col("sure")).select(order, v.alias("v"), F.explode(F.sequence(F.col("sure"), given(F.lit(lo)) - 1)).alias("k"))
    last = asked.orderBy((F.col("v") / (2 * F.col("k") + 1)).desc(), order).limit(int(seats - at[1])).groupBy(F.col(order).alias("_o")).agg(F.count("*").alias("more"))
    return sure.join(last, F.col(order) == F.col("_o"), "left").withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0))).drop("sure", "more", "_o")


def quotas(words: np.ndarray, seats: int, block: int, cap: float) -> np.ndarray:
    """Words that each shard of a source is to give: seats of a block each, none above `cap` times the shard's words;
    what shards can't take goes to the highest quotients of the others, and at last word by word to the first."""
    limit = np.floor(cap * words).astype(np.int64)
    if len(words) == 1:
        return np.minimum(int(seats) * block, limit)
    most, out = limit // block, np.zeros(len(words), np.int64)
    left, open_ = int(seats), most > 0
    while left > 0 and open_.any():
        given = sainte_lague(np.where(open_, words, 0).astype(float), int(out[open_].sum()) + left)
        over = open_ & (given >= most)
        if not over.any():
            out[open_], left = given[open_], 0
            break
        left -= int((most[over] - out[over]).sum())
        out[over] = most[over]
        open_ &= ~over
    out = out * block
    room, rest = limit - out, int(max(left, 0)) * block
    return out + np.clip(rest - (np.cumsum(room) - room), 0, room)


def chosen(size: np.ndarray, quota: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words taken of each row of a stream, and how often each row is taken as a whole (by the word in its middle)."""
    total = int(size.sum())
    if not total:
        return np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    passes, rest = divmod(int(quota), total)
    count = -(-total // block)
    length = np.full(count, block, np.int64)
    length[-1] = total - (count - 1) * block
    order = np.argsort(mixed(np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)), kind="stable")
    part = np.zeros(count, np.int64)
    part[order] = np.clip(rest - (np.cumsum(length[order]) - length[order]), 0, length[order])
    before = np.concatenate([[0], np.cumsum(part)])
    upto = lambda x: before[x // block] + np.minimum(x % block, np.append(part, 0)[x // block])  # noqa: E731  chosen words before a place
    end = np.cumsum(size)
    middle = np.minimum(end - size + size // 2, total - 1)
    return passes * size + upto(end) - upto(end - size), (passes + (middle % block < part[middle // block])) * (size > 0)


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, volume: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 8) -> DataFrame:
    """`key`, size, source_size, target and taken (words, repeats counted) of each row, and copies: how often the mix
    has the row if rows are taken whole."""
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[key]
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = staged(df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), words.alias("size"), F.xxhash64(text).alias("_tie")).withColumn("_draw", F.xxhash64("_key", F.lit(seed))))
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("n"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    sources = staged(filled(staged(numbered(sizes, [F.col("_source").asc_nulls_last()], "_at", 0).withColumn("weight", weight)), volume, cap))
    least, whole, total = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("target"), F.sum("n")).first()
    block = max(1, min(block, int((least or 0) / GRAIN)))
    plan = seated(sources, "target", "_at", round((whole or 0) / block)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / shard)).cast("long"))
    plan = staged(plan.select(F.col("_source").alias("_name"), "_at", F.col("n").alias("source_size"), "target", "seats", "shards"))
    rows = staged(rows.join(plan, F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_shard", F.pmod("_draw", "shards")).drop("_source", "_name", "shards"))
    shards = rows.where("size > 0").groupBy("_at", "_shard", "seats").agg(F.sum("size").alias("words"))

    # Small sources and shards share tasks, so that each holds some SHARD words.
    tasks = F.lit(max(1, -(-int(total or 0) // shard)))

    def groups(pdf: pd.DataFrame, columns: list[str]):
        """Bounds of the stretches of rows that agree in `columns`."""
        new = (pdf[columns] != pdf[columns].shift()).any(axis=1).to_numpy()
        at = np.append(np.flatnonzero(new), len(pdf))
        return zip(at[:-1].tolist(), at[1:].tolist())

    def dealt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_shard"])
        words, seats, out = pdf["words"].to_numpy(), pdf["seats"].to_numpy(), np.zeros(len(pdf), np.int64)
        for a, b in groups(pdf, ["_at"]):
            out[a:b] = quotas(words[a:b], int(seats[a]), block, cap)
        return pdf[["_at", "_shard"]].assign(_quota=out)

    held = staged(shards.groupBy(F.pmod(F.xxhash64("_at"), tasks)).applyInPandas(dealt, "_at long, _shard long, _quota long"))
    streams = rows.where("size > 0").join(held, ["_at", "_shard"])

    def taken(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", "_shard", "_draw", "_key", "_tie", "size"], kind="stable")
        at, own, quota, size = (pdf[c].to_numpy(np.int64) for c in ("_at", "_shard", "_quota", "size"))
        words, copies = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for a, b in groups(pdf, ["_at", "_shard"]):
            words[a:b], copies[a:b] = chosen(size[a:b], int(quota[a]), block, ((int(at[a]) * 1_000_003 + int(own[a])) * 1_000_003 + seed) & (1 << 63) - 1)
        return pdf[["_key", "size", "source_size", "target"]].assign(taken=words, copies=copies)

    schema = f"_key {kind}, size long, source_size long, target double, taken long, copies long"
    out = streams.groupBy(F.pmod(F.xxhash64("_at", "_shard"), tasks)).applyInPandas(taken, schema)
    empty = rows.where("size = 0").select("_key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return out.unionByName(empty).withColumnRenamed("_key", key)


def repeat(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix as rows: each row as often as the mix takes it whole.  Rows that repeat a key share its copies evenly."""
    columns, own, times, copy = df.columns, *(fresh(df, x) for x in ("_k", "_times", "_copy"))
    taken = mix(df, text, source, key, **options).groupBy(key).agg(F.count("*").alias("n"), F.sum("copies").alias("t"))
    counts = staged(taken.select(F.col(key).alias(own), F.floor(F.col("t") / F.col("n") + 0.5).cast("int").alias(times)).where(F.col(times) > 0))
    joined = df.join(counts, F.col(key).eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns)
