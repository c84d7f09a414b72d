"""Quality classifier (operator 1): Naive Bayes support vectors.

Indicators of hashed n-grams are scaled by their class log-count ratios; a linear hinge-loss model is fitted on them by
dual coordinate descent and interpolated with its mean weight.  The n-grams are those of bytes, of words, and of words
told only by which of them are equal ("a b a": patterns of repetition, which hold whatever the words are).  Scores are a
logistic function of the margin.  The fit takes a bounded sample of labelled rows (`per_class` of each class, those of
least hash); every row is scored, on its whole text.

Null and empty texts have no feature but the intercept and are scored like any other.  Rows of other labels than 0 and
1 are not learnt from; of repeated labels of a row the least counts; without both classes every score is the share of
class 1 (0.5 without labels).  Repeated rows are scored alike; those of a sampled key are all learnt from.  Ties of the
sample's hash are broken by key.  Texts are looked at one by one, with some 40 times a text's size at hand.  Columns
other than the key, the text and the label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, mix, prepare, word_hashes, words_of

BITS = 18
#: Words of an n-gram of repetition at most.
REPEATS = 6
ORDERS = (1, 2, 3, 4)
#: Labelled rows of each class that the fit takes at most.
PER_CLASS = 1200


def repetitions(h: np.ndarray, most: int = REPEATS) -> list[np.ndarray]:
    """Codes of the word n-grams of 2 to `most` words by which of their words are equal: each word by how far back in
    the n-gram it stood last, 0 if it didn't."""
    back = np.zeros(len(h), np.int64)
    for d in range(min(most, len(h)) - 1, 0, -1):
        back[d:][h[d:] == h[:-d]] = d
    out = []
    for n in range(2, min(most, len(h)) + 1):
        count = len(h) - n + 1
        code = np.zeros(count, np.int64)
        for i in range(n):
            own = back[i : i + count]
            code = code * most + np.where(own <= i, own, 0)
        out.append(np.unique(code) * (most + 1) + n)
    return out


def features(data: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Sorted ids of the n-grams in a text's bytes."""
    found, shift, top = [], np.uint32(32 - bits), np.uint64(64 - bits)
    wide = data.astype(np.uint32)
    gram = np.zeros(len(data), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(wide) < n:
            break
        gram = gram[: len(wide) - n + 1] * np.uint32(257) + wide[n - 1 :] + np.uint32(1)
        if n in orders:
            found.append((gram * np.uint32(2654435761) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> shift)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    h = word_hashes(data, starts, ends)
    found += [h >> top, mix(h[:-1] * np.uint64(3) + h[1:]) >> top]
    found += [mix(x.astype(np.uint64) + np.uint64(1 << 40)) >> top for x in repetitions(h)]
    if sum(map(len, found)) < 1 << 12:
        return np.unique(np.concatenate([x.astype(np.int64) for x in found]))
    seen = np.zeros(1 << bits, bool)
    for x in found:
        seen[x] = True
    return np.flatnonzero(seen)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each indicator in class 1 over that in class -1."""
    counts = [np.full(dims, alpha) for _ in range(2)]
    for ids, label in zip(rows, y):
        counts[int(label > 0)][ids] += 1
    neg, pos = (c / c.sum() for c in counts)
    return np.log(pos / neg)


def dual_coordinate_descent(rows, values, y: np.ndarray, dims: int, c: float = 1.0, epochs: int = 30, tol: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights, the intercept last, of the hinge-loss linear model on sparse rows (ids, values)."""
    w, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values]) + 1.0
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        worst = 0.0
        for i in order:
            ids, v, label = rows[i], values[i], y[i]
            g = label * (w[ids] @ v + w[dims]) - 1.0
            step = min(max(alpha[i] - g / square[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[ids] += step * label * v
                w[dims] += step * label
                worst = max(worst, abs(step))
        if worst < tol * c:
            break
    return w


class Model:
    """Weights over indicators (log-count ratios folded in), intercept, and the slope of the logistic score."""

    def __init__(self, weights: np.ndarray | None, ratios: np.ndarray | None, bias: float, slope: float):
        self.weights, self.ratios, self.bias, self.slope = weights, ratios, bias, slope

    def score(self, data: np.ndarray) -> float:
        if self.weights is None:
            return self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(data)), -500, 500))))

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratios[ids]
        return float(self.weights[ids] @ r) / max(float(np.sqrt(r @ r)), 1e-12) + self.bias


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, beta: float = 0.5, c: float = 1.0, dims: int = 1 << BITS) -> Model:
    """A model of rows of ids and labels 0 or 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(None, None, float(labels.mean()) if len(labels) else 0.5, 1.0)

    def one(take):
        chosen = [rows[i] for i in take]
        ratios = log_count_ratios(chosen, y[take], dims)
        values = [(v := ratios[ids]) / max(float(np.sqrt(v @ v)), 1e-12) for ids in chosen]
        w = dual_coordinate_descent(chosen, values, y[take], dims, c)
        mean = np.abs(w[:dims]).sum() / max(1, np.count_nonzero(w[:dims]))
        return Model(((1 - beta) * mean + beta * w[:dims]).astype(np.float32), ratios.astype(np.float32), beta * float(w[dims]), 1.0)

    if min((y > 0).sum(), (y < 0).sum()) >= 10:  # the slope, from margins of rows that its weights haven't seen
        part = np.arange(len(rows)) % 5 == 0
        first = one(np.flatnonzero(~part))
        m, t = np.array([first.margin(rows[i]) for i in np.flatnonzero(part)]), y[part]
        slope = min(2.0 ** np.arange(-3, 7), key=lambda a: float(np.logaddexp(0, -a * m * t).mean()))
    else:
        slope = 4.0
    model = one(np.arange(len(rows)))
    model.slope = float(slope)
    return model


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on the rows of `df` that `labels` marks 0 or 1, at most `per_class` of each.

    The sampled keys, at most 2 x per_class, are broadcast; only those rows' features reach the driver.
    """
    spark = prepare(df.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_y"))
    order = [F.xxhash64(key), F.col(key)]
    sample = None
    for v in (0, 1):
        part = marks.where(F.col("_y") == v).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    picked = [(r[0], r[1]) for r in sample.collect()]
    if not picked:
        return Model(None, None, 0.5, 1.0)
    kind = dict(df.dtypes)[key]
    ids = spark.createDataFrame(picked, f"_key {kind}, _y int")
    rows = df.select(df[key].alias("_key"), df[text].cast("string").alias("_text")).join(F.broadcast(ids), "_key")

    def run(batches):
        for batch in by_bytes(batches, 1):
            data, off = flat(batch.column(1))
            got = [features(data[off[i] : off[i + 1]]).astype(np.uint32).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(got, pa.binary())], ["k", "y", "ids"])

    found = rows.select("_key", "_text", "_y").mapInArrow(run, "k string, y int, ids binary").toPandas()
    found["n"] = found["ids"].map(len)
    found = found.sort_values(["k", "n"], kind="stable")
    return fit_rows([np.frombuffer(b, np.uint32).astype(np.int64) for b in found["ids"]], found["y"].to_numpy())


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """`keep` and `out` double in 0 to 1, of every row."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # 2 x 4 x 2^BITS bytes
    df = df.select(*keep, df[text].cast("string").alias("_text"))

    def run(batches):
        m = sent.value
        for batch in by_bytes(batches, len(keep)):
            data, off = flat(batch.column(len(keep)))
            got = np.array([m.score(data[off[i] : off[i + 1]]) for i in range(batch.num_rows)], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(got)], [*keep, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(run, f"{kinds}, {out} double")
