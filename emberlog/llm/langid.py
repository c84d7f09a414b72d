"""Language ID (operator 7): sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learnt by follow-the-regularised-leader with elastic-net penalties, then divided by a temperature that
minimises the log loss of rows set aside.  Document frequencies come from all rows that may be learnt from; the weights
from a bounded, hash-chosen sample (about `per_lang` rows of each language).  Every row is predicted from its whole text.

A text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn from.
Repeated rows are predicted alike and count as often as they stand; of equal likelihoods the first language by code
point wins.  Texts are looked at one by one, with some 60 times a text's size at hand.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, prepare

BITS = 16
ORDERS = 3
#: Rows of each language that the weights are learnt from, in expectation.
PER_LANG = 600
LETTER = re.compile(r"[^\W\d_]").search


def gram_counts(text: str, bits: int = BITS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the hashed character n-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, found = np.uint32(32 - bits), [np.zeros(0, np.uint32)]
    gram = np.zeros(len(points), np.uint32)
    for n in range(1, orders + 1):
        if len(points) < n:
            break
        gram = (gram[: len(points) - n + 1] + np.uint32(n)) * np.uint32(0x01000193) ^ points[n - 1 :] * np.uint32(0x9E3779B1)
        found.append(gram * np.uint32(0x85EBCA6B) >> shift)
    every = np.concatenate(found)
    if len(every) < 1 << 13:
        ids, counts = np.unique(every, return_counts=True)
        return ids.astype(np.int64), counts
    total = np.bincount(every, minlength=1 << bits)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def tfidf(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[ids]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


class Ftrl:
    """Multinomial FTRL-proximal: per-coordinate rates, L1 and L2 penalties."""

    def __init__(self, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))  # the intercept is last

    def weights(self, ids) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        ids, values = np.append(ids, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(ids)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g

    def final(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that minimises the mean log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray | None, weights: np.ndarray | None, t: float):
        self.langs, self.idf, self.weights, self.t = langs, idf, weights, t

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER(text):
            return "und", 0.0
        ids, counts = gram_counts(text)
        p = softmax((tfidf(ids, counts, self.idf) @ self.weights[ids] + self.weights[-1]) / self.t)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 3, seed: int = 11) -> Model:
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], int)
    values = [tfidf(ids, counts, idf) for ids, counts in rows]
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    learner, rng = Ftrl(len(langs), len(idf)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~aside)):
            learner.learn(rows[i][0], values[i], int(y[i]))
    w = learner.final()
    held = np.flatnonzero(aside)
    logits = np.array([values[i] @ w[rows[i][0]] + w[-1] for i in held]).reshape(-1, len(langs))
    return Model(langs, idf.astype(np.float32), w.astype(np.float32), temperature(logits, y[held]))


def fit(df: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Learn from the rows where `may_learn` holds and text and lang are not null."""
    spark = prepare(df.sparkSession)
    rows = df.where(may_learn).select(df[key].alias("_key"), df[text].cast("string").alias("_text"), df[lang].cast("string").alias("_lang")).where("_text is not null and _lang is not null")

    def document_frequencies(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in by_bytes(batches, 0):
            for t in batch.column(0).to_pylist():
                total[gram_counts(t)[0]] += 1
                n += 1
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(total[ids], n))], ["id", "n"])

    found = rows.select("_text").mapInArrow(document_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # 2^BITS + 1 rows at most
    count = dict(zip(found["id"], found["n"]))
    idf = np.log((1 + count.pop(-1, 0)) / (1 + np.zeros(1 << BITS))) + 1
    if not count:
        return Model([], None, None, 1.0)
    ids = np.fromiter(count, np.int64, len(count))
    idf[ids] -= np.log(1 + np.fromiter(count.values(), np.float64, len(count)))
    idf[np.setdiff1d(np.arange(1 << BITS), ids)] = 0
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    # Each language's share of the range of hashes; a language of few rows gives all.
    share = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / v)))))
    draw = F.pmod(F.xxhash64("_key", F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(draw < F.element_at(share, F.col("_lang")))

    def grams(batches):
        for batch in by_bytes(batches, 1):
            got = [gram_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.string()), pa.array([i.astype(np.uint32).tobytes() for i, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())], ["k", "y", "ids", "counts"])

    got = sample.select("_key", "_text", "_lang").mapInArrow(grams, "k string, y string, ids binary, counts binary").toPandas().sort_values(["k", "y", "ids"], kind="stable")
    if not len(got):
        return Model([], None, None, 1.0)
    return fit_rows([(np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(b, np.uint32).astype(float)) for a, b in zip(got["ids"], got["counts"])], got["y"].tolist(), idf)


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `lang_pred` string and `score` double of every row."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # 2^BITS floats for each language
    df = df.select(*keep, df[text].cast("string").alias("_text"))

    def run(batches):
        m = sent.value
        for batch in by_bytes(batches, len(keep)):
            got = [m.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(run, f"{kinds}, lang_pred string, score double")
