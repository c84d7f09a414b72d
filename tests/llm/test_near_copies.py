"""The pipeline's near-dedup stage on planted near copies, against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from emberlog.llm import resemble  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """The least key of each row's group."""
    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and similar(sets[a], sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def planted():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts, passage = [], prose(40)
    for n in (3, 5, 6, 9, 30, 100, 400):
        base = prose(n)
        for share in (0.0, 0.01, 0.02, 0.025, 0.03, 0.05):
            words = [w if rng.random() >= share else "X" + w for w in base]
            texts += [" ".join(words), "  ".join(words).upper()]
    base = prose(120)
    for _ in range(40):  # one large group of near copies, some of which only others link
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 5])):
            words[at] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [" ".join(passage + prose(rng.choice([1, 3, 8, 40]))) for _ in range(40)]
    texts += [" ".join(passage)] * 9 + ["", None, " \n", "one", "two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("dense, share", [(3, 64), (24, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, dense, share):
    """Whatever is dense, and whatever order the shingles are put in."""
    monkeypatch.setattr(resemble, "SHARE", share)
    rows = planted()
    got = {r.doc_id: r.component for r in resemble.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), dense=dense).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) < len(rows) - 60


def test_stage_thins_near_copies(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(200)]
    near = [*words[:100], "edited", *words[101:]]  # 191 of 201 five-word shingles are shared
    far = [w if i % 12 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", f"s{i}", 1) for i, w in enumerate([words, near, far])] + [(None, " ".join(words), "en", "s", 1)], SCHEMA)
    kept = pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 2), (True, None)]


def test_parity_bits_bound_what_sets_differ_in():
    rng = np.random.default_rng(4)
    for n, m in ((0, 3), (1, 1), (60, 70), (900, 1000), (5000, 4100)):
        x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        y = np.unique(np.concatenate([x[: int(0.85 * n)], y[: m - int(0.85 * n)]]))
        bits = [resemble.bits_apart(resemble.wide_parity(a), resemble.wide_parity(b)) for a, b in ((x, y), (y, x))]
        apart = len(np.setxor1d(x, y))
        assert bits[0] == bits[1] and 0.75 * apart <= bits[0] <= apart


@pytest.mark.parametrize("stretch", [256, 2])
def test_long_texts_below_the_threshold_are_told_without_their_sets(spark, monkeypatch, stretch):
    rng, sent, staged = random.Random(6), [], resemble.staged
    monkeypatch.setattr(resemble, "STRETCH", stretch, raising=False)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base[:2480] + [f"t{i}x{j}" for j in range(520)]) for i in range(7)]
    texts += [texts[0] + " end", texts[0] + " of it", texts[0][3:]]
    rows = list(enumerate(texts, 1))

    def told(df):
        out = staged(df)
        for name, kind in df.dtypes:
            if name != "marks" and (kind == "binary" or kind == "array<bigint>"):
                size = F.length(name) if kind == "binary" else 8 * F.size(name)
                sent.append(out.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(resemble, "staged", told)
    got = {r.doc_id: r.component for r in resemble.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), dense=3).collect()}
    assert got == brute(rows) and len(set(got.values())) == 7
    assert 0 < max(sent) <= len(rows) * 3000  # whole sets have 8 bytes for each of some 3000 shingles


def test_least_reached_is_the_least_node_of_each_component():
    rng = np.random.default_rng(4)
    for nodes, links in ((1, 1), (50, 20), (50, 60), (3000, 2500), (3000, 2999)):
        a, b = rng.integers(-nodes, nodes, (2, links)) if links != nodes - 1 else np.array([np.arange(nodes - 1), np.arange(1, nodes)])
        root = {}

        def top(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            low, high = sorted((top(x), top(y)))
            root[high] = low
        got = dict(zip(*(c.tolist() for c in resemble.least_reached(a, b))))
        assert got == {x: top(x) for x in root}


def tasks_of(spark, name, run):
    """What `run` returns, and how many tasks Spark ran for it."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_few_links_take_few_tasks(spark):
    """A table of links that one task can deal with isn't dealt out."""
    links = [(i, i + 7) for i in range(300) if i % 50 < 40]
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame(links, "a long, b long")
        found, tasks = tasks_of(spark, "few links", lambda: resemble._upward(edges).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = resemble.least_reached(*np.array(links).T)
    assert sorted((r.node, r.root) for r in found) == sorted(zip(*(c.tolist() for c in want)))
    assert 0 < tasks < 24
