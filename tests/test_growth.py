"""What a task holds or calls mustn't grow beside the input."""

import random
import re

import pyarrow as pa
import pytest


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("stage", ["stats", "eventstats"])
def test_sketches_are_not_kept_beside_each_distinct_value(engine, stage):
    aggs = "dc(id) as d, estdc(id) as e, count() as n, max(ms) as m, estdc(level, where id > 1) as l"
    for by, want in (("service", {("api", 3, 3, 3, 90.0, 2), ("web", 2, 2, 2, 7.0, 1), (None, 1, 1, 1, 1.0, 1)}), ("", {(6, 6, 6, 90.0, 3)})):
        df = engine.query(f"from main | {stage} {aggs}" + (" by service" if by else "") + f" | keep {by + ', ' if by else ''}d, e, n, m, l")
        assert set(rows(df)) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        held = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[[^\]]*approx_count_distinct", plan)
        assert held and {k.count("#") for k in held} == {1 if by else 0}


def test_sketches_beside_distinct_counts_of_no_rows_and_of_maps(spark, engine):
    from emberlog.engine import Engine

    assert rows(engine.query("from main | where id > 9 | stats dc(id) as d, estdc(id) as e, max(ms) as m")) == [(0, 0, None)]
    assert rows(engine.query("from main | where id > 9 | stats dc(id) as d, estdc(id) as e by service")) == []
    df = spark.sql("select id as n, map('a', id % 2) as k, cast(if(id % 2 = 0, -0.0, 0.0) as double) as z from range(6)")
    e = Engine(spark).source("main", df, order=["n"])
    assert sorted(r[1:] for r in rows(e.query("from main | stats dc(n) as d, estdc(n) as e by k"))) == [(3, 3), (3, 3)]
    assert rows(e.query("from main | stats dc(n) as d, estdc(n) as e by z | keep d, e")) == [(6, 6)]


def trees(spans):
    """(trace, depth, branch) of (n, trace, span, parent, name, ms), trace by trace."""
    out = []
    for t in sorted({s[1] for s in spans if s[1]}):
        mine = [s for s in spans if s[1] == t]
        known, seen = {s[2] for s in mine if s[2]}, set()

        def draw(span, depth, lead, mark, inner, t=t, mine=mine, known=known, seen=seen):
            if span[0] in seen:
                return
            seen.add(span[0])
            name = (span[4] or f"span:{(span[2] or '')[:8]}") + (f" [{span[5]:.0f}ms]" if span[5] is not None else "")
            out.append((t, depth, lead + mark + name))
            below = [s for s in mine if span[2] and s[3] == span[2]]
            for s in below:
                last = s is below[-1]
                draw(s, depth + 1, inner, "└── " if last else "├── ", inner + ("    " if last else "│   "))

        for s in mine:
            if not (s[3] and s[3] in known):
                draw(s, 0, "", "", "")
        for s in mine:
            draw(s, 0, "", "", "")
    return out


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_traces_are_drawn_in_one_call_a_task(spark, small_batches, seed):
    from emberlog.engine import Engine

    rng, spans = random.Random(seed), []
    for n in range(120):
        t = rng.choice(["a", "b", "b", "b", "c", *(f"t{i}" for i in range(25)), "", None])
        spans.append((n, t, rng.choice([f"s{n}", f"s{n}", f"s{n}", f"s{rng.randrange(120)}", "", None]), rng.choice([f"s{rng.randrange(120)}", f"s{max(0, n - 5)}", "", None]), rng.choice(["get", "put", None]), rng.choice([1.0, 12.6, None])))
    schema = "n long, trace_id string, span_id string, parent_id string, operation string, duration_ms double"
    shuffled = rng.sample(spans, len(spans))
    df = spark.createDataFrame(shuffled, schema).selectExpr("*", "timestamp_seconds(n div 2) _time")
    got = Engine(spark).source("main", df, order=["n"]).query("from main | trace")
    assert [(r.trace_id, r._span_depth, r._span_tree) for r in got.collect()] == trees(spans)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def plainly_merged(lines, similarity):
    """{pattern: (count, least example)}, and how many lines have a pattern."""
    counts = {}
    for x in lines:
        parts = re.split(r"[ \t\n\x0b\f\r]+", x or "")
        p = " ".join("<*>" if re.fullmatch(r"\d+", t) else t for t in parts if t)
        if p:
            n, e = counts.get(p, (0, x))
            counts[p] = (n + 1, min(e, x))
    groups = {}
    for p, (n, e) in sorted(counts.items(), key=lambda x: (-x[1][0], x[0])):
        parts = p.split(" ")
        templates = groups.setdefault((len(parts), parts[0]), [])
        scores = [sum(x == y or x == "<*>" for x, y in zip(t[0], parts)) / len(parts) for t in templates]
        if scores and max(scores) >= similarity:
            t = templates[scores.index(max(scores))]
            t[:] = [x if x == y else "<*>" for x, y in zip(t[0], parts)], t[1] + n, min(t[2], e)
        else:
            templates.append([parts, n, e])
    out = {}
    for t in (t for g in groups.values() for t in g):
        had = out.get(" ".join(t[0]), (0, t[2]))
        out[" ".join(t[0])] = (had[0] + t[1], min(had[1], t[2]))
    return out, sum(n for n, _ in counts.values())


@pytest.mark.parametrize("seed, similarity", [(0, 0.4), (1, 0.6), (2, 0.75), (3, 1.0)])
def test_messages_are_merged_in_one_call_a_task(spark, small_batches, seed, similarity):
    from emberlog.engine import Engine

    rng = random.Random(seed)
    lines = [rng.choice([" ", "", "\t", "  "]) + rng.choice([" ", "  ", "\n"]).join(rng.choice(["a", "b", "c", "é", "<*>", "12", "7", "\U0001f600", "\uffee", "\u00a0"]) for _ in range(rng.choice([0, 1, 2, 4, 4, 5]))) for _ in range(400)] + [None]
    lines += [f"single{i}" for i in range(60)]
    e = Engine(spark).source("main", spark.createDataFrame(list(enumerate(lines)), "n long, _raw string"), order=["n"])
    got = e.query(f"from main | patterns similarity={similarity} max_templates=100000")
    want, total = plainly_merged(lines, similarity)
    found = rows(got)
    assert {p: (n, x) for p, n, _, x in found} == want and len(found) == len(want)
    assert [(-n, p) for p, n, _, _ in found] == sorted((-n, p) for p, n, _, _ in found)
    assert all(abs(r - 100 * n / total) <= 0.00501 for _, n, r, _ in found)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1
    # Masked messages are made once: the total doesn't mask them again.
    assert plan.count("functions=[partial_count(1), partial_min(line") == 1


@pytest.mark.parametrize("seed, words, similarity", [(0, 3, 0.6), (1, 12, 0.5), (2, 40, 0.4), (3, 40, 0.9), (4, 12, 1.1), (5, 12, 0.0)])
def test_templates_found_by_their_rare_tokens_are_those_of_all(seed, words, similarity):
    from emberlog.operators.helpers import merged

    rng = random.Random(seed)
    tokens = ["<*>", *(f"w{i}" for i in range(words))]
    lines = sorted({" ".join(["h", *(rng.choice(tokens) for _ in range(6))]) for _ in range(400)})
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array([1] * len(x)), pa.array(x)], ["pattern", "count", "example"]) for x in (lines[:150], lines[150:])]
    got = [r for b in merged(iter(batches), similarity) for r in b.to_pylist()]
    assert {r["pattern"]: (r["count"], r["example"]) for r in got} == plainly_merged(lines, similarity)[0]


def test_a_message_meets_few_of_many_unlike_templates():
    from emberlog.operators.helpers import Templates

    group = Templates(0.4, 8)
    for i in range(500):
        group.add(["h", *(f"w{i * 7 % 500 + j}" for j in range(7))], 1, "x")
    assert len(group.counts) == 500
    assert len(group.table[group.close([group.codes[t] for t in ["h", *(f"w{70 + j}" for j in range(7))]])]) < 20
