"""Random filters, groupings and windows against DuckDB, and the registered queries against their SQL."""

import datetime
import decimal
import os
import random

import pytest

from emberlog import queries as core

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{round(float(x), 5) + 0.0:.5f}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def same(df, sql):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = db.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = sorted(tuple(plain(r[i]) for i in sorted(range(len(names)), key=names.__getitem__)) for r in cur.fetchall())
    mine = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert mine == theirs


def some_predicate(rng, depth=2):
    if depth and rng.random() < 0.6:
        op = rng.choice(["and", "or"])
        a, b = some_predicate(rng, depth - 1), some_predicate(rng, depth - 1)
        return f"({a[0]} {op} {b[0]})", f"({a[1]} {op} {b[1]})"
    if rng.random() < 0.2:
        a = some_predicate(rng, depth - 1 if depth else 0)
        return f"not {a[0]}", f"not {a[1]}"
    kind = rng.randrange(4)
    if kind == 0:
        op, n = rng.choice(["<", "<=", ">", ">="]), rng.randint(0, 150)
        return f"value {op} {n}", f"value {op} {n}"
    if kind == 1:
        v = rng.choice(["click", "view", "error", "none"])
        return f'event_type == "{v}"', f"event_type = '{v}'"
    if kind == 2:
        n = sorted(rng.sample(range(20), 3))
        return f"user_id in [{', '.join(map(str, n))}]", f"user_id in ({', '.join(map(str, n))})"
    a, m = rng.randint(0, 6), rng.randint(1, 7)
    return f"event_id % {m} == {a}", f"event_id % {m} = {a}"


@pytest.mark.parametrize("seed", range(12))
def test_random_aggregates(spark, seed):
    rng = random.Random(seed)
    ours, theirs = some_predicate(rng)
    inner, inner_sql = some_predicate(rng, 1)
    keys = rng.choice([["event_type"], ["user_id"], ["event_type", "user_id"], []])
    by = f" by {', '.join(keys)}" if keys else ""
    text = f"from events | where {ours} | stats count() as n, count(where {inner}) as c, sum(value) as s, min(value) as lo, dc(user_id) as u, p90(value) as p{by}"
    select = ", ".join([*keys, "count(*) AS n", f"count(*) FILTER ({inner_sql}) AS c", "sum(value) AS s", "min(value) AS lo", "count(DISTINCT user_id) AS u", "quantile_cont(value, 0.9) AS p"])
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    same(core.engine(spark, SF).query(text), f"SELECT {select} FROM events WHERE {theirs}{group}")


@pytest.mark.parametrize("seed", range(6))
def test_random_windows(spark, seed):
    rng = random.Random(seed)
    n, current = rng.choice([0, 1, 3, 8]), rng.random() < 0.5
    hi = 0 if current else 1
    lo = "UNBOUNDED" if not n else str(n - 1 if current else n)
    frame = f"ROWS BETWEEN {lo} PRECEDING AND {'CURRENT ROW' if not hi else '1 PRECEDING'}"
    text = f"from events | streamstats window={n} current={str(current).lower()} count() as n, sum(value) as s, max(value) as m by event_type | keep event_id, n, s, m"
    w = f"WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id {frame})"
    same(core.engine(spark, SF).query(text), f"SELECT event_id, count(*) OVER w AS n, sum(value) OVER w AS s, max(value) OVER w AS m FROM events {w}")


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_registered_queries(spark, name):
    same(core.queries()[name](spark, SF), core.SQL[name])
