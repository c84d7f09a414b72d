import pytest

from emberlog.lang.errors import QueryError
from emberlog.operators import legacy, metadata


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("from main timeout | keep id", [(2,), (6,)]),
        ('from main "connection reset" | keep id', [(4,)]),
        ("from main | where ms > 10 | keep id", [(1,), (2,), (5,)]),
        ("from main | where not (ms > 10) | keep id", [(4,), (6,)]),
        ("from main | head 2 | keep id", [(1,), (2,)]),
        ("from main | tail 2 | keep id", [(5,), (6,)]),
        ("from main | sort -ms | keep id | head 3", [(3,), (2,), (5,)]),
        ("from main | sort ms | keep id | tail 2", [(2,), (3,)]),
        ("from main | sort level, -id | keep id", [(2,), (6,), (3,), (1,), (5,), (4,)]),
        ("from main | dedup service | sort id | keep id", [(1,), (3,), (6,)]),
        ("from main | explode tags as tag | keep id, tag", [(1, "a"), (1, "b"), (3, "c"), (5, "a"), (6, "d"), (6, "e")]),
        ("from main | stats count() as n, count(level) as l by service | sort service", [("api", 3, 3), ("web", 2, 1), (None, 1, 1)]),
        ("from main | where id > 9 | stats count(), sum(ms)", [(0, None)]),
        ("from main | stats first(level) as f, last(level) as l, list(id) as i", [("INFO", "INFO", [1, 2, 3, 4, 5, 6])]),
        ("from main | sort -id | stats first(id) as f, list(id) as i", [(6, [6, 5, 4, 3, 2, 1])]),
        ("from main | sort -level, id | stats list(id) as i", [([4, 5, 1, 3, 6, 2],)]),
        ("from main | stats count(where status >= 400) as bad, sum(ms, where level == \"INFO\") as s", [(2, 13.0)]),
        ("from main | streamstats window=2 sum(id) as s | keep s", [(1,), (3,), (5,), (7,), (9,), (11,)]),
        ("from main | streamstats current=false last(id) as p by service | sort id | keep p", [(None,), (1,), (None,), (3,), (2,), (None,)]),
        ("from main | eventstats max(id) as m by service | keep id, m", [(1, 5), (2, 5), (3, 4), (4, 4), (5, 5), (6, 6)]),
        ("from main | extend a = 7 / 2, b = -7 / 2, c = 1 / 0, d = 7 % 0, e = 7.0 / 2 | head 1 | keep a, b, c, d, e", [(3, -3, None, None, 3.5)]),
        ("from main | extend a = nothing.x ?? 5, b = tags[-1], c = tags[9], d = len(tags) | head 1 | keep a, b, c, d", [(5, "b", None, 2)]),
        ("from main | where is_null(level) or is_missing(nope) and id == 1 | keep id", [(1,), (4,)]),
        ("from main | stats count() as n by bin(_time, 30m) | keep n", [(3,), (2,), (1,)]),
        ("from main | keep id | union [from main | where id == 1 | keep level] | tail 2", [(6, None), (None, "INFO")]),
        ("from main | keep id, service | join type=outer on id with [from main | where id > 4 | extend id = id + 1 | keep id, level] | stats count() as n, count(level) as l", [(7, 2)]),
        ("from main | sessionize maxpause=10m | sort id | keep id, _session_id", [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)]),
        ("from main | transaction service maxspan=10m | sort _time, service | keep service, eventcount", [("api", 2), ("web", 1), ("api", 1), ("web", 1), (None, 1)]),
        ("from main | correlate id ms | keep _n", [(5,)]),
        ("from main | xyseries service level id | sort service | keep service, INFO", [("api", 1), ("web", 3), (None, 6)]),
        ("from main | describe | where field == \"level\" | keep type, coverage, distinct_est, top_values", [("string", 5 / 6, 3, ["INFO(3)", "ERROR(1)", "WARN(1)"])]),
        ("from main | rollup 1h, 1d | keep _resolution, count", [("1h", 5), ("1h", 1), ("1d", 6)]),
        ("from main | outliers field=ms threshold=1 | where _outlier | keep id", [(2,)]),
    ],
)
def test_rows(engine, text, want):
    assert rows(engine.query(text)) == want


@pytest.mark.parametrize(
    "text, code",
    [
        ('from main | where status == "500"', "S002"),
        ("from main | extend a = level + 1", "S003"),
        ("from main | where status", "S004"),
        ("from main | where count() > 1", "S005"),
        ("from main | extend a = lenn(level)", "S006"),
        ("from main | extend a = lower()", "S007"),
        ("from main | join on nope with [from main]", "S008"),
        ("from nowhere", "S010"),
        ("from $x", "S011"),
        ("from main | stats sum(level)", "S003"),
        ("from main | explode level", "S003"),
    ],
)
def test_meaning_is_checked_before_spark_runs(engine, text, code):
    with pytest.raises(QueryError) as e:
        engine.query(text)
    assert e.value.code == code


def test_strict_fields_and_warnings(engine):
    found = engine.run("from main | where levle == \"x\"")
    assert "level" in found.warnings[0]
    engine.strict_fields = True
    with pytest.raises(QueryError) as e:
        engine.run("from main | keep levle")
    assert e.value.code == "S001"


def test_strict_casts_fail_the_query(engine):
    assert rows(engine.query("from main | extend a = int(level) | head 1 | keep a")) == [(None,)]
    with pytest.raises(Exception, match="can't convert"):
        engine.query("from main | extend a = int!(level) | keep a").collect()


def test_compare_moves_the_window(engine):
    from datetime import datetime, timezone

    now = datetime(2024, 1, 1, 1, 0, tzinfo=timezone.utc)
    got = rows(engine.query("from main[-30m] | stats count() as n by service | compare previous 30m | sort service", now))
    assert got == [("api", 1, 2, -1), ("web", 1, 1, 0)]


def test_plans_push_down_and_prune(spark, engine, tmp_path):
    path = str(tmp_path / "t")
    engine.query("from main | drop tags").write.parquet(path)
    engine.catalog.add_parquet("t", path, order=["id"])
    plan = engine.explain("from t | where status >= 500 | stats count() as n by service")
    assert "GreaterThanOrEqual(status,500)" in plan and "ReadSchema: struct<service:string,status:bigint>" in plan
    plan = engine.explain("from t | sort -ms | head 3 | keep id")
    assert "TakeOrderedAndProject" in plan and "level" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_fluent_frames(engine, spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, k string")
    got = engine.frame(df, order=["id"]).where("id > 1").stats("count() as n by k").sort("k").df
    assert rows(got) == [("a", 1), ("b", 1)]


def test_tee_writes_rows(spark, tmp_path):
    from emberlog.engine import Engine

    e = Engine(spark, tee=True).source("main", spark.range(3), order=["id"])
    assert e.query(f'from main | tee "{tmp_path}/out" | stats count() as n').collect()[0].n == 3
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    with pytest.raises(QueryError):
        Engine(spark).source("main", spark.range(3)).query('from main | tee "/nowhere"')


def test_trace_draws_trees(spark):
    from emberlog.engine import Engine

    data = [("t1", "a", "", "gw", "root", 10), ("t1", "b", "a", "db", "get", 4), ("t1", "c", "a", "db", "put", 5), ("t1", "d", "b", "io", "read", 1), ("t1", "e", "gone", "x", "y", 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "n long, trace_id string, span_id string, parent_id string, service string, operation string, duration_ms long").selectExpr("*", "timestamp_seconds(n) as _time")
    got = rows(Engine(spark).source("main", df, order=["n"]).query("from main | trace | keep _span_depth, _span_tree"))
    assert got == [(0, "gw.root [10ms]"), (1, "├── db.get [4ms]"), (2, "│   └── io.read [1ms]"), (1, "└── db.put [5ms]"), (0, "x.y [2ms]")]


def test_patterns_merge_similar_messages(spark):
    from emberlog.engine import Engine

    lines = [f"user u{i} logged in after {i} ms" for i in range(20)] + ["disk full on /dev/sda1"] * 3
    e = Engine(spark).source("main", spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n long, _raw string"), order=["n"])
    got = rows(e.query("from main | patterns"))
    assert got == [("user <*> logged in after <*> ms", 20, 86.96, lines[0]), ("disk full on /dev/sda1", 3, 13.04, "disk full on /dev/sda1")]


def test_legacy_operators(engine):
    f = engine.run("from main | keep id, service, ms").frame
    assert rows(legacy.fillnull(f, "0", ["ms"]).output())[2] == (3, "web", 0.0)
    assert rows(legacy.reverse(f).output())[0][0] == 6
    assert rows(legacy.untable(engine.run("from main | head 1 | keep id, ms, status").frame, "id", "k", "v").output()) == [(1, "ms", "12.0"), (1, "status", "200")]
    both = legacy.appendcols(f, engine.run("from main | where id > 4 | keep level").frame)
    assert [r[3] for r in sorted(rows(both.output()))] == ["WARN", "INFO", None, None, None, None]
    combined = legacy.mvcombine(engine.run("from main | keep service, id").frame, "id").output()
    assert sorted(rows(combined), key=str) == [("api", [1, 2, 5]), ("web", [3, 4]), (None, [6])]
    packed = legacy.pack_json(f, ["id", "service"]).output().first()
    assert packed["_raw"] == '{"id":1,"service":"api"}'
    split = legacy.makemv(engine.run('from main | extend c = "a,b" | head 1 | keep c').frame, "c")
    assert rows(split.output()) == [(["a", "b"],)] and rows(legacy.nomv(split, "c", "+").output()) == [("a+b",)]


def test_metadata(engine):
    df = engine.query("from main")
    assert rows(metadata.histogram(df, 3_600_000_000).orderBy("bucket"))[0][1] == 5
    assert rows(metadata.field_values(df, "level"))[0] == ("INFO", 3, 60.0)
    assert {r.field: r.present for r in metadata.field_catalog(df).collect()}["ms"] == 5
    assert [r.name for r in metadata.sources(engine.catalog).collect()] == ["main"]
