import pytest

from emberlog.engine import Engine
from emberlog.lang.errors import QueryError
from emberlog.plans.views import Views
from emberlog.streaming import live

TABLE = "id long, _time timestamp, service string, ms double"


def events(spark, n=40, start=0):
    return spark.range(start, start + n).selectExpr("id", "timestamp_seconds(1704067200 + id * 60) as _time", "concat('s', id % 3) as service", "cast(id * id % 17 as double) as ms")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


VIEW = "from main | where id >= 0 | stats count() as n, sum(ms) as s, avg(ms) as a, min(ms) as lo, max(ms) as hi, stdev(ms) as sd, estdc(id) as d by service, bin(_time, 5m)"


def test_views_answer_queries(spark, tmp_path):
    e = Engine(spark).source("main", lambda: events(spark), order=["id"])
    views = Views(e, str(tmp_path / "views"))
    plain = Engine(spark).source("main", lambda: events(spark), order=["id"])
    views.create(VIEW, "v")
    for text in (
        "from main | where id >= 0 | stats count() as n, avg(ms) as a, stdev(ms) as sd by service, bin(_time, 5m)",
        "from main | where id >= 0 | stats sum(ms) as s, min(ms) as lo, max(ms) as hi, var(ms) as v, range(ms) as r by service",
        "from main | where id >= 0 | stats count() as n, avg(ms) as a by bin(_time, 10m) | sort -n, _time | head 3",
        "from main | where id >= 0 | stats count() as n",
    ):
        found = e.run(text)
        assert found.query.pipeline.stages[0].name == "viewscan" and 'view "v"' in found.rewrites[-1].after
        assert rows(found.df) == rows(plain.query(text))
    for text in ("from main | stats count() as n", "from main | where id >= 0 | stats count() as n by id", "from main | where id >= 0 | stats p50(ms) as p", "from main | where id >= 0 | stats count() as n by bin(_time, 7m)"):
        assert e.run(text).query.pipeline.stages[0].name == "from"
    views.append("v", events(spark, 20, 40))
    assert e.query("from main | where id >= 0 | stats count() as n").first().n == 60
    views.compact("v")
    assert e.query("from main | where id >= 0 | stats count() as n, max(ms) as m").first().n == 60
    assert views.read("v").count() > 0
    views.save()
    again = Views(Engine(spark).source("main", lambda: events(spark), order=["id"]), views.root).load()
    assert again.views["v"].text == VIEW
    views.views["v"].status = "paused"
    assert e.run("from main | where id >= 0 | stats count() as n").query.pipeline.stages[0].name == "from"
    views.drop("v")


def test_view_definitions_are_checked(spark, tmp_path):
    e = Engine(spark).source("main", lambda: events(spark), order=["id"])
    views = Views(e, str(tmp_path / "views"))
    view = views.create('from main | stats p50(ms) as p, count() as n by bin(_time, 5m) | materialize "mv" retention=10m')
    assert view.name == "mv" and view.retention == 600_000_000
    from datetime import datetime, timezone

    views.expire("mv", datetime(2024, 1, 1, 0, 40, tzinfo=timezone.utc))
    assert rows(views.read("mv").select("n")) == [(5,), (5,)]
    for text in ("from main | head 3", "from main | sort id | stats count()", "from main | stats dc(id)"):
        with pytest.raises(QueryError):
            views.create(text, "x")


def stream_of(spark, path, batches):
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(path)
        del i
    return spark.readStream.schema(TABLE).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_live_queries(spark, tmp_path):
    e = Engine(spark)
    stream = stream_of(spark, str(tmp_path / "in"), [events(spark, 10), events(spark, 30, 10)])
    got = drain(live.tail(e, "from main | where ms > 12 | extend x = ms * 2 | keep id, x", stream), "tailed")
    assert rows(got) == [(i, 2.0 * (i * i % 17)) for i in range(40) if i * i % 17 > 12]
    got = drain(live.windows(e, "from main | where id >= 0 | stats count() as n, sum(ms) as s by bin(_time, 5m)", stream, "0 seconds"), "windowed")
    closed = rows(got)
    assert closed and all(r[1] == 5 for r in closed)
    for text in ("from main | sort id", "from main | stats count()", "from main | streamstats count() as n"):
        with pytest.raises(QueryError):
            live.tail(e, text, stream)


def test_streaming_state(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), [events(spark, 6), events(spark, 6, 6)])
    got = drain(live.running(stream, "service", "ms"), "ran")
    assert {r.running_count for r in got.collect() if r.service == "s0"} == {1, 2, 3, 4}
    got = drain(live.sessions(stream, "service", 240_000_000, "0 seconds"), "sessions")
    assert got.columns == ["service", "_session_start", "_session_end", "events"]
    e = Engine(spark).source("main", lambda: events(spark, 12), order=["id"])
    views = __import__("emberlog.plans.views", fromlist=["Views"]).Views(e, str(tmp_path / "views"))
    views.create("from main | stats count() as n by service", "live", backfill=False)
    live.maintain(views, "live", stream, str(tmp_path / "ck")).awaitTermination()
    assert rows(e.query("from main | stats count() as n by service")) == [("s0", 4), ("s1", 4), ("s2", 4)]


def test_spread_of_large_values_is_that_without_a_view(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01T0{i % 4}:00:00Z", 1e9 + i % 2, "x") for i in range(400)], "t string, v double, k string").selectExpr("cast(t as timestamp) _time", "v", "k")
    text = "from src | stats stdev(v) as sd, varp(v) as vp by k"
    plain = Engine(spark).source("src", df, time="_time").query(text).first()
    e = Engine(spark).source("src", df, time="_time")
    Views(e, str(tmp_path)).create("from src | stats stdev(v) as sd, varp(v) as vp by k, bin(_time, 1h)", "v")
    found = e.run(text)
    assert found.query.pipeline.stages[0].name == "viewscan"
    got = found.df.first()
    assert abs(got.sd - plain.sd) < 1e-9 and abs(got.vp - 0.25) < 1e-9


def test_a_view_keeps_its_states_until_the_new_ones_are_whole(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", 1), ("2024-01-02T00:00:00Z", 2)], "t string, v long").selectExpr("cast(t as timestamp) _time", "v")
    e = Engine(spark).source("src", df, time="_time")
    views = Views(e, str(tmp_path))
    views.create("from src | stats sum(v) as s by bin(_time, 1d)", "daily")
    before = sorted(map(tuple, views.read("daily").collect()))
    path = Views._path

    def broken(self, *parts):
        if parts[-1] == "_next":
            raise RuntimeError("lost")
        return path(self, *parts)

    generation = views._generation("daily")
    monkeypatch.setattr(views, "_generation", lambda name: generation)
    monkeypatch.setattr(Views, "_path", broken)
    with pytest.raises(RuntimeError):
        views.compact("daily")
    monkeypatch.undo()
    assert sorted(map(tuple, views.read("daily").collect())) == before
    views.append("daily", df)
    views.compact("daily")
    assert sorted(r.s for r in views.read("daily").collect()) == [2, 4]
    views.pause("daily")
    assert views.match(e.run("from src | stats sum(v) as s by bin(_time, 1d)").query.pipeline.stages) is None
    views.resume("daily")
    with pytest.raises(QueryError):
        views.create('from src | stats sum(v) as s by bin(_time, 1d) | materialize "x" partition_by=v')


def test_percentiles_of_an_exact_engine_are_not_answered_by_sketches(spark, tmp_path):
    df = spark.range(1000).selectExpr("timestamp_seconds(id) _time", "id v")
    for approximate, first in ((False, "from"), (True, "viewscan")):
        e = Engine(spark, approximate=approximate).source("src", df, time="_time")
        Views(e, f"{tmp_path}/{approximate}").create("from src | stats p50(v) as p by bin(_time, 1h)", "p")
        assert e.run("from src | stats p50(v) as p by bin(_time, 1h)").query.pipeline.stages[0].name == first


def test_spans_in_a_circle_are_kept(spark):
    rows = [(1, "t", "a", "b"), (2, "t", "b", "a"), (3, "t", "c", "c"), (4, "u", "d", "")]
    df = spark.createDataFrame(rows, "n long, trace_id string, span_id string, parent_id string").selectExpr("timestamp_seconds(n) _time", "*")
    got = Engine(spark).source("src", df, order=["n"], time="_time").query("from src | trace").collect()
    assert sorted((r.trace_id, r._span_depth) for r in got) == [("t", 0), ("t", 0), ("t", 1), ("u", 0)]


def test_follow_shows_the_past_once_and_then_what_comes(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(t, f"e{t}") for t in x], "n long, _raw string").selectExpr("timestamp_seconds(n) _time", "n", "_raw")
    past = rows(1, 3, 2)
    rows(2, 3, 4).write.parquet(f"{tmp_path}/in")
    shown = []
    stream = spark.readStream.schema(past.schema).parquet(f"{tmp_path}/in")
    sink = lambda df: shown.extend(r.n for r in df.collect())
    live.follow(Engine(spark), "from src | keep n", past, stream, sink, f"{tmp_path}/check").awaitTermination()
    rows(5).write.mode("append").parquet(f"{tmp_path}/in")
    live.follow(Engine(spark), "from src | keep n", past, stream, lambda df: shown.extend(-r.n for r in df.collect()), f"{tmp_path}/check").awaitTermination()
    assert shown == [1, 2, 3, 4, -1, -2, -3, -5]


def test_numbers_follow_the_order(spark):
    from emberlog.staging import numbered

    df = spark.range(5000).selectExpr("cast(id * 7919 % 5000 as int) v", "id % 3 g").repartition(7)
    got = numbered(df, [df["v"].asc()], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 5000
    assert numbered(df.where("v < 0"), [df["v"].asc()], "n").collect() == []
