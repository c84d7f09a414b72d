import json

import pytest

from emberlog.engine import Engine
from emberlog.lang.errors import QueryError
from emberlog.sources import readers, sinks

#: Lines made up for each format, and what is to be read from them.
LINES = {
    "combined": [
        ('192.0.2.44 - zoe [03/Jun/2025:06:07:08 +0200] "DELETE /cart/9?all=1 HTTP/2" 204 0 "https://shop.example/" "probe/3.1 (x; y)"', {"client_ip": "192.0.2.44", "ident": None, "user": "zoe", "method": "DELETE", "uri": "/cart/9?all=1", "protocol": "HTTP/2", "status": 204, "bytes": 0, "referer": "https://shop.example/", "user_agent": "probe/3.1 (x; y)"}),
        ('2001:db8::5 - - [03/Jun/2025:06:07:08 +0200] "-" 400 - "-" "-"', {"client_ip": "2001:db8::5", "user": None, "request": None, "method": None, "status": 400, "bytes": None, "user_agent": None}),
    ],
    "clf": [
        ('edge7 - - [03/Jun/2025:06:07:09 +0200] "HEAD /feed HTTP/1.1" 304 -', {"client_ip": "edge7", "user": None, "method": "HEAD", "uri": "/feed", "status": 304, "bytes": None}),
        ('edge7 id zoe [03/Jun/2025:06:07:09 +0200] "PATCH /p HTTP/1.1" 500 77', {"ident": "id", "user": "zoe", "status": 500, "bytes": 77}),
    ],
    "syslog": [
        ("<86>Jun  3 06:07:10 vault3 cron[771]: job nightly took 4s", {"priority": 86, "facility": 10, "severity": 6, "facility_name": "authpriv", "severity_name": "info", "format": "rfc3164", "timestamp": "Jun  3 06:07:10", "hostname": "vault3", "appname": "cron", "procid": "771", "message": "job nightly took 4s", "version": None}),
        ('<165>1 2025-06-03T06:07:10.5Z vault3 billing - M12 [at@1 k="v"][b@1] paid', {"priority": 165, "version": 1, "format": "rfc5424", "procid": None, "msgid": "M12", "message": "paid"}),
    ],
    "nginx_error": [
        ('2025/06/03 06:07:11 [crit] 31#4: *57 no live upstreams, client: 198.51.100.8, server: shop, request: "OPTIONS /pay HTTP/2.0", upstream: "http://pool/"', {"severity": "crit", "pid": 31, "tid": 4, "cid": 57, "message": "no live upstreams", "client": "198.51.100.8", "server": "shop", "method": "OPTIONS", "uri": "/pay", "upstream": "http://pool/"}),
        ("2025/06/03 06:07:11 [notice] 1#1: signal process started", {"severity": "notice", "cid": None, "message": "signal process started", "client": None}),
    ],
    "apache_error": [
        ("[Tue Jun 03 06:07:12.000777 2025] [authz:warn] [pid 88:tid 3] [client 198.51.100.9:40021] AH01630: denied by rule", {"module": "authz", "severity": "warn", "pid": 88, "tid": 3, "client_ip": "198.51.100.9", "client_port": 40021, "error_code": "AH01630", "message": "denied by rule"}),
        ("[Tue Jun 03 06:07:12 2025] [notice] resuming", {"module": None, "severity": "notice", "pid": None, "error_code": None, "message": "resuming"}),
    ],
    "redis": [
        ("905:X 03 Jun 2025 06:07:13.004 # odown quorum", {"pid": 905, "role_char": "X", "role": "sentinel", "level_char": "#", "level": "warning", "message": "odown quorum"}),
        ("7:C 03 Jun 2025 06:07:13.004 . saved", {"role": "rdb_child", "level": "debug"}),
    ],
    "postgres": [
        ("2025-06-03 06:07:14.25 CET [4411] zoe@ledger LOG:  duration: 0.75 ms  statement: UPDATE t SET a = 1", {"pid": 4411, "user": "zoe", "database": "ledger", "severity": "LOG", "duration_ms": 0.75, "statement": "UPDATE t SET a = 1"}),
        ("2025-06-03 06:07:14 CET [4411] FATAL:  role is gone", {"user": None, "severity": "FATAL", "duration_ms": None, "message": "role is gone"}),
    ],
    "mysql_slow": [
        ("# Time: 2025-06-03T06:07:15.9Z\n# User@Host: zoe[zoe] @ ledger7 [198.51.100.3]  Id:     9\n# Query_time: 12.25  Lock_time: 0.5  Rows_sent: 3  Rows_examined: 70001\nDELETE\nFROM old;", {"user": "zoe", "host": "ledger7", "client_ip": "198.51.100.3", "connection_id": 9, "query_time": 12.25, "rows_examined": 70001, "statement": "DELETE\nFROM old;"}),
        ("# User@Host: a[a] @  []\n# Query_time: 1.0  Lock_time: 0.0  Rows_sent: 0  Rows_examined: 0\nSET timestamp=5;\nDO 1;", {"timestamp": None, "user": "a", "statement": "DO 1;"}),
    ],
    "haproxy": [
        ('198.51.100.4:41000 [03/Jun/2025:06:07:16.777] tls~ pool/b2 4/3/2/91/100 502 310 - - SH-- 9/8/7/6/+2 1/0 "GET /slow HTTP/1.1"', {"client_ip": "198.51.100.4", "client_port": 41000, "frontend": "tls~", "backend": "pool", "server": "b2", "tq": 4, "tt": 100, "status": 502, "bytes": 310, "term_state": "SH--", "actconn": 9, "method": "GET", "uri": "/slow"}),
        ('198.51.100.4:41001 [03/Jun/2025:06:07:16.778] tls pool/<NOSRV> -1/-1/-1/-1/0 400 0 - - PR-- 1/1/0/0/0 0/0 "<BADREQ>"', {"server": "<NOSRV>", "tq": -1, "status": 400, "method": None}),
    ],
    "json": [
        ('{"size": 7, "who": {"name": "zoe", "score": 2.25}, "tags": ["x", 3], "ok": false, "gone": null}', {"size": 7, "who.name": "zoe", "who.score": 2.25, "tags": '["x",3]', "ok": False}),
        ('  {"size": -1} ', {"size": -1}),
    ],
    "logfmt": [
        ('at=warn note="two words, one=pair" left=12 share=0.25', {"at": "warn", "note": "two words, one=pair", "left": 12, "share": 0.25}),
        ('at="say \\"hi\\"" left=', {"at": 'say "hi"'}),
    ],
    "docker": [
        ('{"log":"started in 3s\\n","stream":"stderr","time":"2025-06-03T06:07:17Z"}', {"log": "started in 3s", "stream": "stderr", "time": "2025-06-03T06:07:17Z"}),
        ('{"log":"","stream":"stdout","time":"2025-06-03T06:07:17Z"}', {"stream": "stdout"}),
    ],
    "cef": [
        ("CEF:1|North\\|West|Scan|7.2|E-5|port sweep|3|dpt=22 reason=too many tries spt=9", {"cef_version": "1", "device_vendor": "North|West", "signature_id": "E-5", "name": "port sweep", "severity": "3", "dpt": 22, "reason": "too many tries", "spt": 9}),
        ("CEF:0|a|b|c|d|e|f|", {"device_vendor": "a", "severity": "f"}),
    ],
    "leef": [
        ("LEEF:2.0|North|Scan|7.2|lockout|;|who=zoe m;try=5", {"leef_version": "2.0", "event_id": "lockout", "who": "zoe m", "try": 5}),
        ("LEEF:1.0|North|Scan|7.2|lockout|who=zoe\ttry=6", {"leef_version": "1.0", "who": "zoe", "try": 6}),
    ],
}


def parsed(spark, line, stage):
    e = Engine(spark).source("main", spark.createDataFrame([(1, line), (2, "neither"), (3, None)], "n long, _raw string"), order=["n"])
    return [r.asDict() for r in e.query(f"from main | {stage}").collect()]


@pytest.mark.parametrize("name", LINES)
def test_formats(spark, name):
    for line, want in LINES[name]:
        good, bad, none = parsed(spark, line, f"parse {name}")
        assert {k: good[k] for k in want} == want and good["_error"] is None
        assert bad["_error"] == none["_error"] == f"parse:{name}: no fields extracted"


def test_parse_arguments(spark):
    kv = parsed(spark, "a:1;b:'x y'", "parse kv(sep=\";\", assign=\":\", quote=\"'\") into (a as int, b) prefix p_ on_error null")
    assert kv[0] == {"n": 1, "_raw": "a:1;b:'x y'", "p_a": 1, "p_b": "x y"} and kv[1]["p_a"] is None
    assert len(parsed(spark, "id=7 x", r'parse regex r"id=(?<id>\d+)" into (id as int) on_error drop')) == 1
    assert parsed(spark, "id=7 x", r'parse regex r"id=(?<id>\d+)" into (id as int) on_error drop')[0]["id"] == 7
    assert parsed(spark, "1.2.3.4 - bob [now]", 'parse pattern "<ip> - <_> [<ts>]"')[0]["ip"] == "1.2.3.4"
    assert parsed(spark, "took 35ms", 'parse pattern "took %{d:duration}" | extend s = d / 1ms')[0]["s"] == 35.0
    w3c = parsed(spark, "2024-01-01 GET -", 'parse w3c("#Fields: date cs-method c-ip")')[0]
    assert (w3c["date"], w3c["cs_method"], w3c["c_ip"]) == ("2024-01-01", "GET", None)
    keep = parsed(spark, '{"n": 9, "m": 2}', "parse json")
    assert (keep[0]["n"], keep[0]["m"]) == (1, 2)  # what is there stays
    chain = parsed(spark, "a=5 b=6", "parse first_of(json, logfmt) into (a as int)")
    assert chain[0]["a"] == 5 and chain[0]["_error"] is None
    with pytest.raises(Exception, match="no fields extracted"):
        parsed(spark, "x", "parse json into (a) on_error strict")
    with pytest.raises(QueryError):
        parsed(spark, "x", r'parse regex r"\d+"')


def test_detection(spark, tmp_path):
    of = lambda *x: readers.detect(list(x))
    lines = {k: [x for x, _ in v if "\n" not in x] for k, v in LINES.items()}
    cases = [("json", lines["json"]), ("docker", lines["docker"][:1]), ("combined", lines["combined"][:1]), ("syslog", lines["syslog"][:1]), ("logfmt", lines["logfmt"][:1]), ("csv", ["a,b", "1,2"]), ("tsv", ["a\tb", "1\t2"]), ("raw", ["plain text"]), ("raw", [])]
    for kind, some in cases:
        assert of(*some) == kind
        assert readers.detect_all(spark.createDataFrame([(x,) for x in some], "value string")) == kind
    late = ["plain text"] * 30 + lines["json"][:1] * 60  # what comes after the first lines counts as much
    assert readers.detect_all(spark.createDataFrame([(x,) for x in late], "value string").repartition(3)) == "json"


def test_lines_in_hand(spark):
    import io

    for items in (["one", "two\n"], io.StringIO("one\ntwo\n")):
        assert [r._raw for r in readers.read_lines(spark, items).output().collect()] == ["one", "two"]


def test_bulk_documents_that_look_like_actions(spark, tmp_path):
    bulk = tmp_path / "b.ndjson"
    bulk.write_text('{"index":{"_id":"1"}}\n{"index":{"a":1},"msg":"x"}\n{"delete":{"_id":"9"}}\n{"create":{"_id":"2"}}\n{"update":{"b":2},"msg":"y"}\n{"index":{"_id":"3"}}\n{"msg":"z"}\n')
    assert [(r._id, r.msg) for r in readers.read_bulk(spark, str(bulk)).output().orderBy("msg").collect()] == [("1", "x"), ("2", "y"), ("3", "z")]


def test_texts_that_hold_the_marks(spark):
    odd = "k=1\x01z end"
    got = parsed(spark, odd, r'parse regex r"k=(?<v>\S+) (?<w>\w+)"')[0]
    assert (got["v"], got["w"]) == ("1\x01z", "end")
    assert parsed(spark, "a\x02b - c", 'parse pattern "<x> - <y>"')[0]["x"] == "a\x02b"


def test_readers(spark, tmp_path):
    logs = tmp_path / "a.log"
    logs.write_text("\n".join(json.dumps({"timestamp": f"2024-01-01T00:00:0{i}.500Z", "level": "INFO", "n": i}) for i in range(3)))
    e = Engine(spark)
    f = readers.read_logs(spark, str(logs))
    e.catalog.makers["logs"] = lambda: f
    got = e.query("from logs | where n >= 1 | keep _time, level, n, index, _sourcetype").collect()
    assert [(r._time.isoformat(), r.level, r.n, r["index"], r._sourcetype) for r in got] == [("2024-01-01T00:00:01.500000", "INFO", 1, "main", "json"), ("2024-01-01T00:00:02.500000", "INFO", 2, "main", "json")]
    bulk = tmp_path / "bulk.ndjson"
    bulk.write_text('{"index":{"_index":"web","_id":"1"}}\n{"msg":"a"}\n{"delete":{"_id":"2"}}\n{"create":{"_index":"app"}}\n{"msg":"b"}\n')
    assert [(r["index"], r.msg) for r in readers.read_bulk(spark, str(bulk)).output().orderBy("msg").collect()] == [("web", "a"), ("app", "b")]
    hec = tmp_path / "hec.json"
    hec.write_text('{"time": 1704067200.5, "host": "h", "event": {"a": 1}}\n{"event": "plain", "fields": {"k": "v"}}\n')
    got = readers.read_hec(spark, str(hec)).output().collect()
    assert [(r._raw, r.host, r.fields) for r in got] == [('{"a":1}', "h", None), ("plain", None, {"k": "v"})]
    assert got[0]._time.isoformat() == "2024-01-01T00:00:00.500000"
    otlp = tmp_path / "otlp.json"
    record = {"timeUnixNano": "1704067200000000000", "severityText": "WARN", "body": {"stringValue": "hi"}, "attributes": [{"key": "k", "value": {"intValue": "3"}}], "traceId": "t"}
    otlp.write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record, record]}]}]}))
    got = readers.read_otlp(spark, str(otlp)).output()
    assert got.count() == 2 and [(r._raw, r._source, r.level, r.attributes) for r in readers.dedup_batch(got).collect()] == [("hi", "api", "WARN", {"k": "3"})]
    table = tmp_path / "t.csv"
    table.write_text("ts,v\n2024-01-01 00:00:00,1\n2024-01-01 00:00:05,2\n")
    assert [r.v for r in readers.read_logs(spark, str(table)).output().collect()] == [1, 2]


def test_sinks(spark, engine, tmp_path):
    df = engine.query("from main | head 2 | keep id, level, tags")
    for kind in ("json", "csv", "tsv", "parquet"):
        sinks.write(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert sinks.render(df, "ndjson").splitlines()[0] == '{"id": 1, "level": "INFO", "tags": ["a", "b"]}'
    assert sinks.render(df.select("id", "level"), "markdown").splitlines()[0] == "| id | level |"
    assert sinks.render(df.select("id"), "box").splitlines()[0] == "┌────┐" and sinks.render(df.select("id"), "ascii").splitlines()[1] == "| id |"
    assert sinks.render(df.select("id"), "glimpse") == "id <bigint> 1, 2"
    assert sinks.render(df.select("id"), "table", 1).endswith("the first 1 rows are shown") and len(sinks.render(spark.range(1500), "ndjson").splitlines()) == 1500
    assert sinks.render(df.select("id"), "csv") == "id\n1\n2\n" and "level=INFO" in sinks.render(df, "line") and "--- 2" in sinks.render(df, "vertical")
