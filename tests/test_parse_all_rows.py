"""Fields and types of parse come from all rows, not from the first ones."""

import pytest

from emberlog.engine import Engine
from emberlog.lang.errors import QueryError


def parsed(spark, lines, stage):
    df = spark.createDataFrame(list(enumerate(lines)), "n long, _raw string").coalesce(1)
    return [r.asDict() for r in Engine(spark).source("main", df, order=["n"]).query(f"from main | {stage} | sort n").collect()]


LATE = {
    "json": ['{"a": 1, "o": null}'] * 250 + ['{"a": 2.5, "late": "x", "o": {"p": 3}}'],
    "logfmt": ["a=1"] * 250 + ["a=2.5 late=x"],
    "kv": ["a=1"] * 250 + ["a=2.5 late=x"],
    "cef": ["CEF:0|V|P|1|100|n|1|a=1"] * 250 + ["CEF:0|V|P|1|100|n|1|a=2.5 late=x"],
    "leef": ["LEEF:2.0|V|P|1.0|login|^|a=1"] * 250 + ["LEEF:2.0|V|P|1.0|login|^|a=2.5^late=x"],
}


@pytest.mark.parametrize("name", LATE)
def test_late_fields_and_types(spark, name):
    rows = parsed(spark, LATE[name], f"parse {name}")
    assert [float(rows[i]["a"]) for i in (0, 250)] == [1.0, 2.5] and [rows[i]["late"] for i in (0, 250)] == [None, "x"]
    assert name != "json" or rows[250]["o.p"] == 3


def test_object_in_some_rows(spark):
    rows = parsed(spark, ['{"a": {"b": 1}}', '{"a": 7}', '{"a": "s", "big": 9223372036854775808}'], "parse json")
    assert [r["a"] for r in rows] == ['{"b":1}', "7", "s"] and rows[2]["big"] == 2.0**63 and "a.b" not in rows[0]


def test_late_header(spark):
    rows = parsed(spark, ["#Version: 1.0"] * 250 + ["#Fields: date c-ip", "2024-01-01 h"], "parse w3c")
    assert rows[251]["c_ip"] == "h"
    with pytest.raises(QueryError):
        parsed(spark, ["#Fields: a b", "1 2", "#Fields: b a", "2 1"], "parse w3c")
