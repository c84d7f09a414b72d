"""The registered queries: text in the query language, and SQL that gives the same rows.

Each runs over whole tables.  `head` and `top` occur only where they are the feature that is shown.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .operators import legacy, metadata
from .plans.views import Views, shared_folder

#: Sources: columns that order them, event time, raw text.
TABLES = {
    "events": {"order": ["ts", "event_id"], "time": "ts", "raw": "props"},
    "orders": {"order": ["o_orderdate", "o_orderkey"], "time": "o_orderdate"},
    "lineitem": {"order": ["l_orderkey", "l_linenumber"], "time": "l_shipdate"},
    "documents": {"order": ["doc_id"], "raw": "text"},
    "pages": {"order": ["page_id"], "raw": "html"},
    "conversations": {"order": ["conv_id", "turn"], "raw": "text"},
    "customer": {"order": ["c_custkey"]},
    "supplier": {"order": ["s_suppkey"]},
    "part": {"order": ["p_partkey"]},
    "nation": {"order": ["n_nationkey"]},
    "region": {"order": ["r_regionkey"]},
    "labels": {"order": ["doc_id"]},
    "benchmark": {"order": ["item_id"], "raw": "text"},
    "embeddings": {"order": ["vec_id"]},
}
#: "Now" of queries with relative times.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    for name, options in TABLES.items():
        e.catalog.add_parquet(name, f"{sf_dir}/{name}.parquet", **options)
    return e


TEXTS: dict[str, str] = {}
SQL: dict[str, str] = {}


def q(name: str, text: str, sql: str | None = None) -> None:
    TEXTS[name] = text
    if sql:
        SQL[name] = sql


def bucket(column: str, us: int) -> str:
    return f"make_timestamp(epoch_us({column}) // {us} * {us})"


DAY, HOUR = 86_400_000_000, 3_600_000_000
EV = "events"
PURCHASE = "event_type = 'purchase'"

# Sources and search
q("topk_users", 'from events | where event_type == "purchase" | stats count() as n, sum(value) as total by user_id | extend total = round(total, 4) | sort -total, user_id | head 10', f"SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE {PURCHASE} GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10")
q("source_glob", "from nat*, reg*, !region | stats count() as n, max(n_nationkey) as top", "SELECT count(*) AS n, max(n_nationkey) AS top FROM nation")
q("source_union_glob", "from {nation,region} | stats count() as n, count(r_name) as regions", "SELECT 30 AS n, 5 AS regions")
q("time_range", "from events[2024-01-05T00:00:00Z..2024-01-12T00:00:00Z] | stats count() as n, min(event_id) as a", "SELECT count(*) AS n, min(event_id) AS a FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
q("time_relative", "from events[-7d..-1d] | stats count() as n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-30'")
q("search_terms", "from documents the of | keep doc_id", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), 'of')")
q("search_pairs", 'from events event_type=pur* value>=50 or user_id in (1, 2, 3) | stats count() as n', "SELECT count(*) AS n FROM events WHERE (event_type LIKE 'pur%' AND value >= 50) OR user_id IN (1, 2, 3)")
q("search_phrase", 'from documents "licensed under" | keep doc_id, source', "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed under')")

# Filter and projection
q("where_3vl", 'from events | where not (value > 50 and event_type in ["click", "view"]) or value between 10 and 20 | stats count() as n', "SELECT count(*) AS n FROM events WHERE NOT (value > 50 AND event_type IN ('click', 'view')) OR value BETWEEN 10 AND 20")
q("extend_chain", "from events | extend double = value * 2, half = double / 4, tag = event_type + \"!\", odd = event_id % 2, third = event_id / 3 | keep event_id, double, half, tag, odd, third", "SELECT event_id, value * 2 AS double, value * 2 / 4 AS half, event_type || '!' AS tag, event_id % 2 AS odd, event_id // 3 AS third FROM events")
q("keep_glob", "from orders | keep o_order*, o_custkey | keep * except o_orderdate, o_orderpriority", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
q("drop_rename", "from customer | drop c_name, *segment | rename c_custkey as id, c_acctbal as balance", "SELECT c_custkey AS id, c_nationkey, c_acctbal AS balance FROM customer")
q("coalesce_missing", "from events | extend a = nothing ?? event_type, b = exists(nothing), c = is_missing(nothing), d = is_missing(value), e = is_null(value) | stats count(a) as a, count(where b) as b, count(where c) as c, count(where d) as d, count(where e) as e", "SELECT count(*) AS a, 0 AS b, count(*) AS c, 0 AS d, 0 AS e FROM events")

# Aggregation
q("stats_basic", "from events | stats count() as n, count(value) as nv, sum(value) as s, avg(value) as a, min(value) as lo, max(value) as hi by event_type | extend s = round(s, 4), a = round(a, 6)", "SELECT event_type, count(*) AS n, count(value) AS nv, round(sum(value), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL")
q("stats_empty", "from events | where value < -1 | stats count() as n, sum(value) as s", "SELECT count(*) AS n, sum(value) AS s FROM events WHERE value < -1")
q("stats_conditional", 'from events | stats count(where event_type == "click") as clicks, sum(value, where value > 50) as big, dc(user_id, where value > 90) as users by bin(_time, 7d) | extend big = round(big, 4)', f"SELECT {bucket('ts', 7 * DAY)} AS _time, count(*) FILTER (event_type = 'click') AS clicks, round(sum(value) FILTER (value > 50), 4) AS big, count(DISTINCT user_id) FILTER (value > 90) AS users FROM events GROUP BY 1")
q("stats_percentiles", "from events | stats p50(value) as p50, p75(value) as p75, p90(value) as p90, p95(value) as p95, p99(value) as p99, perc(value, 10) as p10 by event_type | extend p50 = round(p50, 6), p75 = round(p75, 6), p90 = round(p90, 6), p95 = round(p95, 6), p99 = round(p99, 6), p10 = round(p10, 6)", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99, 10)) + " FROM events GROUP BY 1")
q("stats_spread", "from lineitem | stats stdev(l_quantity) as sd, var(l_quantity) as v, stdevp(l_quantity) as sdp, varp(l_quantity) as vp, range(l_quantity) as r, sumsq(l_quantity) as sq by l_returnflag | extend sd = round(sd, 6), v = round(v, 6), sdp = round(sdp, 6), vp = round(vp, 6), sq = round(sq, 2)", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, round(stddev_pop(l_quantity), 6) AS sdp, round(var_pop(l_quantity), 6) AS vp, max(l_quantity) - min(l_quantity) AS r, round(sum(l_quantity * l_quantity), 2) AS sq FROM lineitem GROUP BY 1")
q("stats_distinct", "from orders | stats dc(o_custkey) as customers, dc(o_orderpriority) as priorities by o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
q("stats_estdc", "from events | stats estdc(user_id) as users, estdc_error(user_id) as err")
q("stats_mode_values", "from events | stats mode(event_type) as m, values(event_type) as v by user_id", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS i FROM c) SELECT user_id, max(event_type) FILTER (i = 1) AS m, list_sort(list(event_type)) AS v FROM r GROUP BY 1")
q("stats_order", "from events | stats first(event_type) as f, last(event_type) as l, earliest(value) as e, latest(value) as t, list(event_id) as ids by user_id", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS f, arg_max(event_type, (ts, event_id)) AS l, arg_min(value, (ts, event_id)) AS e, arg_max(value, (ts, event_id)) AS t, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY 1")
q("stats_rates", "from events | stats rate() as r, per_second(value) as ps, per_minute(value) as pm, per_hour(value) as ph, per_day(value) as pd by bin(_time, 1d) | extend r = round(r, 9), ps = round(ps, 9), pm = round(pm, 9), ph = round(ph, 6), pd = round(pd, 4)", f"SELECT {bucket('ts', DAY)} AS _time, round(count(*) / 86400.0, 9) AS r, round(sum(value) / 86400, 9) AS ps, round(sum(value) * 60 / 86400, 9) AS pm, round(sum(value) * 3600 / 86400, 6) AS ph, round(sum(value), 4) AS pd FROM events GROUP BY 1")
q("stats_times", "from events | stats earliest_time() as a, latest_time() as z by event_type | extend a = round(a, 3), z = round(z, 3)", "SELECT event_type, round(epoch_us(min(ts)) / 1e6, 3) AS a, round(epoch_us(max(ts)) / 1e6, 3) AS z FROM events GROUP BY 1")
q("stats_expression_keys", "from orders | stats count() as n, sum(o_totalprice / 100) as s by lower(o_orderpriority) as priority, o_totalprice > 200000 as big | extend s = round(s, 2)", "SELECT lower(o_orderpriority) AS priority, o_totalprice > 200000 AS big, count(*) AS n, round(sum(o_totalprice / 100), 2) AS s FROM orders GROUP BY 1, 2")
q("stats_bin", "from events | stats count() as n, avg(value) as a by bin(_time, 1h), event_type | extend a = round(a, 6)", f"SELECT {bucket('ts', HOUR)} AS _time, event_type, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY 1, 2")

# Windows
q("eventstats_by", "from events | eventstats avg(value) as a, count() as n, dc(user_id) as u by event_type | extend above = value > a | keep event_id, n, u, above", "SELECT event_id, n, u, value > a AS above FROM events JOIN (SELECT event_type, avg(value) AS a, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1) USING (event_type)")
q("eventstats_all", "from orders | eventstats max(o_totalprice) as top, p50(o_totalprice) as mid | extend share = round(o_totalprice / top, 8), mid = round(mid, 4) | keep o_orderkey, share, mid", "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 8) AS share, (SELECT round(quantile_cont(o_totalprice, 0.5), 4) FROM orders) AS mid FROM orders")
q("streamstats_running", "from events | streamstats count() as n, sum(value) as s, min(value) as lo, dc(event_type) as types by user_id | extend s = round(s, 4) | keep event_id, n, s, lo, types", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s, min(value) OVER w AS lo, len(list_distinct(list(event_type) OVER w)) AS types FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
q("streamstats_window", "from events | streamstats window=5 avg(value) as a, max(value) as m by user_id | extend a = round(a, 6) | keep event_id, a, m", "SELECT event_id, round(avg(value) OVER w, 6) AS a, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
q("streamstats_before", "from events | streamstats current=false window=3 sum(value) as s, last(event_type) as p, stdev(value) as d by user_id | extend s = round(s, 4), d = round(d, 5) | keep event_id, s, p, d", "SELECT event_id, round(sum(value) OVER w, 4) AS s, last_value(event_type) OVER w AS p, round(stddev_samp(value) OVER w, 5) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
q("window_functions", "from conversations | streamstats lag(turn) as l, lag(turn, 2) as l2, lead(role) as nxt, row_number() as rn, running_sum(turn) as rs, moving_avg(turn, 3) as ma by conv_id | extend ma = round(ma, 6) | keep conv_id, turn, l, l2, nxt, rn, rs, ma", "SELECT conv_id, turn, lag(turn) OVER w AS l, lag(turn, 2) OVER w AS l2, lead(role) OVER w AS nxt, row_number() OVER w AS rn, sum(turn) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS rs, round(avg(turn) OVER (w ROWS 2 PRECEDING), 6) AS ma FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")

# Order, limits, sets
q("sort_head", "from lineitem | sort -l_extendedprice, l_orderkey, l_linenumber | head 25 | keep l_orderkey, l_linenumber, l_extendedprice", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
q("sort_nulls", "from documents | join type=left on doc_id with [from labels] | sort -quality, doc_id | head 40 | keep doc_id, quality", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 40")
q("head_tail", "from events | tail 20 | head 5 | keep event_id, ts", "SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) ORDER BY ts, event_id LIMIT 5")
q("dedup_one", "from events | dedup user_id, event_type | keep event_id, user_id, event_type", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
q("dedup_three", "from events | dedup 3 user_id | keep event_id", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
q("join_inner", "from orders | rename o_custkey as c_custkey | join on c_custkey with [from customer | keep c_custkey, c_mktsegment] | stats count() as n, sum(o_totalprice) as s by c_mktsegment | extend s = round(s, 2)", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
q("join_left", "from customer | rename c_custkey as k | join type=left on k with [from orders | where o_totalprice > 300000 | stats count() as big by o_custkey | rename o_custkey as k] | keep k, big", "SELECT c_custkey AS k, big FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS big FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
q("join_outer", "from labels | join type=outer on doc_id with [from documents | where n_chars > 2000 | keep doc_id, n_chars] | keep doc_id, quality, n_chars", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, quality, n_chars FROM labels l FULL JOIN (SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000) d ON l.doc_id = d.doc_id")
q("join_collision", "from nation | rename n_regionkey as r_regionkey | extend r_name = n_name | join on r_regionkey with [from region]", "SELECT n_nationkey, n_name, n_regionkey AS r_regionkey, n_name AS r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
q("cte_join", "let $busy = from events | stats count() as n by user_id | where n > 50; from events | join on user_id with $busy | stats count() as n", "SELECT count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 50)")
q("union_padded", "from nation | keep n_name | union [from region | keep r_name], [from nation | where n_regionkey == 1 | keep n_name, n_regionkey]", "SELECT n_name, NULL AS r_name, NULL AS n_regionkey FROM nation UNION ALL SELECT NULL, r_name, NULL FROM region UNION ALL SELECT n_name, NULL, n_regionkey FROM nation WHERE n_regionkey = 1")
q("explode_split", 'from benchmark | extend words = split(text, " ") | explode words as word | stats count() as n by word', "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY 1")
q("explode_embedding", "from embeddings | explode embedding as x | stats count() as n, max(x) as m by label | extend m = round(m, 5)", "SELECT label, count(*) AS n, round(max(x)::DOUBLE, 5) AS m FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
q("describe_orders", "from orders | keep o_orderstatus, o_orderpriority | describe | keep field, type, coverage, distinct_est", "SELECT 'o_orderstatus' AS field, 'string' AS type, 1.0::DOUBLE AS coverage, count(DISTINCT o_orderstatus) AS distinct_est FROM orders UNION ALL SELECT 'o_orderpriority', 'string', 1.0, count(DISTINCT o_orderpriority) FROM orders")

# Short forms
q("top", "from events | top 3 event_type", "SELECT event_type, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM events GROUP BY 1 ORDER BY count DESC, event_type LIMIT 3")
q("rare", "from orders | rare 2 o_orderpriority", "SELECT o_orderpriority, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM orders GROUP BY 1 ORDER BY count, o_orderpriority LIMIT 2")
q("every", "from events | every 6h by event_type stats count() as n, sum(value) as s | extend s = round(s, 4)", f"SELECT {bucket('ts', 6 * HOUR)} AS _time, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
q("rate", "from events | rate per 1d by event_type", f"SELECT {bucket('ts', DAY)} AS _time, event_type, count(*) AS rate FROM events GROUP BY 1, 2")
q("latency", "from events | latency value every 1w by event_type | extend p50 = round(p50, 6), p95 = round(p95, 6), p99 = round(p99, 6)", f"SELECT {bucket('ts', 7 * DAY)} AS _time, event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS count FROM events GROUP BY 1, 2")
q("percentiles", "from events | percentiles value by event_type | extend p50_value = round(p50_value, 6), p75_value = round(p75_value, 6), p90_value = round(p90_value, 6), p95_value = round(p95_value, 6), p99_value = round(p99_value, 6)", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}_value" for p in (50, 75, 90, 95, 99)) + " FROM events GROUP BY 1")
q("proportion", 'from events | proportion event_type == "error" as err every 1d | extend err = round(err, 8)', f"SELECT {bucket('ts', DAY)} AS _time, count(*) FILTER (event_type = 'error') AS err_num, count(*) AS err_den, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 8) AS err FROM events GROUP BY 1")
q("facets", "from orders | facets o_orderstatus, o_orderpriority limit=2", "WITH c AS (SELECT 'o_orderstatus' AS _facet, o_orderstatus AS _value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2) SELECT _facet, _value, count FROM (SELECT *, row_number() OVER (PARTITION BY _facet ORDER BY count DESC, _value) AS r FROM c) WHERE r <= 2")
q("impact", "from lineitem | impact sum(l_quantity) by l_returnflag | extend pct_sum_l_quantity = round(pct_sum_l_quantity, 8)", "SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity, sum(sum(l_quantity)) OVER () AS total_sum_l_quantity, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 8) AS pct_sum_l_quantity FROM lineitem GROUP BY 1")
q("baseline", "from events | baseline value window=10 by user_id | extend b = round(baseline_value, 6), d = round(delta_value, 6) | keep event_id, b, d", "SELECT event_id, round(avg(value) OVER w, 6) AS b, round(value - avg(value) OVER w, 6) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
q("changes", "from events | changes event_type by user_id | keep event_id, event_type, previous_event_type", "SELECT event_id, event_type, p AS previous_event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL AND p <> event_type")
q("exemplars", "from events | exemplars 2 by event_type | keep event_id, event_type", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 2")

# Investigation
q("outliers_iqr", "from events | outliers field=value method=iqr | where _outlier | extend _score = round(_score, 6) | keep event_id, _score", "WITH s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM events) SELECT event_id, round(CASE WHEN value < a THEN (a - 1.5 * (z - a) - value) / (z - a) ELSE (value - z - 1.5 * (z - a)) / (z - a) END, 6) AS _score FROM events, s WHERE value < a - 1.5 * (z - a) OR value > z + 1.5 * (z - a)")
q("outliers_zscore", "from lineitem | outliers field=l_extendedprice method=zscore threshold=2.0 | where _outlier | extend z = round(_score, 5) | keep l_orderkey, l_linenumber, z", "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - m) / d, 5) AS z FROM lineitem, s WHERE abs(l_extendedprice - m) / d > 2")
q("outliers_mad", "from events | outliers field=value method=mad threshold=4 | where _outlier | keep event_id", "WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT m, median(abs(value - m)) AS d FROM events, m GROUP BY m) SELECT event_id FROM events, d WHERE 0.6745 * abs(value - m) / d > 4")
q("sessionize", "from events | sessionize maxpause=6h by user_id | keep event_id, _session_id, _session_start, _session_end", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g), b AS (SELECT user_id, n, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (ORDER BY user_id, a) AS id FROM b) SELECT event_id, id AS _session_id, a AS _session_start, z AS _session_end FROM s JOIN i USING (user_id, n)")
q("transaction", "from events | transaction user_id maxspan=6h | extend duration = round(duration, 3) | keep user_id, _time, duration, eventcount, event_type, _raw", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS _time, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration, count(*) AS eventcount, arg_min(event_type, (ts, event_id)) AS event_type, string_agg(props, chr(10) ORDER BY ts, event_id) AS _raw FROM s GROUP BY user_id, n")
q("transaction_bounds", 'from conversations | extend _time = timestamp(turn) | transaction conv_id startswith=role == "user" | keep conv_id, _time, eventcount', "WITH s AS (SELECT *, sum(CASE WHEN role = 'user' OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)) SELECT conv_id, make_timestamp(min(turn) * 1000000) AS _time, count(*) AS eventcount FROM s GROUP BY conv_id, n")
q("topology", "from customer | extend service = string(c_nationkey), downstream = c_mktsegment | topology weight_field=c_acctbal | extend _edge_weight = round(_edge_weight, 2)", "SELECT c_nationkey::VARCHAR AS _source, c_mktsegment AS _destination, count(*) AS _edge_count, (sum(count(*)) OVER (PARTITION BY c_nationkey))::BIGINT AS _source_out_degree, (sum(count(*)) OVER (PARTITION BY c_mktsegment))::BIGINT AS _dest_in_degree, round(sum(c_acctbal), 2) AS _edge_weight FROM customer GROUP BY c_nationkey, c_mktsegment")
q("correlate_pearson", "from lineitem | correlate l_quantity l_extendedprice | extend _correlation = round(_correlation, 8)", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS _correlation, 'pearson' AS _method, count(*) AS _n, 'l_quantity' AS _field1, 'l_extendedprice' AS _field2 FROM lineitem")
q("correlate_spearman", "from orders | correlate o_totalprice o_custkey method=spearman | extend _correlation = round(_correlation, 8)", "SELECT round(corr(a, b), 8) AS _correlation, 'spearman' AS _method, count(*) AS _n, 'o_totalprice' AS _field1, 'o_custkey' AS _field2 FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderdate, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS b FROM orders)")
q("rollup", "from events | rollup 1h, 1d by event_type", f"SELECT '1h' AS _resolution, {bucket('ts', HOUR)} AS _bucket, event_type, count(*) AS count FROM events GROUP BY 2, 3 UNION ALL SELECT '1d', {bucket('ts', DAY)}, event_type, count(*) FROM events GROUP BY 2, 3")
q("xyseries", "from orders | stats count() as n by o_orderpriority, o_orderstatus | xyseries o_orderpriority o_orderstatus n", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
q("compare", "from events[-7d] | stats count() as n, max(value) as m by event_type | compare previous 7d", "WITH a AS (SELECT event_type, count(*) AS n, max(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1), b AS (SELECT event_type, count(*) AS n, max(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24' GROUP BY 1) SELECT a.event_type, a.n, a.m, b.n AS previous_n, b.m AS previous_m, a.n - b.n AS change_n, a.m - b.m AS change_m FROM a LEFT JOIN b USING (event_type)")
q("patterns_mask", "from events | patterns mode=mask | keep pattern, count, percent", "SELECT pattern, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM (SELECT regexp_replace(props, '\\d+\\}', '<*>') AS pattern FROM events) GROUP BY 1")
q("patterns", "from pages | extend line = url | patterns field=line")
q("trace", 'from conversations | extend trace_id = string(conv_id), span_id = printf("%d-%d", conv_id, turn), parent_id = if(turn > 0, printf("%d-%d", conv_id, turn - 1), ""), _time = timestamp(turn), operation = role | trace')

# Parse
q("parse_json", "from events | parse json | keep event_id, k, _error", "SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL AS _error FROM events")
q("parse_json_into", "from events | parse json from props into (k as int) prefix p. on_error null | stats sum(p.k) as s by event_type", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS s FROM events GROUP BY 1")
q("parse_regex", r'from pages | parse regex r"^(?<scheme>https?)://(?<host>[^/]+)/(?<path>.*)$" from url on_error drop | keep page_id, scheme, host, path', r"SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 1), '') AS scheme, nullif(regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 2), '') AS host, nullif(regexp_extract(url, '^(https?)://([^/]+)/(.*)$', 3), '') AS path FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/(.*)$')")
q("parse_pattern", 'from pages | parse pattern "<scheme>://<host>/<rest>" from url | stats count() as n by scheme, host', r"SELECT nullif(regexp_extract(url, '^(.*?)://(.*?)/(.*)$', 1), '') AS scheme, nullif(regexp_extract(url, '^(.*?)://(.*?)/(.*)$', 2), '') AS host, count(*) AS n FROM pages GROUP BY 1, 2")
q("parse_error", 'from documents | parse json | stats count() as n, count(_error) as bad', "SELECT count(*) AS n, count(*) AS bad FROM documents")
q("parse_kv", 'from orders | extend line = printf("id=%d status=%s priority=\\"%s\\"", o_orderkey, o_orderstatus, o_orderpriority) | parse logfmt from line into (id as int, status, priority) | keep id, status, priority, _error', "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, NULL AS _error FROM orders")
q("parse_combined", r'from orders | extend line = printf("10.0.0.%d - bob [14/Feb/2026:14:52:01 +0000] \"GET /o/%d HTTP/1.1\" 200 %d \"-\" \"curl/8\" rt=0.1", o_orderkey % 250, o_orderkey, o_custkey) | parse combined from line | keep o_orderkey, client_ip, ident, user, timestamp, method, uri, protocol, status, bytes, referer, user_agent', "SELECT o_orderkey, '10.0.0.' || (o_orderkey % 250) AS client_ip, NULL AS ident, 'bob' AS user, '14/Feb/2026:14:52:01 +0000' AS timestamp, 'GET' AS method, '/o/' || o_orderkey AS uri, 'HTTP/1.1' AS protocol, 200 AS status, o_custkey AS bytes, NULL AS referer, 'curl/8' AS user_agent FROM orders")
q("parse_first_of", r'from orders | extend line = if(o_orderkey % 2 == 0, printf("{\"a\": %d}", o_orderkey), printf("a=%d", o_orderkey)) | parse first_of(json, logfmt) from line into (a as int) | keep o_orderkey, a', "SELECT o_orderkey, o_orderkey AS a FROM orders")

# Functions
q("fn_string", 'from customer | extend a = upper(c_mktsegment), b = substr(c_name, -4), c = replace(c_name, r"0+", "0"), d = len(c_name), e = starts_with(c_name, "Cust"), f = ends_with(c_name, "1"), g = printf("%s/%d", c_mktsegment, c_custkey), h = join(split(c_name, "#"), "+"), i = trim("  x ") | keep c_custkey, a, b, c, d, e, f, g, h, i', "SELECT c_custkey, upper(c_mktsegment) AS a, right(c_name, 4) AS b, regexp_replace(c_name, '0+', '0', 'g') AS c, length(c_name) AS d, starts_with(c_name, 'Cust') AS e, ends_with(c_name, '1') AS f, c_mktsegment || '/' || c_custkey AS g, replace(c_name, '#', '+') AS h, 'x' AS i FROM customer")
q("fn_search", r'from documents | extend a = has(text, "the"), b = contains(text, "THE "), c = contains_cs(text, "The "), d = matches(text, r"\b[A-Z]{4,}\b"), e = extract(text, r"(\d{3,})"), f = glob(source, "src1*") | keep doc_id, a, b, c, d, e, f', r"SELECT doc_id, list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), 'the') AS a, contains(lower(text), 'the ') AS b, contains(text, 'The ') AS c, regexp_matches(text, '\b[A-Z]{4,}\b') AS d, nullif(regexp_extract(text, '(\d{3,})', 1), '') AS e, source LIKE 'src1%' AS f FROM documents")
q("fn_math", "from part | extend a = round(p_retailprice, 1), b = floor(p_retailprice), c = ceil(p_retailprice / 7), d = round(sqrt(p_retailprice), 6), e = round(ln(p_retailprice), 6), f = round(log(p_retailprice), 6), g = pow(p_size, 2), h = clamp(p_size, 10, 20), i = bucket(p_size, [0, 10, 25]), j = abs(p_size - 25), k = round(atan2(p_size, 3), 6), l = sqrt(0 - p_size) | keep p_partkey, a, b, c, d, e, f, g, h, i, j, k, l", "SELECT p_partkey, round(p_retailprice, 1) AS a, floor(p_retailprice)::BIGINT AS b, ceil(p_retailprice / 7)::BIGINT AS c, round(sqrt(p_retailprice), 6) AS d, round(ln(p_retailprice), 6) AS e, round(log10(p_retailprice), 6) AS f, pow(p_size, 2) AS g, least(greatest(p_size, 10), 20) AS h, CASE WHEN p_size >= 25 THEN 25 WHEN p_size >= 10 THEN 10 ELSE 0 END AS i, abs(p_size - 25) AS j, round(atan2(p_size, 3), 6) AS k, NULL AS l FROM part")
q("fn_time", 'from orders | extend a = bin(o_orderdate, 7d), b = strftime(o_orderdate, "%Y-%m-%d %H:%M"), c = strptime(strftime(o_orderdate, "%d/%m/%Y"), "%d/%m/%Y"), d = day_of_week(o_orderdate), e = o_orderdate + 1d, f = (o_orderdate - timestamp("1990-01-01T00:00:00Z")) / 1d | extend f = round(f, 6) | keep o_orderkey, a, b, c, d, e, f', f"SELECT o_orderkey, {bucket('o_orderdate', 7 * DAY)} AS a, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS b, date_trunc('day', o_orderdate) AS c, dayofweek(o_orderdate) AS d, o_orderdate + INTERVAL 1 DAY AS e, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1990-01-01')) / 86400000000, 6) AS f FROM orders")
q("fn_hash", "from customer | extend a = md5(c_name), b = sha1(c_name), c = sha256(c_name) | keep c_custkey, a, b, c", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer")
q("fn_xxhash", "from customer | extend a = xxhash64(c_name) | keep c_custkey, a")
q("fn_network", 'from customer | extend ip = printf("10.%d.%d.7", c_nationkey, c_custkey % 256), a = cidr_match("10.0.0.0/13", ip), b = ip_parse(ip).private, c = ipmask("255.255.0.0", ip), d = ip_parse(ip).version | keep c_custkey, a, b, c, d', "SELECT c_custkey, c_nationkey < 8 AS a, true AS b, '10.' || c_nationkey || '.0.0' AS c, 4 AS d FROM customer")
q("fn_array", 'from part | extend w = split(p_name, " "), a = w[0], b = w[-1], c = w[99], d = slice(w, 0, 1), e = any(w, x -> len(x) > 4), f = all(w, x -> len(x) > 4), g = map(w, x -> upper(x)), h = filter(w, x -> x != w[0]), i = array_sort(array_distinct(array_concat(w, w))), j = w[0] in w | keep p_partkey, a, b, c, d, e, f, g, h, i, j', "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, w[1] AS a, w[-1] AS b, NULL AS c, w[1:1] AS d, list_bool_or(list_transform(w, lambda x: length(x) > 4)) AS e, list_bool_and(list_transform(w, lambda x: length(x) > 4)) AS f, list_transform(w, lambda x: upper(x)) AS g, list_filter(w, lambda x: x <> w[1]) AS h, list_sort(list_distinct(w)) AS i, true AS j FROM p")
q("fn_object", 'from region | extend o = {id: r_regionkey, name: r_name}, a = o.name, b = o["id"], c = has_key(o, "name"), d = keys(o), e = to_json(o) | keep r_regionkey, a, b, c, d, e', "SELECT r_regionkey, r_name AS a, r_regionkey AS b, true AS c, ['id', 'name'] AS d, '{\"id\":' || r_regionkey || ',\"name\":\"' || r_name || '\"}' AS e FROM region")
q("fn_convert", 'from orders | extend a = int("3.7"), b = float("x"), c = bool("yes"), d = string(o_custkey), e = int(o_totalprice), f = duration("90s") / 1m, g = timestamp("2024-01-02T03:04:05Z"), h = typeof(o_custkey), i = if(o_custkey > 50, "hi", "lo"), j = case(o_custkey < 10, "a", o_custkey < 50, "b", "c"), k = nullif(o_orderstatus, "F") | keep o_orderkey, a, b, c, d, e, f, g, h, i, j, k', "SELECT o_orderkey, 3 AS a, NULL AS b, true AS c, o_custkey::VARCHAR AS d, trunc(o_totalprice)::BIGINT AS e, 1.5 AS f, TIMESTAMP '2024-01-02 03:04:05' AS g, 'int' AS h, CASE WHEN o_custkey > 50 THEN 'hi' ELSE 'lo' END AS i, CASE WHEN o_custkey < 10 THEN 'a' WHEN o_custkey < 50 THEN 'b' ELSE 'c' END AS j, nullif(o_orderstatus, 'F') AS k FROM orders")
q("fn_url", 'from pages | extend u = url_parse(url) | extend scheme = u.scheme, host = u.host, back = urldecode("a%20b") | keep page_id, scheme, host, back', r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host, 'a b' AS back FROM pages")
q("fn_path", 'from nation | extend a = path_normalize("/a//b/./c/../d/"), b = trim("xxnxx", "x"), c = len(urldecode("%41")), d = flatten([[1, 2], [3]]), e = now() - now() == 0s | keep n_nationkey, a, b, c, d, e', "SELECT n_nationkey, '/a/b/d' AS a, 'n' AS b, 1 AS c, [1, 2, 3] AS d, true AS e FROM nation")
q("fn_agent", 'from nation | extend u = useragent_parse("Mozilla/5.0 (X11; Linux x86_64) Firefox/115.0") | extend b = u.browser, v = u.version, o = u.os | keep n_nationkey, b, v, o', "SELECT n_nationkey, 'Firefox' AS b, '115.0' AS v, 'Linux' AS o FROM nation")

# Formats, over lines that are made of table columns
LINE = "from orders | extend k = o_orderkey, c = o_custkey, s = o_orderstatus | extend line = "
q("parse_kv_options", LINE + r'''printf("id:%d;status:'%s x';n:%d", k, s, c) | parse kv(sep=";", assign=":", quote="'") from line into (id as int, status, n as int) | keep k, id, status, n''', "SELECT o_orderkey AS k, o_orderkey AS id, o_orderstatus || ' x' AS status, o_custkey AS n FROM orders")
q("parse_clf", LINE + r'printf("192.0.2.%d - ann [01/Mar/2025:08:00:00 +0000] \"POST /c/%d HTTP/2\" 201 -", c % 200, k) | parse clf from line | keep k, client_ip, user, method, uri, protocol, status, bytes', "SELECT o_orderkey AS k, '192.0.2.' || (o_custkey % 200) AS client_ip, 'ann' AS user, 'POST' AS method, '/c/' || o_orderkey AS uri, 'HTTP/2' AS protocol, 201 AS status, NULL AS bytes FROM orders")
q("parse_syslog", LINE + r'if(k % 2 == 0, printf("<%d>Mar  1 08:00:00 node%d billing[%d]: order %s shipped", k % 192, c % 7, c, s), printf("<%d>1 2025-03-01T08:00:00Z node%d billing %d ID7 - order %s shipped", k % 192, c % 7, c, s)) | parse syslog from line | keep k, priority, facility, severity, hostname, appname, procid, message, format, version', "SELECT o_orderkey AS k, o_orderkey % 192 AS priority, (o_orderkey % 192) // 8 AS facility, o_orderkey % 8 AS severity, 'node' || (o_custkey % 7) AS hostname, 'billing' AS appname, o_custkey::VARCHAR AS procid, 'order ' || o_orderstatus || ' shipped' AS message, CASE WHEN o_orderkey % 2 = 0 THEN 'rfc3164' ELSE 'rfc5424' END AS format, CASE WHEN o_orderkey % 2 = 1 THEN 1 END AS version FROM orders")
q("parse_nginx_error", LINE + r'printf("2025/03/01 08:00:00 [warn] %d#%d: *%d client sent too large body, client: 192.0.2.9, server: shop, request: \"PUT /o/%d HTTP/1.1\", host: \"shop.example\"", c, c % 5, k, k) | parse nginx_error from line | keep k, severity, pid, tid, cid, message, client, server, method, uri, host', "SELECT o_orderkey AS k, 'warn' AS severity, o_custkey AS pid, o_custkey % 5 AS tid, o_orderkey AS cid, 'client sent too large body' AS message, '192.0.2.9' AS client, 'shop' AS server, 'PUT' AS method, '/o/' || o_orderkey AS uri, 'shop.example' AS host FROM orders")
q("parse_apache_error", LINE + r'printf("[Sat Mar 01 08:00:00.000001 2025] [proxy:warn] [pid %d:tid %d] [client 192.0.2.7:%d] AH01144: no handler for %s", c, k, 1024 + c % 60000, s) | parse apache_error from line | keep k, module, severity, pid, tid, client_ip, client_port, error_code, message', "SELECT o_orderkey AS k, 'proxy' AS module, 'warn' AS severity, o_custkey AS pid, o_orderkey AS tid, '192.0.2.7' AS client_ip, 1024 + o_custkey % 60000 AS client_port, 'AH01144' AS error_code, 'no handler for ' || o_orderstatus AS message FROM orders")
q("parse_cef", LINE + r'printf("CEF:0|Acme|Gate|2.1|%d|order %s|5|cs1=%d act=held back dst=192.0.2.1", k, s, c) | parse cef from line | keep k, device_vendor, signature_id, name, severity, cs1, act, dst', "SELECT o_orderkey AS k, 'Acme' AS device_vendor, o_orderkey::VARCHAR AS signature_id, 'order ' || o_orderstatus AS name, '5' AS severity, o_custkey AS cs1, 'held back' AS act, '192.0.2.1' AS dst FROM orders")
q("parse_leef", LINE + r'printf("LEEF:2.0|Acme|Gate|2.1|%d|;|cust=%d;state=%s x", k, c, s) | parse leef from line into (event_id, cust as int, state) | keep k, event_id, cust, state', "SELECT o_orderkey AS k, o_orderkey::VARCHAR AS event_id, o_custkey AS cust, o_orderstatus || ' x' AS state FROM orders")
q("parse_docker", LINE + r'printf("{\"log\":\"order %d is %s\",\"stream\":\"stderr\",\"time\":\"2025-03-01T08:00:00Z\"}", k, s) | parse docker from line | keep k, log, stream, time', "SELECT o_orderkey AS k, 'order ' || o_orderkey || ' is ' || o_orderstatus AS log, 'stderr' AS stream, '2025-03-01T08:00:00Z' AS time FROM orders")
q("parse_redis", LINE + r'printf("%d:S 01 Mar 2025 08:00:00.125 # order %d kept", c, k) | parse redis from line | keep k, pid, role, level, timestamp, message', "SELECT o_orderkey AS k, o_custkey AS pid, 'replica' AS role, 'warning' AS level, '01 Mar 2025 08:00:00.125' AS timestamp, 'order ' || o_orderkey || ' kept' AS message FROM orders")
q("parse_postgres", LINE + r'printf("2025-03-01 08:00:00.125 UTC [%d] ann@shop LOG:  duration: %d.5 ms  statement: SELECT %d", c, c % 900, k) | parse postgres from line | keep k, pid, user, database, severity, duration_ms, statement', "SELECT o_orderkey AS k, o_custkey AS pid, 'ann' AS user, 'shop' AS database, 'LOG' AS severity, (o_custkey % 900) + 0.5::DOUBLE AS duration_ms, 'SELECT ' || o_orderkey AS statement FROM orders")
q("parse_mysql_slow", LINE + r'printf("# Time: 2025-03-01T08:00:00.5Z\n# User@Host: ann[ann] @ shop [192.0.2.3]  Id: %d\n# Query_time: %d.25  Lock_time: 0.5  Rows_sent: %d  Rows_examined: %d\nSELECT %d;", k, c % 60, c, k, k) | parse mysql_slow from line | keep k, user, host, client_ip, connection_id, query_time, lock_time, rows_sent, rows_examined, statement', "SELECT o_orderkey AS k, 'ann' AS user, 'shop' AS host, '192.0.2.3' AS client_ip, o_orderkey AS connection_id, (o_custkey % 60) + 0.25::DOUBLE AS query_time, 0.5::DOUBLE AS lock_time, o_custkey AS rows_sent, o_orderkey AS rows_examined, 'SELECT ' || o_orderkey || ';' AS statement FROM orders")
q("parse_haproxy", LINE + r'printf("192.0.2.8:%d [01/Mar/2025:08:00:00.125] shop~ carts/cart%d 1/2/3/%d/%d 503 %d - - sC-- 4/3/2/1/+1 0/0 \"GET /cart/%d HTTP/1.1\"", 1024 + c % 60000, c % 9, c % 100, c % 100 + 6, c, k) | parse haproxy from line | keep k, client_port, frontend, backend, server, tr, tt, status, bytes, term_state, actconn, method, uri', "SELECT o_orderkey AS k, 1024 + o_custkey % 60000 AS client_port, 'shop~' AS frontend, 'carts' AS backend, 'cart' || (o_custkey % 9) AS server, o_custkey % 100 AS tr, o_custkey % 100 + 6 AS tt, 503 AS status, o_custkey AS bytes, 'sC--' AS term_state, 4 AS actconn, 'GET' AS method, '/cart/' || o_orderkey AS uri FROM orders")
q("parse_w3c", LINE + r'printf("2025-03-01 08:00:00 GET /o/%d - %d", k, c) | parse w3c("#Fields: date time cs-method cs-uri-stem cs-uri-query time-taken") from line into (cs_method, cs_uri_stem, cs_uri_query, time_taken as int) | keep k, cs_method, cs_uri_stem, cs_uri_query, time_taken', "SELECT o_orderkey AS k, 'GET' AS cs_method, '/o/' || o_orderkey AS cs_uri_stem, NULL AS cs_uri_query, o_custkey AS time_taken FROM orders")
q("parse_late_fields", r'from events | extend line = if(event_id % 10 == 0, printf("{\"a\": %d.5, \"late\": \"x%d\"}", event_id, event_id), printf("{\"a\": %d}", event_id)) | parse json from line | keep event_id, a, late', "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id + 0.5 ELSE event_id END::DOUBLE AS a, CASE WHEN event_id % 10 = 0 THEN 'x' || event_id END AS late FROM events")
q("parse_odd_bytes", r'from nation | extend line = "k=1" + urldecode("%01") + "z" + urldecode("%02") + " " + n_name | parse regex r"k=(?<v>\S+) (?<w>\w+)" from line | extend v = md5(v) | keep n_nationkey, v, w', r"SELECT n_nationkey, md5('1' || chr(1) || 'z' || chr(2)) AS v, regexp_extract(n_name, '^\w+', 0) AS w FROM nation")

# More functions
q("fn_trigonometry", "from part | extend x = p_size / 100.0 | extend a = round(exp(x), 6), b = round(sin(x), 6), c = round(cos(x), 6), d = round(tan(x), 6), e = round(asin(x), 6), f = round(acos(x), 6), g = round(atan(x), 6) | keep p_partkey, a, b, c, d, e, f, g", "SELECT p_partkey, round(exp(p_size / 100.0), 6) AS a, round(sin(p_size / 100.0), 6) AS b, round(cos(p_size / 100.0), 6) AS c, round(tan(p_size / 100.0), 6) AS d, round(asin(p_size / 100.0), 6) AS e, round(acos(p_size / 100.0), 6) AS f, round(atan(p_size / 100.0), 6) AS g FROM part")
q("fn_trims", 'from customer | extend a = ltrim("  " + c_name + " "), b = rtrim(" " + c_name + "  "), c = ltrim(c_name, "Cus"), d = coalesce(nullif(c_mktsegment, "BUILDING"), "none"), e = extract_all(c_name, r"[1-9]") | keep c_custkey, a, b, c, d, e', "SELECT c_custkey, c_name || ' ' AS a, ' ' || c_name AS b, ltrim(c_name, 'Cus') AS c, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS d, nullif(regexp_extract_all(c_name, '[1-9]'), []) AS e FROM customer")
q("fn_objects", 'from region | extend a = {id: string(r_regionkey)}, b = {name: r_name}, c = merge(a, b), d = values(c), e = keys(c), f = time_of_day(timestamp("2024-01-02T03:04:05Z")) / 1s | keep r_regionkey, d, e, f', "SELECT r_regionkey, [r_regionkey::VARCHAR, r_name] AS d, ['id', 'name'] AS e, 11045.0 AS f FROM region")
q("fn_strict", 'from orders | extend a = int!(string(o_custkey)), b = float!("2.5"), c = bool!("true") | keep o_orderkey, a, b, c', "SELECT o_orderkey, o_custkey AS a, 2.5 AS b, true AS c FROM orders")
q("fn_paths", 'from nation | extend a = path_normalize("/a/b/c/d/e/../../../../.."), b = path_normalize("x/../../y/./z//"), c = path_normalize("/../" + n_name), d = path_normalize("a/..") | keep n_nationkey, a, b, c, d', "SELECT n_nationkey, '/' AS a, '../y/z' AS b, '/' || n_name AS c, '.' AS d FROM nation")
q("fn_json_former", 'from nation | extend j = json_object("name", n_name, "n", n_nationkey, "s", "7"), t = json_type(j, "n"), u = json_type(j), a = json_array(n_nationkey, n_name, true), x = json_set(j, "o.p", 5), r = json_remove(j, "name"), m = json_merge(j, json_object("n", 0)), v = json_valid(j), p = json_extract(j, "$.s"), l = json_array_length(a) | keep n_nationkey, j, t, u, a, x, r, m, v, p, l', """SELECT n_nationkey, '{"n":' || n_nationkey || ',"name":"' || n_name || '","s":7}' AS j, 'number' AS t, 'object' AS u, '[' || n_nationkey || ',"' || n_name || '",true]' AS a, '{"n":' || n_nationkey || ',"name":"' || n_name || '","s":7,"o":{"p":5}}' AS x, '{"n":' || n_nationkey || ',"s":7}' AS r, '{"n":0,"name":"' || n_name || '","s":7}' AS m, true AS v, '7' AS p, 3 AS l FROM nation""")
q("fn_former", 'from part | extend w = split(p_name, " "), a = ilike(p_name, "%A%"), b = mvjoin(w, "+"), c = mvcount(mvdedup(mvappend(w, w))), d = greatest(p_size, 10), e = least(p_size, 10), f = isnum(string(p_size)), g = isint("x"), h = isarray(w), i = isobject("{}"), j = isbool(true), k = len(sha512(p_name)) | keep p_partkey, a, b, c, d, e, f, g, h, i, j, k', "SELECT p_partkey, p_name ILIKE '%A%' AS a, replace(p_name, ' ', '+') AS b, len(list_distinct(string_split(p_name, ' '))) AS c, greatest(p_size, 10) AS d, least(p_size, 10) AS e, true AS f, false AS g, true AS h, true AS i, true AS j, 128 AS k FROM part")
q("stats_null_keys", "from documents | join type=left on doc_id with [from labels] | stats count() as n, max(doc_id) as m by quality", "SELECT quality, count(*) AS n, max(doc_id) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
q("stats_default_names", "from orders | stats count(), max(o_totalprice), dc(o_custkey) by o_orderstatus", "SELECT o_orderstatus, count(*) AS \"count()\", max(o_totalprice) AS \"max(o_totalprice)\", count(DISTINCT o_custkey) AS \"dc(o_custkey)\" FROM orders GROUP BY 1")
q("stats_estdc_bounds", "from events | stats estdc(user_id) as e, dc(user_id) as n, estdc_error(user_id) as r by event_type | extend near = abs(e - n) <= 0.05 * n + 1, some = r >= 0 | keep event_type, near, some", "SELECT event_type, true AS near, true AS some FROM events GROUP BY 1")
q("stats_more_percentiles", "from events | stats p25(value) as a, perc(value, 33) as b by event_type | extend a = round(a, 6), b = round(b, 6)", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS a, round(quantile_cont(value, 0.33), 6) AS b FROM events GROUP BY 1")
q("describe_top_values", "from orders | keep o_orderstatus | describe | explode top_values as t | keep field, t", "SELECT 'o_orderstatus' AS field, o_orderstatus || '(' || count(*) || ')' AS t FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC, o_orderstatus LIMIT 5")
q("trace_chain", 'from conversations | extend trace_id = string(conv_id), span_id = printf("%d-%d", conv_id, turn), parent_id = printf("%d-%d", conv_id, turn - 1), _time = timestamp(turn), operation = role | trace | keep trace_id, operation, _span_depth, _span_tree', "SELECT conv_id::VARCHAR AS trace_id, role AS operation, d AS _span_depth, CASE WHEN d = 0 THEN role ELSE repeat('    ', (d - 1)::INTEGER) || '└── ' || role END AS _span_tree FROM (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) AS d FROM conversations)")

# The comparison set of the benchmark
q("bench_filtered_agg", "from lineitem | where l_quantity >= 25 | stats count() as n, avg(l_extendedprice) as a by l_returnflag | extend a = round(a, 4)", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS a FROM lineitem WHERE l_quantity >= 25 GROUP BY 1")
q("bench_group_by", "from lineitem | stats count() as n, sum(l_quantity) as s by l_linestatus, l_returnflag", "SELECT l_linestatus, l_returnflag, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2")
q("bench_token_search", "from documents licensed | stats count() as n by source", "SELECT source, count(*) AS n FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), 'licensed') GROUP BY 1")
q("bench_range_top", "from events | where value > 20 and value <= 80 | top 5 user_id", "SELECT user_id, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM events WHERE value > 20 AND value <= 80 GROUP BY 1 ORDER BY count DESC, user_id LIMIT 5")
q("bench_time_bucket", "from events | every 5m stats count() as n", f"SELECT {bucket('ts', 300_000_000)} AS _time, count(*) AS n FROM events GROUP BY 1")


def runner(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(text, NOW)

    return run


# Queries that are calls: views, questions about a source, operators of the former dialect

CALLS: dict = {}


def call(name: str, sql: str):
    def put(fn):
        CALLS[name] = fn
        SQL[name] = sql
        return fn

    return put


VIEW = "from events | stats count() as n, sum(value) as s, avg(value) as a, max(value) as m, stdev(value) as d by event_type, bin(_time, 1h)"


def viewed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query answered by a view, or an error."""
    e = engine(spark, sf_dir)
    Views(e, shared_folder(spark)).create(VIEW, "hourly")
    found = e.run(text, NOW)
    if found.query.pipeline.stages[0].name != "viewscan":
        raise RuntimeError("the view isn't used")
    return found.df


@call("view_exact", f"SELECT event_type, {bucket('ts', HOUR)} AS _time, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY 1, 2")
def view_exact(spark, sf_dir):
    return viewed(spark, sf_dir, "from events | stats count() as n, avg(value) as a by event_type, bin(_time, 1h) | extend a = round(a, 6)")


@call("view_fewer_keys", "SELECT event_type, round(sum(value), 4) AS s, max(value) AS m, round(stddev_samp(value), 5) AS d FROM events GROUP BY 1")
def view_fewer_keys(spark, sf_dir):
    return viewed(spark, sf_dir, "from events | stats sum(value) as s, max(value) as m, stdev(value) as d by event_type | extend s = round(s, 4), d = round(d, 5)")


@call("view_wider_buckets", f"SELECT {bucket('ts', DAY)} AS _time, count(*) AS n FROM events GROUP BY 1")
def view_wider_buckets(spark, sf_dir):
    return viewed(spark, sf_dir, "from events | stats count() as n by bin(_time, 1d)")


@call("view_large_values", "SELECT event_type, round(stddev_samp(value), 4) AS d FROM events GROUP BY 1")
def view_large_values(spark, sf_dir):
    """A spread of some tens about a thousand million."""
    e = engine(spark, sf_dir)
    start = "from events | extend far = value + 1000000000.0 | "
    Views(e, shared_folder(spark)).create(start + "stats stdev(far) as d by event_type, bin(_time, 1h)", "far")
    return e.run(start + "stats stdev(far) as d by event_type | extend d = round(d, 4)", NOW).df


@call("meta_histogram", f"SELECT {bucket('o_orderdate', 7 * DAY)} AS bucket, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2")
def meta_histogram(spark, sf_dir):
    return metadata.histogram(engine(spark, sf_dir).query("from orders"), 7 * DAY, by="o_orderstatus")


@call("meta_field_values", "SELECT o_orderpriority AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def meta_field_values(spark, sf_dir):
    return metadata.field_values(engine(spark, sf_dir).query("from orders"), "o_orderpriority")


@call("meta_fields", "SELECT 'n_nationkey' AS field, count(n_nationkey) AS present, 1.0::DOUBLE AS coverage FROM nation UNION ALL SELECT 'n_name', count(n_name), 1.0 FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey), 1.0 FROM nation")
def meta_fields(spark, sf_dir):
    return metadata.field_catalog(engine(spark, sf_dir).query("from nation")).select("field", "present", "coverage")


@call("old_fillnull", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def old_fillnull(spark, sf_dir):
    f = engine(spark, sf_dir).run("from documents | join type=left on doc_id with [from labels] | keep doc_id, quality").frame
    return legacy.fillnull(f, -1, ["quality"]).output()


@call("old_untable", "SELECT n_nationkey, 'n_name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def old_untable(spark, sf_dir):
    return legacy.untable(engine(spark, sf_dir).run("from nation").frame, "n_nationkey", "k", "v").output()


@call("old_mvcombine", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1")
def old_mvcombine(spark, sf_dir):
    return legacy.mvcombine(engine(spark, sf_dir).run("from nation | keep n_regionkey, n_name").frame, "n_name").output()


@call("old_makemv_nomv", "SELECT p_partkey, string_split(p_name, ' ') AS words, replace(p_name, ' ', '+') AS again FROM part")
def old_makemv_nomv(spark, sf_dir):
    f = engine(spark, sf_dir).run("from part | extend words = p_name, again = p_name | keep p_partkey, words, again").frame
    return legacy.nomv(legacy.makemv(legacy.makemv(f, "words", " "), "again", " "), "again", "+").output()


@call("old_appendcols", "SELECT n_nationkey, r_name FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def old_appendcols(spark, sf_dir):
    e = engine(spark, sf_dir)
    return legacy.appendcols(e.run("from nation | keep n_nationkey").frame, e.run("from region | keep r_name").frame).output()


@call("old_offset", "SELECT c_custkey FROM customer WHERE c_custkey > (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 1 OFFSET 9)")
def old_offset(spark, sf_dir):
    return legacy.offset(engine(spark, sf_dir).run("from customer | keep c_custkey").frame, 10).output()


@call("old_unpack", "SELECT event_id, (props->>'$.k')::BIGINT AS \"p.k\" FROM events")
def old_unpack(spark, sf_dir):
    f = engine(spark, sf_dir).run("from events | keep event_id, props").frame
    return legacy.unpack(f, "json", "props", "p.").output().select("event_id", "`p.k`")


@call("old_reverse", "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 3")
def old_reverse(spark, sf_dir):
    f = legacy.reverse(engine(spark, sf_dir).run("from nation | keep n_name").frame)
    return f.df.orderBy(*f.sort_columns()).limit(3).select("n_name")


@call("old_pack_json", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS packed FROM region")
def old_pack_json(spark, sf_dir):
    return legacy.pack_json(engine(spark, sf_dir).run("from region").frame, ["r_regionkey", "r_name"], "packed").output().select("r_regionkey", "packed")


def queries() -> dict:
    return {name: runner(text) for name, text in TEXTS.items()} | CALLS
