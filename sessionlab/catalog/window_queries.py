"""Queries on neighbouring sessions, numbering and group values on every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlab.catalog.aggregate_queries import KURT3, SKEW3, digits_of, rounded
from sessionlab.catalog.inputs import S, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.operators import windows as W

_OVER = "OVER (PARTITION BY user_id ORDER BY start, event_id)"


def _visits(spark, d):
    return sessions(spark, d).select("event_id", "user_id", "start")


@query("neighbour_session", f"""
WITH {S} SELECT event_id, {', '.join(
    f"round({f}(start, {i}) {_OVER} / 3600.0, 6) AS {n}_start_{i}"
    for i in (1, 2, 3) for n, f in (('prev', 'lag'), ('next', 'lead')))} FROM s""")
def neighbour_session(spark, d):
    out = W.neighbour_sessions(_visits(spark, d), "user_id", "start", ["event_id"], 3).drop("user_id", "start")
    return rounded(out, *[c for c in out.columns if c != "event_id"], digits=6)


@query("neighbour_gap", f"""
WITH {S} SELECT event_id, {', '.join(
    [f"round((start - lag(start, {i}) {_OVER}) / 3600.0, 6) AS prev_gap_{i}" for i in (1, 2)]
    + [f"round((lead(start, {i}) {_OVER} - start) / 3600.0, 6) AS next_gap_{i}" for i in (1, 2)])} FROM s""")
def neighbour_gap(spark, d):
    out = W.neighbour_sessions(_visits(spark, d), "user_id", "start", ["event_id"], 2, gaps=True).drop("user_id", "start")
    return rounded(out, *[c for c in out.columns if c != "event_id"], digits=6)


@query("neighbour_session_sliced", f"""
WITH {S} SELECT event_id, round(lag(start, 1) {_OVER} / 3600.0, 6) AS prev_start_1,
  round(lag(start, 2) {_OVER} / 3600.0, 6) AS prev_start_2, round(lead(start, 1) {_OVER} / 3600.0, 6) AS next_start_1,
  round(lead(start, 2) {_OVER} / 3600.0, 6) AS next_start_2 FROM s""")
def neighbour_session_sliced(spark, d):
    """The same with a limit so low that the rows are cut into blocks of 20, so that most visitors cross an edge."""
    rows = _visits(spark, d)
    out = W.neighbour_sessions(rows, "user_id", "start", ["event_id"], 2, hot_rows=20).drop("user_id", "start")
    return rounded(out, *[c for c in out.columns if c != "event_id"], digits=6)


@query("higher_order_feature", f"""
WITH {S} SELECT event_id, round(lag(start, 2) {_OVER} / 3600.0, 6) AS two_before,
  round(lead(start, 1) {_OVER} / 3600.0, 6) AS one_after FROM s""")
def higher_order_feature(spark, d):
    """The feature function takes ``lag`` or ``lead`` as an argument."""
    rows = W.neighbour_session(_visits(spark, d), "user_id", "start", ["event_id"], F.lag, 2, "two_before")
    rows = W.neighbour_session(rows, "user_id", "start", ["event_id"], F.lead, 1, "one_after")
    return rounded(rows.drop("user_id", "start"), "two_before", "one_after", digits=6)


@query("session_gap", f"WITH {S} SELECT event_id, round((lead(start) {_OVER} - start) / 3600.0, 6) AS gap FROM s")
def session_gap(spark, d):
    out = W.session_gap(_visits(spark, d), "user_id", "start", ["event_id"])
    return rounded(out.select("event_id", "gap"), "gap", digits=6)


@query("gap_neighbours", f"""
WITH {S}, g AS (SELECT *, (lead(start) {_OVER} - start) / 3600.0 AS gap FROM s)
SELECT event_id, round(lead(gap) {_OVER}, 6) AS gap_lead, round(lag(gap) {_OVER}, 6) AS gap_lag FROM g""")
def gap_neighbours(spark, d):
    out = W.gap_neighbours(_visits(spark, d), "user_id", "start", ["event_id"])
    return rounded(out.select("event_id", "gap_lead", "gap_lag"), "gap_lead", "gap_lag", digits=6)


_BROADCAST = {"mean": "avg({0})", "sd": "stddev_samp({0})", "skewness": SKEW3, "kurtosis": KURT3,
              "sum": "coalesce(sum({0}), 0)", "max": "max({0})", "min": "min({0})"}


@query("group_broadcast", f"""
WITH {S}, g AS (SELECT channel AS c, {', '.join(f"{e.format('log_value')} AS s_{n}" for n, e in _BROADCAST.items())} FROM s GROUP BY channel)
SELECT event_id, {', '.join(f"round(s_{n}, {digits_of(n)}) AS log_value_{n}_channel" for n in _BROADCAST)}
FROM s LEFT JOIN g ON s.channel IS NOT DISTINCT FROM g.c""")
def group_broadcast(spark, d):
    rows = sessions(spark, d).select("event_id", "channel", "log_value")
    out = W.group_broadcast(rows, "channel", ["log_value"], list(_BROADCAST))
    names = [f"log_value_{n}_channel" for n in _BROADCAST]
    return rounded(out.select("event_id", *names), *names)


@query("group_functions", f"""
WITH {S}, g AS (SELECT channel AS c, avg(log_value) AS m, max(log_value) AS x FROM s WHERE channel IS NOT NULL GROUP BY channel)
SELECT event_id, round(CASE WHEN channel IS NULL THEN log_value ELSE m END, 8) AS log_value_mean_channel,
  round(CASE WHEN channel IS NULL THEN log_value ELSE x END, 5) AS log_value_max_channel FROM s LEFT JOIN g ON channel = c""")
def group_functions(spark, d):
    """The other convention: rows without a group keep their own value."""
    rows = sessions(spark, d).select("event_id", "channel", "log_value")
    out = W.group_broadcast(rows, "channel", ["log_value"], ["mean", "max"], keep_ungrouped=True)
    return rounded(out.drop("channel", "log_value"), "log_value_mean_channel", "log_value_max_channel")


@query("distinct_broadcast", f"""
WITH {S}, t AS (SELECT event_id, user_id, channel, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS wday FROM s),
a AS (SELECT hour, count(DISTINCT user_id) AS n FROM t GROUP BY hour),
b AS (SELECT wday, count(DISTINCT user_id) AS n FROM t GROUP BY wday),
c AS (SELECT channel, count(DISTINCT user_id) AS n FROM t GROUP BY channel)
SELECT event_id, a.n AS hour_user_cnt, b.n AS wday_user_cnt, c.n AS channel_user_cnt
FROM t JOIN a ON t.hour = a.hour JOIN b ON t.wday = b.wday JOIN c ON t.channel IS NOT DISTINCT FROM c.channel""")
def distinct_broadcast(spark, d):
    rows = sessions(spark, d).select("event_id", "user_id", "channel", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("wday"))
    out = W.distinct_broadcast(rows, ["hour", "wday", "channel"], "user_id")
    return out.select("event_id", "hour_user_cnt", "wday_user_cnt", "channel_user_cnt")


@query("row_number_per_key", f"WITH {S} SELECT event_id, CAST(row_number() {_OVER} AS INTEGER) AS n FROM s")
def row_number_per_key(spark, d):
    return W.row_number_per_key(_visits(spark, d), "user_id", "start", ["event_id"]).select("event_id", "n")


@query("first_n_per_key", f"""
WITH {S}, r AS (SELECT event_id, user_id, CAST(row_number() {_OVER} AS INTEGER) AS n FROM s)
SELECT * FROM r WHERE n <= 30""")
def first_n_per_key(spark, d):
    return W.first_n_per_key(_visits(spark, d), "user_id", "start", ["event_id"], 30).select("event_id", "user_id", "n")


@query("day_ordinal", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS INTEGER) AS day_no FROM orders""")
def day_ordinal(spark, d):
    return W.day_ordinal(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select(
        "o_orderkey", "day_no")
