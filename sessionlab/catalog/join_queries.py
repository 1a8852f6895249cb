"""Queries on joins, stacking and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlab.catalog.inputs import S, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.operators import joins as J
from sessionlab.operators.aggregates import count_by, stats_by
from sessionlab.sources.schemas import BLEND_WEIGHTS


@query("left_join_nullsafe", f"""
WITH {S}, g AS (SELECT channel, count(*) AS n, round(avg(log_value), 8) AS value_r FROM s GROUP BY channel)
SELECT s.event_id, s.channel, s.value, g.n, g.value_r FROM s LEFT JOIN g ON s.channel IS NOT DISTINCT FROM g.channel""")
def left_join_nullsafe(spark, d):
    rows = sessions(spark, d).select("event_id", "channel", "value", "log_value")
    groups = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("log_value"), 8).alias("value"))
    return J.left_join_nullsafe(rows.drop("log_value"), groups, "channel")


@query("left_join_multi", f"""
WITH {S}, g AS (SELECT user_id, channel, count(*) AS n FROM s GROUP BY user_id, channel)
SELECT s.event_id, s.user_id, s.channel, g.n FROM s LEFT JOIN g
ON s.user_id = g.user_id AND s.channel IS NOT DISTINCT FROM g.channel""")
def left_join_multi(spark, d):
    rows = sessions(spark, d).select("event_id", "user_id", "channel")
    return J.left_join_multi(rows, count_by(rows, "user_id", "channel"), ["user_id", "channel"])


def _scores(spark, d):
    """One score per visitor, and a template that also lists visitors without any session."""
    scores = stats_by(sessions(spark, d), ["user_id"], ["log_value"], ["mean"]).select(
        F.col("user_id").cast("string").alias("visitor"), F.round("log_value_mean", 8).alias("score"))
    template = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("visitor"))
    return scores, template


_TEMPLATE_SQL = """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS visitor, round(avg(ln(1 + value)), 8) AS score FROM events GROUP BY user_id),
t AS (SELECT CAST(c_custkey AS VARCHAR) AS visitor FROM customer)
SELECT t.visitor, p.score FROM {}"""


@query("right_join_template", _TEMPLATE_SQL.format("p RIGHT JOIN t ON p.visitor = t.visitor"))
def right_join_template(spark, d):
    scores, template = _scores(spark, d)
    return J.right_join_template(scores, template, "visitor")


@query("left_join_template", _TEMPLATE_SQL.format("t LEFT JOIN p ON p.visitor = t.visitor"))
def left_join_template(spark, d):
    scores, template = _scores(spark, d)
    return J.left_join_template(template, scores, "visitor")


TYPES = ("signup", "error", "click", "view", "purchase")


def score_files(spark, d):
    """Six result files: a visitor score over all sessions, and one per session type (missing for a visitor
    without sessions of the type)."""
    rows = sessions(spark, d)
    parts = [rows] + [rows.filter(F.col("event_type") == t) for t in TYPES]
    return [stats_by(p, ["user_id"], ["value"], ["mean"]).select(
        F.col("user_id"), F.log1p("value_mean").alias("score")) for p in parts]


SCORE_SQL = "SELECT e.user_id, " + ", ".join(
    f"s{i}.score AS score_{i}" for i in range(1, 7)) + " FROM (SELECT DISTINCT user_id FROM events) e " + " ".join(
    f"LEFT JOIN (SELECT user_id, ln(1 + avg(value)) AS score FROM events {w} GROUP BY user_id) s{i} ON e.user_id = s{i}.user_id"
    for i, w in enumerate([""] + [f"WHERE event_type = '{t}'" for t in TYPES], 1))


@query("multi_left_join", "SELECT user_id, " + ", ".join(f"round(score_{i}, 6) AS score_{i}" for i in range(1, 7))
       + f" FROM ({SCORE_SQL})")
def multi_left_join(spark, d):
    joined = J.multi_left_join(score_files(spark, d), "user_id", "score")
    return joined.select("user_id", *[F.round(f"score_{i}", 6).alias(f"score_{i}") for i in range(1, 7)])


@query("bind_cols", """
SELECT event_id, event_type, value FROM events""")
def bind_cols(spark, d):
    """Two files that belong side by side are matched on a stored row id, never by position."""
    events = table(spark, d, "events")
    return J.zip_by_row_id(events.select("event_id", "event_type"), events.select("event_id", "value"), "event_id")


@query("period_lookup", """
SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08' THEN 1
  WHEN ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' THEN 2
  WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 3
  WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 4 END AS period FROM events""")
def period_lookup(spark, d):
    periods = [("2024-01-03", "2024-01-08", 1), ("2024-01-08", "2024-01-15", 2),
               ("2024-01-15", "2024-01-22", 3), ("2024-01-22", "2024-01-29", 4)]
    return J.period_lookup(table(spark, d, "events"), F.col("ts").cast("date"), periods).select("event_id", "period")


@query("attach_group_stats_self", f"""
WITH {S}, g AS (SELECT user_id, max(value) AS hi, min(value) AS lo FROM s GROUP BY user_id)
SELECT event_id, value = hi AS is_best, value = lo AS is_worst FROM s JOIN g USING (user_id)""")
def attach_group_stats_self(spark, d):
    rows = sessions(spark, d).select("event_id", "user_id", "value")
    out = J.left_join_nullsafe(rows, stats_by(rows, ["user_id"], ["value"], ["min", "max"]), "user_id")
    return out.select("event_id", (F.col("value") == F.col("value_max")).alias("is_best"),
                      (F.col("value") == F.col("value_min")).alias("is_worst"))


@query("union_fill", """
SELECT CAST(c_acctbal AS DOUBLE) AS balance, c_custkey AS id, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_acctbal, s_suppkey, NULL FROM supplier""")
def union_fill(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                                                   F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return J.union_fill(customers, suppliers, sort_columns=True)


@query("sort_by_date", "SELECT o_orderkey, o_orderdate FROM orders")
def sort_by_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("sort_multi", "SELECT user_id, ts, event_id FROM events")
def sort_multi(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id").orderBy("user_id", "ts", "event_id")


@query("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def top_k(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30)


@query("blend", "SELECT user_id, round(" + " + ".join(f"{w} * score_{i}" for i, w in enumerate(BLEND_WEIGHTS, 1))
       + f", 6) AS score FROM ({SCORE_SQL})")
def blend_query(spark, d):
    from sessionlab.operators.scoring import blend
    return blend(score_files(spark, d), BLEND_WEIGHTS, "user_id", "score").select("user_id", F.round("score", 6).alias("score"))
