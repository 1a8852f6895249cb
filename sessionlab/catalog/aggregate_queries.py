"""Queries on group statistics and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlab.catalog.inputs import S, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.functions.columns import distinct_with_null
from sessionlab.operators import aggregates as A
from sessionlab.operators import profiling as P
from sessionlab.operators.skew import exact_quantile
from sessionlab.operators.windows import first_n_per_key

# Type-3 moments in DuckDB: its own skewness is bias-adjusted, so undo that first.
SKEW3 = ("CASE WHEN count({0}) >= 3 THEN skewness({0}) * (count({0}) - 2) / sqrt(count({0}) * (count({0}) - 1.0)) "
         "* power((count({0}) - 1.0) / count({0}), 1.5) END")
KURT3 = "(kurtosis_pop({0}) + 3) * power((count({0}) - 1.0) / count({0}), 2) - 3"

STAT_SQL = {
    "mean": "avg({0})", "median": "median({0})", "sd": "stddev_samp({0})", "var": "var_samp({0})",
    "skewness": SKEW3, "kurtosis": KURT3, "min": "min({0})", "max": "max({0})",
    "sum": "coalesce(sum({0}), 0)", "count": "count({0})",
}


def digits_of(name):
    """Means of two-decimal values get more digits: at few digits they can sit exactly on a rounding border."""
    return 8 if "mean" in name or name == "m" else 5


def rounded(df, *names, digits=None):
    return df.withColumns({n: F.round(n, digits or digits_of(n)) for n in names})


def stat_columns(measure, stats, template="{m}_{s}"):
    return ", ".join(
        f"round(CAST({STAT_SQL[s].format(measure)} AS DOUBLE), {digits_of(s)}) AS \"{template.format(m=measure, s=s)}\""
        for s in stats)


@query("count_by", f"""
WITH {S} SELECT CAST(month(ts) AS INTEGER) AS month, user_id, count(*) AS n FROM s GROUP BY ALL""")
def count_by(spark, d):
    return A.count_by(sessions(spark, d).withColumn("month", F.month("ts")), "month", "user_id")


@query("count_by_weekday_user", f"""
WITH {S} SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS wday, user_id, count(*) AS n FROM s GROUP BY ALL""")
def count_by_weekday_user(spark, d):
    return A.count_by(sessions(spark, d).withColumn("wday", F.dayofweek("ts")), "wday", "user_id")


@query("count_by_date", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL")
def count_by_date(spark, d):
    return A.count_by(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


def _one(stat, fn):
    sql = f"WITH {S} SELECT channel, CAST(hour(ts) AS INTEGER) AS hour, {stat_columns('log_value', [stat])} FROM s GROUP BY ALL"

    def run(spark, d):
        rows = sessions(spark, d).withColumn("hour", F.hour("ts"))
        return rounded(fn(rows, ["channel", "hour"], ["log_value"]), f"log_value_{stat}")

    query(f"{stat}_by", sql)(run)


for _stat, _fn in (("sum", A.sum_by), ("mean", A.mean_by), ("min", A.min_by), ("max", A.max_by), ("sd", A.sd_by),
                   ("var", A.var_by), ("median", A.median_by), ("skewness", A.skewness_by), ("kurtosis", A.kurtosis_by)):
    _one(_stat, _fn)


@query("moments_small_groups", f"""
WITH {S}, g AS (SELECT user_id, CAST(ts AS DATE) AS day, log_revenue FROM s)
SELECT user_id, day, {stat_columns('log_revenue', ['var', 'mean', 'sum', 'min', 'max', 'count'])}, {stat_columns('log_revenue', ['skewness'])}
FROM g GROUP BY ALL""")
def moments_small_groups(spark, d):
    """Groups of none, one or a few values: variance of one is NULL, sum of none is 0."""
    stats = ["var", "mean", "sum", "min", "max", "count", "skewness"]
    rows = sessions(spark, d).select("user_id", F.col("ts").cast("date").alias("day"), "log_revenue")
    # two values have skewness 0 by the moment formula; the oracle's function starts at three
    out = A.stats_by(rows, ["user_id", "day"], ["log_revenue"], stats)
    out = out.withColumn("log_revenue_skewness", F.when(F.col("log_revenue_count") >= 3, F.col("log_revenue_skewness")))
    out = out.withColumns({"log_revenue_sum": F.col("log_revenue_sum").cast("double"),
                           "log_revenue_count": F.col("log_revenue_count").cast("double")})
    return rounded(out, *[f"log_revenue_{s}" for s in stats])


@query("exact_median_large", f"""
WITH {S} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS med FROM s GROUP BY event_type""")
def exact_median_large(spark, d):
    """The median method for groups and value sets too large for counters."""
    return rounded(exact_quantile(sessions(spark, d), ["event_type"], "value", 0.5, "med"), "med", digits=6)


@query("distinct_by", f"""
WITH {S} SELECT CAST(hour(ts) AS INTEGER) AS hour,
  count(DISTINCT channel) + max(CASE WHEN channel IS NULL THEN 1 ELSE 0 END) AS with_null,
  count(DISTINCT channel) AS without_null FROM s GROUP BY ALL""")
def distinct_by(spark, d):
    rows = sessions(spark, d).withColumn("hour", F.hour("ts"))
    return rows.groupBy("hour").agg(distinct_with_null("channel").alias("with_null"),
                                    F.count_distinct("channel").alias("without_null"))


@query("count_nonnull_by", f"WITH {S} SELECT user_id, count(revenue) AS n FROM s GROUP BY user_id")
def count_nonnull_by(spark, d):
    return A.count_nonnull_by(sessions(spark, d), ["user_id"], "revenue")


GROUP_KEYS = ["channel", "user_id", "wday"]
GROUP_STATS = ["mean", "median", "var", "skewness", "min", "max", "sum"]


@query("group_stats", f"""
WITH {S}, t AS (SELECT event_id, channel, user_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS wday, log_value FROM s),
""" + ",\n".join(
    f"g_{k} AS (SELECT {k} AS key_{k}, {stat_columns('log_value', GROUP_STATS, '{m}_{s}_' + k)} FROM t GROUP BY {k})"
    for k in GROUP_KEYS) + f"""
SELECT event_id, {', '.join(f'log_value_{s}_{k}' for k in GROUP_KEYS for s in GROUP_STATS)} FROM t
""" + "\n".join(f"LEFT JOIN g_{k} ON t.{k} IS NOT DISTINCT FROM key_{k}" for k in GROUP_KEYS))
def group_stats(spark, d):
    """Seven statistics for three keys on every row; NULL is a group."""
    rows = sessions(spark, d).select("event_id", "channel", "user_id", F.dayofweek("ts").alias("wday"), "log_value")
    out = A.attach_group_stats(rows, GROUP_KEYS, ["log_value"], GROUP_STATS)
    names = [f"log_value_{s}_{k}" for k in GROUP_KEYS for s in GROUP_STATS]
    return rounded(out.select("event_id", *names), *names)


_FEATURES = ("l_quantity", "l_linenumber", "l_discount", "l_tax")


@query("mean_all_by", "SELECT l_partkey, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in _FEATURES)
       + " FROM lineitem GROUP BY l_partkey")
def mean_all_by(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", *_FEATURES)
    return rounded(A.mean_all_by(rows, "l_partkey"), *_FEATURES, digits=9)


@query("rollup_log_sum", f"""
WITH {S} SELECT user_id, round(ln(1 + sum(coalesce(revenue, 0))), 5) AS y FROM s GROUP BY user_id""")
def rollup_log_sum(spark, d):
    rows = sessions(spark, d).select("user_id", F.log1p(F.coalesce("revenue", F.lit(0.0))).alias("y"))
    return rounded(A.rollup_by(rows, "user_id", "y"), "y")


FIRST_SQL = f"""
WITH {S}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS n FROM s)
"""


def _first_30(spark, d):
    rows = sessions(spark, d).select("event_id", "user_id", "start", "value")
    return first_n_per_key(rows, "user_id", "start", ["event_id"], 30)


@query("rowwise_stats", FIRST_SQL + """
SELECT user_id, round(avg(value), 8) AS p_mean, round(median(value), 5) AS p_med, round(stddev_samp(value), 5) AS p_sd,
  round(sum(value), 5) AS p_sum, min(value) AS p_min, max(value) AS p_max FROM r WHERE n <= 30 GROUP BY user_id""")
def rowwise_stats(spark, d):
    return rounded(A.rowwise_stats(_first_30(spark, d), "user_id", "value"), "p_mean", "p_med", "p_sd", "p_sum")


@query("pivot_wide", FIRST_SQL + "SELECT user_id, " + ", ".join(
    f"max(CASE WHEN n = {i} THEN value END) AS pred{i}" for i in range(1, 31)) + " FROM r GROUP BY user_id")
def pivot_wide(spark, d):
    return A.pivot_wide(_first_30(spark, d).select("user_id", "n", "value"), "user_id", "n", "value", 30)


@query("rmse", """
SELECT round(sqrt(avg(power(l_extendedprice / 1000 - l_quantity, 2))), 5) AS rmse FROM lineitem""")
def rmse(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), "l_quantity")
    return rounded(A.error_of(rows, "p", "l_quantity"), "rmse")


@query("five_number", """
SELECT min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 5) AS q1, round(median(o_totalprice), 5) AS median,
  round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.75), 5) AS q3, max(o_totalprice) AS max
FROM orders""")
def five_number(spark, d):
    return rounded(P.five_number(table(spark, d, "orders"), "o_totalprice"), "q1", "median", "q3").withColumn("mean", F.round("mean", 4))


@query("null_profile", f"""
WITH {S} SELECT 'channel' AS "column", round(avg(CASE WHEN channel IS NULL THEN 1 ELSE 0 END), 6) AS null_share FROM s
UNION ALL SELECT 'revenue', round(avg(CASE WHEN revenue IS NULL THEN 1 ELSE 0 END), 6) FROM s
UNION ALL SELECT 'value', round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) FROM s""")
def null_profile(spark, d):
    return rounded(P.null_profile(sessions(spark, d).select("channel", "revenue", "value")), "null_share", digits=6)


def _profile_sql(column, kind, numeric):
    nums = (f"CAST(min({column}) AS DOUBLE) AS min, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS sd, "
            f"CAST(max({column}) AS DOUBLE) AS max") if numeric else (
        "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS max")
    top = f"FROM s WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, CAST({column} AS VARCHAR) LIMIT 1"
    return (f"SELECT '{column}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, count(*) - count({column}) AS missing, "
            f"count(DISTINCT {column}) AS \"distinct\", (SELECT CAST({column} AS VARCHAR) {top}) AS top, "
            f"(SELECT count(*) {top}) AS top_n, (SELECT string_agg(v || ': ' || n, chr(10) ORDER BY n DESC, v) FROM "
            f"(SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n {top[:-1]}10)) AS top_values, {nums} FROM s")


@query("column_profile", f"WITH {S} " + " UNION ALL ".join([
    _profile_sql("channel", "string", False), _profile_sql("k", "int", True), _profile_sql("revenue", "double", True),
    _profile_sql("user_id", "bigint", True)]))
def column_profile(spark, d):
    return rounded(P.column_profile(sessions(spark, d).select("channel", "k", "revenue", "user_id")), "mean", "sd", digits=4)


@query("value_counts", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query("histogram", "WITH " + ", ".join(
    f"b_{c} AS (SELECT '{c}' AS \"column\", least(CAST(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 20) AS INTEGER) + 1, 20) AS bin "
    f"FROM part, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM part))"
    for c in ("p_size", "p_retailprice")) + """
SELECT "column", bin, count(*) AS n FROM (SELECT * FROM b_p_size UNION ALL SELECT * FROM b_p_retailprice) GROUP BY ALL""")
def histogram(spark, d):
    return P.histogram(table(spark, d, "part"), 20, ["p_size", "p_retailprice"])


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlation(spark, d):
    return rounded(P.correlation(table(spark, d, "lineitem"), list(_CORR)), "r", digits=6)


@query("correlation_with_nulls", f"WITH {S} SELECT 'revenue' AS a, 'k' AS b, round(corr(revenue, k), 6) AS r FROM s")
def correlation_with_nulls(spark, d):
    return rounded(P.correlation(sessions(spark, d), ["revenue", "k"]), "r", digits=6)


@query("correlation_all", """
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
    nullif(l_linenumber, 3) AS gaps, 5 AS flat, CASE WHEN l_linenumber > 100 THEN 1 END AS nothing FROM lineitem),
names AS (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax',
    'gaps', 'flat', 'nothing']) AS name, generate_subscripts(range(11), 1) AS i),
long AS (SELECT row_number() OVER () AS id, * FROM t),
cells AS (SELECT id, unnest(range(1, 12)) AS i, unnest([l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, gaps, flat, nothing]::DOUBLE[]) AS v FROM long),
r AS (SELECT x.i AS i, y.i AS j, corr(x.v, y.v) AS r FROM cells x JOIN cells y ON x.id = y.id AND x.i < y.i GROUP BY ALL)
SELECT a.name AS a, b.name AS b, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 5) AS r FROM r JOIN names a ON a.i = r.i JOIN names b ON b.i = r.j""")
def correlation_all(spark, d):
    """All numeric columns, one with gaps, one constant, one empty."""
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.nullif("l_linenumber", F.lit(3)).alias("gaps"), F.lit(5).alias("flat"), F.when(F.col("l_linenumber") > 100, 1).alias("nothing"))
    return rounded(P.correlation(items), "r", digits=5)


@query("distinct_by_sketch", f"""
WITH {S} SELECT channel, count(DISTINCT user_id) AS exact, TRUE AS within FROM s GROUP BY channel""")
def distinct_by_sketch(spark, d):
    """Daily sketches merged per group: within three standard errors of the exact count."""
    rows = sessions(spark, d).select("channel", F.to_date("ts").alias("day"), "user_id")
    daily = A.distinct_sketches(rows, ["channel", "day"], "user_id")
    merged = A.merged_distinct(daily, ["channel"])
    exact = A.distinct_by(rows, ["channel"], "user_id", count_null=False, name="exact")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 3 * A.SKETCH_ERROR + 1
    return exact.join(merged.withColumnRenamed("channel", "c"), F.col("channel").eqNullSafe(F.col("c"))).select(
        "channel", "exact", near.alias("within"))


@query("row_count", "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols FROM lineitem")
def row_count(spark, d):
    return A.row_count(table(spark, d, "lineitem"))
