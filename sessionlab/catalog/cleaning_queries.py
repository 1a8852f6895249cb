"""Queries on projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.catalog.inputs import FLAT, S, raw_sessions, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.functions import columns as C
from sessionlab.operators import cleaning as K
from sessionlab.operators import nested as N
from sessionlab.operators.joins import align_columns, name_intersect
from sessionlab.sources import schemas as X


@query("drop_cols", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def drop_cols(spark, d):
    return K.drop_cols(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "absent"])


@query("derive", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net,
  l_returnflag || l_linestatus AS state FROM lineitem""")
def derive(spark, d):
    rows = K.derive(table(spark, d, "lineitem"), {
        "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4),
        "state": F.concat("l_returnflag", "l_linestatus"),
    })
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "state")


@query("rename_cols", "SELECT c_custkey AS visitor, c_name AS label FROM customer")
def rename_cols(spark, d):
    return K.rename(table(spark, d, "customer").select("c_custkey", "c_name"), {"c_custkey": "visitor", "c_name": "label"})


@query("na_tokens_to_null", """
SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_orderpriority END AS o_orderpriority,
  nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders""")
def na_tokens_to_null(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return K.na_tokens_to_null(orders, ("5-LOW", "4-NOT SPECIFIED", "P"))


@query("fill_null", f"""
WITH {S} SELECT event_id, coalesce(channel, 'Nodata') AS channel, coalesce(revenue, -1.0) AS revenue FROM s""")
def fill_null(spark, d):
    return K.fill_null(sessions(spark, d).select("event_id", "channel", "revenue"), {"channel": "Nodata", "revenue": -1.0})


@query("presence_flag", f"WITH {S} SELECT event_id, CAST(revenue IS NOT NULL AS INTEGER) AS has_revenue FROM s")
def presence_flag(spark, d):
    return sessions(spark, d).select("event_id", C.presence_flag("revenue").alias("has_revenue"))


@query("equals_flag", f"WITH {S} SELECT event_id, CAST(channel = 'view' AS INTEGER) AS is_view FROM s")
def equals_flag(spark, d):
    return sessions(spark, d).select("event_id", C.equals_flag("channel", "view").alias("is_view"))


@query("bool_to_int", f"""WITH {FLAT} SELECT "visitId", CAST("isMobile" AS INTEGER) AS "isMobile" FROM flat""")
def bool_to_int(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "device")
    return N.json_flatten(raw, {"device": X.DEVICE}).select("visitId", C.bool_to_int("isMobile").alias("isMobile"))


@query("cast_cols", f"""
WITH {S} SELECT event_id, TRY_CAST(substr(props, 7, 1) AS INTEGER) AS digit, TRY_CAST(event_type AS DOUBLE) AS bad,
  CAST(k AS DOUBLE) AS k FROM s JOIN (SELECT event_id AS eid, props FROM events) ON event_id = eid""")
def cast_cols(spark, d):
    """Bad text gives NULL, it does not fail the job."""
    rows = table(spark, d, "events").select(
        "event_id", F.substring("props", 7, 1).alias("digit"), F.col("event_type").alias("bad"),
        F.get_json_object("props", "$.k").alias("k"))
    return K.cast_cols(rows, {"digit": "int", "bad": "double", "k": "double"})


def _patchy(spark, d):
    """Columns of every kind for the fitted selections: constant, all NULL, sparse, two-valued, normal."""
    return sessions(spark, d).select(
        "event_id", "channel", "value", "k",
        F.lit("x").alias("constant"),
        F.lit(None).cast("string").alias("empty"),
        F.when(F.col("k") == 7, F.lit("seven")).alias("sparse"),
        F.when(F.col("event_id") == 0, "rare").otherwise("common").alias("skewed"),
        F.when(F.col("event_type") == "view", F.lit(1)).alias("one_or_null"),
    )


_PATCHY_SQL = f"""
WITH {S}, p AS (SELECT event_id, channel, value, k, 'x' AS constant, CAST(NULL AS VARCHAR) AS empty,
  CASE WHEN k = 7 THEN 'seven' END AS sparse, CASE WHEN event_id = 0 THEN 'rare' ELSE 'common' END AS skewed,
  CASE WHEN event_type = 'view' THEN 1 END AS one_or_null FROM s)
SELECT {{}} FROM p"""


@query("drop_constant_cols", _PATCHY_SQL.format("event_id, channel, value, k, sparse, skewed, one_or_null"))
def drop_constant_cols(spark, d):
    return K.drop_constant_cols(_patchy(spark, d))


@query("drop_sparse_cols", _PATCHY_SQL.format("event_id, channel, value, k, constant, skewed, one_or_null"))
def drop_sparse_cols(spark, d):
    return K.drop_sparse_cols(_patchy(spark, d), 0.9)


@query("drop_near_zero_var", _PATCHY_SQL.format("event_id, channel, value, k"))
def drop_near_zero_var(spark, d):
    return K.drop_near_zero_var(_patchy(spark, d))


@query("near_zero_var_stats", """
WITH t AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS v FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'late', CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN 'y' ELSE 'n' END FROM orders),
c AS (SELECT "column", v, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS rn FROM c)
SELECT "column", max(CASE WHEN rn = 1 THEN n END) AS top, max(CASE WHEN rn = 2 THEN n END) AS second,
  count(*) AS "distinct", max(CASE WHEN rn = 1 THEN n END) > 19.0 * max(CASE WHEN rn = 2 THEN n END) AS drop
FROM r GROUP BY "column" """)
def near_zero_var_stats(spark, d):
    late = F.when(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"), "y").otherwise("n")
    return K.fit_near_zero_var(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", late.alias("late")))


@query("drop_common_nzv", _PATCHY_SQL.format("event_id, channel, value, k, one_or_null, empty"))
def drop_common_nzv(spark, d):
    """Near-constant in both tables goes, unless listed to keep. (In the second table one more column varies.)"""
    rows = _patchy(spark, d)
    other = rows.withColumn("one_or_null", F.col("k"))
    return K.drop_common_nzv([rows, other], keep=["empty"])[0]


@query("align_columns", """
SELECT o_orderkey, o_totalprice, 'train' AS side FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT o_orderkey, o_totalprice, 'test' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def align_columns_query(spark, d):
    orders = table(spark, d, "orders")
    train = K.date_filter(orders, "o_orderdate", end="1998-01-01").select("o_orderkey", "o_orderstatus", "o_totalprice")
    test = K.date_filter(orders, "o_orderdate", start="1998-01-01").select("o_totalprice", "o_custkey", "o_orderkey")
    a, b = align_columns(train, test)
    return a.withColumn("side", F.lit("train")).union(b.withColumn("side", F.lit("test")))


@query("name_intersect", "SELECT event_id, user_id, event_type, value FROM events")
def name_intersect_query(spark, d):
    events = table(spark, d, "events").drop("ts")
    return events.select(*name_intersect(events.columns, sessions(spark, d).columns))


@query("date_filter", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def date_filter(spark, d):
    return K.date_filter(table(spark, d, "orders"), "o_orderdate", "1996-03-01", "1997-01-01").select(
        "o_orderkey", "o_orderdate")


@query("row_range", """
SELECT event_id, ts >= TIMESTAMP '2024-01-20' AS is_test FROM events WHERE ts >= TIMESTAMP '2024-01-20'""")
def row_range(spark, d):
    stacked = _tagged(spark, d)
    return K.row_range(stacked, test=True)


@query("tag_source", "SELECT event_id, ts >= TIMESTAMP '2024-01-20' AS is_test FROM events")
def tag_source(spark, d):
    return _tagged(spark, d)


def _tagged(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    train = K.tag_source(K.date_filter(events, "ts", end="2024-01-20"), False)
    test = K.tag_source(K.date_filter(events, "ts", start="2024-01-20"), True)
    return train.unionByName(test).drop("ts")


@query("mutate_by_type", """
SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM customer""")
def mutate_by_type(spark, d):
    return K.mutate_by_type(table(spark, d, "customer"), T.StringType, F.upper)


@query("select_by_type", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def select_by_type(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", *K.columns_of(part, T.StringType))


@query("select_by_prefix", "SELECT l_orderkey, l_shipdate, l_suppkey, l_linenumber, l_partkey FROM lineitem")
def select_by_prefix(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *K.columns_with_prefix(rows, "l_s"))


@query("clip_negative", """
SELECT c_custkey, CASE WHEN c_acctbal - 5000 < 0 THEN 0 ELSE c_acctbal - 5000 END AS clipped FROM customer""")
def clip_negative(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.clip_negative(F.col("c_acctbal") - 5000).alias("clipped"))


@query("zero_when", f"WITH {S} SELECT event_id, CASE WHEN value < 10 THEN 0.0 ELSE value END AS pred FROM s")
def zero_when(spark, d):
    return sessions(spark, d).select("event_id", C.zero_when("value", F.col("value") < 10).alias("pred"))


@query("binary_label", f"WITH {S} SELECT event_id, CAST(coalesce(revenue, 0) > 0.001 AS INTEGER) AS paid FROM s")
def binary_label(spark, d):
    return sessions(spark, d).select("event_id", C.binary_label("revenue").alias("paid"))


@query("log_label", f"""
WITH {FLAT} SELECT "visitId", round(ln(1 + coalesce(TRY_CAST("transactionRevenue" AS DOUBLE), 0)), 6) AS y FROM flat""")
def log_label(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "totals")
    return N.json_flatten(raw, {"totals": X.TOTALS}).select("visitId", F.round(C.log_label("transactionRevenue"), 6).alias("y"))
