"""Queries on scalar features and category encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlab.catalog.inputs import FLAT, S, raw_sessions, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.functions import columns as C
from sessionlab.operators import encoding as E
from sessionlab.operators import nested as N
from sessionlab.operators.cleaning import mutate_by_type
from sessionlab.sources import schemas as X
from pyspark.sql import types as T


@query("cross_feature", f"""
WITH {S} SELECT event_id, channel || '_' || user_id AS channel_user, event_type || '_' || k AS type_k FROM s""")
def cross_feature(spark, d):
    return sessions(spark, d).select("event_id", C.cross_feature("channel", "user_id").alias("channel_user"),
                                     C.cross_feature("event_type", "k").alias("type_k"))


_LEFT, _RIGHT = ["continent", "country", "city"], ["browser", "operatingSystem", "deviceCategory"]


@query("cross_features", f"""
WITH {FLAT} SELECT "visitId", {', '.join(f'"{a}" || chr(95) || "{b}" AS "{a}_{b}"' for a in _LEFT for b in _RIGHT)}
FROM flat""")
def cross_features(spark, d):
    flat = N.json_flatten(raw_sessions(spark, d).select("visitId", "device", "geoNetwork"),
                          {"device": X.DEVICE, "geoNetwork": X.GEO})
    return flat.select("visitId", *[c.alias(n) for n, c in C.cross_features(_LEFT, _RIGHT).items()])


@query("paste_feature", f"""
WITH {S} SELECT event_id, coalesce(channel, 'NA') || '_' || coalesce(CAST(k AS VARCHAR), 'NA') AS channel_k,
  CAST(year(ts) AS VARCHAR) || '_' || ((dayofyear(ts) - 1) // 7 + 1) AS year_week,
  CAST(month(ts) AS VARCHAR) || '_' || (dayofweek(ts) + 1) AS month_wday,
  CAST(hour(ts) AS VARCHAR) || '_' || minute(ts) AS hour_minute
FROM s""")
def paste_feature(spark, d):
    rows = sessions(spark, d)
    parts = rows.withColumns(C.calendar_parts("ts") | {"minute": F.minute("ts")})
    pairs = C.calendar_pairs(["year_week", "month_wday", "hour_minute"])
    return parts.select("event_id", C.paste_feature("channel", "k").alias("channel_k"),
                        *[c.alias(n) for n, c in pairs.items()])


@query("parse_ymd", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders""")
def parse_ymd(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("t"))
    return text.select("o_orderkey", C.parse_ymd("t").alias("day"))


@query("epoch_to_ts", """
SELECT event_id, date_trunc('second', ts) AS started FROM events""")
def epoch_to_ts(spark, d):
    return sessions(spark, d).select("event_id", C.epoch_to_ts("start").cast("timestamp_ntz").alias("started"))


@query("calendar_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(day(o_orderdate) AS INTEGER) AS day, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS wday,
  CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INTEGER) AS week, CAST(dayofyear(o_orderdate) AS INTEGER) AS yday,
  CAST(date_diff('day', date_trunc('quarter', o_orderdate), o_orderdate) + 1 AS INTEGER) AS qday
FROM orders""")
def calendar_parts(spark, d):
    parts = C.calendar_parts("o_orderdate", hour=False)
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("text_calendar", """
SELECT event_id, dayname(ts) AS weekday_name, strftime(ts, '%H') AS hour_text, strftime(ts, '%m') AS month_text
FROM events""")
def text_calendar(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in C.text_calendar("ts").items()])


@query("log_transforms", """
SELECT event_id, CASE WHEN value > 0 THEN round(ln(value), 6) WHEN value = 0 THEN CAST('-Infinity' AS DOUBLE) END AS log_value,
  round(ln(1 + value), 6) AS log1p_value,
  round(exp(value / 100) - 1, 6) AS expm1_value
FROM events""")
def log_transforms(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(C.natural_log(v), 6).alias("log_value"), F.round(F.log1p(v), 6).alias("log1p_value"),
        F.round(F.expm1(v / 100), 6).alias("expm1_value"))


@query("round_result", """
SELECT o_orderkey, round_even(o_totalprice / 7, 5) AS rounded FROM orders""")
def round_result(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.round_result(F.col("o_totalprice") / 7).alias("rounded"))


@query("conditionals", f"""
WITH {S} SELECT event_id, CASE WHEN channel IS NULL THEN 'none' WHEN channel IN ('view', 'click') THEN 'browse'
  ELSE 'act' END AS kind FROM s""")
def conditionals(spark, d):
    kind = F.when(F.col("channel").isNull(), "none").when(F.col("channel").isin("view", "click"), "browse").otherwise("act")
    return sessions(spark, d).select("event_id", kind.alias("kind"))


@query("regex_replace", """
SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS masked,
  regexp_replace(url, '(https?)://', '\\1|', 'g') AS split_scheme
FROM pages""")
def regex_replace(spark, d):
    """Look-around needs no special support: it is Java regex."""
    return table(spark, d, "pages").select(
        "page_id", F.regexp_replace("url", r"(?<![0-9])[0-9]+(?![0-9])", "#").alias("masked"),
        F.regexp_replace("url", r"(?<=https?)://", "|").alias("split_scheme"))


# --- encoding ---------------------------------------------------------------------------------------------

@query("label_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS p_type,
  CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER) AS p_name,
  CASE WHEN p_brand <> 'Brand#2' THEN CAST(dense_rank() OVER (ORDER BY nullif(p_brand, 'Brand#2') NULLS LAST) AS INTEGER) END AS p_brand
FROM part""")
def label_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_name", F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"))
    return E.label_encode(part, ["p_type", "p_name", "p_brand"])


@query("label_encode_ids", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name DESC) AS INTEGER) AS code_desc,
  CAST(dense_rank() OVER (ORDER BY c_name) AS INTEGER) AS c_name
FROM customer""")
def label_encode_ids(spark, d):
    """As many levels as rows: ranks come from a range sort, not from one task."""
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    coded = E.label_encode(customer, ["c_name"])
    n = F.lit(customer.agg(F.count_distinct("c_name")).first()[0])
    return coded.withColumn("code_desc", (n + 1 - F.col("c_name")).cast("int"))


@query("lump_rare", """
WITH n AS (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand)
SELECT p_partkey, CASE WHEN n.c > 0.04 * (SELECT count(*) FROM part) THEN part.p_brand ELSE 'Other' END AS p_brand
FROM part JOIN n ON part.p_brand = n.p_brand""")
def lump_rare(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return E.lump_rare(part, E.fit_kept_levels(part, ["p_brand"], 0.04))


@query("explicit_na", f"""
WITH {S} SELECT event_id, coalesce(channel, '(Missing)') AS channel FROM s""")
def explicit_na(spark, d):
    return E.explicit_na(sessions(spark, d).select("event_id", "channel"), ["channel"])


@query("one_hot", """
WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_size <= 10 THEN 'L' WHEN p_size <= 30 THEN 'M' ELSE 'S' END AS size FROM part)
SELECT p_partkey, """ + ", ".join(
    f"CAST(p_type = '{t}' AS INTEGER) AS \"p_type{t}\"" for t in
    ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + """,
  CAST(size = 'M' AS INTEGER) AS "sizeM", CAST(size = 'S' AS INTEGER) AS "sizeS"
FROM t""")
def one_hot(spark, d):
    size = F.when(F.col("p_size") <= 10, "L").when(F.col("p_size") <= 30, "M").otherwise("S")
    part = table(spark, d, "part").select("p_partkey", "p_type", size.alias("size"))
    return E.one_hot(part, E.fit_levels(part, ["p_type", "size"]))


# --- function values --------------------------------------------------------------------------------------

@query("one_hot_many", """
SELECT c_custkey, (SELECT count(*) + 1 + count(DISTINCT c_mktsegment) + 1 FROM customer) AS slots,
  CAST(dense_rank() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS INTEGER) AS first_slot
FROM customer""")
def one_hot_many(spark, d):
    """As many levels as rows, and a second column of five: two entries in a sparse vector of all slots."""
    hot = E.one_hot_vector(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"])
    vector = F.unwrap_udt("hot")  # as it is stored: an array of all slots per row would grow with the square of the rows
    return hot.select("c_custkey", vector["size"].cast("long").alias("slots"),
                      F.get(vector["indices"], (F.array_position(vector["values"], F.lit(1.0)) - 1).cast("int")).alias("first_slot"))


@query("function_sequence", f"""
WITH {S} SELECT event_id, upper(coalesce(channel, '(Missing)')) AS channel, CAST(year(ts) AS INTEGER) AS year FROM s""")
def function_sequence(spark, d):
    """A sequence of table functions is a chain of ``transform`` calls."""
    def filled(df):
        return E.explicit_na(df, ["channel"])

    def dated(df):
        return df.withColumns({"year": C.calendar_parts("ts")["year"]})

    def shout(df):
        return mutate_by_type(df, T.StringType, F.upper)

    return (sessions(spark, d).select("event_id", "channel", "ts").transform(filled).transform(dated)
            .transform(shout).drop("ts"))


@query("row_lambdas", """
SELECT vec_id, round(sum(x * x), 6) AS norm2, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS INTEGER) AS positive
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""")
def row_lambdas(spark, d):
    """Per-row lambdas over arrays run as JVM higher-order functions."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("struct_expand", f"""
WITH {S} SELECT event_id, k // 10 AS tens, k % 10 AS ones FROM s""")
def struct_expand(spark, d):
    """A row function with several results: build one struct, then expand it."""
    both = F.struct((F.col("k") / 10).cast("int").alias("tens"), (F.col("k") % 10).alias("ones"))
    return sessions(spark, d).select("event_id", both.alias("s")).select("event_id", "s.*")
