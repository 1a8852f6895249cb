"""Session-shaped inputs built from the driver tables, and the same columns as SQL for the oracles.

``sessions`` is a typed view of ``events``. ``raw_sessions`` has the shape of the session export: JSON
object columns and Python-literal list columns as text. Its SQL counterparts (``FLAT``, ``HITS_ROWS``)
never see that text: they derive the expected values straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlab.sources.readers import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table. Times in the data are UTC, so the session's zone is set to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, folder, name)


# --- typed sessions -----------------------------------------------------------------------------------

def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, user_id, ts, start (epoch seconds), channel (NULL for one type), value, revenue (sparse), k, and the
    logs of the two amounts (two-decimal amounts have averages that sit exactly on rounding borders)."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"),
        "event_type",
        F.nullif("event_type", F.lit("error")).alias("channel"),
        "value",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("revenue"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.log1p("value").alias("log_value"),
        F.log1p(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("log_revenue"),
    )


S = """s AS (
  SELECT event_id, user_id, ts, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS start, event_type,
         nullif(event_type, 'error') AS channel, value,
         CASE WHEN event_type = 'purchase' THEN value END AS revenue,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         ln(1 + value) AS log_value, CASE WHEN event_type = 'purchase' THEN ln(1 + value) END AS log_revenue
  FROM events)"""


# --- raw export ---------------------------------------------------------------------------------------

def raw_sessions(spark: SparkSession, folder: str, keyed: bool = False) -> DataFrame:
    """Session export with its text columns: one row per event, geography from the customer tables.

    ``keyed`` joins the events once more by their id and keeps their number as ``k``. All joins meet the narrow rows, which are
    then dealt evenly: a partition that is small as it is holds many texts once they are made."""
    e = sessions(spark, folder)
    if keyed:
        ids = table(spark, folder, "events").select(F.col("event_id").cast("int").alias("_id"), F.get_json_object("props", "$.k").cast("int").alias("_k"))
        e = e.join(ids, F.col("event_id").cast("int") == F.col("_id"))
    place = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    joined = e.join(place, F.col("user_id") == F.col("c_custkey"), "left").repartition(tasks)
    return joined.select(
        F.col("event_type").alias("channelGrouping"),
        _dimensions().alias("customDimensions"),
        F.date_format("ts", "yyyyMMdd").alias("date"),
        _device().alias("device"),
        F.lpad(F.col("user_id").cast("string"), 12, "0").alias("fullVisitorId"),
        _geo().alias("geoNetwork"),
        _hits().alias("hits"),
        F.lit("Not Socially Engaged").alias("socialEngagementType"),
        _totals().alias("totals"),
        _traffic().alias("trafficSource"),
        F.col("event_id").cast("int").alias("visitId"),
        (F.col("k") % 9 + 1).cast("int").alias("visitNumber"),
        F.col("start").alias("visitStartTime"),
        *([F.col("_k").alias("k")] if keyed else []),
    )


def _choice(number: Column, *values: str | None) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, F.lit(v)).otherwise(out)
    return out


def _device() -> Column:
    return F.to_json(F.struct(
        _choice(F.col("k") % 4, "Chrome", "Safari", "(not set)", "Firefox").alias("browser"),
        F.lit("not available in demo dataset").alias("browserVersion"),
        F.col("c_mktsegment").alias("operatingSystem"),
        F.when(F.col("value") < 20, "mobile").when(F.col("value") < 60, "desktop").otherwise("tablet")
        .alias("deviceCategory"),
        (F.col("value") < 20).alias("isMobile"),
    ))


def _geo() -> Column:
    return F.to_json(F.struct(
        F.col("r_name").alias("continent"),
        F.col("n_name").alias("country"),
        F.lit("not available in demo dataset").alias("cityId"),
        F.when(F.col("k") % 5 == 0, "(not set)")
        .otherwise(F.concat(F.lit("city "), F.col("user_id") % 40)).alias("city"),
        F.when(F.col("k") % 3 == 0, "unknown.unknown")
        .otherwise(F.concat(F.lit("net"), F.col("user_id") % 25, F.lit(".com"))).alias("networkDomain"),
    ))


def _totals() -> Column:
    return F.to_json(F.struct(
        F.lit("1").alias("visits"),
        (F.col("k") % 20 + 1).cast("string").alias("hits"),
        F.when(F.col("k") % 7 != 0, (F.col("k") % 13 + 1).cast("string")).alias("pageviews"),
        F.when(F.col("value") < 10, "1").alias("bounces"),
        F.when(F.col("k") % 2 == 0, "1").alias("newVisits"),
        F.round(F.col("revenue") * 100).cast("long").cast("string").alias("transactionRevenue"),
    ))


def _traffic() -> Column:
    return F.to_json(F.struct(
        F.lit("(not set)").alias("campaign"),
        _choice(F.col("k") % 3, "google", "direct", "mall.site.com").alias("source"),
        F.when(F.col("event_type") == "view", "(none)").when(F.col("event_type") == "click", "cpc")
        .otherwise("organic").alias("medium"),
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("/path/"), F.col("k"))).alias("referralPath"),
        F.when(F.col("k") % 3 == 1, F.lit(True)).alias("isTrueDirect"),
        F.struct(
            F.when(F.col("k") % 10 == 0, "Top").alias("slot"),
            F.when(F.col("k") % 10 == 0, "1").alias("page"),
            F.when(F.col("k") % 10 == 0, F.lit(False)).alias("isVideoAd"),
            F.lit("not available in demo dataset").alias("criteriaParameters"),
        ).alias("adwordsClickInfo"),
    ))


def _dimensions() -> Column:
    """``[]`` for every seventh k, else one or two dimensions, one of them with an apostrophe."""
    first = F.concat(F.lit("{'index': '4', 'value': '"), F.col("r_name"), F.lit("'}"))
    second = F.concat(F.lit("{'index': '2', 'value': \"Men's "), F.col("event_type"), F.lit("\"}"))
    both = F.when(F.col("k") % 2 == 0, F.concat(first, F.lit(", "), second)).otherwise(first)
    return F.when(F.col("k") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), both, F.lit("]")))


def _hits() -> Column:
    """k % 4 hits as a Python literal: bare True / None, both quote kinds, a hex escape, nested lists."""
    count = F.col("k") % 4
    last = F.col("k") % 4

    def product(p: Column) -> Column:
        return F.concat(
            F.lit("{'productSKU': 'SKU"), F.col("k") + p, F.lit("', 'v2ProductName': \"Men's "), F.col("event_type"),
            F.lit(" "), p, F.lit("\", 'v2ProductCategory': 'Home/"), F.col("c_mktsegment"),
            F.lit("/', 'productVariant': '(not set)', 'productBrand': 'B"), p % 3,
            F.lit("', 'productPrice': '"), p * 1000, F.lit("', 'localProductPrice': '"), p * 900,
            F.lit("', 'isImpression': True, 'customDimensions': [], 'customMetrics': []}"))

    def hit(i: Column) -> Column:
        entrance = F.when(i == 1, F.lit("'isEntrance': True, ")).otherwise(F.lit("'isEntrance': None, "))
        leave = F.when(i == last, F.lit("'isExit': True, ")).otherwise(F.lit("'isExit': False, "))
        promo = F.when(i == 2, F.concat(
            F.lit("{'promoId': 'P"), F.col("k"), F.lit("', 'promoName': 'Summer \\xa0Sale', 'promoCreative': 'c.jpg', "
                                                    "'promoPosition': 'Row "), i, F.lit("'}"))).otherwise(F.lit(""))
        return F.concat(
            F.lit("{'hitNumber': '"), i, F.lit("', 'time': '"), i * 1000, F.lit("', 'hour': '"), F.hour("ts"),
            F.lit("', 'minute': '"), F.minute("ts"), F.lit("', 'isInteraction': True, "), entrance, leave,
            F.lit("'page': {'pagePath': '/"), F.col("event_type"), F.lit("/"), i,
            F.lit("', 'pageTitle': \"True Grit, Men's "), F.col("event_type"), F.lit("\", 'pagePathLevel2': '/"),
            F.col("event_type"), F.lit("/', 'pagePathLevel3': ''}, 'transaction': {'currencyCode': 'USD'}, "
                                       "'item': {'currencyCode': 'USD'}, 'appInfo': {'screenName': 'shop/"), i,
            F.lit("', 'landingScreenName': 'shop/1', 'exitScreenName': 'shop/"), last,
            F.lit("', 'screenDepth': '0'}, 'experiment': [], 'customVariables': [], 'product': ["),
            F.array_join(F.transform(F.sequence(F.lit(1), i), product), ", "),
            F.lit("], 'promotion': ["), promo, F.lit("], 'social': {'socialNetwork': '(not set)', "
                                                     "'hasSocialSourceReferral': 'No', "
                                                     "'socialInteractionNetworkAction': ' : '}, "
                                                     "'type': 'PAGE', 'eCommerceAction': {'action_type': '"),
            F.col("k") % 3, F.lit("', 'step': '1'}, 'dataSource': 'web'}"))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), hit), ", ")
    return F.when(count == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), text, F.lit("]")))


# The values the parsed export must have.
FLAT = S + """, flat AS (
  SELECT s.event_type AS "channelGrouping", lpad(CAST(s.user_id AS VARCHAR), 12, '0') AS "fullVisitorId",
         CAST(s.event_id AS INTEGER) AS "visitId", CAST(s.k % 9 + 1 AS INTEGER) AS "visitNumber",
         s.start AS "visitStartTime", s.ts, s.k, s.value, s.event_type, s.revenue,
         c.c_mktsegment,
         strftime(s.ts, '%Y%m%d') AS date,
         CASE s.k % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN '(not set)' ELSE 'Firefox' END AS browser,
         c.c_mktsegment AS "operatingSystem",
         CASE WHEN s.value < 20 THEN 'mobile' WHEN s.value < 60 THEN 'desktop' ELSE 'tablet' END AS "deviceCategory",
         s.value < 20 AS "isMobile",
         r.r_name AS continent, n.n_name AS country,
         CASE WHEN s.k % 5 = 0 THEN '(not set)' ELSE 'city ' || (s.user_id % 40) END AS city,
         CASE WHEN s.k % 3 = 0 THEN 'unknown.unknown' ELSE 'net' || (s.user_id % 25) || '.com' END AS "networkDomain",
         '1' AS visits, CAST(s.k % 20 + 1 AS VARCHAR) AS hits,
         CASE WHEN s.k % 7 <> 0 THEN CAST(s.k % 13 + 1 AS VARCHAR) END AS pageviews,
         CASE WHEN s.value < 10 THEN '1' END AS bounces,
         CASE WHEN s.k % 2 = 0 THEN '1' END AS "newVisits",
         CAST(CAST(round(s.revenue * 100) AS BIGINT) AS VARCHAR) AS "transactionRevenue",
         '(not set)' AS campaign,
         CASE s.k % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'direct' ELSE 'mall.site.com' END AS source,
         CASE s.event_type WHEN 'view' THEN '(none)' WHEN 'click' THEN 'cpc' ELSE 'organic' END AS medium,
         CASE WHEN s.k % 6 = 0 THEN '/path/' || s.k END AS "referralPath",
         CASE WHEN s.k % 3 = 1 THEN TRUE END AS "isTrueDirect",
         CASE WHEN s.k % 10 = 0 THEN 'Top' END AS slot,
         CASE WHEN s.k % 10 = 0 THEN '1' END AS page,
         CASE WHEN s.k % 10 = 0 THEN FALSE END AS "isVideoAd",
         CASE WHEN s.k % 7 <> 0 THEN '4' END AS "cD_index",
         CASE WHEN s.k % 7 <> 0 THEN r.r_name END AS "cD_value"
  FROM s LEFT JOIN customer c ON s.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

HITS_ROWS = FLAT + """, h AS (
  SELECT flat.*, i, k % 4 AS n_hits FROM flat, unnest(range(1, CAST(k % 4 + 1 AS BIGINT))) AS t(i))"""
