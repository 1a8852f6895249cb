"""Queries on nested text: JSON objects, Python literals, hits, custom dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.catalog.inputs import FLAT, HITS_ROWS, S, raw_sessions, sessions, table
from sessionlab.catalog.registry import query
from sessionlab.functions import literals
from sessionlab.functions.literals import parse_failures, parse_pyliteral
from sessionlab.operators import nested as N
from sessionlab.operators.cleaning import cast_cols, drop_cols, na_tokens_to_null
from sessionlab.sources import schemas as X

FLAT_COLUMNS = (
    "browser", "operatingSystem", "deviceCategory", "isMobile", "continent", "country", "city", "networkDomain",
    "visits", "hits", "pageviews", "bounces", "newVisits", "transactionRevenue", "campaign", "source", "medium",
    "referralPath", "isTrueDirect",
)


@query("json_flatten", f"""
WITH {FLAT} SELECT "visitId", {', '.join(f'"{c}"' for c in FLAT_COLUMNS)},
  slot AS "adwordsClickInfo.slot", page AS "adwordsClickInfo.page", "isVideoAd" AS "adwordsClickInfo.isVideoAd"
FROM flat""")
def json_flatten(spark, d):
    flat = N.json_flatten(raw_sessions(spark, d).drop("hits"), X.JSON_COLUMNS)
    return flat.select("visitId", *FLAT_COLUMNS, "`adwordsClickInfo.slot`", "`adwordsClickInfo.page`",
                       "`adwordsClickInfo.isVideoAd`")


@query("json_infer_schema", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_infer_schema(spark, d):
    events = table(spark, d, "events").select("event_id", "props")
    return N.json_flatten(events, {"props": N.json_infer_schema(events, "props")})


@query("json_flatten_prefixed", f"""
WITH {FLAT} SELECT "visitId", browser AS device_browser, "operatingSystem" AS "device_operatingSystem",
  "isMobile" AS "device_isMobile", country AS "geoNetwork_country", pageviews AS totals_pageviews,
  slot AS "trafficSource_adwordsClickInfo_slot"
FROM flat""")
def json_flatten_prefixed(spark, d):
    return N.json_flatten_prefixed(raw_sessions(spark, d).drop("hits"), X.JSON_COLUMNS).select(
        "visitId", "device_browser", "device_operatingSystem", "device_isMobile", "geoNetwork_country",
        "totals_pageviews", "trafficSource_adwordsClickInfo_slot")


@query("struct_flatten", f"""
WITH {FLAT} SELECT "visitId", campaign AS "trafficSource_campaign", source AS "trafficSource_source",
  medium AS "trafficSource_medium", slot AS "trafficSource_adwordsClickInfo_slot",
  page AS "trafficSource_adwordsClickInfo_page", "isVideoAd" AS "trafficSource_adwordsClickInfo_isVideoAd"
FROM flat""")
def struct_flatten(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "trafficSource")
    parsed = raw.withColumn("trafficSource", F.from_json("trafficSource", X.TRAFFIC))
    return N.struct_flatten(parsed, "trafficSource").select(
        "visitId", "trafficSource_campaign", "trafficSource_source", "trafficSource_medium",
        "trafficSource_adwordsClickInfo_slot", "trafficSource_adwordsClickInfo_page",
        "trafficSource_adwordsClickInfo_isVideoAd")


@query("json_normalize", f"""
WITH {FLAT} SELECT "visitId", CASE WHEN k % 4 > 0 THEN 1 END AS "hitNumber",
  CASE WHEN k % 4 > 0 THEN 'True Grit, Men''s ' || event_type END AS "page.pageTitle",
  CASE WHEN k % 4 > 0 THEN 'shop/' || (k % 4) END AS "appInfo.exitScreenName",
  CASE WHEN k % 4 > 0 THEN 'USD' END AS "transaction.currencyCode"
FROM flat""")
def json_normalize(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits")
    first = N.literal_eval(raw, "hits", X.HITS).withColumn("hits", N.array_first("hits"))
    return N.json_normalize(first, "hits").select(
        "visitId", F.col("hitNumber").try_cast("int").alias("hitNumber"), "`page.pageTitle`", "`appInfo.exitScreenName`", "`transaction.currencyCode`")


@query("json_normalize_union", f"""
WITH {S} SELECT event_id, k, CASE WHEN k % 2 = 0 THEN event_type END AS "a.even", CASE WHEN k % 2 = 1 THEN TRUE END AS "a.b.odd",
  CASE WHEN k % 3 = 0 THEN 'it''s' END AS third FROM s""")
def json_normalize_union(spark, d):
    """Keys that only some rows have."""
    inner = F.when(F.col("k") % 2 == 0, F.concat(F.lit("'even': '"), "event_type", F.lit("'"))).otherwise(F.lit("'b': {'odd': True, 'e': []}"))
    third = F.when(F.col("k") % 3 == 0, F.lit(", 'third': \"it's\"")).otherwise(F.lit(""))
    text = F.concat(F.lit("{'a': {"), inner, F.lit("}"), third, F.lit(", 'none': {}}"))
    out = N.json_normalize_union(sessions(spark, d).select("event_id", "k", text.alias("t")), "t")
    return out.select("event_id", "k", "`a.even`", "`a.b.odd`", "third")


@query("json_strip_sentinel", f"""
WITH {FLAT} SELECT "visitId", browser, "operatingSystem", "deviceCategory", "isMobile" FROM flat""")
def json_strip_sentinel(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "device")
    return N.infer_sentinel_stripped(raw, "device", "not available in demo dataset")


@query("pyliteral_to_json", f"""
WITH {S} SELECT event_id, CASE WHEN k % 7 <> 0 THEN 'it''s ' || event_type END AS name,
  CASE WHEN k % 7 <> 0 THEN TRUE END AS ok, k, CASE WHEN k % 7 <> 0 THEN 'True, None' END AS note
FROM s""")
def pyliteral_to_json(spark, d):
    """True and None as values are rewritten; the same words inside text are left alone."""
    literal = F.concat(F.lit("[{'name': \"it's "), "event_type", F.lit("\", 'ok': True, 'gone': None, 'k': "),
                       "k", F.lit(", 'note': 'True, None'}]"))
    text = sessions(spark, d).select(
        "event_id", "k", F.when(F.col("k") % 7 == 0, F.lit("[]")).otherwise(literal).alias("t"))
    parsed = F.from_json(literals.pyliteral_to_json("t"), "array<struct<name string, ok boolean, gone string, note string>>",
                         {"allowSingleQuotes": "true"})
    first = N.array_first(parsed)
    return text.select("event_id", first["name"].alias("name"), first["ok"].alias("ok"), "k",
                       first["note"].alias("note"))


@query("pyliteral_hits_failures", f"""
WITH {FLAT} SELECT count(*) AS sessions, CAST(0 AS BIGINT) AS failed, CAST(sum(k % 4) AS BIGINT) AS hits FROM flat""")
def pyliteral_hits_failures(spark, d):
    """Every hits text parses; failures are counted, not dropped."""
    raw = raw_sessions(spark, d).select("hits")
    parsed = raw.withColumn("p", parse_pyliteral("hits", X.HITS))
    return parsed.agg(F.count(F.lit(1)).alias("sessions"), parse_failures("hits", X.HITS).alias("failed"),
                      F.sum(F.size("p")).alias("hits"))


@query("pyliteral_mixed", f"""
WITH {S} SELECT event_id, k % 3 = 0 AS flag, CAST(k AS VARCHAR) AS second, 'say ''k'': True, [None, ok' AS note FROM s""")
def pyliteral_mixed(spark, d):
    """Bare words after commas and doubled blanks count; the same words inside quoted text stay."""
    text = sessions(spark, d).select("event_id", F.concat(
        F.lit("{'list': [None,  "), F.when(F.col("k") % 3 == 0, "True").otherwise("False"), F.lit(", None], 'pair':  ['x', '"), "k",
        F.lit("'], 'note': \"say 'k': True, [None, ok\"}")).alias("t"))
    parsed = parse_pyliteral("t", X.struct(list=T.ArrayType(T.BooleanType()), pair=T.ArrayType(T.StringType()), note="string"))
    p = text.select("event_id", parsed.alias("p"))
    return p.select("event_id", F.get("p.list", F.lit(1)).alias("flag"), F.get("p.pair", F.lit(1)).alias("second"),
                    F.col("p.note").alias("note"))


@query("pyliteral_failures", f"""
WITH {S} SELECT count(*) AS texts, CAST(sum(CASE WHEN k % 5 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM s""")
def pyliteral_failures(spark, d):
    """Texts that break off and texts of which one part does not fit are both counted."""
    text = sessions(spark, d).select(F.when(F.col("k") % 5 == 0, "{'a': 1, 'b': [1, 2").when(
        F.col("k") % 5 == 1, "{'a': 'one', 'b': [1]}").otherwise("{'a': 3, 'b': [None]}").alias("t"))
    return text.agg(F.count(F.lit(1)).alias("texts"),
                    parse_failures("t", X.struct(a="integer", b=T.ArrayType(T.IntegerType()))).alias("failed"))


@query("sentinel_exact", f"""
WITH {S} SELECT event_id, CASE WHEN k % 2 = 1 THEN 'v' END AS "a.b", k AS c FROM s""")
def sentinel_exact(spark, d):
    """A placeholder with brackets, under a key with a dot."""
    text = sessions(spark, d).select("event_id", F.concat(
        F.lit('{"a.b": "'), F.when(F.col("k") % 2 == 0, "(not set)").otherwise("v"), F.lit('", "c": '), "k", F.lit("}")).alias("t"))
    stripped = N.json_strip_sentinel(text, ["t"], "(not set)")
    p = stripped.select("event_id", F.from_json("t", "`a.b` string, c int").alias("p"))
    return p.select("event_id", F.col("p").getField("a.b").alias("a.b"), F.col("p.c").alias("c"))


@query("json_infer_odd_keys", f"""
WITH {S} SELECT event_id, 'x' || k AS "AVOID", k AS "OBJECTS" FROM s""")
def json_infer_odd_keys(spark, d):
    """Keys that hold the words for types keep their names."""
    text = sessions(spark, d).select("event_id", F.concat(
        F.lit('{"AVOID": "x'), "k", F.lit('", "OBJECTS": '), "k", F.lit(', "VOID": null}')).alias("t"))
    schema = N.json_infer_schema(text, "t")
    p = text.select("event_id", F.from_json("t", schema).alias("p"))
    return p.select("event_id", "p.AVOID", F.col("p.OBJECTS").cast("int").alias("OBJECTS"))


@query("pyliteral_brackets", f"""
WITH {FLAT} SELECT "visitId", "cD_index" AS index, "cD_value" AS value FROM flat""")
def pyliteral_brackets(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "customDimensions")
    first = N.array_first(parse_pyliteral("customDimensions", X.DIMENSIONS))
    return raw.select("visitId", first["index"].alias("index"), first["value"].alias("value"))


@query("literal_eval", f"""
WITH {FLAT} SELECT "visitId", CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_dims,
  CASE WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'Men''s ' || event_type END AS second_value
FROM flat""")
def literal_eval(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "customDimensions")
    dims = N.literal_eval(raw, "customDimensions", X.DIMENSIONS)
    return dims.select("visitId", F.size("customDimensions").alias("n_dims"),
                       F.get("customDimensions", F.lit(1))["value"].alias("second_value"))


@query("empty_array_default", f"""
WITH {FLAT} SELECT "visitId", "cD_value" AS value FROM flat
UNION ALL SELECT "visitId", 'Men''s ' || event_type FROM flat WHERE k % 7 <> 0 AND k % 2 = 0""")
def empty_array_default(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "customDimensions")
    dims = N.literal_eval(raw, "customDimensions", X.DIMENSIONS)
    return dims.select("visitId", F.explode(N.empty_array_default("customDimensions")).alias("e")).select(
        "visitId", F.col("e.value").alias("value"))


@query("array_first", f"""
WITH {FLAT} SELECT "visitId", CASE WHEN k % 4 > 0 THEN 1 END AS first_hit,
  CASE WHEN k % 4 > 0 THEN 'SKU' || (k + 1) END AS first_product, "cD_value" AS first_dimension
FROM flat""")
def array_first(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits", "customDimensions")
    parsed = N.literal_eval(N.literal_eval(raw, "hits", X.HITS), "customDimensions", X.DIMENSIONS)
    hit = N.array_first("hits")
    return parsed.select("visitId", hit["hitNumber"].try_cast("int").alias("first_hit"),
                         N.array_first(hit["product"])["productSKU"].alias("first_product"),
                         N.array_first("customDimensions")["value"].alias("first_dimension"))


@query("hits_explode", f"""
WITH {HITS_ROWS} SELECT "fullVisitorId" || '_' || "visitId" AS key, CAST(i - 1 AS INTEGER) AS hit_pos,
  CAST(i AS INTEGER) AS "hits_hitNumber", i * 1000 AS hits_time, CAST(hour(ts) AS INTEGER) AS hits_hour,
  CASE WHEN i = 1 THEN TRUE END AS "hits_isEntrance", i = n_hits AS "hits_isExit",
  'True Grit, Men''s ' || event_type AS "hits_page_pageTitle", 'shop/' || i AS "hits_appInfo_screenName"
FROM h
UNION ALL SELECT "fullVisitorId" || '_' || "visitId", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM flat WHERE k % 4 = 0""")
def hits_explode(spark, d):
    raw = raw_sessions(spark, d).select("fullVisitorId", "visitId", "hits")
    rows = N.hits_explode(N.literal_eval(raw, "hits", X.HITS), "hits", ["fullVisitorId", "visitId"])
    rows = cast_cols(rows, {f"hits_{c}": kind for c, kind in X.HIT_NUMBERS.items()})
    return rows.select("key", "hit_pos", "hits_hitNumber", "hits_time", "hits_hour", "hits_isEntrance",
                       "hits_isExit", "hits_page_pageTitle", "hits_appInfo_screenName")


@query("array_field_list", f"""
WITH {FLAT} SELECT "visitId",
  CASE WHEN k % 4 > 0 THEN 'Men''s ' || event_type || ' 1' ELSE '' END AS product_names,
  CASE WHEN k % 4 > 0 THEN 'Home/' || c_mktsegment || '/' ELSE '' END AS product_categories,
  '' AS promo_ids, '' AS promo_names
FROM flat""")
def array_field_list(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits")
    first = N.literal_eval(raw, "hits", X.HITS).select("visitId", N.array_first("hits").alias("h"))

    def names(inner, field):
        return F.array_join(N.array_field_list(F.col("h")[inner], field), "|")

    return first.select("visitId", names("product", "v2ProductName").alias("product_names"),
                        names("product", "v2ProductCategory").alias("product_categories"),
                        names("promotion", "promoId").alias("promo_ids"),
                        names("promotion", "promoName").alias("promo_names"))


_LISTS = {
    "page_title": "'True Grit, Men''s ' || event_type",
    "hit_number": "i",
    "hit_time": "i * 1000",
    "hit_exit": "i = n_hits",
    "screen_name": "'shop/' || i",
    "exit_screen_name": "'shop/' || n_hits",
    "transaction_currency": "'USD'",
    "action_type": "k % 3",
}


@query("hits_pluck", f"""
WITH {HITS_ROWS}, l AS (SELECT "visitId",
  {', '.join(f"string_agg(CAST({e} AS VARCHAR), '|' ORDER BY i) AS {n}" for n, e in _LISTS.items())}
  FROM h GROUP BY "visitId")
SELECT flat."visitId", {', '.join(f"coalesce({n}, '') AS {n}" for n in _LISTS)}
FROM flat LEFT JOIN l ON flat."visitId" = l."visitId" """)
def hits_pluck(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits")
    plucked = N.hits_pluck(N.literal_eval(raw, "hits", X.HITS), "hits")
    return plucked.select("visitId", *[F.array_join(F.col(n).cast("array<string>"), "|").alias(n) for n in _LISTS])


@query("product_pluck", f"""
WITH {HITS_ROWS}, p AS (
  SELECT "visitId", string_agg('SKU' || (k + p), '|' ORDER BY i, p) AS skus,
         string_agg(CAST(p * 1000 AS VARCHAR), '|' ORDER BY i, p) AS prices
  FROM h, unnest(range(1, i + 1)) AS t(p) GROUP BY "visitId")
SELECT flat."visitId", coalesce(skus, '') AS skus, coalesce(prices, '') AS prices
FROM flat LEFT JOIN p ON flat."visitId" = p."visitId" """)
def product_pluck(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits")
    plucked = N.product_pluck(N.literal_eval(raw, "hits", X.HITS), "hits", ["productSKU", "productPrice"], flat=True)
    return plucked.select("visitId", F.array_join("product_productSKU", "|").alias("skus"),
                          F.array_join("product_productPrice", "|").alias("prices"))


@query("promotion_pluck", f"""
WITH {FLAT} SELECT "visitId", CASE WHEN k % 4 >= 2 THEN 'P' || k ELSE '' END AS promo_ids,
  CASE WHEN k % 4 >= 2 THEN 'Summer ' || chr(160) || 'Sale' ELSE '' END AS promo_names
FROM flat""")
def promotion_pluck(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits")
    plucked = N.promotion_pluck(N.literal_eval(raw, "hits", X.HITS), "hits", ["promoId", "promoName"], flat=True)
    return plucked.select("visitId", F.array_join("promotion_promoId", "|").alias("promo_ids"),
                          F.array_join("promotion_promoName", "|").alias("promo_names"))


@query("dimension_explode", f"""
WITH {FLAT} SELECT "fullVisitorId", "visitStartTime", "cD_index", "cD_value" FROM flat
UNION ALL SELECT "fullVisitorId", "visitStartTime", '2', 'Men''s ' || event_type FROM flat WHERE k % 7 <> 0 AND k % 2 = 0""")
def dimension_explode(spark, d):
    raw = raw_sessions(spark, d).select("fullVisitorId", "visitStartTime", "customDimensions")
    return N.dimension_explode(N.literal_eval(raw, "customDimensions", X.DIMENSIONS), "customDimensions")


@query("drop_null_nested", f"""
WITH {FLAT} SELECT "visitId", "cD_index" AS index FROM flat WHERE k % 4 > 0 AND k % 7 <> 0""")
def drop_null_nested(spark, d):
    raw = raw_sessions(spark, d).select("visitId", "hits", "customDimensions")
    parsed = N.literal_eval(N.literal_eval(raw, "hits", X.HITS), "customDimensions", X.DIMENSIONS)
    kept = N.drop_null_nested(parsed, "hits", "customDimensions")
    return kept.select("visitId", N.array_first("customDimensions")["index"].alias("index"))


@query("drop_empty_substructs", f"""
WITH {FLAT} SELECT "visitId", CASE WHEN k % 4 > 0 THEN 'PAGE' END AS type, CAST(0 AS INTEGER) AS empty_fields FROM flat""")
def drop_empty_substructs(spark, d):
    """Fields known to be empty are absent from the parse schema, so they never become columns."""
    raw = raw_sessions(spark, d).select("visitId", "hits")
    first = N.literal_eval(raw, "hits", X.HITS).withColumn("hits", N.array_first("hits"))
    flat = N.json_normalize(first, "hits")
    gone = ("experiment", "customVariables", "customMetrics", "publisher_infos", "customDimensions")
    return flat.select("visitId", "type", F.lit(sum(c in gone for c in flat.columns)).alias("empty_fields"))


@query("null_text_replace", f"""
WITH {S} SELECT event_id, CASE WHEN k % 2 = 1 THEN k END AS k FROM s""")
def null_text_replace(spark, d):
    """A bare None is a NULL value after parsing."""
    text = F.concat(F.lit("{'k': "), F.when(F.col("k") % 2 == 1, F.col("k").cast("string")).otherwise(F.lit("None")),
                    F.lit("}"))
    parsed = parse_pyliteral(text, X.struct(k="integer"))
    return sessions(spark, d).select("event_id", parsed["k"].alias("k"))


@query("export_clean", f"""
WITH {FLAT} SELECT "visitId", nullif(browser, '(not set)') AS browser, nullif(city, '(not set)') AS city,
  nullif("networkDomain", 'unknown.unknown') AS "networkDomain", nullif(medium, '(none)') AS medium,
  CAST(NULL AS VARCHAR) AS campaign
FROM flat""")
def export_clean(spark, d):
    """Flatten, drop placeholder columns, turn NA tokens to NULL."""
    flat = N.json_flatten(raw_sessions(spark, d).drop("hits", "customDimensions"), X.JSON_COLUMNS, sep="_")
    flat = drop_cols(flat, X.EMPTY_DEVICE_FIELDS + X.EMPTY_GEO_FIELDS)
    return na_tokens_to_null(flat, X.NA_TOKENS).select("visitId", "browser", "city", "networkDomain", "medium", "campaign")
