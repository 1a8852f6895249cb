"""Queries on scans and sinks: the export is written to the shared folder as files and read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sessionlab.catalog.inputs import FLAT, raw_sessions, table
from sessionlab.catalog.registry import query
from sessionlab.functions.columns import rmse
from sessionlab.operators.nested import json_flatten
from sessionlab.session import scratch_path
from sessionlab.sources import readers as R
from sessionlab.sources import schemas as X
from sessionlab.sources import writers as Wr


def _export(spark, d, name, rows_per_file=None):
    """The session export as packed CSV files."""
    raw = raw_sessions(spark, d).select(*X.SESSIONS_V2.fieldNames())
    path = scratch_path(spark, name)
    return Wr.sink_split(raw, path, rows_per_file, Wr.PACKING) if rows_per_file else Wr.sink_csv(raw, path, Wr.PACKING)


_PARSED = """"visitId", "fullVisitorId", "visitStartTime", browser, country, pageviews"""
_PARSED_SQL = f"WITH {FLAT} SELECT {_PARSED} FROM flat"


def _parsed(df):
    flat = json_flatten(df, {"device": X.DEVICE, "geoNetwork": X.GEO, "totals": X.TOTALS})
    return flat.select("visitId", "fullVisitorId", "visitStartTime", "browser", "country", "pageviews")


@query("scan_typed_csv", _PARSED_SQL)
def scan_typed_csv(spark, d):
    return _parsed(R.scan_typed_csv(spark, _export(spark, d, "typed"), X.SESSIONS_V2))


@query("scan_inferred_csv", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS "fullVisitorId", c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_inferred_csv(spark, d):
    """Types are guessed, but the id stays text with its leading zeros."""
    rows = table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("fullVisitorId"), "c_nationkey", "c_acctbal", "c_mktsegment")
    return R.scan_inferred_csv(spark, Wr.sink_csv(rows, scratch_path(spark, "inferred")))


@query("scan_reordered_csv", f"""
WITH {FLAT} SELECT {_PARSED} FROM flat WHERE k % 2 = 0 UNION ALL SELECT {_PARSED} FROM flat WHERE k % 2 = 1""")
def scan_reordered_csv(spark, d):
    """Two exports whose columns stand in different orders, neither that of the schema."""
    raw = raw_sessions(spark, d, keyed=True)
    names = X.SESSIONS_V2.fieldNames()
    back = Wr.sink_csv(raw.filter("k % 2 = 0").select(*reversed(names)), scratch_path(spark, "back"), Wr.PACKING)
    turned = Wr.sink_csv(raw.filter("k % 2 = 1").select(*names[5:], *names[:5]), scratch_path(spark, "turned"), Wr.PACKING)
    return _parsed(R.scan_typed_csv(spark, [back, turned], X.SESSIONS_V2))


@query("scan_sessions_v1", f"""
WITH {FLAT} SELECT CAST("visitId" AS VARCHAR) AS "visitId", "fullVisitorId", "visitStartTime", browser, country, pageviews,
  'S' || "visitId" AS "sessionId" FROM flat""")
def scan_sessions_v1(spark, d):
    """The first version of the export: no list columns, ids as text, a session id."""
    raw = raw_sessions(spark, d).withColumn("sessionId", F.concat(F.lit("S"), "visitId"))
    path = Wr.sink_csv(raw.select(*X.SESSIONS_V1.fieldNames()), scratch_path(spark, "v1"), Wr.PACKING)
    flat = json_flatten(R.scan_typed_csv(spark, path, X.SESSIONS_V1), {"device": X.DEVICE, "geoNetwork": X.GEO, "totals": X.TOTALS})
    return flat.select("visitId", "fullVisitorId", "visitStartTime", "browser", "country", "pageviews", "sessionId")


@query("scan_pruned", f"""WITH {FLAT} SELECT "fullVisitorId", "visitStartTime" FROM flat""")
def scan_pruned(spark, d):
    return R.scan_pruned(spark, _export(spark, d, "pruned"), X.SESSIONS_V2, ["fullVisitorId", "visitStartTime"])


@query("scan_na_tokens", """
SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_orderpriority END AS o_orderpriority
FROM orders""")
def scan_na_tokens(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    path = Wr.sink_csv(rows, scratch_path(spark, "tokens"))
    return R.scan_na_tokens(spark, path, X.struct(o_orderkey="long", o_orderpriority="string"), ("5-LOW", "4-NOT SPECIFIED"))


@query("scan_limit", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 20")
def scan_limit(spark, d):
    """The first n rows, as a trial read takes them."""
    return R.scan_limit(table(spark, d, "events").select("event_id", "event_type"), 20, "event_id")


@query("scan_chunked", _PARSED_SQL)
def scan_chunked(spark, d):
    """Many files of at most 2000 rows; every file is parsed by its own tasks."""
    return _parsed(R.scan_chunked(spark, _export(spark, d, "chunks", 2000), X.SESSIONS_V2))


@query("load_pieces", f"""
WITH {FLAT} SELECT "visitId", "fullVisitorId", "visitStartTime", date, "channelGrouping" FROM flat""")
def load_pieces(spark, d):
    """Pieces of one file: a first run stops after two of them, a second one loads the rest, a third finds nothing."""
    wanted = X.struct(visitId="integer", fullVisitorId="string", visitStartTime="long", date="string", channelGrouping="string")
    folder, target, log = _export(spark, d, "incoming", 1000), scratch_path(spark, "loaded"), scratch_path(spark, "load-log")
    R.load_pieces(spark, folder, wanted, target, log, files_per_piece=1, pieces=2)
    R.load_pieces(spark, folder, wanted, target, log)
    return R.load_pieces(spark, folder, wanted, target, log)


@query("scan_records_over_lines", """
SELECT doc_id, nullif(text, '') AS text, source, FALSE AS page FROM documents
UNION ALL SELECT page_id, url, 'web', TRUE FROM pages""")
def scan_records_over_lines(spark, d):
    """Texts with line feeds, quotes and commas are written and read back, beside files whose records are lines.
    A CSV file knows no empty text: it comes back as NULL."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", F.lit(False).alias("page"))
    urls = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"), F.lit("web").alias("source"),
                                           F.lit(True).alias("page"))
    paths = [Wr.sink_csv(df, scratch_path(spark, "lines")) for df in (docs, urls)]
    return R.scan_typed_csv(spark, paths, docs.schema)


@query("scan_multi", """
SELECT o_orderkey, o_custkey, o_orderstatus, NULL AS o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT o_orderkey, o_custkey, NULL, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'""")
def scan_multi(spark, d):
    """Two part files with one header and one with another, stacked."""
    orders = table(spark, d, "orders")
    first = F.lit("1997-01-01").cast("timestamp_ntz")
    second = F.lit("1999-01-01").cast("timestamp_ntz")
    day = F.col("o_orderdate")
    status = ["o_orderkey", "o_custkey", "o_orderstatus"]
    a = Wr.sink_csv(orders.filter(day < first).select(*status), scratch_path(spark, "part"))
    b = Wr.sink_csv(orders.filter((day >= first) & (day < second)).select(*status), scratch_path(spark, "part"))
    c = Wr.sink_csv(orders.filter(day >= second).select("o_orderkey", "o_custkey", "o_orderpriority"), scratch_path(spark, "part"))
    return R.scan_multi(spark, [([a, b], X.struct(o_orderkey="long", o_custkey="long", o_orderstatus="string")),
                                (c, X.struct(o_orderkey="long", o_custkey="long", o_orderpriority="string"))])


@query("sink_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def sink_csv(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    return R.scan_typed_csv(spark, Wr.sink_csv(part, scratch_path(spark, "csv")), part.schema)


@query("sink_csv_quoted", "SELECT page_id, url, props FROM pages LEFT JOIN (SELECT event_id, props FROM events) ON page_id = event_id")
def sink_csv_quoted(spark, d):
    """Text with commas and double quotes survives the round trip."""
    props = table(spark, d, "events").select("event_id", "props")
    rows = table(spark, d, "pages").select("page_id", "url").join(props, F.col("page_id") == F.col("event_id"), "left").drop("event_id")
    return R.scan_typed_csv(spark, Wr.sink_csv(rows, scratch_path(spark, "quoted")), rows.schema)


@query("sink_split", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, TRUE AS within FROM lineitem")
def sink_split(spark, d):
    """At most 5000 rows per file, checked on what was written."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    back = R.scan_typed_csv(spark, Wr.sink_split(rows, scratch_path(spark, "split"), 5000), rows.schema)
    named = back.withColumn("file", F.input_file_name())
    sizes = named.groupBy("file").agg((F.count(F.lit(1)) <= 5000).alias("within"))
    return named.join(sizes, "file").drop("file")


@query("sink_columnar", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sink_columnar(spark, d):
    path = Wr.sink_columnar(table(spark, d, "customer"), scratch_path(spark, "columnar"), ("c_mktsegment",))
    return spark.read.parquet(path)


@query("materialize", """
SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY o_custkey""")
def materialize(spark, d):
    summary = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("first_day"))
    return Wr.materialize(summary, scratch_path(spark, "restart"))


@query("sink_scored", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS y,
  'visitors_' || (SELECT round(sqrt(avg(power(l_quantity - 25, 2))), 5) FROM lineitem) || '.csv' AS file FROM lineitem""")
def sink_scored(spark, d):
    """The file name carries the error of the scores."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("y"))
    error = rows.agg(rmse("y", F.lit(25.0)).alias("e")).first()["e"]
    path = Wr.sink_scored(rows, scratch_path(spark, "scored"), "visitors", error)
    return R.scan_typed_csv(spark, path, rows.schema).withColumn("file", F.lit(os.path.basename(path)))
