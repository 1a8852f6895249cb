"""Named queries of the operators, each over its whole table, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlab.llm.byte_bpe import decode_documents, encode_documents
from sessionlab.llm.common import table
from sessionlab.llm.conversation_repair import damage, repair_report
from sessionlab.llm.embedding_dedup import embedding_components
from sessionlab.llm.line_dedup import remove_repeated_lines
from sessionlab.llm.ngram_join import jaccard_components
from sessionlab.llm.packing import cut_documents, pack_pieces
from sessionlab.llm.periodic_runs import find_runs
from sessionlab.llm.pii import BASE, KINDS, find_personal_data, spans_text
from sessionlab.llm.sharding import shard_documents
from sessionlab.llm.suffix_dedup import remove_repeats
from sessionlab.llm.toxicity import fit_toxicity, score_toxicity

from sessionlab.llm.url_filter import judge_urls
from sessionlab.llm.vector_search import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "severity", (F.col("severity") >= 0.5).alias("toxic"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "text", "n_removed")


#: Windows of three lines that are not blank; those after the first with their text are covered.
ORACLES["op9_line_dedup"] = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), line AS (
  SELECT doc_id, spot, parts[spot] AS line, trim(parts[spot], chr(32) || chr(9) || chr(13)) AS bare
  FROM cut, unnest(range(1, len(parts) + 1)) AS u(spot)
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k FROM line WHERE bare <> ''
), win AS (
  SELECT doc_id, k, bare || chr(10) || lead(bare, 1) OVER w || chr(10) || lead(bare, 2) OVER w AS body
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS nth FROM win WHERE body IS NOT NULL)
  WHERE nth > 1
), covered AS (
  SELECT DISTINCT s.doc_id, s.spot FROM later l JOIN solid s ON s.doc_id = l.doc_id AND s.k BETWEEN l.k AND l.k + 2
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.spot) FILTER (c.spot IS NULL) AS body, count(c.spot) AS n_removed
  FROM line l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.spot = l.spot GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN k.n_removed > 0 THEN coalesce(k.body, '') ELSE d.text END AS text, k.n_removed
FROM documents d JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(len(BASE))]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = "byte_bpe_50k.tiktoken"
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return decode_documents(encoded, ranks).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.transform("removed", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


#: The rules of the contract, as (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def plant_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``; in one document of ten, by crc32 of its id, words from some place on repeat the first few."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    cut = docs.withColumns({"h": h, "words": F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))})
    n = F.size("words").cast("long")
    a = F.pmod(g, n)
    sized = cut.withColumns({"a": F.when(n > 0, a).cast("int")})
    sized = sized.withColumn("p", (F.floor((n - F.col("a")) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int"))
    places = F.sequence(F.col("a"), (n - 1).cast("int"))
    again = F.transform(places, lambda i: F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))
    return sized.select("doc_id", F.when((F.pmod(F.col("h"), F.lit(10)) == 0) & (n > 0), F.array_join(
        F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(plant_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Longest first; of equal length the one that starts first, then the shorter period.
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    run = found.withColumn("best", best)
    return run.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.shorter * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(talks, damage(talks))
