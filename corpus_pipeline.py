"""From raw documents to packed training sequences, in stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All but the last return the
columns of ``documents``. The operators have no SQL counterpart (a fitted model, connected components, a packing plan), so
there is no ORACLE_SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlab.llm.common import stored, table
from sessionlab.llm.line_dedup import remove_repeated_lines
from sessionlab.llm.ngram_join import keep_one_per_component
from sessionlab.llm.packing import cut_documents, pack_pieces
from sessionlab.llm.pii import mask_personal_data
from sessionlab.llm.toxicity import reject_toxic

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below 0.5; the others go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of three-line windows that occur before."""
    return _recounted(remove_repeated_lines(docs).drop("n_removed"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_per_component(docs, words=5, num=80, den=100)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind."""
    return _recounted(mask_personal_data(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document: sequence_id and offset; ids are not carried along."""
    pieces = cut_documents(docs, TOKENIZER)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
