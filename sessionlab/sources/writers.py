"""File sinks and restart points."""

from __future__ import annotations

from pyspark.sql import DataFrame


# White space around a text is part of it.
CSV_WRITING = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


# For CSV files that are read again: packed fast, by a codec that is part of Spark.
PACKING = "lz4"
# A packed file can't be split among tasks: it holds at most so many rows.
PACKED_ROWS = 100_000


def sink_csv(df: DataFrame, path: str, packing: str | None = None) -> str:
    """CSV files, packed by the codec ``packing`` if one is given; readers tell it by the files' names."""
    if packing:
        return sink_split(df, path, PACKED_ROWS, packing)
    df.write.options(**CSV_WRITING).csv(path)
    return path


def sink_split(df: DataFrame, path: str, rows_per_file: int, packing: str | None = None) -> str:
    """At most ``rows_per_file`` rows in each file; the split happens inside the writing task."""
    df.write.options(**CSV_WRITING, maxRecordsPerFile=str(rows_per_file), compression=packing or "none").csv(path)
    return path


def sink_columnar(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return path


def materialize(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate and read it back: a restart point with no lineage behind it."""
    sink_columnar(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_scored(df: DataFrame, folder: str, prefix: str, score: float) -> str:
    """CSV whose name carries the rounded validation score."""
    return sink_csv(df, f"{folder}/{prefix}_{round(score, 5)}.csv")
