"""File scans. All are lazy; none pulls rows to the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlab.operators.cleaning import na_tokens_to_null

# RFC 4180 quoting, so that JSON text inside quotes survives. multiLine is left to the files that need it (``_routed``): it
# makes a file a single unsplittable task.
CSV_QUOTING = {"header": "true", "quote": '"', "escape": '"'}


def scan_typed_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with declared types, matched to the files by the names in their headers, in whatever order they stand.

    Everything is read as text and converted by ``try_cast``: ids declared as strings keep leading zeros and precision,
    a text that is no number becomes NULL. Paths whose headers differ are scanned apart and stacked by name. Within one
    path all files must share a header, which the reader checks; a column that a header lacks raises ValueError. Records
    may run over several lines: the files that hold such records are read whole, all others stay splittable.
    """
    scans = []
    for header, paths in _by_header(spark, path).items():
        lacking = [f.name for f in schema.fields if f.name not in header]
        if lacking:
            raise ValueError(f"{paths} have no columns {lacking}")
        text = _read_text(spark, paths, header)
        scans.append(text.select(*[_typed(f) for f in schema.fields]))
    return reduce(DataFrame.unionByName, scans)


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The paths grouped by the header of their files; only the first line of a path is read."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in _paths(path):
        groups.setdefault(tuple(spark.read.options(**CSV_QUOTING).csv(p).columns), []).append(p)
    return groups


def _read_text(spark: SparkSession, paths: list[str], header: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = spark.read.options(**CSV_QUOTING, enforceSchema="false").schema(schema)
    return reduce(DataFrame.unionByName, [reader.option("multiLine", whole).csv(files) for whole, files in _routed(spark, paths)])


def _routed(spark: SparkSession, paths: list[str]) -> list[tuple[bool, list[str]]]:
    """The files of the paths as (read whole, files): whole if a record in them runs over several lines.

    Quotes inside a quoted field are doubled, so a line that is a record by itself has an even number of them. One scan of
    the lines finds the files with an odd one; one row per file reaches the driver, which lists the files anyway.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = F.max(F.pmod(quotes, F.lit(2)) == 1).alias("odd")
    found = {_plain(r["file"]): r["odd"] for r in lines.groupBy("file").agg(odd).collect()}
    if not any(found.values()):
        return [(False, paths)]
    sides = [(side, sorted(f for f, odd in found.items() if odd == side)) for side in (False, True)]
    return [(side, files) for side, files in sides if files]


def _plain(uri: str) -> str:
    """A file's path from its URI, with the characters escaped that a path pattern would take for its own."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in unquote(uri))


def _typed(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name)


def scan_inferred_csv(spark: SparkSession, path: str | Sequence[str],
                      string_columns: Sequence[str] = ("fullVisitorId",)) -> DataFrame:
    """CSV with guessed types. The named columns are read as text whatever they look like:
    casting an inferred number back to text would already have lost digits. Types are guessed from the paths that share
    the first header; other paths are matched to it by name."""
    first = next(iter(_by_header(spark, path).values()))
    guesses = [spark.read.options(**CSV_QUOTING, inferSchema="true", multiLine=whole).csv(files).schema
               for whole, files in _routed(spark, first)]
    guessed = T.StructType([T.StructField(fields[0].name, reduce(_wider, [f.dataType for f in fields])) for fields in zip(*guesses)])
    declared = T.StructType([
        T.StructField(f.name, T.StringType() if f.name in string_columns else f.dataType) for f in guessed.fields
    ])
    return scan_typed_csv(spark, path, declared)


# From narrow to wide.
_NUMBERS = (T.IntegerType(), T.LongType(), T.DoubleType())


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds both; text where no number does."""
    if a == b:
        return a
    return _NUMBERS[max(_NUMBERS.index(a), _NUMBERS.index(b))] if a in _NUMBERS and b in _NUMBERS else T.StringType()


def scan_pruned(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                columns: Sequence[str]) -> DataFrame:
    """Only some columns; the select reaches the reader as its ReadSchema."""
    return scan_typed_csv(spark, path, schema).select(*columns)


def scan_na_tokens(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                   tokens: Sequence[str]) -> DataFrame:
    """Several texts read as NULL (the reader's own nullValue takes one)."""
    return na_tokens_to_null(scan_typed_csv(spark, path, schema), tokens)


def scan_limit(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows. With an order the choice is repeatable; each task keeps at most n rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def scan_chunked(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Big input in pieces: the scan's own partitions (``spark.sql.files.maxPartitionBytes``) are
    the pieces, each an independent task, so there is no loop and no append step. To append pieces to a table over
    several runs see ``load_pieces``."""
    return scan_typed_csv(spark, path, schema)


def load_pieces(spark: SparkSession, folder: str, schema: T.StructType, target: str, log: str,
                files_per_piece: int = 100, pieces: int | None = None) -> DataFrame:
    """Append the CSV files of ``folder`` that were not loaded before to the parquet table ``target``, piece by piece.

    A piece is at most ``files_per_piece`` files. The file source notes in ``log`` which files a piece holds before it is
    loaded, the file sink makes a piece visible as a whole, and a run that was killed goes on with the piece it was at: each
    file is appended exactly once, however often this is called. Ends when no file is left, or after ``pieces`` pieces (for
    runs of a given size). Both folders must be shared and kept together. Columns go by the header's names, which must be the
    same in all files; types as in ``scan_typed_csv``. Records may not run over several lines here. Returns the whole table.
    """
    header = next(iter(_by_header(spark, folder)))
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    files = spark.readStream.options(**CSV_QUOTING, enforceSchema="false", maxFilesPerTrigger=files_per_piece).schema(text).csv(folder)
    typed = files.select(*[_typed(f) for f in schema.fields])
    sink = typed.writeStream.format("parquet").option("path", target).option("checkpointLocation", log).outputMode("append")
    if pieces is None:
        sink.trigger(availableNow=True).start().awaitTermination()
    for _ in range(pieces or 0):
        sink.trigger(once=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


def scan_multi(spark: SparkSession, groups: Sequence[tuple[str | Sequence[str], T.StructType]]) -> DataFrame:
    """Stack part files. Paths that share a header go in one group and become one scan; groups with
    different headers are stacked by name, with NULL for what a group lacks."""
    scans = [scan_typed_csv(spark, path, schema) for path, schema in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)
