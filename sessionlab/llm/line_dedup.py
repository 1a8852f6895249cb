"""Line dedup: windows of three consecutive lines that occur before are removed, wherever they lie.

Lines end at a line feed; blanks, tabs and carriage returns around them don't count, and blank lines take no part: they
neither belong to a window nor are removed. A window occurs later if its first occurrence has a smaller doc_id, or the
same one and an earlier place. All lines that later occurrences cover are removed together, overlaps merged; windows are
judged on the input. Null text is empty; documents with fewer than three lines stay as they are; rows that repeat a
doc_id are treated as one document, so each loses what lies in it again. A row without a doc_id has no place in the order of
documents: it is kept whole and removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import chunks, stored, texts, widened

WINDOW = 3
_EDGE = " \t\r"


def _full_lines(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(_EDGE)]


def line_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(hi, lo, doc_id, place) for each window of ``width`` lines: a 128-bit hash, and the rank of its first line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            marks, ids, places = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                lines, full = _full_lines(text)
                if len(full) >= width:
                    own = [xxhash.xxh3_128_digest(lines[i].strip(_EDGE).encode()) for i in full]
                    marks += [xxhash.xxh3_128_digest(b"".join(own[k:k + width])) for k in range(len(own) - width + 1)]
                    ids += [doc] * (len(own) - width + 1)
                    places += range(len(own) - width + 1)
            halves = np.frombuffer(b"".join(marks), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()), pa.array(places, pa.int32())],
                names=["hi", "lo", "doc_id", "place"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hi long, lo long, doc_id long, place int")


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, places) of windows that are not the first with their hash.

    First occurrences come from partial minima, so a window that a third of all documents hold is not gathered; they are
    joined back only where the hash occurs more than once.
    """
    first = windows.groupBy("hi", "lo").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (windows.join(first, ["hi", "lo"]).where("struct(doc_id, place) != first")
            .groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places")))


def remove_repeated_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with the lines of later windows taken out of ``text``, and ``n_removed`` (lines).

    Columns that bear the helper names are kept apart: ``n_removed`` is replaced.
    """
    docs = docs.drop("n_removed")
    windows = stored(line_windows(docs.where("doc_id is not null"), width), "line-windows")
    later = later_windows(windows).select(F.col("doc_id").alias("__doc"), F.col("places").alias("__places"))
    joined = docs.join(later, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept, removed = [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("__places").to_pylist(), strict=True):
                if not places:
                    kept.append(text)
                    removed.append(0)
                    continue
                lines, full = _full_lines(text)
                covered = {full[p + k] for p in places for k in range(width) if p + k < len(full)}
                kept.append("\n".join(line for i, line in enumerate(lines) if i not in covered))
                removed.append(len(covered))
            batch = batch.drop_columns(["__places"])
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(removed, pa.int64())],
                                             names=[*batch.schema.names, "n_removed"])
    return joined.mapInArrow(run, widened(docs.schema, "n_removed", "long"))
