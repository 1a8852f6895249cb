"""Embedding columns as double-precision arrays, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, key, x): doubles as bytes and their digest, of vectors that are not null, empty or zero and hold neither
    null nor non-finite components; the others, and rows without a vec_id, are left out."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))) & F.exists(
        e, lambda v: F.coalesce(v != 0, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
            ends = column.offsets.to_numpy()
            parts = [values[a:b].tobytes() for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
            keys = [hashlib.blake2b(p, digest_size=16).digest() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], ["vec_id", "key", "x"])
    return rows.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("x")).mapInArrow(
        run, "vec_id long, key binary, x binary")


def matrix(parts: list[bytes], width: int | None = None) -> np.ndarray:
    """One row per vector; shorter vectors are padded with zeros, which leaves their cosines as they are."""
    width = width or max((len(p) // 8 for p in parts), default=0)
    if all(len(p) == 8 * width for p in parts):
        return np.frombuffer(b"".join(parts), dtype=np.float64).reshape(len(parts), width)
    out = np.zeros((len(parts), width))
    for k, p in enumerate(parts):
        out[k, :len(p) // 8] = np.frombuffer(p, dtype=np.float64)
    return out


def pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the row of y beside it; equal vectors give equal results wherever they stand."""
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
