"""Helpers shared by the operators: tables, shared storage, text columns as flat byte arrays, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sessionlab.session import scratch_path

#: Bytes of text that one step of a task turns into arrays at once; a single longer text is its own step.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result is stored: it does so once the driver has collected the
    objects that stand for them, which a driver with little to do puts off for long."""
    spark.sparkContext._jvm.System.gc()


def widened(schema: StructType, name: str, kind: str) -> StructType:
    """The schema with one more column."""
    return StructType([*schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold about ``limit`` bytes of ``text``; empty batches are left out."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """The texts of a column as Python strings; null is empty."""
    return pc.fill_null(column, "").to_pylist()


_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 polynomial prefix hashes modulo 2^64 of a byte array, over random byte values."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers("up", _BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end), alike wherever the bytes lie."""
    down = powers("down", _BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run without ASCII white space, A-Z lower-cased), and the first word index of each row."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ~space[inner]  # a row's first byte starts a word, whatever ends the row before
    ends[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = range_hash(prefix_hash(_LOWER[data]), start, end)
    return hashes, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``words`` words; a shorter row has its whole sequence as one."""
    hashes, first = word_hashes(data, offsets)
    runs = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        runs = runs * _U(0xD6E8FEB86659FD93) + mix(hashes[k:k + len(runs)] + _U(k + 1))
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(runs[a:b - words + 1])
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for k in range(b - a):
                whole = whole * _U(0xC2B2AE3D27D4EB4F) + mix(hashes[a + k:a + k + 1] + _U(k + 1))
            yield mix(whole + _U(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
