"""Approximate nearest neighbours by cosine with an inverted multi-index.

The two halves of a unit vector are quantised separately, by as many centroids each as give about CELL vectors a cell, from
HALF to MOST_HALF of them, so every vector lies in one of at most MOST_HALF^2 cells. A query walks the cells in order of the summed distance of their two centroids, with a heap over the
pairs, until the cells hold the probed share of all vectors; the vectors of these cells are reranked by their cosine in
double precision. The codebooks are fitted on at most FIT_ROWS vectors, and the share is the least that finds the wanted
part of true neighbours among them. Every usable vector is indexed.

Vectors that are null, empty, zero or hold null or non-finite components take no part. A query never finds rows of its
own vec_id; ties go to the smaller vec_id; with fewer candidates than k all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlab.llm.common import stored
from sessionlab.llm.vectors import matrix, pair_cosines, usable_vectors

FIT_ROWS, FIT_QUERIES, WANTED = 6_000, 300, 0.97
#: Fewest and most centroids of a half, and vectors of a cell that their number aims at.
HALF, MOST_HALF, CELL = 16, 256, 200
#: Vectors of a cell that one task compares; larger cells are split.
PART = 8_192
#: Queries that are asked of a part at a time.
TURN = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids by Lloyd's rounds from rows spread over the sample; fewer rows give fewer centroids."""
    centroids = np.unique(x, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)].copy()
    for _ in range(rounds):
        near = _squared(x, centroids).argmin(1)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def walk_cells(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, least: float) -> list[int]:
    """Cells by increasing summed distance until they hold ``least`` vectors. The heap holds a frontier of pairs."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))
    return out


def centroid_count(n: int) -> int:
    """Centroids of each half for n vectors."""
    return max(HALF, min(MOST_HALF, int((n / CELL) ** 0.5)))


class MultiIndex:
    """Codebooks of the two halves, and the share of all vectors that a query probes."""

    def __init__(self, sample: np.ndarray, k: int, half: int = HALF, wanted: float = WANTED):
        unit = _unit(sample)
        self.width = unit.shape[1]
        self.middle = max(1, self.width // 2)
        self.books = [fit_centroids(unit[:, :self.middle], half), fit_centroids(unit[:, self.middle:], half)]
        self.share = self._calibrate(unit, k, wanted)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(unit[:, :self.middle], self.books[0]), _squared(unit[:, self.middle:], self.books[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        first, second = self.distances(unit)
        return first.argmin(1) * len(self.books[1]) + second.argmin(1)

    @property
    def cell_count(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def _calibrate(self, unit: np.ndarray, k: int, wanted: float) -> float:
        """Share of the sample that must be probed until ``wanted`` of the true neighbours of sample queries are met."""
        cell = self.cells(unit)
        sizes = np.bincount(cell, minlength=self.cell_count)
        some = np.linspace(0, len(unit) - 1, min(FIT_QUERIES, len(unit))).astype(int)
        first, second = self.distances(unit[some])
        need = []
        for q, a, b in zip(some.tolist(), first, second, strict=True):
            cosine = unit @ unit[q]
            cosine[q] = -2
            best = np.argsort(-cosine, kind="stable")[:k]
            order = np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")  # the whole walk at once
            held = np.empty(len(order))
            held[order] = np.cumsum(sizes[order])
            need += (held[cell[best]] / len(unit)).tolist()
        return float(np.quantile(need, wanted)) if need else 1.0


def nearest(rows: DataFrame, k: int = 5, every: int = 50, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose vec_id is divisible by ``every``.

    Rows without a vec_id take no part. A vec_id that repeats is no neighbour of itself, and stands for the nearest of its rows."""
    vectors = stored(usable_vectors(rows).select("vec_id", "x"), "vectors")
    sample = [bytes(r["x"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("x").collect()]
    if not sample:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    head = vectors.agg(F.max(F.octet_length("x")).alias("bytes"), F.count("*").alias("n")).first()
    width = head["bytes"] // 8
    index = MultiIndex(matrix(sample, width), k, centroid_count(head["n"]), wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_unit(matrix(batch.column("x").to_pylist(), width)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], ["vec_id", "x", "cell"])
    placed = stored(vectors.mapInArrow(place, "vec_id long, x binary, cell int"), "placed")
    sizes = np.zeros(index.cell_count, dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_HALF^2 rows
        sizes[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-sizes // PART))
    least = max(index.share * sizes.sum(), 4 * k + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").to_pylist()
            if not x:
                continue
            first, second = index.distances(_unit(matrix(x, width)))
            ids, own, cells, split = batch.column("vec_id").to_pylist(), [], [], []
            for n, (a, b) in enumerate(zip(first, second, strict=True)):
                for c in walk_cells(a, b, sizes, least):
                    own += [n] * int(parts[c])
                    cells += [c] * int(parts[c])
                    split += range(int(parts[c]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[n] for n in own], pa.int64()), pa.array([x[n] for n in own], pa.binary()),
                 pa.array(cells, pa.int32()), pa.array(split, pa.int32())], ["query_id", "q", "cell", "part"])
    asked = vectors.where(F.col("vec_id") % every == 0)
    # A group holds one part of a cell and one turn of the queries, however many there are of either.
    turns = max(1, -(-asked.count() // TURN))
    queries = asked.mapInArrow(route, "query_id long, q binary, cell int, part int").withColumn(
        "turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    split = np.flatnonzero(parts > 1)
    stock = placed.withColumn("parts", F.lit(1))
    if len(split):  # at most MOST_HALF^2 rows
        of_cell = rows.sparkSession.createDataFrame(pd.DataFrame({"cell": split.astype(np.int32), "of": parts[split]}))
        stock = placed.join(F.broadcast(of_cell), "cell", "left").withColumn("parts", F.coalesce("of", F.lit(1)))
    stock = stock.select("vec_id", "x", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))

    def rerank(stock: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids = stock["vec_id"].to_numpy()
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(ids) and len(asked):
            x, q = matrix(stock["x"].tolist(), width), matrix(asked["q"].tolist(), width)
            unit, own = _unit(x), asked["query_id"].to_numpy()
            for at in range(0, len(q), 128):
                rough = _unit(q[at:at + 128]) @ unit.T
                rough[own[at:at + 128, None] == ids] = -2
                edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(rough), -2.0)
                i, j = np.nonzero((rough >= edge[:, None] - 1e-9) & (rough > -1.5))
                score = [pair_cosines(x[j[n:n + (1 << 16)]], q[i[n:n + (1 << 16)] + at]) for n in range(0, len(i), 1 << 16)]
                best = pd.DataFrame({"query_id": own[i + at], "vec_id": ids[j], "score": np.concatenate([np.zeros(0), *score])})
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(best[best.groupby("query_id").cumcount() < k])
        return pd.concat(out[1:] or out, ignore_index=True)

    found = stock.groupBy("cell", "part", "turn").cogroup(queries.groupBy("cell", "part", "turn")).applyInPandas(
        rerank, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
