"""Embedding near-duplicates by PCA-ordered tiled comparison, exactly.

Unit vectors are rotated onto their principal axes, largest variance first. Two of them are compared by accumulating the
products of leading dimensions; what the others can still add is at most the product of the vectors' suffix norms, and a
pair is given up as soon as its cosine cannot reach the threshold. Blocks are boxes of the leading coordinates, cut along
the widest one until they hold few enough vectors; two blocks whose balls (a centre and the largest angle to it) are further
apart than the threshold allows never meet. A block holds as many vectors as a task can, so that a vector is sent to few
tiles. Pairs left at the end are decided by the cosine of the original vectors in double precision.

Equal vectors are compared once, for all their copies. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing. Shorter vectors count as padded with zeros. Rows that repeat a vec_id count as vectors each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import stored
from sessionlab.llm.components import connected_components
from sessionlab.llm.vectors import matrix, pair_cosines, usable_vectors

#: Least vectors in one block, bytes of the vectors of a block, and blocks that small tables are dealt to.
BLOCK, BLOCK_BYTES, LEAST_BLOCKS = 4096, 16 << 20, 6
#: Rows and columns compared at once, dimensions in one step.
ROWS, COLUMNS, STEP = 512, 4096, 16
#: Vectors that the boxes are cut by, of these the fewest in a box, and coordinates that may be cut. The choice decides which
#: vectors share a block, never which are compared.
SAMPLE, BOX_SAMPLE, LEADING = 16_384, 16, 16
_MARGIN = 1e-9


def _principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes by falling variance of the unit vectors; width^2 sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("x").to_pylist(), width)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])
    sums = classes.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(width * width)
    for r in sums.collect():
        total[r["cell"]] = r["value"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def tile_links(x: np.ndarray, z: np.ndarray, y: np.ndarray, w: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine >= threshold; z and w are the rotated unit vectors of x and y."""
    width = z.shape[1]
    suffix = lambda m: np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], 0))
    tail_z, tail_w = suffix(z), suffix(w)
    rows, columns = [], []
    for at, across in ((a, b) for a in range(0, len(z), ROWS) for b in range(0, len(w), COLUMNS)):
        part, side = slice(at, at + ROWS), slice(across, across + COLUMNS)
        step = min(STEP, width)
        so_far = z[part, :step] @ w[side, :step].T
        rest = np.outer(tail_z[part, step], tail_w[side, step]) if step < width else 0.0
        i, j = np.nonzero(so_far + rest >= threshold - _MARGIN)
        product, i, j = so_far[i, j], i + at, j + across
        while step < width and len(i):
            upto = min(step + STEP, width)
            product = product + np.einsum("ij,ij->i", z[i, step:upto], w[j, step:upto])
            step = upto
            bound = product + (tail_z[i, step] * tail_w[j, step] if step < width else 0.0)
            keep = bound >= threshold - _MARGIN
            i, j, product = i[keep], j[keep], product[keep]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            hit = pair_cosines(x[a], y[b]) >= threshold
            rows.append(a[hit])
            columns.append(b[hit])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


class Boxes:
    """Boxes of the leading coordinates with about ``size`` of ``n`` vectors each, cut by a sample; ``centres`` are unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, size: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # coordinate, value, number of the next cut or ~box on either side
        centres: list[np.ndarray] = []
        share = n / max(1, len(sample))

        def cut(z: np.ndarray) -> int:
            if len(z) * share > size and len(z) >= 2 * BOX_SAMPLE:
                axis = int(np.var(z[:, :LEADING], axis=0).argmax())
                middle = np.sort(z[:, axis])[len(z) // 4:len(z) - len(z) // 4]
                value = float(middle[np.diff(middle).argmax() + 1])  # the widest gap of the middle half keeps clusters whole
                left = z[:, axis] < value
                if left.any():
                    here = len(self.cuts)
                    self.cuts.append((axis, value, 0, 0))
                    self.cuts[here] = (axis, value, cut(z[left]), cut(z[~left]))
                    return here
            middle = z.mean(axis=0)
            norm = np.linalg.norm(middle)
            centres.append(middle / norm if norm else np.eye(1, z.shape[1])[0])
            return ~(len(centres) - 1)
        self.root = cut(sample)
        self.centres = np.array(centres)

    def of(self, z: np.ndarray) -> np.ndarray:
        """The box of each vector."""
        at = np.full(len(z), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            for k in np.unique(at[inner]).tolist():
                axis, value, left, right = self.cuts[k]
                here = inner[at[inner] == k]
                at[here] = np.where(z[here, axis] < value, left, right)
        return ~at

    def apart(self, radius: np.ndarray, reach: float) -> np.ndarray:
        """Whether no vectors of two boxes can be within the angle ``reach``; ``radius`` is the largest angle to a centre."""
        between = np.arccos(np.clip(self.centres @ self.centres.T, -1.0, 1.0))
        return between - radius[:, None] - radius[None, :] > reach


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes, the smallest index reachable over the links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_components(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links (other vectors linked directly) and component_id (smallest vec_id reachable) of each row.

    A row without a vec_id links with nothing and has no component; rows that repeat a vec_id count as one vector, which links
    by each of their embeddings.

    The number of block pairs grows with the square of the vectors, as comparing all of them must; what a task holds is
    bounded by two blocks, and what it returns are counts and a star for each of its components, never its pairs. The driver
    holds a sample and a row for each box, both bounded by SAMPLE.
    """
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    vectors = stored(usable_vectors(rows), "vectors")
    classes = vectors.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = stored(classes, "vector-classes")
    head = classes.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
    if not head["n"]:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    width = head["bytes"] // 8
    axes = _principal_axes(classes, width)

    def rotated(x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes

    some = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow().column(0).to_pylist()
    size = min(max(BLOCK, -(-head["n"] // LEAST_BLOCKS)), max(1, BLOCK_BYTES // (8 * width)))
    boxes = Boxes(rotated(matrix(some, width)), head["n"], size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = rotated(matrix(batch.column("x").to_pylist(), width))
            box = boxes.of(z)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", z, boxes.centres[box]), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box.astype(np.int32)), pa.array(angle)],
                                             [*batch.schema.names, "box", "angle"])
    dealt = stored(classes.select("vec_id", "copies", "x").mapInArrow(
        deal, "vec_id long, copies long, x binary, box int, angle double"), "dealt")
    count, radius = np.zeros(len(boxes.centres), np.int64), np.zeros(len(boxes.centres))
    for r in dealt.groupBy("box").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # at most SAMPLE / BOX_SAMPLE
        count[r["box"]], radius[r["box"]] = r["n"], r["radius"]
    # A box that holds more than a block is dealt to several, by vec_id.
    parts = np.maximum(1, -(-count // size))
    begin = np.cumsum(parts) - parts
    near = ~boxes.apart(radius, float(np.arccos(threshold)) + 1e-6) & (count[:, None] > 0) & (count[None, :] > 0)
    one, two = np.nonzero(np.triu(near))
    blocks = lambda box: F.sequence(F.col(f"begin{box}"), F.col(f"begin{box}") + F.col(f"parts{box}") - 1)
    pairs = rows.sparkSession.createDataFrame(pd.DataFrame(
        {"begin1": begin[one], "parts1": parts[one], "begin2": begin[two], "parts2": parts[two]}))
    pairs = pairs.withColumn("a", F.explode(blocks(1))).withColumn("b", F.explode(blocks(2))).where("a <= b").select("a", "b")
    sides = pairs.select(F.col("a").alias("block"), "a", "b").unionByName(
        pairs.where("a != b").select(F.col("b").alias("block"), "a", "b"))
    of_box = rows.sparkSession.createDataFrame(pd.DataFrame({"box": np.arange(len(parts)), "begin": begin, "parts": parts}))
    placed = dealt.join(F.broadcast(of_box), "box").select(  # at most SAMPLE / BOX_SAMPLE boxes
        "vec_id", "copies", "x", (F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left = (pdf["block"] == pdf["a"]).to_numpy()
        x = matrix(pdf["x"].tolist(), width)
        z = rotated(x)
        ids, copies = pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy()
        here = np.flatnonzero(left)
        there = here if left.all() else np.flatnonzero(~left)
        i, j = tile_links(x[here], z[here], x[there], z[there], threshold)
        i, j = here[i], there[j]
        if left.all():
            i, j = i[i < j], j[i < j]
        count = np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
        root = _smallest_reachable(len(ids), i, j)
        moved, linked = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(count)
        return pd.DataFrame({
            "a": np.concatenate([ids[moved], ids[linked]]),
            "b": pd.array([*ids[root[moved]].tolist(), *[None] * len(linked)], dtype="Int64"),
            "n": np.concatenate([np.zeros(len(moved)), count[linked]]).astype(np.int64)})

    found = stored(placed.join(sides, "block").groupBy("a", "b").applyInPandas(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    result = (vectors.select("vec_id", "key")
              .join(classes.select("key", F.col("vec_id").alias("rep"), "copies"), "key")
              .join(counts, "rep", "left").join(parts, "rep", "left")
              .groupBy("vec_id").agg((F.max("copies") - 1 + F.coalesce(F.max("others"), F.lit(0))).alias("n_links"),
                                     F.min(F.coalesce("component", "rep")).alias("component_id")))
    return ids.join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
