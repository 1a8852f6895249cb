"""Best-fit packing of documents into sequences of bounded length, by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the numbers of pieces of each length (at most ``capacity`` counts,
whatever the input) describe the problem in full. Large lengths are rounded up within groups of equal cardinality; a
linear program over the configurations of these few sizes, by column generation, says how often to use each; the actual
lengths of a group take the places of its rounded size; what is left, and all small lengths, goes where it fits best.
The plan gives each piece its sequence and offset from the piece's rank among those of its length, and the rank comes
from counts per writing task, so no group of equal lengths is ever gathered.

Pieces of length 0 are refused (a document always has its end id); an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlab.llm.common import chunks, stored, widened
from sessionlab.llm.word_tokens import encode_texts

CAPACITY = 2048
#: Groups of large lengths, and the shares of the capacity above which lengths count as large: each is tried, smaller
#: lengths being left to best fit, and the plan with the fewest sequences is used.
GROUPS = 32
LARGE = (1 / 8, 1 / 4, 1 / 2)


@dataclass
class Bins:
    """``count`` alike sequences from number ``first`` on, with ``room`` left."""

    count: int
    room: int
    first: int


@dataclass
class Plan:
    """Rows (length, rank from, per sequence, first sequence, offset): pieces of a length by rank, ``per`` to a sequence."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, bins: Bins, count: int, per: int) -> None:
        """The next ``count * per`` pieces of a length go to ``count`` sequences of ``bins``, side by side."""
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, per, bins.first, self.capacity - bins.room))
        self.used[length] = rank + count * per

    def open(self, count: int) -> Bins:
        bins = Bins(count, self.capacity, self.sequences)
        self.sequences += count
        return bins


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Multisets of sizes that fit, and how often to use each: the linear program's solution, rounded down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))  # columns: so many of one size
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for _ in range(40 * m):
        price = inverse.sum(axis=0)  # every configuration costs one sequence
        value, best = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            gain = value[c - sizes[fits]] + price[fits]
            k = int(np.argmax(gain))
            if gain[k] > value[c - 1] + 1e-12:
                value[c], best[c] = gain[k], fits[k]
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if best[c] < 0:
                c -= 1
            else:
                column[best[c]] += 1
                c -= sizes[best[c]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        amount -= ratio[out] * direction
        amount[out] = ratio[out]
        basis[:, out] = column
        inverse[out] /= direction[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(direction[rest], inverse[out])
    return [(basis[:, k].astype(int), int(np.floor(amount[k] + 1e-9))) for k in range(m) if amount[k] >= 1 - 1e-9]


def _best_fit(plan: Plan, left: dict[int, int], bins: list[Bins]) -> None:
    """Pieces, longest first, go to the sequences with the least room that holds them; new ones are opened at the end."""
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    for length in sorted(left, reverse=True):
        n = left[length]
        room = length
        while n:
            while room <= plan.capacity and not by_room.get(room):
                room += 1
            if room > plan.capacity:
                per = plan.capacity // length
                b = plan.open(-(-n // per))
            else:
                b = by_room[room].pop()
            per = b.room // length
            whole = min(b.count, n // per)
            if whole:  # full use of so many; the others keep their room
                used = Bins(whole, b.room, b.first)
                plan.put(length, used, whole, per)
                n -= whole * per
                by_room.setdefault(used.room - per * length, []).append(Bins(whole, used.room - per * length, used.first))
            rest = b.count - whole
            if rest and n and n < per:
                last = Bins(1, b.room, b.first + whole)
                plan.put(length, last, 1, n)
                by_room.setdefault(last.room - n * length, []).append(Bins(1, last.room - n * length, last.first))
                whole, rest, n = whole + 1, rest - 1, 0
            if rest:
                by_room.setdefault(b.room, []).append(Bins(rest, b.room, b.first + whole))


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
                 share: float = LARGE[0]) -> Plan:
    """Sequences for ``counts`` (pieces by length)."""
    plan, left = Plan(capacity), {k: n for k, n in counts.items() if n}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    full = left.pop(capacity, 0)
    if full:
        plan.put(capacity, plan.open(full), full, 1)
    large = sorted((k for k in left if k > capacity * share), reverse=True)
    bins: list[Bins] = []
    if large:
        # Equal-cardinality groups of the pieces in order of length; a group's rounded size is its longest.
        total, queue, group_of, seen = sum(left[k] for k in large), [], {}, 0
        for k in large:
            g = seen * groups // total
            if not queue or g != group_of["last"]:
                queue.append([])
                group_of["last"] = g
            queue[-1].append([k, left[k]])
            seen += left[k]
        sizes = np.array([q[0][0] for q in queue])
        demand = np.array([float(sum(n for _, n in q)) for q in queue])
        for config, times in _configurations(sizes, demand, capacity):
            parts = [plan.open(times)] if times else []
            for g in np.flatnonzero(config).tolist():
                for _ in range(int(config[g])):
                    done: list[Bins] = []
                    for b in parts:  # actual lengths, longest first, take the places of the rounded size
                        while b.count and queue[g]:
                            k, n = queue[g][0]
                            take = min(n, b.count)
                            used = Bins(take, b.room, b.first)
                            plan.put(k, used, take, 1)
                            left[k] -= take
                            done.append(Bins(take, b.room - k, b.first))
                            b = Bins(b.count - take, b.room, b.first + take)
                            queue[g][0][1] -= take
                            if not queue[g][0][1]:
                                queue[g].pop(0)
                        if b.count:
                            done.append(b)
                    parts = done
            bins += parts
    _best_fit(plan, {k: n for k, n in left.items() if n}, bins)
    return plan


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences over the shares; none can have fewer than all tokens over the capacity."""
    least, best = -(-sum(k * n for k, n in counts.items()) // capacity), None
    for share in LARGE:
        plan = plan_lengths(counts, capacity, GROUPS, share)
        best = plan if best is None or plan.sequences < best.sequences else best
        if best.sequences == least:
            break
    return best


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of every document: its ids and a closing 0, cut at the capacity.

    ``ids`` holds little-endian unsigned 32-bit integers. ``tokenizer`` is a file name of the public tokenizers or a path.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers
            path = public_tokenizers.path(tokenizer)
        for batch in chunks(batches, "text"):
            cells: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                encode_texts(batch.column("text"), path, b"\0\0\0\0"), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    cells.append((doc, k, at // 4, len(part) // 4, part))
            columns = list(zip(*cells, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every sequence is filled from 0 without gaps.

    Needs ``length``; other columns are kept, those named sequence_id or offset replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task number, and rank of each piece among the task's pieces of its length."""
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
            rank = np.empty(len(by), dtype=np.int64)
            rank[order] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
            rank += seen[length]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(by), task, np.int32)), pa.array(rank)],
                                             names=[*batch.schema.names, "__task", "__rank"])

    written = stored(pieces.mapInArrow(ranked, widened(widened(pieces.schema, "__task", "int"), "__rank", "long")), "pieces")
    per_task = written.groupBy("length", "__task").agg(F.count("*").alias("__n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_task.select("length", "__task", F.coalesce(before, F.lit(0)).alias("__before"))
    plan = np.array(sorted(best_plan(counts, capacity).rows), dtype=np.int64).reshape(-1, 5)
    key = plan[:, 0] * (1 << 48) + plan[:, 1]  # in order of length, then rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy() + batch.column("__before").to_numpy()
            row = plan[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            batch = batch.drop_columns(["__task", "__rank", "__before"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=[*batch.schema.names, "sequence_id", "offset"])

    joined = written.join(offsets, ["length", "__task"]).select(*pieces.columns, "__task", "__rank", "__before")
    return joined.mapInArrow(place, widened(widened(pieces.schema, "sequence_id", "long"), "offset", "long"))
