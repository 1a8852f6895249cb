"""Conversation structure repair: the cheapest edits that bring a conversation's roles into the order
``(s?(ua)+)?`` (an optional system turn, then pairs of user and assistant), found by iterative-deepening A*.

Faults. Rows of a conversation are taken by turn, nulls first; rows that share a turn by role, then by a hash of the
text. The first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier), truncated
(the last character that is not white space is none of ``.!?``). A null role or text counts as one space.

Edits, with their costs: D delete 4, I insert an empty user or assistant row 3, K keep 0, R give the row the role user or
assistant 3. Blank and duplicate rows must go; a truncated row that stays costs 3 more. The role that must come next
is always a single one but for a leading system row, so the string of edit initials determines the repair. Of the
cheapest strings the least in ASCII is taken. Only roles that begin with s, u or a can be kept.

Search. Depth first in ASCII order of the edits, under a bound on the whole cost that rises to the least cost proven
beyond it; a table holds for each (row, last role) that failed the least cost to go proven for it. The first accepting
path is the answer. The estimate counts forced deletions, truncated rows, and disjoint neighbours that can't follow each other.

Scale. A conversation may hold a third of all rows, so nothing gathers one: rows are numbered by one range sort in
which only (conversation, task) sizes are exchanged, faults are joined back from aggregates, and the search works on
blocks of ``BLOCK`` rows. A conversation of one block is solved at once; for a longer one each block is solved for every
role before it and every role after it, and the blocks' tables are combined in a tree, 32 at a time. The least string
of a pair of roles is part of the least string of the whole, as strings of equal cost over the same rows are never
prefixes of one another. Conversations with a null id form one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlab.llm.common import stored

#: Rows of one search.
BLOCK = 64
#: Block tables combined by one task row in a round.
FAN = 32
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Last role so far: none, system, user, assistant; whole conversations end with none or assistant.
STATES, ACCEPT = ".sua", (0, 3)
_NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
_EDITS = "array<struct<cost:long,audit:string>>"


class Search:
    """Iterative deepening over one block: ``roles`` has a letter per row (x: no legal role), ``faults`` one of
    ``-`` (must go), ``t`` (truncated) and ``.`` (sound)."""

    def __init__(self, roles: str, faults: str):
        self.roles, self.faults, self.n = roles, faults, len(roles)
        self.base = [0] * (self.n + 1)  # cost that no repair of the rows from here on avoids
        for i in range(self.n - 1, -1, -1):
            bad = roles[i] == "x"
            own = {"-": DELETE, "t": TRUNCATED + bad, ".": REROLE * bad}[faults[i]]
            self.base[i] = self.base[i + 1] + own
        self.solid = [i for i in range(self.n) if faults[i] != "-"]

    def _pair(self, left: int | None, right: int | None, state: int, exits: tuple[int, ...]) -> int:
        """Least extra cost if row ``right`` can't follow row ``left`` (None: the state before, or the end)."""
        roles = self.roles
        before = STATES[state] if left is None else roles[left]
        after = None if right is None else roles[right]
        if before == "x" or after == "x":
            return 0  # counted in the base
        if after is None:
            legal = STATES.index(before) in exits
        else:
            legal = before + after in (".s", ".u", "su", "ua", "au")
        if legal:
            return 0
        return 1 if any(k is not None and self.faults[k] == "t" for k in (left, right)) else 3

    def _estimates(self, exits: tuple[int, ...]) -> list[list[int]]:
        """Per state and row: base, plus the weight of disjoint neighbours that can't follow each other."""
        rows: list[int | None] = [*self.solid, None]
        m = len(self.solid)
        best = [0] * (m + 2)
        for k in range(m - 1, -1, -1):
            best[k] = max(best[k + 1], self._pair(rows[k], rows[k + 1], 0, exits) + best[min(k + 2, m)])
        first = np.searchsorted(np.array(self.solid, dtype=np.int64), np.arange(self.n + 1)).tolist()
        return [[self.base[i] + max(best[first[i]], self._pair(None, rows[first[i]], s, exits) + best[min(first[i] + 1, m)])
                 for i in range(self.n + 1)] for s in range(len(STATES))]

    def reachable(self, entry: int, state: int) -> bool:
        if state == 0:
            return entry == 0
        if state == 1:
            return entry == 1 or entry == 0 and any(self.roles[i] == "s" for i in self.solid)
        return True

    def solve(self, entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
        """(cost, edits, last state) of the cheapest way from state ``entry`` to one of ``exits``; None if there is none."""
        if not any(self.reachable(entry, e) for e in exits):
            return None
        roles, faults, n = self.roles, self.faults, self.n
        need = self._estimates(exits)
        path: list[str] = []

        def edits(i: int, s: int) -> Iterator[tuple[str, int, int, int]]:
            want = _NEXT[s]
            if i < n:
                yield "D", DELETE, i + 1, s
            yield "I", INSERT, i, STATES.index(want)
            if i < n and faults[i] != "-":
                extra = TRUNCATED if faults[i] == "t" else 0
                if roles[i] == want or roles[i] == "s" and s == 0:
                    yield "K", extra, i + 1, STATES.index(roles[i])
                yield "R", REROLE + extra, i + 1, STATES.index(want)

        def visit(i: int, s: int, left: int) -> int:
            """-1 once an accepting path is found, else the least cost to go that is proven, which is above ``left``."""
            if need[s][i] > left:
                return need[s][i]
            if i == n and s in exits:
                path.append(STATES[s])
                return -1
            least = 1 << 60
            for letter, cost, j, t in edits(i, s):
                found = visit(j, t, left - cost)
                if found < 0:
                    path.append(letter)
                    return -1
                least = min(least, found + cost)
            need[s][i] = least
            return least

        bound = need[entry][0]
        while (found := visit(0, entry, bound)) >= 0:
            bound = found
        return bound, "".join(reversed(path[1:])), STATES.index(path[0])


@dataclass(frozen=True)
class Repair:
    """``rows``: the given rows with position and fault; ``audits``: a row per conversation (conv_id, illegal, cost, audit)."""

    rows: DataFrame
    audits: DataFrame


def number_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls as one space) with ``pos`` in the conversation from 0, letter of the role, whether
    blank or open-ended, and a 128-bit mark (hi, lo) of role and text."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    marked = plain.withColumns({
        "letter": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), "blank": solid == "",
        "open": ~F.substring(solid, -1, 1).isin(".", "!", "?"), "__tie": F.monotonically_increasing_id()})
    ordered = marked.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.xxhash64("text"), "__tie").drop("__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, at = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            place, hi, lo = [], [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                at = at + 1 if held == (conv,) else 0
                held = (conv,)
                place.append(at)
                mark = xxhash.xxh3_128_intdigest(role.encode() + b"\0" + text.encode())
                hi.append((mark >> 64) - (1 << 63))
                lo.append((mark & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array([task] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "at", "hi", "lo", "task"])
    kinds = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    placed = stored(ordered.mapInArrow(run, f"{kinds}, at long, hi long, lo long, task int"), "conversation-rows")
    sizes = placed.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # Only a conversation that a task goes on with has rows before: one for each task at most.
    later = sizes.withColumn("shift", F.sum("n").over(before)).where("shift > 0").select(
        F.col("conv_id").alias("c"), F.col("task").alias("k"), "shift")
    return placed.join(F.broadcast(later), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")), "left").select(
        "conv_id", "turn", "role", "text", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"),
        "letter", "blank", "open", "hi", "lo")


def mark_faults(rows: DataFrame) -> DataFrame:
    """The rows of ``number_rows`` with ``fault``: blank, duplicate, truncated or null."""
    first = rows.groupBy("conv_id", "hi", "lo").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("hi").alias("h"), F.col("lo").alias("l"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l"))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "pos", "letter", fault.alias("fault"))


def _ways(search: Search, block: int) -> list[dict | None]:
    """The cheapest way for each pair of states (entry * 4 + exit)."""
    out: list[dict | None] = [None] * 16
    if block == 0 and search.n < BLOCK:  # the whole conversation
        cost, audit, state = search.solve(0, ACCEPT)
        out[state] = {"cost": cost, "audit": audit}
        return out
    for entry in (range(4) if block else (0,)):
        for state in range(4):
            found = search.solve(entry, (state,))
            if found:
                out[entry * 4 + state] = {"cost": found[0], "audit": found[1]}
    return out


def _chained(left: list[dict | None], right: list[dict | None]) -> list[dict | None]:
    """The ways through two blocks, one after the other."""
    out: list[dict | None] = [None] * 16
    for entry in range(4):
        for state in range(4):
            ways = [(a["cost"] + b["cost"], a["audit"] + b["audit"]) for mid in range(4)
                    if (a := left[entry * 4 + mid]) and (b := right[mid * 4 + state])]
            if ways:
                cost, audit = min(ways)
                out[entry * 4 + state] = {"cost": cost, "audit": audit}
    return out


def _illegal(letters: str) -> int:
    return sum(letters[i:i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))


_WAY = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_TABLE = f"conv_id {{}}, block long, ends string, illegal long, ways {_EDITS}"


def _solved(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, faults = batch.column("letters").to_pylist(), batch.column("faults").to_pylist()
            ways = [_ways(Search(r, f), b) for r, f, b in zip(roles, faults, batch.column("block").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array([r[0] + r[-1] for r in roles]),
                 pa.array([_illegal(r) for r in roles], pa.int64()), pa.array(ways, _WAY)],
                names=["conv_id", "block", "ends", "illegal", "ways"])
    return blocks.mapInArrow(run, _TABLE.format(dict(blocks.dtypes)["conv_id"]))


def _combined(tables: DataFrame) -> DataFrame:
    """One row for each run of ``FAN`` neighbouring blocks."""
    grouped = tables.groupBy("conv_id", F.expr(f"block div {FAN}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "ends", "illegal", "ways"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, illegal, ways = [], [], []
            for parts in batch.column("parts").to_pylist():
                now = parts[0]["ways"]
                for part in parts[1:]:
                    now = _chained(now, part["ways"])
                ends.append(parts[0]["ends"][0] + parts[-1]["ends"][1])
                illegal.append(sum(p["illegal"] for p in parts) + sum(
                    _illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(parts, parts[1:], strict=False)))
                ways.append(now)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(ends, pa.string()), pa.array(illegal, pa.int64()),
                 pa.array(ways, _WAY)], names=["conv_id", "block", "ends", "illegal", "ways"])
    return grouped.mapInArrow(run, _TABLE.format(dict(tables.dtypes)["conv_id"]))


def repair_conversations(conversations: DataFrame) -> Repair:
    """Faults and cheapest repairs of ``conversations(conv_id, turn, role, text)``; other columns are not looked at."""
    rows = stored(mark_faults(number_rows(conversations)), "conversation-faults")
    fate = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", "t").otherwise(".")
    parts = F.sort_array(F.collect_list(F.struct("pos", "letter", fate.alias("fate"))))
    blocks = rows.groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("block")).agg(parts.alias("parts")).select(
        "conv_id", "block", F.array_join("parts.letter", "").alias("letters"), F.array_join("parts.fate", "").alias("faults"))
    tables = stored(_solved(blocks), "conversation-blocks")
    # How far the longest conversation is from one row: a single number.
    while (tables.agg(F.max("block")).first()[0] or 0) > 0:
        tables = stored(_combined(tables), "conversation-blocks")
    ends = F.array_sort(F.filter(F.array(*[F.get("ways", F.lit(s)) for s in ACCEPT]), lambda w: w.isNotNull()))
    final = tables.withColumn("way", F.get(ends, F.lit(0)))
    return Repair(rows, final.select("conv_id", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit")))


def repaired_rows(repair: Repair) -> DataFrame:
    """conv_id, place (order in the repaired conversation), turn, role, text and edit (K, R or I) of all rows that remain.

    Inserted rows have no turn and an empty text. The edits meet the rows by conversation and position.
    """
    kind = dict(repair.rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit in zip(batch.column("conv_id"), batch.column("audit").to_pylist(), strict=True):
                for start in _steps(audit, 1 << 16):
                    place, pos, role, edit = (list(x) for x in zip(*start, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv.as_py()] * len(place), batch.schema.field("conv_id").type), pa.array(place, pa.int64()),
                         pa.array(pos, pa.int64()), pa.array(role, pa.string()), pa.array(edit, pa.string())],
                        names=["c", "place", "p", "given", "edit"])
    edits = repair.audits.select("conv_id", "audit").mapInArrow(run, f"c {kind}, place long, p long, given string, edit string")
    edits = stored(edits, "conversation-edits")
    met = repair.rows.join(edits.where("edit <> 'I'"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p"))).select(
        "conv_id", "place", "turn", F.when(F.col("edit") == "R", F.col("given")).otherwise(F.col("role")).alias("role"), "text", "edit")
    return met.unionByName(edits.where("edit = 'I'").select(
        F.col("c").alias("conv_id"), "place", F.lit(None).cast(dict(repair.rows.dtypes)["turn"]).alias("turn"),
        F.col("given").alias("role"), F.lit("").alias("text"), "edit"))


def _steps(audit: str, size: int) -> Iterator[list[tuple[int, int | None, str, str]]]:
    """(place, position of the row, role by the order of roles, edit) of each edit but deletions, in pieces of ``size``."""
    left = len(audit) - audit.count("D")
    system, place, pos = left % 2, 0, 0
    out: list[tuple[int, int | None, str, str]] = []
    for edit in audit:
        if edit != "D":
            role = "system" if place < system else "assistant" if (place - system) % 2 else "user"
            out.append((place, None if edit == "I" else pos, role, edit))
            place += 1
        pos += edit != "I"
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def digest_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """``key`` and ``sha256`` (lowercase hex of its lines, in order, joined by line feeds).

    A digest is one sequential pass, so the lines of a key stream through one task, sorted on disk and never gathered.
    """
    kind = dict(lines.dtypes)[key]
    dealt = lines.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(line).alias("l")).repartition("k").sortWithinPartitions("k", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        digest = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], kind_of), pa.array([digest.hexdigest()])], names=[key, "sha256"])
        for batch in batches:
            kind_of = batch.schema.field("k").type
            for k, text in zip(batch.column("k").to_pylist(), batch.column("l").to_pylist(), strict=True):
                if held == (k,):
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield closed()
                    held, digest = (k,), hashlib.sha256()
                digest.update(text.encode())
        if digest is not None:
            yield closed()
    return dealt.select("k", "l").mapInArrow(run, f"{key} {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with one of five faults planted by crc32 of ``conv_id:turn``, modulo 20: 0 drops the
    row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    space = F.lit(" ")
    mark = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(mark.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.withColumn("__kind", kind).where("__kind <> 0").withColumn(
        "__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))


def repair_report(conversations: DataFrame, broken: DataFrame) -> DataFrame:
    """Per conv_id of ``conversations``: gaps, faults, illegal neighbours, cost and edits of the repair of ``broken``, and a
    digest of the repaired conversation. A conversation without rows in ``broken`` has zeros and empty texts."""
    repair = repair_conversations(broken)
    counts = {f: F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")}
    turns = repair.rows.groupBy("conv_id", "turn").agg(*counts.values())
    spread = turns.groupBy("conv_id").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count("turn")).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in counts])
    lines = repaired_rows(repair).select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    sides = {"t": spread, "a": repair.audits, "d": digest_lines(lines, "conv_id", "place", "line")}
    out = conversations.select("conv_id").distinct()
    for name, side in sides.items():
        side = side.withColumnRenamed("conv_id", f"__{name}")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts, "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
