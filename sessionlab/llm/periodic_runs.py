"""Periodic run detection: stretches of words that repeat with a short period, many times over.

A run of smallest period q qualifies with a length of at least ``max(least, times * q)``, so each of its words occurs
at least ``times`` times in it. Recursive frequency splitting: a word that occurs less often within its segment can
belong to no qualifying run, so it splits the segment; the parts are counted again until nothing splits. What survives
is scanned lag by lag: short lags directly, long ones from a grid of windows (a run of period q in [Q, 2Q) and length
4q holds a window of Q words that starts at a multiple of Q and recurs q words later). Lags are always confirmed word
by word, and a lag whose stretch has a smaller period, which divides it, is left out. Every text is taken whole.

Words are maximal runs without ASCII white space, compared as bytes. Null and empty texts have no words and no runs.
Each row stands for itself: null and repeated ids do not matter. All columns are kept; ``runs`` and ``collapsed`` are
replaced if they exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionlab.llm.common import chunks, mix, powers, range_hash, texts, widened

#: A qualifying run has at least ``LEAST`` words and ``TIMES`` periods.
LEAST, TIMES = 6, 4
#: Lags below are scanned directly, those from here on through the grid.
GRID_FROM = 32
_RUN = "array<struct<start:long,length:long,period:long>>"
_U = np.uint64


def frequency_split(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Segments [start, end) in which every word occurs ``times`` times or more, by recursive splitting.

    ``words`` holds the word numbers of many texts end to end, ``bounds`` where they begin and end. All open segments
    are counted together in each step; a segment that loses no word is done.
    """
    start, end = bounds[:-1], bounds[1:]
    done: list[tuple[int, int]] = []
    while True:
        long = end - start >= least
        start, end = start[long], end[long]
        if not len(start):
            return sorted(done)
        sizes = end - start
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) + np.repeat(start - first, sizes)
        segment = np.repeat(np.arange(len(start)), sizes)
        _, key, count = np.unique(segment * (int(words.max()) + 1) + words[place], return_inverse=True, return_counts=True)
        rare = count[key] < times
        losing = np.bincount(segment[rare], minlength=len(start)) > 0
        done += zip(start[~losing].tolist(), end[~losing].tolist(), strict=True)
        kept = ~rare & losing[segment]
        place, segment = place[kept], segment[kept]
        if not len(place):
            return sorted(done)
        new = np.flatnonzero((np.diff(place) != 1) | (np.diff(segment) != 0)) + 1
        cuts = np.concatenate(([0], new, [len(place)]))
        start, end = place[cuts[:-1]], place[cuts[1:] - 1] + 1


def _smaller_period(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether x[start:end], of period q and at least 2q long, has a smaller period; it then has one that divides q."""
    rest, r = q, 2
    while rest > 1:
        if rest % r:
            r = r + 1 if r * r <= rest else rest
            continue
        while rest % r == 0:
            rest //= r
        d = q // r
        if np.array_equal(x[start:end - d], x[start + d:end]):
            return True
    return False


def _matching(x: np.ndarray, i: int, q: int) -> int:
    """How many words from i on equal those q later."""
    n, step, at = len(x) - q, 64, i
    while at < n:
        stop = min(at + step, n)
        differ = x[at:stop] != x[at + q:stop + q]
        if differ.any():
            return at + int(differ.argmax()) - i
        at, step = stop, step * 4
    return max(0, n - i)


def _grid_runs(x: np.ndarray, known: list[tuple[int, int, int]], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of qualifying runs with a period of GRID_FROM or more; ``known`` has those with smaller ones."""
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + _U(1)) * powers("up", _U(0x9E3779B97F4A7C15), len(x)), out=total[1:])
    back = x[::-1]
    known, width = list(known), GRID_FROM
    while times * width <= len(x):
        begin = np.arange(len(x) - width + 1)
        marks = range_hash(total, begin, begin + width)
        grid = np.arange(0, len(marks) - width, width)
        wide = [(s, e) for s, e, _ in known if e - s >= 2 * width]
        lag = width + np.arange(width)
        found: dict[int, int] = {}
        for rows in np.array_split(grid, len(grid) * width // 4_000_000 + 1):
            at = rows[:, None] + lag[None, :]
            p, k = np.nonzero((marks[np.minimum(at, len(marks) - 1)] == marks[rows][:, None]) & (at < len(marks)))
            p, q_of = rows[p], lag[k]
            for s, e in wide:  # inside a run of a smaller period, only multiples of it can match
                outside = (p < s) | (p + q_of + width > e)
                p, q_of = p[outside], q_of[outside]
            for i, q in zip(p.tolist(), q_of.tolist(), strict=True):
                if i + width + q <= found.get(q, 0):
                    continue
                s = i - _matching(back, len(x) - i - q, q)
                e = i + _matching(x, i, q) + q
                found[q] = max(found.get(q, 0), e)
                if e - s >= max(least, times * q) and not _smaller_period(x, s, e, q):
                    known.append((s, e, q))
                    yield s, e, q
        width *= 2


def segment_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of all qualifying runs in one surviving segment, by lag scan."""
    found = []
    for q in range(1, min(GRID_FROM - 1, len(x) // times) + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        s, e = edge[::2], edge[1::2] + q
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            if b - a >= max(least, times * q) and not _smaller_period(x, a, b, q):
                found.append((a, b, q))
    if len(x) >= times * GRID_FROM:
        found += _grid_runs(x, found, least, times)
    return found


def text_runs(bodies: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Per text, given as words: its runs (start, length, period) by start, then period."""
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
    if bounds[-1]:
        flat = np.empty(int(bounds[-1]), dtype=object)
        flat[:] = [w for b in bodies for w in b]
        words = pd.factorize(flat)[0].astype(np.int64)
        for s, e in frequency_split(words, bounds, least, times):
            row = int(np.searchsorted(bounds, s, side="right")) - 1
            out[row] += [(s + a - int(bounds[row]), b - a, q) for a, b, q in segment_runs(words[s:e], least, times)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words) and ``collapsed``: the text with each run reduced to its
    first period, words joined by single spaces (empty if there are none)."""
    docs = docs.drop("runs", "collapsed")
    if times < 4:
        raise ValueError("the scan of long lags needs runs of at least four periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bodies = [t.encode().split() for t in texts(batch.column("text"))]  # splits at ASCII white space only
            found = text_runs(bodies, least, times)
            kept = [b" ".join(collapse(b, r)).decode() for b, r in zip(bodies, found, strict=True)]
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind), pa.array(kept, pa.string())],
                                             names=[*batch.schema.names, "runs", "collapsed"])
    return docs.mapInArrow(run, widened(widened(docs.schema, "runs", _RUN), "collapsed", "string"))
