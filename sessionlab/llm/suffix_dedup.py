"""Removal of byte strings that occur before, by hash-compared suffix sorting.

Every byte covered by a string of SPAN bytes that also starts in a document with a smaller doc_id is removed.

Finding what to sort. In each text the gram with the smallest hash of every SPAN-byte window is an anchor. Two equal
windows have the same anchor at the same place, so only documents that share an anchor can share a window, and only the
windows around shared anchors are sorted: rows that meet under an anchor are streamed in order of doc_id, never gathered.

Frequent anchors. An anchor with more than HOT_ROWS rows is not left to one task: its rows are dealt by the bytes around it, and
where these differ, by single windows. Bytes that are frequent themselves are known from a sample of the documents, with a
document that holds them: rows of larger documents are covered by it and need not meet, so only the few smaller ones do.

Sorting. The suffixes at these windows are sorted by merging: prefix polynomial hashes and a binary search give the
common extension of two suffixes, so one comparison takes the logarithm of SPAN steps. Neighbours that agree over SPAN
bytes by hash are compared byte by byte before they count as equal.

Texts are UTF-8 bytes, null is empty; equal texts are settled by their digest; matches never cross documents. Rows that
repeat a doc_id with the same text are alike; doc_id is expected to identify a text otherwise. A row without a doc_id has no place in the order: it is
kept whole and covers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import chunks, flat_bytes, mix, powers, prefix_hash, range_hash, release, stored, widened
from sessionlab.llm.common import _BASE_INVERSE

SPAN = 50
GRAM = 16
#: Anchor rows that are sorted together; a larger group is worked off in slices of this size.
BLOCK = 20_000
#: Rows of an anchor above which they are dealt to many tasks, and of how many documents one is looked at to find such anchors.
#: Neither changes the result.
HOT_ROWS = 20_000
SAMPLE = 16
#: Bytes of text that one step turns into arrays: few enough for them to stay in the processor's cache.
CHUNK = 1 << 18
_U = np.uint64


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + width] for every i with a full window, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def anchors_of(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors in concatenated rows: place, hash, first and last start of the windows that each is smallest in, and the
    hash of all bytes of these windows."""
    width, n = span - gram + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    prefix = prefix_hash(data)
    down = powers("down", _BASE_INVERSE, n)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1] + _U(gram)) | _U(1)
    least = _sliding(hashes, width, np.minimum)  # by window start
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(begin, end - span + 1):end] = 0  # windows that would leave their row
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    best = _sliding(padded, width, np.maximum)  # largest minimum of the windows that hold a gram
    at = np.flatnonzero(hashes == best)
    values = hashes[at]
    # Windows side by side with one minimum belong to its first gram in them, and to the next one where that falls out.
    edge = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    first, last, want = edge, np.append(edge[1:], len(least)) - 1, least[edge]
    first, last, want = first[want > 0], last[want > 0], want[want > 0]
    parts = []
    while len(first):
        owner = np.searchsorted(at, first)
        while (wrong := values[owner] != want).any():
            owner[wrong] += 1
        until = np.minimum(last, at[owner])
        parts.append((owner, first, until))
        more = until < last
        first, last, want = until[more] + 1, last[more], want[more]
    owner, first, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none)
    order = np.argsort(owner, kind="stable")
    owner, first, last = owner[order], first[order], last[order]
    return at[owner], values[owner], first, last, range_hash(prefix, first, last + span)


def _suffix_less(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffix a comes before suffix b within ``depth`` bytes, and their common extension, for arrays of both."""
    down = powers("down", _BASE_INVERSE, len(prefix))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), depth, np.int64)
    from_a, from_b, scale_a, scale_b = prefix[a], prefix[b], down[a], down[b]
    for _ in range(int(depth).bit_length()):
        middle = (low + high + 1) >> 1
        same = (prefix[a + middle] - from_a) * scale_a == (prefix[b + middle] - from_b) * scale_b
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    at = np.minimum(low, depth - 1)
    return (low < depth) & (data[a + at] < data[b + at]), low


def _merged(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, klass: np.ndarray, depth: int) -> np.ndarray:
    """Order of different suffixes that come sorted by ``klass``, the class of their first bytes: within a class, sorted runs
    of 1, 2, 4, .. are merged. A suffix's place is its own rank plus its rank in the neighbouring run, found by binary search
    with hash comparisons."""
    n = len(starts)
    order = np.arange(n)
    edge = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
    size = np.diff(np.append(edge, n))
    begin, length = np.repeat(edge, size), np.repeat(size, size)  # of each place's class
    run = 1
    while run < size.max():
        todo = np.flatnonzero(length > run)
        rank = todo - begin[todo]
        block = rank // run
        mate = begin[todo] + (block ^ 1) * run
        stop = np.minimum(mate + run, begin[todo] + length[todo])
        mate = np.minimum(mate, stop)
        low, high = mate.copy(), stop.copy()
        own = starts[order[todo]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            ahead, _ = _suffix_less(data, prefix, starts[order[middle]], own[open_], depth)
            low[open_] = np.where(ahead, middle + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], middle)
        place = begin[todo] + (block - (block & 1)) * run + rank % run + (low - mate)
        fresh = order.copy()
        fresh[place] = order[todo]
        order = fresh
        run *= 2
    return order


def suffix_sort(data: np.ndarray, starts: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and whether each equals the one before it.

    Copies are brought together by the hash of all ``depth`` bytes and one of each is sorted: dealt by its first bytes, and
    by merging where these are alike.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    prefix = prefix_hash(data)
    whole = (prefix[starts + depth] - prefix[starts]) * powers("down", _BASE_INVERSE, len(prefix))[starts]
    order = np.argsort(whole)
    whole = whole[order]
    heads = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
    copies = np.diff(np.append(heads, n))
    lone = starts[order[heads]]
    ranked, klass = np.arange(len(lone)), np.zeros(len(lone), dtype=np.uint64)
    for at in range(0, min(16, depth - 7), 8):  # by eight bytes, then by the class so far and as many bytes as fit beside it
        key = np.zeros(len(lone), dtype=np.uint64)
        for k in range(at, at + 8):
            key = key << _U(8) | data[lone[ranked] + k].astype(np.uint64)
        room = _U(int(klass[-1]).bit_length())
        if room:
            key = klass << (_U(64) - room) | key >> room
        by = np.argsort(key)
        ranked, key = ranked[by], key[by]
        klass = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))).astype(np.uint64)
    ranked = ranked[_merged(data, prefix, lone[ranked], klass, depth)]
    many = copies[ranked]
    ahead = np.cumsum(many) - many
    order = order[np.repeat(heads[ranked] - ahead, many) + np.arange(n)]
    equal = np.ones(n, dtype=bool)
    equal[ahead] = False
    same = np.flatnonzero(equal)
    reach = np.arange(depth)
    for at in range(0, len(same), 1 << 14):  # collisions are ruled out by the bytes themselves
        part = same[at:at + (1 << 14)]
        equal[part] = (data[starts[order[part - 1]][:, None] + reach] == data[starts[order[part]][:, None] + reach]).all(axis=1)
    return order, equal


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by ``__packed``, compressed for the shuffle."""
    schema = widened(docs.drop("text").schema, "__packed", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in chunks(batches, "text"):
            packed = [None if t is None else press(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rest = batch.select(schema.names[:-1])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(packed, pa.binary())], names=schema.names)
    return docs.select(*[F.col(f"`{n}`") for n in schema.names[:-1]], "text").mapInArrow(run, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``__packed`` turned back into ``text`` (binary), a few rows at a time."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in chunks(batches, "__packed", CHUNK // 2):
        at = batch.schema.get_field_index("__packed")
        yield batch.set_column(at, "text", pa.array([None if p is None else open_(p) for p in batch.column(at).to_pylist()], pa.binary()))


@dataclass(frozen=True)
class Frequent:
    """Anchors above the row limit (sorted); frequent contents with their anchor and a document that holds them (sorted by
    content); frequent windows of these anchors (sorted by hash) with a document that holds them."""

    anchors: np.ndarray
    contents: np.ndarray
    owners: np.ndarray
    holders: np.ndarray
    window_marks: np.ndarray
    window_bytes: np.ndarray
    window_holders: np.ndarray

    def hot(self, anchor: np.ndarray) -> np.ndarray:
        return _found_in(self.anchors, anchor)[0]

    def told(self, anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows whose content a smaller document is known to hold."""
        known, at = _found_in(self.contents, content)
        if not len(self.contents):
            return known
        return known & (self.owners[at] == anchor) & (self.holders[at] < doc)


def _found_in(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is in the sorted ``values``, and where."""
    if not len(values):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return values[at] == wanted, at


def _frequent(docs: DataFrame) -> Broadcast[Frequent]:
    """What is frequent, from a sample of the documents. At most one in HOT_ROWS anchor rows comes to the driver, with its windows."""
    context = docs.sparkSession.sparkContext
    nothing = np.zeros(0, np.int64)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    plain = context.broadcast(Frequent(nothing, nothing, nothing, nothing, nothing, np.zeros((0, SPAN), np.uint8), nothing))
    seen = stored(_anchor_rows(some, plain).groupBy("anchor", "content").agg(
        F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n")), "sampled")
    limit = HOT_ROWS // SAMPLE
    anchors = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("anchor").toArrow()
    anchors = np.sort(anchors.column(0).to_numpy())
    if not len(anchors):
        return plain
    contents = seen.where(F.col("n") > limit).select("content", "anchor", "holder").orderBy("content").toArrow()
    hot = context.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            data, offsets = flat_bytes(batch.column("text"))
            _, hashes, first, last, _ = anchors_of(data, offsets)
            row = np.searchsorted(offsets, first, side="right") - 1
            keep = np.flatnonzero(_found_in(hot.value, hashes.view(np.int64))[0])
            many = (last - first + 1)[keep]
            begin = np.repeat(first[keep], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            ids = np.repeat(batch.column("doc_id").to_numpy()[row[keep]], many)
            yield pa.RecordBatch.from_arrays(
                [pa.array([data[a:a + SPAN].tobytes() for a in begin.tolist()], pa.binary()), pa.array(ids)], names=["window", "doc_id"])

    windows = some.mapInArrow(run, "window binary, doc_id long").groupBy("window").agg(
        F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).toArrow()
    body = np.frombuffer(b"".join(windows.column(0).to_pylist()), dtype=np.uint8).reshape(-1, SPAN)
    begin = np.arange(0, body.size, SPAN)
    marks = range_hash(prefix_hash(body.ravel()), begin, begin + SPAN).view(np.int64)
    order = np.argsort(marks, kind="stable")
    return context.broadcast(Frequent(
        anchors, *(contents.column(k).to_numpy() for k in range(3)), marks[order], body[order], windows.column(1).to_numpy()[order]))


#: How a row of an anchor is dealt: with all others of its anchor, with those of its content, or alone as it is known to be covered.
PLAIN, BY_CONTENT, TOLD = range(3)


def _anchor_rows(docs: DataFrame, frequent: Broadcast[Frequent]) -> DataFrame:
    """(anchor, content, doc_id, start, size, way, spread) of each text: an anchor's hash, and the bytes of its windows by hash,
    place and length; rows are dealt by anchor and spread. A text whose like with a smaller doc_id the task has met is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in chunks(batches, "text", CHUNK):
            data, offsets = flat_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(ids), dtype=bool)
            for k, doc in enumerate(ids.tolist()):
                mark = xxhash.xxh3_128_digest(data[offsets[k]:offsets[k + 1]])
                fresh[k] = doc < seen.get(mark, doc + 1)
                if fresh[k]:
                    seen[mark] = doc
            _, hashes, first, last, content = anchors_of(data, offsets)
            row = np.searchsorted(offsets, first, side="right") - 1
            keep = fresh[row]
            row, first = row[keep], first[keep]
            anchor, content, doc = hashes[keep].view(np.int64), content[keep].view(np.int64), ids[row]
            told = frequent.value.told(anchor, content, doc)
            way = np.where(told, TOLD, np.where(frequent.value.hot(anchor), BY_CONTENT, PLAIN)).astype(np.int8)
            spread = np.choose(way, [np.int64(0), content, doc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(content), pa.array(doc), pa.array(first - offsets[row]),
                 pa.array((last[keep] + SPAN - first).astype(np.int32)), pa.array(way), pa.array(spread)],
                names=["anchor", "content", "doc_id", "start", "size", "way", "spread"])
    return docs.mapInArrow(run, "anchor long, content long, doc_id long, start long, size int, way tinyint, spread long")


def _met(rows: DataFrame) -> DataFrame:
    """(doc_id, start, end) from rows sorted by anchor, content and doc_id. Bytes that a smaller document holds around the
    same anchor are covered; where an anchor has several contents, the first row of each is to be compared window by
    window and comes with a null end. Other contents of an anchor dealt by content lie elsewhere: it counts as having several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mixed = None, None  # first rows that wait for more of their anchor; the last anchor known to be mixed
        for batch in batches:
            way = batch.column(5).to_numpy()
            if (way == TOLD).any():
                known = batch.filter(pa.array(way == TOLD))
                end = known.column(3).to_numpy() + known.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), pa.array(end)], ["doc_id", "start", "end"])
                batch = batch.filter(pa.array(way != TOLD))
            cells = [batch.column(k).to_numpy() for k in range(6)] + [np.zeros(batch.num_rows, dtype=bool)]
            if held is not None:
                cells = [np.concatenate(x) for x in zip(held, cells, strict=True)]
            anchor, content, doc, start, size, way, told = cells
            n = len(anchor)
            if not n:
                continue
            group = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            part = group | np.concatenate(([True], content[1:] != content[:-1]))
            least = doc[np.flatnonzero(part)][np.cumsum(part) - 1]
            number = np.cumsum(group) - 1
            many = (np.bincount(number, part) > 1) | (way[np.flatnonzero(group)] == BY_CONTENT)
            many[0] |= mixed is not None and mixed == anchor[0]
            lone = (doc == least) & ~told
            wait = lone & ~many[number] & (number == number[-1])
            again, ask = doc > least, lone & many[number]
            mixed = anchor[-1] if many[-1] else None
            keep = np.flatnonzero(wait)
            if many[-1]:  # only the smallest document of the last content is still needed
                keep = np.flatnonzero(part)[-1:]
                told = np.ones(n, dtype=bool)
            held = [x[keep].copy() for x in (anchor, content, doc, start, size, way, told)]
            pick = np.concatenate([np.flatnonzero(again), np.flatnonzero(ask)])
            end = pa.array(start[pick] + size[pick], mask=np.arange(len(pick)) >= int(again.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[pick]), pa.array(start[pick]), end], ["doc_id", "start", "end"])
    return rows.mapInArrow(run, "doc_id long, start long, end long")


def _window_bytes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The SPAN bytes from each place on, a row each."""
    return np.lib.stride_tricks.sliding_window_view(data, SPAN)[begin] if len(begin) else np.zeros((0, SPAN), np.uint8)


def _binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a byte matrix."""
    ends = np.arange(0, rows.size + 1, SPAN, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _windows(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray,
             frequent: Frequent, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``_contexts`` for each window of frequent anchors, which begin at first to last; runs of windows that a smaller
    document is known to hold are one row."""
    many = last - first + 1
    owner = np.repeat(np.arange(len(first)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = first[owner] + nth
    body = _window_bytes(data, begin)
    mark = range_hash(prefix_hash(data), begin, begin + SPAN).view(np.int64)
    known, at = _found_in(frequent.window_marks, mark)
    told = np.zeros(len(mark), dtype=bool)
    some = np.flatnonzero(known)
    told[some] = (frequent.window_bytes[at[some]] == body[some]).all(axis=1) & (frequent.window_holders[at[some]] < doc[owner[some]])
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))[:len(owner)]
    opens = told & (edge | ~np.concatenate(([False], told[:-1])))
    closes = told & (np.append(edge[1:], True) | ~np.append(told[1:], False))
    run, upto = owner[opens], nth[closes] + SPAN
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor[run]), pa.array(doc[run]), pa.array(doc[run]), pa.array(start[run] + nth[opens]),
         pa.nulls(len(run), pa.binary()), pa.array(start[run] + upto)], names=kind.names)
    rest = np.flatnonzero(~told)
    own = owner[rest]
    yield pa.RecordBatch.from_arrays(
        [pa.array(anchor[own]), pa.array(mark[rest] | 1), pa.array(doc[own]), pa.array(start[own] + nth[rest]),
         _binary_rows(body[rest]), pa.nulls(len(rest), pa.int64())], names=kind.names)


def _contexts(found: DataFrame, frequent: Broadcast[Frequent]) -> DataFrame:
    """(anchor, spread, doc_id, start, bytes, end): all bytes of the windows of the anchors that begin at ``starts`` of a text; those of
    frequent anchors window by window, with an odd spread. With an end the bytes are known to be covered. Rows are dealt by anchor
    and spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            data, offsets = flat_bytes(batch.column("text"))
            _, hashes, first, last, _ = anchors_of(data, offsets)
            row = np.searchsorted(offsets, first, side="right") - 1
            wanted = batch.column("starts")
            counts = np.diff(wanted.offsets.to_numpy())
            want = wanted.flatten().to_numpy() + np.repeat(offsets[:-1], counts)
            keep = np.flatnonzero(np.isin(first, want))
            ids = batch.column("doc_id").to_numpy()
            anchor, doc, start = hashes[keep].view(np.int64), ids[row[keep]], (first - offsets[row])[keep]
            hot = frequent.value.hot(anchor)
            rest = np.flatnonzero(~hot)
            parts = [data[a:b].tobytes() for a, b in zip(first[keep[rest]].tolist(), (last[keep[rest]] + SPAN).tolist(), strict=True)]
            none = pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[rest]), pa.array(np.zeros(len(rest), np.int64)), pa.array(doc[rest]), pa.array(start[rest]),
                 pa.array(parts, pa.binary()), none], names=kind.names)
            hot = np.flatnonzero(hot)
            if len(hot):
                pick = keep[hot]
                yield from _windows(data, first[pick], last[pick], anchor[hot], doc[hot], start[hot], frequent.value, kind)
    kind = pa.schema([("anchor", pa.int64()), ("spread", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                      ("bytes", pa.binary()), ("end", pa.int64())])
    return found.mapInArrow(run, "anchor long, spread long, doc_id long, start long, bytes binary, end long")


def _block_spans(doc: np.ndarray, start: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, ...]:
    """(doc_id, start, end) covered in one block of rows sorted by anchor and doc_id, and the rows first with their bytes."""
    coded = parts.dictionary_encode()  # codes by first appearance
    codes = coded.indices.to_numpy()
    lone = np.unique(codes, return_index=True)[1]
    first = lone[codes]
    body, ends = flat_bytes(coded.dictionary)
    data, sizes = np.append(body, np.uint8(0)), np.diff(ends)
    windows = sizes - SPAN + 1
    base = ends[:-1]
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner = np.repeat(np.arange(len(lone)), windows)
    order, equal = suffix_sort(data, base[owner] + nth)
    klass = np.cumsum(~equal) - 1
    docs = doc[lone][owner]
    least = np.full(klass[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, klass, docs[order])
    before = np.empty(len(order), dtype=bool)
    before[order] = least[klass] < docs[order]  # a window of these bytes lies in a smaller document
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))
    opens = before & (edge | ~np.concatenate(([False], before[:-1])))
    closes = before & (np.append(edge[1:], True) | ~np.append(before[1:], False))
    run_of, run_a, run_b = owner[opens], nth[opens], nth[closes] + SPAN
    again = np.flatnonzero(doc > doc[first])  # the same bytes in a smaller document: covered as a whole
    size_of = sizes[codes]
    own = np.flatnonzero(doc == doc[first])  # rows that depend on single windows
    slot = np.searchsorted(lone, first[own])
    at, upto = np.searchsorted(run_of, slot), np.searchsorted(run_of, slot, side="right")
    many = upto - at
    pick = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())
    rows = np.repeat(own, many)
    return (np.concatenate([doc[again], doc[rows]]), np.concatenate([start[again], start[rows] + run_a[pick]]),
            np.concatenate([start[again] + size_of[again], start[rows] + run_b[pick]]), lone)


def _window_spans(batch: pa.RecordBatch, held: list[np.ndarray]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
    """(doc_id, start, end) of the single windows, sorted by anchor, hash and doc_id, whose bytes a smaller document of their
    group holds; and the first row of the last group, which the next batch may go on with."""
    anchor, spread, doc, start = (batch.column(k).to_numpy() for k in range(4))
    body = flat_bytes(batch.column(4))[0].reshape(-1, SPAN)
    cells = [anchor, spread, doc, start, body]
    if held:
        cells = [np.concatenate(x) for x in zip(held, cells, strict=True)]
    anchor, spread, doc, start, body = cells
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (spread[1:] != spread[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (body == body[head]).all(axis=1)
    found = same & (doc > doc[head])
    first: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(~same).tolist():  # other bytes of the same hash
        found[k] = first.setdefault((int(head[k]), body[k].tobytes()), int(doc[k])) < doc[k]
    last = head[-1:]
    if not same[head[-1]:].all():  # a group that mixes bytes goes on as a whole
        last = np.arange(head[-1], len(doc))
    out = pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(start[found]), pa.array(start[found] + SPAN)], ["doc_id", "start", "end"])
    return out, [c[last].copy() for c in cells]


def _covered(contexts: DataFrame) -> DataFrame:
    """(doc_id, start, end) of bytes that windows in smaller documents cover; rows come sorted by anchor, spread and doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: pa.RecordBatch | None = None
        carried = 0
        held: list[np.ndarray] = []  # the first row of the last window group

        def work(block: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
            ids, a, b, first = _block_spans(block.column(2).to_numpy(), block.column(3).to_numpy(), block.column(4))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a), pa.array(b)], ["doc_id", "start", "end"]), first

        for batch in batches:
            known = pc.is_valid(batch.column(5))
            if pc.any(known).as_py():
                yield batch.filter(known).select(["doc_id", "start", "end"])
                batch = batch.filter(pc.invert(known))
            single = (batch.column(1).to_numpy() & 1).astype(bool)
            if single.any():
                out, held = _window_spans(batch.filter(pa.array(single)), held)
                yield out
                batch = batch.filter(pa.array(~single))
            rows = batch if rows is None else pa.concat_batches([rows, batch])
            while rows.num_rows - carried > BLOCK:
                anchor, spread = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (spread[1:] != spread[:-1])) + 1
                cut = int(edge[-1]) if len(edge) and edge[-1] > carried else rows.num_rows
                out, first = work(rows.slice(0, cut))
                yield out
                if cut < rows.num_rows:
                    rows, carried = rows.slice(cut), 0
                else:  # one anchor or window fills the block: its distinct bytes go on, each with its smallest document
                    rows = rows.take(pa.array(first))
                    carried = rows.num_rows
        if rows is not None and rows.num_rows:
            yield work(rows)[0]
    return contexts.mapInArrow(run, "doc_id long, start long, end long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (sorted, apart, with start and end) of the bytes to remove; documents that keep all are left out."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    marks = stored(docs.select("doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("digest")), "digests")
    first = marks.where(f"n >= {SPAN}").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(
        "first < last").select("digest", "first")
    copies = stored(marks.join(first, "digest").where("doc_id > first").select("doc_id", "n").distinct(), "copies")
    frequent = _frequent(docs)
    rows = _anchor_rows(docs, frequent).repartition("anchor", "spread").sortWithinPartitions("anchor", "content", "doc_id").drop("spread")
    met = stored(_met(rows), "met")
    del rows
    starts = stored(met.where("end is null").groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "starts")
    release(docs.sparkSession)  # the places of all anchors are the largest shuffle, and no longer needed
    # Which documents are to be compared is not bounded: texts and places meet in a shuffle.
    found = _packed(docs).join(starts.hint("merge"), "doc_id").select("doc_id", "__packed", "starts")
    contexts = _contexts(found, frequent).repartition("anchor", "spread").sortWithinPartitions("anchor", "spread", "doc_id")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    spans = _covered(contexts).unionByName(met.where("end is not null")).unionByName(whole)
    return stored(spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "repeats")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes that stay) and ``removed`` (array of start, end: maximal removed runs)."""
    docs = docs.drop("kept", "removed")
    spans = repeated_spans(docs).select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans"))
    joined = _packed(docs).join(spans.hint("merge"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    schema = widened(widened(docs.schema, "kept", "binary"), "removed", "array<struct<start:bigint,end:bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in _unpacked(batches):
            kept, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in spans or []:
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["end"])
                    else:
                        runs.append([s["start"], s["end"]])
                at, out = 0, []
                for a, b in runs:
                    out.append((text or b"")[at:a])
                    at = b
                kept.append(b"".join([*out, (text or b"")[at:]]))
                removed.append([{"start": a, "end": b} for a, b in runs])
            columns = {n: batch.column(n) for n in schema.names[:-2]}
            columns["text"] = columns["text"].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(kept, pa.binary()), pa.array(removed, runs_type)],
                                             names=schema.names)
    return joined.mapInArrow(run, schema)
