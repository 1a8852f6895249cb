"""N-gram Jaccard join: documents whose shingle sets reach a Jaccard similarity, exactly, by skipping work that the
relations between sets make needless.

Index. All sets order their tokens alike: by how often the token's counter was met in the corpus, rare ones first. A set
is listed under each token of its prefix, so that two linked sets share at least one list. An entry holds the set's size
and a parity sketch: the bits in which two sketches differ are no more than the tokens in which the sets differ, so most
pairs of a list are ruled out at once, and a pair is never lost. Pairs whose sketches are close join their sets; those that
are merely possible are held against sketches as long as the sets, which leave few but true links. What is left makes
neighbourhoods. Nothing is decided here, and sets that share a passage, but too little of it, do not meet.

Join. Inside a neighbourhood (or a pair of its parts, when it is too large for one task) index lists are kept in order of
the position that a token has in the set. For a set, the blocks of a list whose positions can't begin a link any more are
skipped; only if some entry remains are overlaps counted, over the larger sets alone. A set that is highly similar to one
just answered takes over that set's overlaps and corrects them with the lists of the tokens in which the two differ.

Null and empty texts have empty sets and link with nothing; equal sets always link; rows that repeat a doc_id count as
one document only if their text is the same, else each text links for that doc_id. Rows without a doc_id link with nothing
and have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlab.llm.common import chunks, flat_bytes, mix, shingle_sets, stored
from sessionlab.llm.components import connected_components

_U = np.uint64
#: Sets and shingles of one side of a comparison task.
TILE_SETS, TILE_TOKENS = 4096, 4_000_000
#: Counters that stand for the frequency of shingles (a fixed size, whatever the corpus).
COUNTERS = 1 << 16
#: A list of more entries is joined into one neighbourhood without looking at its pairs.
LIST_SETS = 4096
#: Lists up to this length are compared many at a time.
SHORT = 12
#: A list with more possible pairs per set than this is joined as well.
LIST_PAIRS = 32
#: Once a task has met a token about so often, further sets with it are tied together inside the task.
TASK_SETS = 64


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a set of n under which a link of it must be found: it shares num / den of the larger set at least."""
    return n - -(-n * num // den) + 1


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        pair = np.array([np.add.reduce(mix(tokens)), np.add.reduce(mix(tokens ^ _U(0x5851F42D4C957F2D)))])
    return tuple(mix(pair + _U(len(tokens))).view(np.int64).tolist())


def shingle_signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit signature (hi, lo) and a long sketch of each document's shingle set; and from each task,
    rows that say how many sets hold a token of each counter (``counter``, ``met``; null in the documents' rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "hi", "lo", "sketch", "counter", "met"]
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in chunks(batches, "text"):
            sets = list(shingle_sets(*flat_bytes(batch.column("text")), words))
            marks = [_signature(s) for s in sets]
            total += np.bincount((np.concatenate(sets) % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                pa.array([long_sketch(s) for s in sets], pa.binary()), none, none], names=names)
        used = np.flatnonzero(total)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(total[used])], names=names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, hi long, lo long, sketch binary, counter long, met long")


def _counters(marks: DataFrame) -> np.ndarray:
    """How many sets hold a token of each counter, over all documents; ``COUNTERS`` numbers reach the driver."""
    found = marks.where("counter is not null").groupBy("counter").agg(F.sum("met").alias("met")).toPandas()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["counter"].to_numpy(dtype=np.int64)] = found["met"].to_numpy(dtype=np.int64)
    return out


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """256 parity bits as four words; a set of at most 256 tokens uses the first two only."""
    width = 128 if len(tokens) <= 256 else 256
    place = (mix(tokens) >> _U(40)).astype(np.int64) % width
    bits = np.bincount(place, minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def long_sketch(tokens: np.ndarray) -> bytes:
    """Parity bits, at least as many as tokens (a power of two, 65,536 at most)."""
    width = min(max(64, 1 << (max(1, len(tokens)) - 1).bit_length()), 1 << 16)
    place = (mix(tokens ^ _U(0x2545F4914F6CDD1D)) >> _U(40)).astype(np.int64) % width
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def long_sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two long sketches differ, the longer one folded to the shorter's length."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def sketches_differ(a: np.ndarray, b: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ (rows of four words); ``wide`` says where both sets have all four."""
    def folded(x: np.ndarray) -> np.ndarray:
        return x[..., :2] ^ x[..., 2:]
    narrow = np.bitwise_count(folded(a) ^ folded(b)).sum(axis=-1, dtype=np.int64)
    full = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return np.where(wide, full, narrow)


def _index_entries(docs: DataFrame, words: int, num: int, den: int, counted: np.ndarray) -> DataFrame:
    """(key, kind, node, size, four words of sketch): the entries of the index lists, once for each set and task.

    Kind 1 is an entry. Where a task has met a token very often, it ties the sets it meets from then on to the first of
    these: kind 2 says that ``key`` and ``node`` are two such sets; kind 0 is that first one's entry, which stands for all
    of them and joins the whole list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met = np.zeros(1 << 21, dtype=np.int32)
        first: dict[int, int] = {}
        for batch in chunks(batches, "text"):
            keys, nodes, sizes, sketches = [], [], [], []
            for s in shingle_sets(*flat_bytes(batch.column("text")), words):
                if not len(s):
                    continue
                node = _signature(s)[1]
                if node in seen:
                    continue
                seen.add(node)
                rare = counted[(s % _U(COUNTERS)).astype(np.int64)]
                prefix = s[np.lexsort((s, rare))[:prefix_length(len(s), num, den)]]
                keys.append(prefix)
                nodes.append(np.full(len(prefix), node, dtype=np.int64))
                sizes.append(np.full(len(prefix), len(s), dtype=np.int32))
                sketches.append(np.broadcast_to(sketch_of(s), (len(prefix), 4)))
            if not keys:
                continue
            key, node, size, sketch = (np.concatenate(x) for x in (keys, nodes, sizes, sketches))
            slot = (key % _U(len(met))).astype(np.int64)
            often = met[slot] >= TASK_SETS
            np.add.at(met, slot, 1)
            key, kind = key.view(np.int64).copy(), np.ones(len(key), dtype=np.int8)
            for i in np.flatnonzero(often).tolist():
                stands = first.setdefault(int(key[i]), int(node[i]))
                if stands == node[i]:
                    kind[i] = 0
                else:
                    key[i], kind[i] = stands, 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(kind), pa.array(node), pa.array(size),
                 *[pa.array(np.ascontiguousarray(sketch[:, w]).view(np.int64)) for w in range(4)]],
                names=["key", "kind", "node", "size", "s0", "s1", "s2", "s3"])
    return docs.select("text").mapInArrow(
        run, "key long, kind byte, node long, size int, s0 long, s1 long, s2 long, s3 long")


def _may_link(size: np.ndarray, other: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes (the first not larger) may link if they differ in ``differ`` tokens at least."""
    both = size + other
    # The overlap o must be num / den of the union both - o; the sets then differ in both - 2 * o tokens.
    overlap = -(-num * both // (num + den))
    return (other * num <= size * den) & (differ <= both - 2 * overlap)


def _close(differ: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Whether sketches are so much alike that their sets are joined without a further look."""
    return differ <= np.where(wide, 64, 32)


def _list_links(node: np.ndarray, size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> list[tuple[int, int, bool]]:
    """The pairs of one list (in order of size) that may link, as (a, b, sure): of those whose sketches are close, as many
    as join what they join; of the others, all that are not joined so."""
    label, found, doubtful = np.arange(len(node)), [], 0
    for i in range(len(node) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        if not len(rest):
            if (label == label[i]).all():
                break
            continue
        wide = (size[rest] > 256) & (size[i] > 256)
        differ = sketches_differ(sketch[i], sketch[rest], wide)
        may = _may_link(size[i], size[rest], differ, num, den)
        near = may & _close(differ, wide)
        for j in rest[near].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((int(node[i]), int(node[j]), True))
        far = rest[may & ~near]
        far = far[label[far] != label[i]]
        found += [(int(node[i]), n, False) for n in node[far].tolist()]
        doubtful += len(far)
        if doubtful > LIST_PAIRS * len(node):
            return [(int(node[0]), n, True) for n in node[1:].tolist()]
    return found


def candidate_links(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, sure): pairs of sets that hold together all sets which may link, from the index lists; pairs that are not sure
    may be dropped if the two sets don't link.

    A task reads its lists one after another, sorted; short lists are compared together, and one of more than ``LIST_SETS``
    entries, or with an entry that stands for many, is joined as it streams by."""
    dealt = entries.repartition("key").sortWithinPartitions("key", "kind", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the list that the last batch may not have ended
        star: tuple[int, int] | None = None  # (key, node) of a list that is joined as it streams by
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)] if held else cols
            key, kind = cols[0], cols[1]
            a, b, sure = [key[kind == 2]], [cols[2][kind == 2]], [np.ones(int((kind == 2).sum()), dtype=bool)]
            cols = [c[kind < 2] for c in cols]
            key, kind, node, size = cols[:4]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(key))
            held, left, right = [], [], []
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                if star and star[0] != key[lo]:
                    star = None
                if star or kind[lo] == 0 or hi - lo > LIST_SETS:
                    star = star or (int(key[lo]), int(node[lo]))
                    a.append(np.full(hi - lo, star[1]))
                    b.append(node[lo:hi])
                    sure.append(np.ones(hi - lo, dtype=bool))
                elif hi == len(key):
                    held = [c[lo:hi] for c in cols]
                elif hi - lo > 1:
                    left.append(lo)
                    right.append(hi)
            yield from _compared(cols, left, right, a, b, sure, num, den)
        if held and len(held[0]) > 1:
            yield from _compared(held, [0], [len(held[0])], [], [], [], num, den)
    return dealt.mapInArrow(run, "a long, b long, sure boolean").where("a <> b").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _compared(cols: list[np.ndarray], left: list[int], right: list[int], a: list[np.ndarray], b: list[np.ndarray],
              sure: list[np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The links of the lists [left, right) of a batch, after the given ones; short lists of one length are compared at once."""
    node, size = cols[2], cols[3].astype(np.int64)
    sketch = np.column_stack([c.view(np.uint64) for c in cols[4:8]]) if len(node) else np.zeros((0, 4), np.uint64)
    lo, hi = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
    for k in range(2, SHORT + 1):
        begin = lo[hi - lo == k]
        if not len(begin):
            continue
        x, y = (begin[:, None] + t[None, :] for t in np.triu_indices(k, 1))
        wide = (size[x] > 256) & (size[y] > 256)
        differ = sketches_differ(sketch[x], sketch[y], wide)
        ok = _may_link(size[x], size[y], differ, num, den)
        near = ok & _close(differ, wide)
        ok[near[:, :k - 1].all(axis=1), k - 1:] = False  # the smallest set joins them all
        a.append(node[x[ok]])
        b.append(node[y[ok]])
        sure.append(near[ok])
    long = hi - lo > SHORT
    for i, j in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
        pairs = _list_links(node[i:j], size[i:j], sketch[i:j], num, den)
        a.append(np.array([p[0] for p in pairs], dtype=np.int64))
        b.append(np.array([p[1] for p in pairs], dtype=np.int64))
        sure.append(np.array([p[2] for p in pairs], dtype=bool))
    if a:
        x, y, certain = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        found = np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y), certain.astype(np.int64))), axis=0)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)), pa.array(found[:, 2] > 0)], names=["a", "b", "sure"])


def _possible_links(links: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the candidate links, without those whose long sketches rule them out."""
    sets = marks.where("n_shingles > 0").groupBy(F.col("lo").alias("node")).agg(
        F.min("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    one, two = (sets.select(F.col("node").alias(f"node_{x}"), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    pairs = links.where("not sure").join(one, F.col("a") == F.col("node_a")).join(two, F.col("b") == F.col("node_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.sort(np.column_stack([batch.column(c).to_numpy() for c in ("size_a", "size_b")]), axis=1)
            differ = np.array([long_sketches_differ(x, y) for x, y in zip(
                batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)], dtype=np.int64)
            keep = _may_link(sizes[:, 0], sizes[:, 1], differ, num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    checked = pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")
    return links.where("sure").select("a", "b").unionByName(checked)


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``tokens`` in place of ``text``, only the rows whose set is the one their ``node`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = list(shingle_sets(*flat_bytes(batch.column("text")), words))
            own = np.array([_signature(s)[1] for s in sets], dtype=np.int64) == batch.column("node").to_numpy()
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "tokens", pa.array([s.tobytes() for s in sets], pa.binary())).filter(pa.array(own))
    kept = [f"{n} {t}" for n, t in docs.dtypes if n != "text"]
    return docs.select(*[n for n in docs.columns if n != "text"], "text").mapInArrow(
        run, ", ".join([*kept, "tokens binary"]))


def skip_join(sets: list[np.ndarray], num: int, den: int, left: np.ndarray | None = None,
              weights: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between sorted token sets with Jaccard similarity num / den or more: a spanning forest of them (indices), and
    the weight of the sets that each set links with.

    ``left`` marks two sides; then only links from one side to the other are looked for.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])), dtype=np.int64)
    sets = [sets[i] for i in order]
    side = None if left is None else np.asarray(left)[order]
    weight = np.ones(len(sets), dtype=np.int64) if weights is None else np.asarray(weights, dtype=np.int64)[order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Tokens in the order of their frequency, rare ones first; the place of a token in its set is its position.
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    by_set = np.lexsort((token, owner))
    token = token[by_set]
    position = np.arange(len(token)) - np.repeat(ends[:-1], sizes)
    own = [token[ends[i]:ends[i + 1]] for i in range(len(sets))]
    lists = owner[np.argsort(token, kind="stable")]  # per token, its sets in order of size
    starts = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(count)))))
    # The prefix index: per token, sets in order of the position that the token has in them.
    early = position < sizes[owner] - -(-sizes[owner] * num // den) + 1
    p_token, p_set, p_place = token[early], owner[early], position[early]
    by_place = np.lexsort((p_place, p_token))
    p_set, p_place = p_set[by_place], p_place[by_place]
    p_starts = np.concatenate(([0], np.cumsum(np.bincount(p_token, minlength=len(count)))))
    parent = np.arange(len(sets))
    links = np.zeros(len(sets), dtype=np.int64)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def walk(tokens: np.ndarray, into: np.ndarray, sign: int, after: int) -> None:
        for t in tokens.tolist():
            part = lists[starts[t]:starts[t + 1]]
            into[part[np.searchsorted(part, after, side="right"):]] += sign  # a list holds a set once

    def begins(i: int, n: int, last: int) -> bool:
        """Whether a list block of the set's prefix holds a larger set that may still link."""
        reach = n * (den - num) // num  # no set of this size or more has a first common token beyond
        for p, t in enumerate(own[i][:prefix_length(n, num, den)].tolist()):
            a, b = p_starts[t], p_starts[t + 1]
            if b - a < 2:
                continue
            b = a + int(np.searchsorted(p_place[a:b], reach, side="right"))  # later blocks are skipped
            j, q = p_set[a:b], p_place[a:b]
            m = sizes[j]
            if ((j > i) & (j < last) & ((1 + np.minimum(n - p, m - q) - 1) * (num + den) >= num * (n + m))).any():
                return True
        return False

    forest, overlaps, held = [], None, None
    for i in range(len(sets)):
        n = int(sizes[i])
        if not n:
            continue
        last = int(np.searchsorted(sizes, n * den // num, side="right"))  # sizes beyond can't link
        answer = None
        if held is not None:
            gone = np.setdiff1d(own[held], own[i], assume_unique=True)
            new = np.setdiff1d(own[i], own[held], assume_unique=True)
            if len(gone) + len(new) <= n // 2:  # highly similar: derive this set's overlaps from the other's
                answer, held = overlaps, i
                walk(gone, answer, -1, i)
                walk(new, answer, 1, i)
        if answer is None:
            if not begins(i, n, last):
                continue
            answer = np.zeros(len(sets), dtype=np.int32)
            walk(own[i], answer, 1, i)
            held, overlaps = i, answer
        both = answer[i + 1:last]
        hits = np.flatnonzero(both * den >= num * (n + sizes[i + 1:last] - both)) + i + 1
        if side is not None:
            hits = hits[side[hits] != side[i]]
        links[i] += weight[hits].sum()
        links[hits] += weight[i]
        for j in hits.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((int(order[i]), int(order[j])))
    out = np.zeros(len(sets), dtype=np.int64)
    out[order] = links
    return forest, out


def _neighbourhood_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the sets (doc_id, weight, group, parts, node, tokens): forest links (a, b), and rows (a, null, n) that add to the
    number of documents a set links with. Every pair of a group's parts is one task's work, and every pair of sets belongs
    to one of them."""
    tiled = sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "doc_id", "weight", "tokens", "node", "group", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        left = None if pdf["low"].iat[0] == pdf["high"].iat[0] else (pdf["part"] == pdf["low"]).to_numpy()
        found, links = skip_join([np.frombuffer(x, dtype=np.uint64) for x in pdf["tokens"]], num, den, left, pdf["weight"].to_numpy())
        ids = pdf["doc_id"].to_numpy()
        a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))
        some = np.flatnonzero(links)
        return pd.concat([
            pd.DataFrame({"a": ids[a], "b": pd.array(ids[b], dtype="Int64"), "n": pd.array([pd.NA] * len(a), dtype="Int64")}),
            pd.DataFrame({"a": pdf["node"].to_numpy()[some], "b": pd.array([pd.NA] * len(some), dtype="Int64"),
                          "n": pd.array(links[some], dtype="Int64")})], ignore_index=True)

    return tiled.groupBy("group", "low", "high").applyInPandas(run, "a long, b long, n long")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of ``docs(doc_id, text)``.

    Two documents link when den * intersection >= num * union of their distinct ``words``-word shingles. component_id is
    the smallest doc_id reachable by links, itself included; n_links the number of other rows linked directly. No link
    between different sets is lost and nothing is capped; equal sets are represented by their smallest doc_id.
    """
    docs = docs.select("doc_id", "text")
    seen = stored(shingle_signatures(docs, words), "signatures")
    marks = seen.where("counter is null").drop("counter", "met")
    known = docs.where("doc_id is not null")
    entries = _index_entries(known, words, num, den, _counters(seen))
    met = stored(candidate_links(entries, num, den), "candidate-links")
    near = connected_components(_possible_links(met, marks, num, den))
    classes = marks.where("doc_id is not null").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("weight"))
    near_sets = classes.join(near, classes["lo"] == near["node"]).where("n_shingles > 0").select(
        "doc_id", "n_shingles", "weight", "node", F.col("component").alias("group"))
    parts = near_sets.groupBy("group").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("t")).where("m > 1").select(
        "group", F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("t") / TILE_TOKENS)).cast("int").alias("parts"))
    members = stored(near_sets.join(parts, "group").select("doc_id", "weight", "node", "group", "parts").distinct(), "members")
    # How many ids lie in neighbourhoods grows with the input: texts and ids meet in a shuffle at every size.
    sets = _tokens(known.join(members.hint("merge"), "doc_id"), words)
    found = stored(_neighbourhood_links(sets, num, den), "set-links")
    tied = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("lo_")).agg(F.sum("n").alias("n"))
    label = classes.join(tied, classes["doc_id"] == tied["node"], "left").join(counts, F.col("lo") == F.col("lo_"), "left").select(
        "hi", "lo", F.coalesce("component", classes["doc_id"]).alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = marks.where("doc_id is not null and n_shingles > 0").join(label, ["hi", "lo"]).select(
        "doc_id", "n_shingles", "component_id", "n_links")
    return linked.unionByName(marks.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one_per_component(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, with all their columns. A row without a
    doc_id has no place in that order: it is kept and removes nothing."""
    known = docs.where("doc_id is not null")
    parts = jaccard_components(known, words, num, den).where("doc_id = component_id").select("doc_id").distinct()
    return known.join(parts, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
