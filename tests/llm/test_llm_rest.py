"""Packing, tokenizers, repeated bytes, embeddings, search and URL filters against brute force, and the pipeline's stages."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracles import compare, connect
from sessionlab.llm.byte_bpe import Encoder, PrefixTable, Ranks, decode_documents, encode_documents
from sessionlab.llm.embedding_dedup import Boxes, embedding_components
from sessionlab.llm.packing import best_plan, cut_documents, pack_pieces, plan_lengths
from sessionlab.llm import suffix_dedup
from sessionlab.llm.suffix_dedup import anchors_of, remove_repeats, suffix_sort
from sessionlab.llm.url_filter import judge_urls
from sessionlab.llm.vector_search import centroid_count, nearest, walk_cells
from sessionlab.llm.vectors import pair_cosines

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"), ("block", "com/de/")]


def filled(plan, counts):
    """Every piece has one place and no sequence has a gap or overflows."""
    spans, used = {}, {}
    for length, rank, per, first, offset in sorted(plan.rows):
        assert rank == used.get(length, 0)
        following = [r[1] for r in sorted(plan.rows) if r[0] == length and r[1] > rank]
        upto = following[0] if following else counts[length]
        for k in range(upto - rank):
            spans.setdefault(first + k // per, []).append((offset + k % per * length, length))
        used[length] = upto
    assert used == counts
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity
    return len(spans)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_gapless_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.geometric(1 / (10 + 12 * seed), 700), 1, 64)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    for groups in (3, 16):
        plan_lengths(counts, 64, groups)
        assert filled(plan_lengths(counts, 64, groups), counts) == plan_lengths(counts, 64, groups).sequences
    plan = best_plan(counts, 64)
    assert filled(plan, counts) == plan.sequences <= math.ceil(lengths.sum() / 64) * 1.03 + 1
    assert best_plan({}).sequences == 0
    with pytest.raises(ValueError):
        plan_lengths({65: 1}, 64)


def test_packed_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "É", "x1", "don't", "<|endoftext|>", "a<|startoftext|>b", "<|EndOfText|>", "né,", "...", "Word."]) for _ in range(rng.choice([0, 3, 80, 700])))
             for _ in range(120)] + [None, "", "\n\t", "same text"] + ["same text"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pieces = cut_documents(df, "word_bpe_49k.json", capacity=128)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 128):
            part = ids[k:k + 128]
            want[i, k // 128] = (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    packed = pack_pieces(pieces, capacity=128).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in packed} == want
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 128
    assert pack_pieces(pieces.limit(0), capacity=128).collect() == []


@pytest.fixture(scope="module")
def ranks():
    return Ranks.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_encodes_as_the_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'ll", "123", "!", "\xa0", "日本", "x" * 300, "\x1c", "\x85", "ing", "😀", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    encoder = Encoder(ranks)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == library.encode_ordinary(t), repr(t)
    df = spark.createDataFrame([*enumerate(texts[:50]), (99, None)], "doc_id long, text string")
    out = decode_documents(encode_documents(df, "byte_bpe_50k.tiktoken"), "byte_bpe_50k.tiktoken").collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out} == {**dict(enumerate(texts[:50])), 99: ""}
    assert encode_documents(df.limit(0), "byte_bpe_50k.tiktoken").collect() == []


def test_prefix_table_appends_and_edits(ranks):
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdeinot hrs") for _ in range(rng.randint(0, 60)))
        whole = PrefixTable(ranks, data)
        assert [ranks.bytes_of[t] for t in whole.ids] == ranks.merged(data)
        part = PrefixTable(ranks, data[:7])
        part.append(data[7:])
        assert part.last == whole.last
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        whole.replace(a, b, b"then")
        assert whole.data == data[:a] + b"then" + data[b:] and whole.ids == PrefixTable(ranks, whole.data).ids
    long = PrefixTable(ranks, b"the cat sat on a mat " * 200)
    assert long.replace(10, 11, b"u") < 400


def brute_repeats(rows, span=50):
    first, out = {}, {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            first.setdefault(data[i:i + span], doc)
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - span + 1):
            if first[data[i:i + span]] < doc:
                gone[i:i + span] = True
        out[doc] = bytes(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_repeated_bytes(spark, monkeypatch, block):
    monkeypatch.setattr("sessionlab.llm.suffix_dedup.BLOCK", block)
    rng = random.Random(block)
    parts = ["".join(rng.choice("abcde fgé") for _ in range(rng.randint(20, 120))) for _ in range(12)] + ["a" * 90, "-" * 70]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(70)]
    rows += [(200, None), (201, ""), (202, "short"), (203, rows[5][1]), (204, "a" * 49), (205, "a" * 50)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, anchor int").repartition(5)
    got = remove_repeats(df).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == brute_repeats(rows)
    assert len(got) == len(rows) and {r["anchor"] for r in got} == {7}
    assert remove_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("hot,sample", [(0, 1), (10, 3), (40, 2)])
def test_frequent_anchors_are_dealt_to_many_tasks(spark, monkeypatch, hot, sample):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    rng = random.Random(hot)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    tails = ["".join(rng.choice("ijkl") for _ in range(60)) for _ in range(4)]
    other = lambda: "".join(rng.choice("mnopqrstuvwxyzé") for _ in range(rng.randint(30, 70)))
    rows = [(i, other() + passage + (rng.choice(tails) if i % 3 == 0 else "") + other()) for i in range(120)]
    rows += [(1000 + i, other() + passage[:rng.randint(49, 80)] + other()) for i in range(10)] + [(2000, rows[3][1]), (2001, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(df).collect()} == brute_repeats(rows)
    # Rows that meet: few, though every anchor of the passage is in 130 documents and its edges are different in each.
    docs = df.where("text is not null")
    frequent = suffix_dedup._frequent(docs)
    assert len(frequent.value.window_marks)
    met = suffix_dedup._anchor_rows(docs, frequent).groupBy("anchor", "spread").count()
    assert met.agg(F.max("count")).first()[0] < 45
    starts = suffix_dedup._anchor_rows(docs, frequent).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    found = suffix_dedup._packed(docs).join(starts, "doc_id").select("doc_id", "__packed", "starts")
    assert suffix_dedup._contexts(found, frequent).groupBy("anchor", "spread").count().agg(F.max("count")).first()[0] < 45


def test_rows_without_an_id_keep_their_bytes(spark):
    text = "the same passage of more than fifty bytes, to be found in each of the rows"
    df = spark.createDataFrame([(None, text), (2, text), (3, f"so: {text}"), (None, None), (None, f"x {text}")], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in remove_repeats(df).collect())
    assert got == [(0, ""), (0, text), (0, f"x {text}"), (2, text), (3, "so: ")]


def test_suffix_sort_and_anchors():
    rng = random.Random(5)
    for depth in (9, 20, 50):
        data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(300)), dtype=np.uint8)
        starts = np.arange(len(data) - depth)
        order, equal = suffix_sort(data, starts, depth)
        windows = [data[i:i + depth].tobytes() for i in starts]
        got = [windows[i] for i in order]
        assert got == sorted(windows) and equal.tolist() == [False, *(a == b for a, b in zip(got, got[1:], strict=False))]
    _, _, first, last, _ = anchors_of(data, np.array([0, 120, 120, 300]))
    starts = sorted(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    assert starts == [*range(71), *range(120, 251)]  # each window of each row has one anchor


def vectors_frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 12))
    rows = [(int(i), (base[rng.integers(60)] * rng.uniform(0.5, 2) + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 1])).tolist()) for i in range(400)]
    rows += [(400 + k, rows[3][1]) for k in range(20)]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] + [1.0] * 11), (950, [float("inf")] * 12)]
    return rows, odd, spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, component int").repartition(4)


def test_embedding_components(spark, monkeypatch):
    rows, odd, df = vectors_frame(spark)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(cosine, -1)
    parent = {i: i for i in ids.tolist()}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(cosine >= 0.95), strict=True):
            if parent[ids[b]] < parent[ids[a]]:
                parent[ids[a]], changed = parent[ids[b]], True
    for block in (4096, 50, 20):  # one block, several boxes, boxes dealt to several blocks
        monkeypatch.setattr("sessionlab.llm.embedding_dedup.BLOCK", block)
        monkeypatch.setattr("sessionlab.llm.embedding_dedup.BLOCK_BYTES", block * 12 * 8)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_components(df).collect()}
        want = {i: (int(n), parent[i]) for i, n in zip(ids.tolist(), (cosine >= 0.95).sum(1), strict=True)}
        assert got == {**want, **{i: (0, i) for i, _ in odd}}
    assert embedding_components(df.limit(0)).collect() == []


def test_boxes_apart_hold_no_links():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(30, 8))[rng.integers(30, size=900)] + rng.normal(size=(900, 8)) * 0.05
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    boxes = Boxes(z[::2], len(z), 40)
    box = boxes.of(z)
    angle = np.arccos(np.clip((z * boxes.centres[box]).sum(axis=1), -1, 1))
    radius = np.zeros(len(boxes.centres))
    np.maximum.at(radius, box, angle)
    apart = boxes.apart(radius, float(np.arccos(0.95)))
    a, b = np.nonzero(z @ z.T >= 0.95)
    assert not apart[box[a], box[b]].any() and apart.mean() > 0.3 and np.bincount(box).max() < 120
    assert Boxes(np.ones((50, 3)), 50, 10).of(np.ones((4, 3))).tolist() == [0] * 4  # equal vectors cannot be cut


@pytest.mark.parametrize("cell", [200, 1])
def test_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr("sessionlab.llm.vector_search.CELL", cell)
    monkeypatch.setattr("sessionlab.llm.vector_search.PART", 50 * cell)
    rows, _, df = vectors_frame(spark, 2)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = nearest(df, k=5, every=20).collect()
    hits = total = 0
    for q in (i for i in ids.tolist() if i % 20 == 0):
        at = int(np.flatnonzero(ids == q)[0])
        score = pair_cosines(x, np.broadcast_to(x[at], x.shape))
        rest = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += sum(r["vec_id"] in ids[rest] for r in mine)
        total += 5
        assert all(abs(r["score"] - score[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
    assert hits >= 0.9 * total
    few = nearest(df.where("vec_id in (0, 1, 2)"), k=5, every=2).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    assert nearest(df.limit(0)).collect() == []


def test_cells_grow_with_the_vectors():
    assert [centroid_count(n) for n in (0, 51_282, 200_000, 10**7, 10**9)] == [16, 16, 31, 223, 256]


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    order = walk_cells(a, b, np.ones(30, dtype=int), np.inf)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(30)) and sums == sorted(sums)


def test_url_rules_and_trees(spark):
    urls = [None, "", "no scheme", "HTTP://A.Org/", "http://b.com?x=1", "http://ünI.EXAMPLE.org/es/a b?z#q", "a://b://c/d#",
            "http://myorg/", "http://x.com/frx", "http://x.com/fr/", "http://org", "http://org/"]
    urls += [f"http://s{k}.{'com/de' if k % 2 else 'org/en'}/{k}?a=1&b={k * 'x'}" for k in range(60)] + [f"http://t{k}.net/{k}?a=1" for k in range(20)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, length string")
    got = {r["page_id"]: r for r in judge_urls(df, RULES).collect()}
    assert len(got) == len(urls) and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    part = {k: (got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(12)}
    assert part == {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.org", "/", "org/"), 4: ("b.com", "", None),
                    5: ("üni.example.org", "/es/a b", "example.org/es/"), 6: ("b:", "//c/d", None), 7: ("myorg", "/", None),
                    8: ("x.com", "/frx", None), 9: ("x.com", "/fr/", "com/fr/"), 10: ("org", "", None), 11: ("org", "/", "org/")}
    assert all(r["verdict"] == ("block" if r["rule"] in ("example.org/es/", "com/de/") else "allow") for r in got.values() if r["rule"])
    assert judge_urls(df.limit(0), RULES).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in queries() if n in oracle_sql() and n.startswith("op")))
def test_query_matches_oracle(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        if name in ("line_dedup", "pii", "packing"):
            assert ids == before  # these change texts, they drop none
        if name != "packing":
            assert docs.columns == columns
        before = ids
    digest = hashlib.sha256(repr(sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))).encode()).hexdigest()
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert digest == hashlib.sha256(repr(sorted(map(tuple, again))).encode()).hexdigest()
