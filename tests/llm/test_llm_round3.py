"""Sharding, periodic runs and conversation repair against brute force on small frames and on the given tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sessionlab.llm import conversation_repair as cr
from sessionlab.llm.embedding_dedup import embedding_components
from sessionlab.llm.line_dedup import remove_repeated_lines
from sessionlab.llm.periodic_runs import find_runs, text_runs
from sessionlab.llm.pii import KINDS, find_personal_data, mask_personal_data
from sessionlab.llm.sharding import assign_shards, jump_hash, moved, shard_documents, with_slots, write_shards
from sessionlab.llm.toxicity import fit_toxicity
from sessionlab.llm.url_filter import judge_urls
from sessionlab.llm.vector_search import nearest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- sharding

def jump(key, shards):
    key &= (1 << 64) - 1
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 666, 1024])
def test_jump_hash_is_the_published_one(spark, shards):
    rng = random.Random(shards)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(300)] + [0, 1, -1, 42, 256, 0xDEAD10CC, -(1 << 63), (1 << 63) - 1]
    got = spark.createDataFrame([(k,) for k in [*keys, None]], "k long").select("k", jump_hash(F.col("k"), shards)).collect()
    assert {r[0]: r[1] for r in got} == {k: jump(k, shards) for k in keys} | {None: None}


def test_known_jumps(spark):
    row = spark.range(1).select(*[jump_hash(F.lit(k).cast("long"), n) for k, n in [(42, 57), (0xDEAD10CC, 666), (256, 1024)]]).first()
    assert tuple(row) == (43, 361, 520)
    with pytest.raises(ValueError):
        jump_hash(F.lit(1), 0)


def shard_rows():
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(400)] + [(5, "text 5")] * 60 + [(9, None), (None, "a"), (None, "a"), (None, None), (-3, ""), (7, "é" * 20000)]
    return rows


def test_shards_have_gapless_slots(spark):
    rows = shard_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, slot int").repartition(7)
    got = shard_documents(df, 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(24))
    assert all(len({r["shard"] for r in got if r["doc_id"] == i}) == 1 for i in (5, 7, 9))
    slots = {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got}
    assert slots == {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_documents(df.repartition(3), 24).collect()}
    assert shard_documents(df.limit(0), 24).count() == 0


def test_only_the_needed_share_moves(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    gone = moved(ids, 24).groupBy("grown_shard").count().collect()
    assert [r["grown_shard"] for r in gone] == [24] and abs(gone[0]["count"] - 800) < 120
    sizes = [r["count"] for r in assign_shards(ids, 24).groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 20000 / 24 * 1.2


def test_one_shard_of_all_rows_is_not_one_task(spark):
    df = spark.range(5000).select(F.lit(3).alias("shard"), F.col("id"))
    got = with_slots(df, [F.col("id").desc()]).collect()
    assert {(r["id"], r["slot"]) for r in got} == {(i, 4999 - i) for i in range(5000)}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(shard_rows())], "doc_id long, text string, extra int")
    write_shards(df, str(tmp_path / "out"), shards=4, rows_per_file=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "extra").collect()) == Counter(tuple(r) for r in df.collect())
    want = {r["extra"]: r["shard"] for r in assign_shards(df, 4).collect()}
    assert {r["extra"]: r["shard"] for r in back.collect()} == want


# --- periodic runs

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    w = []
    kinds, size = rng.choice([1, 2, 3, 8, 200]), rng.choice([0, 5, 40, 300, 600])
    while len(w) < size:
        unit = [b"%d" % rng.randrange(kinds) for _ in range(rng.choice([1, 1, 2, 3, 5, 17, 33, 40, 64, 70]))]
        w += unit * rng.choice([1, 1, 3, 4, 5, 9]) + unit[:rng.randrange(len(unit))]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        bodies = [periodic_text(rng) for _ in range(4)]
        assert text_runs(bodies) == [brute_runs(b) for b in bodies]


def test_long_runs():
    assert text_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    rng = random.Random(5)
    unit = [b"%d" % rng.randrange(30) for _ in range(3000)]
    assert text_runs([unit * 9]) == [[(0, 27_000, 3000)]]
    assert text_runs([[b"%d" % rng.randrange(25) for _ in range(60_000)]])[0] == []


def test_collapsed_texts(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, " \n\t", "r"), (None, "x  y\tx y x y x y z", "r"), (None, "x y", "r"),
            (4, "a a a a a a  b", "r"), (4, "a a a a a a  b", "r"), (5, "é " * 100 + "end", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in find_runs(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 8, 2)], "x y z"), (None, [], "x y"),
        (4, [], "a a a a a a  b"), (4, [], "a a a a a a  b"), (5, [(0, 100, 1)], "é end")], key=str)
    assert find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, times=3)


def test_query_runs(spark, sf_dir):
    found = {r["doc_id"]: r for r in queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    planted = 0
    for d in docs:
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(w), h // 10
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        assert tuple(found[d["doc_id"]]) == (
            d["doc_id"], len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    assert planted


# --- conversations

def cheapest(roles, faults, entry=0, exits=cr.ACCEPT):
    """Shortest paths over (row, last role) by cost, then by edits."""
    best, heap = {}, [(0, "", 0, entry)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in best:
            continue
        best[i, s] = cost, audit
        want = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        steps = [(3, "I", i, want)]
        if i < len(roles):
            steps.append((4, "D", i + 1, s))
            if faults[i] != "-":
                more = 3 * (faults[i] == "t")
                steps.append((3 + more, "R", i + 1, want))
                if roles[i] == "s" and s == 0 or roles[i] == cr.STATES[want]:
                    steps.append((more, "K", i + 1, cr.STATES.index(roles[i])))
        for more, letter, j, t in steps:
            heapq.heappush(heap, (cost + more, audit + letter, j, t))
    ends = [(*best[len(roles), e], e) for e in exits if (len(roles), e) in best]
    return min(ends) if ends else None


def test_search_matches_shortest_paths():
    rng = random.Random(2)
    for _ in range(800):
        n = rng.randrange(1, 14)
        roles, faults = "".join(rng.choice("suuaax") for _ in range(n)), "".join(rng.choice("-t...") for _ in range(n))
        search = cr.Search(roles, faults)
        for entry in range(4):
            for exits in (cr.ACCEPT, (0,), (1,), (2,), (3,)):
                assert search.solve(entry, exits) == cheapest(roles, faults, entry, exits)


def brute_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text of one conversation's damaged rows, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), ""
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "."
        seen.add((role, text))
    letters = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for _, r, _ in rows)
    illegal = sum(letters[i:i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1))
    cost, audit, _ = cheapest(letters, faults.replace("b", "-").replace("d", "-"))
    out, i = [], 0
    for edit in audit:
        last = out[-1][0] if out else ""
        want = "assistant" if last[:1] == "u" else "user"
        if edit == "I":
            out.append((want, ""))
            continue
        if edit != "D":
            out.append((rows[i][1] if edit == "K" else want, rows[i][2]))
        i += 1
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        mark = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(mark.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def check_report(got, rows):
    after = damaged(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == brute_repair(after.get(conv, [])), conv


def test_query_repairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_report(queries()["op13_conversation_repair"](spark, sf_dir).collect(), rows)


def talk(conv, n, seed, first=0):
    rng = random.Random(seed)
    return [(conv, first + 2 * k, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "User", ""]) if rng.random() < 0.3 else ("user", "assistant")[k % 2],
             rng.choice([f"Turn {k}.", f"Turn {k}?", f"Turn {k}", "Same.", " \t", "Ends. \x0b\n"]) if rng.random() < 0.4 else f"Row {k} of {conv}!") for k in range(n)]


def test_long_and_odd_conversations(spark):
    """More blocks than a combining round takes, whole blocks, nulls in every column, nothing left, one row."""
    rows = [r for i, n in enumerate([1, 2, 5, 63, 64, 65, 128, 200, 700, 64 * 32 + 5, 4300]) for r in talk(i, n, i)]
    rows += [(None, 0, "user", "Hi."), (None, 1, None, "So."), (None, None, "assistant", None), (50, None, None, None), (51, 3, "system", "Only.")]
    gone = next(c for c in range(60, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Dropped."))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, fault int")
    df = df.repartition(9)
    check_report(cr.repair_report(df, cr.damage(df)).collect(), rows)
    assert cr.repair_report(df.limit(0), df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "user", "R"), (2, 0, "system", "S."), (3, 5, "user", " ")]
    repair = cr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in cr.repaired_rows(repair).orderBy("conv_id", "place").collect()]
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in repair.audits.collect()} == {
        (1, *cheapest("auuu", "..-t")[:2]), (2, *cheapest("s", ".")[:2]), (3, 4, "D")}
    for conv in (1, 2):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][0] for r in got if r[0] == conv))
    assert not [r for r in got if r[0] == 3]
    assert [(r["turn"], r["fault"]) for r in repair.rows.where("conv_id = 1").orderBy("pos").collect()] == [
        (0, None), (1, None), (2, "duplicate"), (3, "truncated")]


def test_ties_in_turn_follow_role(spark):
    rows = [(1, 0, "user", "B."), (1, 0, "assistant", "A."), (1, 0, "system", "S.")]
    repair = cr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r["role"] for r in repair.rows.orderBy("pos").collect()] == ["assistant", "system", "user"]


# --- rows without an id, clashing names, many blocks

def test_lines_of_rows_without_an_id(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc"), (None, "a\nb\nc")]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x", 3), (None, "a\nb\nc", 0)], key=str)


def test_vectors_without_an_id(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (50, [1.0, 0.1]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in embedding_components(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None), (None, 0, None), (1, 1, 1), (2, 0, 2), (50, 1, 1)], key=str)
    assert {(r["rank"], r["vec_id"]) for r in nearest(df).collect()} == {(1, 1), (2, 2)}


def test_many_vector_blocks(spark, monkeypatch):
    """Blocks of four vectors."""
    from sessionlab.llm import embedding_dedup
    monkeypatch.setattr(embedding_dedup, "BLOCK", 1)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 4 * 16)
    rows = [(k, [float(np.cos(k * 0.004)), float(np.sin(k * 0.004))]) for k in range(1200)]
    df = spark.createDataFrame([r for r in rows if r[0] % 100 < 3 or r[0] > 700], "vec_id long, embedding array<double>").limit(560)
    got = {r["vec_id"]: r["component_id"] for r in embedding_components(df, 0.9999).collect()}
    assert len(set(got.values())) > 1 and all(got[k] == got[k - 1] for k in got if k - 1 in got)


def test_masking_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "write to a.b@example.com now", "own", 3, "c")], "doc_id long, text string, base string, spans int, candidates string")
    got = mask_personal_data(df)
    assert got.columns == df.columns
    assert tuple(got.first()) == (1, "write to [EMAIL] now", "own", 3, "c")


def test_url_columns_of_any_name(spark):
    rows = [(k, f"http://{'a' if k % 2 else 'b'}{k}.{'org' if k % 2 else 'com'}/{'x' if k % 2 else 'de'}/{k}", "keep") for k in range(40)] + [(99, "http://else.net/" + "p" * 50_000, "keep"), (100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, length string").withColumn("depth", F.lit("d")).withColumn("__label", F.lit("l"))
    got = judge_urls(df, [("allow", "org/"), ("block", "com/de/")])
    assert got.columns == [*df.columns, "host", "path", "rule", "verdict"]
    assert {(r["length"], r["depth"], r["__label"]) for r in got.where("page_id < 100").collect()} == {("keep", "d", "l")}
    assert {r["verdict"] for r in got.collect()} == {"allow", "block"}


def test_grades_do_not_depend_on_the_sample(spark):
    rng = random.Random(3)
    calm, bad = [f"w{k}" for k in range(300)], ["zorg", "blurk", "frix"]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = [rng.choice(calm) for _ in range(200)]
        for k in range(rng.choice([1, 4, 10]) if toxic else 0):
            words[k * 7] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, 0), (None, 1), (5, None)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert [len(fit_toxicity(d, lab, rows).thresholds) for rows in (150, 1200)] == [3, 3]


def test_queries_in_turns(spark, monkeypatch):
    from sessionlab.llm import vector_search
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {tuple(r) for r in nearest(df, every=5, wanted=1.0).collect()}
    monkeypatch.setattr(vector_search, "TURN", 7)
    monkeypatch.setattr(vector_search, "PART", 9)
    assert {tuple(r) for r in nearest(df, every=5, wanted=1.0).collect()} == want and len(want) == 400


def test_gazetteer_finds_names_and_spares_places(spark):
    rng = random.Random(4)
    given, family = ["Maria", "John", "Hans", "Claire"], ["Gonzalez", "Smith", "Weber", "Dupont"]
    rows = []
    for i in range(300):
        name = f"{rng.choice(given)} {rng.choice(family)}"
        rows.append((i, f"Please contact {name} at the desk; password: {rng.choice(['aB3dE5gH9', 'Xk29fQ7zT1'])} is set, call 555-123-{1000 + i}."))
    rows += [(1000 + i, f"They met near {rng.choice(given)} {w} and the password: {p}") for i, (w, p) in enumerate(
        [("Street", "required"), ("Park", "changeme"), ("University", "placeholder"), ("Avenue", "forgotten")] * 20)]
    got = {r["doc_id"]: [(s["kind"], s["found"]) for s in r["spans"]] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    person = KINDS.index("person")
    for i, text in rows:
        names = [f for k, f in got[i] if k == person]
        if i < 1000:
            assert len(names) == 1 and names[0] in text
        else:
            assert names == []
