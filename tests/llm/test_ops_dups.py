"""Operators on pairs and repeats against brute force: line dedup, tiling, suffix dedup, SimHash, components, pipeline."""

from __future__ import annotations

import glob
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm import line_dups as L
from tessera.llm import simhash_dups as H
from tessera.llm import suffix_dups as S
from tessera.llm._arrow import cut, cut_to_table
from tessera.llm.graph import components

EDGE = [(1000, None), (1001, ""), (1002, " "), (1003, "\n"), (1004, "\n\nsame line that is long enough\n"), (1005, "same line that is long enough"), (1006, "w " * 60_000), (1007, "x"), (1007, "x")]


def frame(spark, rows, extra="clash"):
    return spark.createDataFrame([(i, t, extra) for i, t in rows], "doc_id long, text string, key string").repartition(3)


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


# --- components --------------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_noise(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 80)]
    rows = [*path, *star, (7, 7), (9, 8), (9, 8), (None, 3), (3, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(80)}, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [0, 40, 1 << 18])
def test_components_in_one_task_and_in_steps(spark, small):
    rng = random.Random(4)
    rows = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)] + [(-(1 << 62), 1 << 62), (None, 5)]
    nodes = sorted({x for a, b in rows for x in (a, b) if a is not None and a != b})
    place = {x: i for i, x in enumerate(nodes)}
    root = union_find(len(nodes), [(place[a], place[b]) for a, b in rows if a is not None and a != b])
    least = {r: min(x for x in nodes if root[place[x]] == r) for r in set(root)}
    got = components(spark.createDataFrame(rows, "a long, b long"), small=small).collect()
    assert sorted((r.node, r.component) for r in got) == [(x, least[root[place[x]]]) for x in nodes]
    named_nodes = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "a string, b string"))
    assert {(r.node, r.component) for r in named_nodes.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_a_small_graph_takes_few_jobs(spark):
    context = spark.sparkContext
    context.setJobGroup("small graph", "")
    try:
        assert {r.component for r in components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).collect()} == {0}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("small graph")) <= 8


@pytest.mark.parametrize("store", [cut, cut_to_table])
def test_what_is_stored_leaves_no_shuffle_files(spark, store):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    counted, before = spark.range(500).groupBy((F.col("id") % 7).alias("k")).count(), files()
    stored = store(counted)
    assert not files() - before
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, counted.collect())) == [(k, 72 if k < 3 else 71) for k in range(7)]


# --- line dedup -----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(97, 99)), max_size=4))
def test_banded_and_bit_parallel_distances(a, b, changes):
    near = bytearray(a)
    for at, kind, c in changes:
        at = min(at, len(near))
        if kind == 0:
            near.insert(at, c)
        elif near and kind == 1:
            near.pop(min(at, len(near) - 1))
        elif near:
            near[min(at, len(near) - 1)] = c
    for x, y in ((a, b), (a, bytes(near))):
        want = edits(x, y)
        assert L.edit_distance(x, y) == want
        raw = np.frombuffer(x + y + b" ", np.uint8)
        assert L.banded(raw, np.array([[0, len(x)]]), raw, np.array([[len(x), len(y)]]))[0] == (want <= L.EDITS)


@settings(max_examples=100, deadline=None)
@given(st.integers(24, 70), st.lists(st.tuples(st.integers(0, 70), st.integers(0, 2)), min_size=1, max_size=2))
def test_linked_lines_share_a_probe(n, changes):
    rng = random.Random(n)
    a = [rng.randrange(256) for _ in range(n)]
    b = a[:]
    for at, kind in changes:
        at = min(at, len(b) - 1)
        if kind == 0:
            b.insert(at, 300)
        elif kind == 1:
            b.pop(at)
        else:
            b[at] = 301
    short, long = sorted((a, b), key=len)
    hits = [(i, p) for i, p, size in L.probes(len(long), len(short)) if long[p : p + size] == short[L.segments(len(short))[i][0] :][:size]]
    assert hits
    plan = {(d, i, s) for d, i, s in L._probe_plan()}
    assert all(((len(long) - len(short), i, p - L.segments(len(short))[i][0]) in plan) or (len(long) == len(short) and p == L.segments(len(short))[i][0]) for i, p in hits)


def line_oracle(rows):
    lines = sorted((i, n, x) for i, t in rows if t for n, x in enumerate(t.split("\n")) if x)
    raw = [x.encode() for *_, x in lines]
    links = [(i, j) for i in range(len(raw)) for j in range(i) if raw[i] == raw[j] or (min(len(raw[i]), len(raw[j])) >= L.LONG_LINE and abs(len(raw[i]) - len(raw[j])) <= 2 and edits(raw[i], raw[j]) <= L.EDITS)]
    root = union_find(len(lines), links)
    gone = {lines[i][:2] for i in range(len(lines)) if root[i] != i}
    return {i: t if not t else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


@pytest.mark.parametrize("group", [L.GROUP, 4])
def test_line_dedup_against_brute_force(spark, group):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 50))) for _ in range(25)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("xyzé")
            lines.append(rng.choice(["".join(x)] * 6 + ["", "ab"]))
        rows.append((i, "\n".join(lines)))
    rows += EDGE[:6]
    got = {r.doc_id: r for r in L.dedup_lines(frame(spark, rows), group=group).collect()}
    want = line_oracle(rows)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_lines == (len(t.split("\n")) if t else 0)
        assert (got[i].n_removed > 0) == (want[i] != t and want[i] is not None)


def test_line_dedup_keeps_columns_and_repeats(spark):
    df = frame(spark, EDGE)
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"] and out.count() == len(EDGE)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(7, "x\ny"), (7, "z\nx"), (None, "p\nq"), (None, "r\np"), (8, "u\nv"), (9, "w\nu")]
    out = [(r.doc_id, r.text) for r in L.dedup_lines(frame(spark, rows)).collect()]
    assert sorted((str(i), x) for i, t in out for x in t.split("\n")) == sorted([("7", "x"), ("7", "y"), ("7", "z"), ("None", "p"), ("None", "q"), ("None", "r"), ("8", "u"), ("8", "v"), ("9", "w")])


# --- greedy string tiling ---------------------------------------------------------------------------------------------


def greedy(item, doc, shortest):
    """Plain definition: the longest common unmarked run first, again and again."""
    shortest, mi, md, out = min(shortest, len(item)), set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and i + k not in mi and d + k not in md and item[i + k] == doc[d + k]:
                    k += 1
                best = max(best, (k, -i, -d))
        k, i, d = best[0], -best[1], -best[2]
        if k < max(1, shortest):
            return out
        mi |= set(range(i, i + k))
        md |= set(range(d, d + k))
        out += k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=30, unique=True), st.data())
def test_tiles_of_reordered_passages(item, data):
    cuts = sorted(data.draw(st.sets(st.integers(0, len(item)), max_size=4)) | {0, len(item)})
    parts = [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    data.draw(st.randoms()).shuffle(parts)
    doc = [x for p in parts for x in [9999, *p]]
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    found = D.tiles(a, b, 5)
    assert sum(k for *_, k in found) == greedy(item, doc, 5)
    assert all((a[i : i + k] == b[d : d + k]).all() for i, d, k in found)
    assert len({x for i, _, k in found for x in range(i, i + k)}) == sum(k for *_, k in found)


def test_tiles_with_repeats_stay_disjoint():
    a, b = np.array([1, 2, 3] * 6, np.uint64), np.array([1, 2, 3] * 9, np.uint64)
    assert D.coverage(a, b, 5) == 1.0
    assert D.coverage(np.zeros(0, np.uint64), b, 5) == 0.0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=35), st.sampled_from([D.DENSE, -1]))
def test_tiles_of_repeated_words_against_the_plain_definition(item, doc, dense):
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    before, D.DENSE = D.DENSE, dense  # -1: always row by row
    try:
        assert sum(k for *_, k in D.tiles(a, b, 5)) == greedy(item, doc, 5)
    finally:
        D.DENSE = before


def test_tiles_of_many_equal_words_are_bounded():
    same = np.full(6000, 7, np.uint64)
    start = time.process_time()
    assert D.tiles(same, same) == [(0, 0, 6000)] and time.process_time() - start < 30


def test_both_paths_of_decontamination_equal_brute_force(spark):
    rng = random.Random(4)
    words = lambda n, v: [f"k{rng.randrange(v)}" for _ in range(n)]
    bench = [(i if i % 4 else None, " ".join(words(rng.choice([3, 12, 25]), 60))) for i in range(14)]
    bench += [bench[1], (1, bench[2][1]), (None, bench[3][1]), (77, ""), (78, None)]
    rows = []
    for i in range(40):
        parts = [words(20, 60)] + [(t or "").split()[rng.randrange(3) :] for _, t in rng.sample(bench, 2)]
        rng.shuffle(parts)
        rows.append((rng.choice([None, 1, 2, i]), " ".join(w for p in parts for w in p)))
    rows += [(5, None), (None, None), (5, ""), rows[0], (1, " ".join(["k1"] * 3000)), (2, bench[5][1].upper())]
    bench += [(90, " ".join(["k1"] * 300))]

    def plain(text):
        shares = [(i, hashlib.md5((t or "").encode()).hexdigest(), greedy(t.split(), (text or "").lower().split(), 5) / len(t.split())) for i, t in bench if t and t.split()] if len(text or "") < 5000 else None
        if shares is None:
            return (90,), 1.0
        hits = sorted(((i is not None, i or 0, h) for i, h, c in shares if c >= D.COVERAGE))
        return tuple(i if known else None for known, i, _ in hits), max((c for *_, c in shares), default=0.0)

    want = sorted((repr(i), repr(plain(t)[0]), round(plain(t)[1], 9)) for i, t in rows)
    b = spark.createDataFrame(bench, "item_id long, text string").repartition(3)
    for limit in (D.BROADCAST_WORDS, 1):
        got = D.decontaminate(frame(spark, rows), b, broadcast_words=limit).collect()
        assert sorted((repr(r.doc_id), repr(tuple(r["items"])), round(r.coverage, 9)) for r in got) == want
        assert all(r.n_items == len(r["items"]) and r.contaminated == (r.n_items > 0) for r in got)


def test_decontamination_finds_passages(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"q{i}w{j}" for j in range(30))) for i in range(8)] + [(8, "tiny item"), (9, None), (10, "")]
    filler = lambda: " ".join(f"f{rng.randrange(5000)}" for _ in range(40))
    words = [t.split() if t else [] for _, t in items]
    rows = [(0, filler()), (1, f"{filler()} {items[0][1].upper()} {filler()}"), (2, filler() + " " + " ".join(words[1][15:] + ["zz"] + words[1][:15])), (3, " ".join(words[2][:10])), (4, "a tiny item here"), (5, " ".join(words[3]) + " " + " ".join(words[4])), *EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (D.BROADCAST_WORDS, 1):
        got = {r.doc_id: r for r in D.decontaminate(frame(spark, rows), bench, broadcast_words=limit).collect()}
        assert {i: sorted(r["items"]) for i, r in got.items() if r.contaminated} == {1: [0], 2: [1], 4: [8], 5: [3, 4]}
        assert got[2].coverage == 1.0 and got[3].coverage == pytest.approx(1 / 3) and got[1000].coverage == 0.0
    assert D.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert D.decontaminate(frame(spark, rows).limit(0), bench).count() == 0


# --- suffix dedup --------------------------------------------------------------------------------------------------------


def repeats(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                mark[i : i + n] = b"\1" * n
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


def repetitive(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(200)) for _ in range(8)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            at = rng.randint(0, 150)
            t += rng.choice(base)[at : at + rng.randint(20, 120)] if kind < 0.5 else "ab" * rng.randint(1, 60) if kind < 0.6 else "x" * rng.randint(1, 120) if kind < 0.65 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 120)))
        out.append(t)
    return [*out, out[2], out[2], "", "short"]


@pytest.mark.parametrize("hot", [S.HOT_BYTES, 200])
def test_suffix_dedup_against_brute_force(spark, hot):
    texts = repetitive(5, 60)
    rows = [*enumerate(texts), (900, None)]
    want = dict(zip([i for i, _ in rows], repeats([(t or "").encode() for _, t in rows], 40), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(frame(spark, rows), length=40, hot_bytes=hot).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_suffix_dedup_edges(spark):
    out = S.remove_repeats(frame(spark, EDGE), with_kept=True).collect()
    assert len(out) == len(EDGE)
    long = next(r for r in out if r.doc_id == 1006)
    assert (long.n_removed, long.n_spans, bytes(long.kept)) == (120_000, 1, b"")
    assert all(bytes(r.kept).decode() == (dict(EDGE)[r.doc_id] or "") for r in out if r.doc_id != 1006)
    assert S.remove_repeats(frame(spark, EDGE).limit(0)).count() == 0


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "SCAN_BYTES", 1000)
    text = "".join(random.Random(3).choice("abc") for _ in range(5000))
    part = pa.record_batch({"text": pa.array([text, "tail " * 10])})
    starts = []
    for raw, offsets, rows, begins in S._pieces(part, 100):
        _, of, first, last, _ = S._segments(raw, offsets, 100)
        starts += [(int(rows[t]), int(begins[t]) + int(p) - int(offsets[t])) for t, a, b in zip(of, first, last, strict=True) for p in range(a, b + 1)]
    assert sorted(starts) == [(0, p) for p in range(4901)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=90).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6))
def test_prefix_free_order_finds_all_repeats(segments):
    count = Counter(s[i : i + 20] for s in segments for i in range(len(s) - 19))
    got = S.repeated_windows(segments, 20)
    assert [m.tolist() for m in got] == [[count[s[i : i + 20]] > 1 for i in range(len(s) - 19)] for s in segments]


# --- SimHash ---------------------------------------------------------------------------------------------------------------


def test_ring_filter_never_drops_a_link():
    rng = np.random.default_rng(0)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(3000)], np.uint64)
    close, passed = np.bitwise_count(x) <= H.DISTANCE, H.ring_passes(x)
    assert passed[close].all() and not passed[~close].all()
    keys = [set((i, int(v) & m) for i, m in enumerate(H.COMBINED)) for v in x]
    assert all(keys[i] & {(j, 0) for j in range(len(H.COMBINED))} for i in np.flatnonzero(close))


def test_forest_has_the_components_of_all_links():
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    want = union_find(len(f), [(i, j) for i in range(len(f)) for j in range(i) if bin(int(f[i] ^ f[j])).count("1") <= 3])
    p, c = H.forest(f)
    assert len(p) == len(f) - len(set(want)) and union_find(len(f), list(zip(p, c, strict=True))) == want


@pytest.mark.parametrize("group", [H.GROUP, 2])
def test_near_duplicates_against_brute_force(spark, group):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        rows.append((i, rng.choice([" ", "\n", "\t\v"]).join(words).replace("w1", "W1")))
    rows += EDGE
    prints = [H.fingerprint(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(frame(spark, rows), group=group).collect())
    assert got == sorted((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows)))
    kept = [r.doc_id for r in H.keep_one(frame(spark, rows), shingle=3, group=group).collect()] if group == H.GROUP else None
    assert kept is None or sorted(kept) == sorted(least.values())


def test_spark_hash_is_the_contract_hash(spark):
    import xxhash

    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_duplicates_of_an_empty_table(spark):
    assert H.near_duplicates(frame(spark, EDGE).limit(0)).count() == 0
