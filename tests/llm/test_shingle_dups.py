"""Near-dedup by exact Jaccard similarity against all pairs, and the pipeline's stage on copies that SimHash leaves apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import shingle_dups as J
from tessera.llm import simhash_dups as H
from tests.llm.test_ops_dups import EDGE, frame, union_find


def jaccard_sets(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not a and not b or 5 * len(a & b) >= 4 * len(a | b)


def copies(seed, count, words=120, edits=6):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(words)] for _ in range(8)]
    rows = []
    for i in range(count):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(900)}"
        rows.append((i, " ".join(own[: rng.choice([words, words, words - 12])])))
    return rows


@pytest.mark.parametrize("hot", [J.HOT, 3])
def test_keep_one_against_all_pairs(spark, hot):
    rows = copies(3, 110) + EDGE + [(2000, "a b"), (2001, "A  b"), (2002, "a b c")]
    sets = [jaccard_sets(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    assert 20 < len(set(root)) < 100
    want = sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))
    assert sorted(r.doc_id for r in J.keep_one(frame(spark, rows), hot=hot).collect()) == want
    assert J.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_the_stage_drops_copies_of_similarity_over_08(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    near = list(words)
    for at in (20, 90):
        near[at] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))]
    assert bin(H.fingerprint(rows[0][1], 5) ^ H.fingerprint(rows[1][1], 5)).count("1") > 3 and alike(jaccard_sets(rows[0][1]), jaccard_sets(rows[1][1]))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()) == [1, 3]


def test_shared_keys_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randrange(12), rng.randrange(4), 7) for _ in range(40)) + [(99, 1, 7), (99, 1, 7)]
    want = sorted({(k, s) for k, s, _ in rows if len({x for y, x, _ in rows if y == k}) > 1})
    for size in (1, 2, 3, 50):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array([r[c] for r in p], np.int64)) for c in range(3)], ["k", "s", "n"]) for p in parts]
        got = [(k, s) for b in J._shared(iter(batches)) for k, s in zip(b.column("k").to_pylist(), b.column("s").to_pylist(), strict=True)]
        assert got == want


def stage_rows(spark, rows):
    """The texts and set rows that the stage works on, and what all pairs say of distinct sets: {(a, b)} of similar ones."""
    docs = frame(spark, rows)
    texts = docs.select("text")
    tagged = docs.select(F.col("doc_id").alias("key"), "text", F.xxhash64("text").alias("tag"))
    found = J.arrow_map(tagged, J._sets(J.arrow_type(docs, "doc_id"), 5), f"key bigint, tag bigint, s bigint, n int, {', '.join(f'{c} bigint' for c in (*J.SKETCH, *H.WIDE))}").cache()
    sets = {J.set_hash(J.shingles(t)): J.shingles(t) for _, t in rows}
    order = sorted(sets)
    return texts, found, {(a, b) for i, b in enumerate(order) for a in order[:i] if J.similar(sets[a], sets[b])}


def test_simhash_finds_the_links_of_the_stage(spark):
    rows = copies(11, 260) + EDGE
    texts, found, want = stage_rows(spark, rows)
    links = [(r.a, r.b) for r in J.simhash_links(texts, found).collect()]
    assert len(want) > 200 and set(links) <= want
    nodes = sorted({x for pair in want for x in pair})
    place = {x: i for i, x in enumerate(nodes)}
    components = lambda pairs: len(set(union_find(len(nodes), [(place[a], place[b]) for a, b in pairs])))
    assert len(nodes) - components(links) >= 0.9 * (len(nodes) - components(want))


def test_the_stage_goes_through_simhash_and_loses_no_link_it_leaves(spark, monkeypatch):
    rows = copies(7, 60)
    sets = [jaccard_sets(t) for _, t in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    want, calls, real = sorted(rows[i][0] for i in set(root)), [], J.wide_candidates
    for share in (1, 0):  # all candidates of SimHash, then none
        monkeypatch.setattr(J, "wide_candidates", lambda *a, share=share: calls.append(1) or real(*a).limit(share * 1_000_000))
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()) == want
    assert len(calls) == 2


def test_pairs_of_small_and_large_keys():
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    rows = []
    for k, n in enumerate((1, 2, 3, 33, 63, 64, 65, 150)):
        for _ in range(n):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            rows.append((k, len(rows), int(centres[rng.integers(5)]) ^ flips))
    k, s, fp = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (np.int64, np.int64, np.uint64), strict=True))
    a, b = H._wide_pairs(k, s, fp.view(np.int64))
    near = [(x, y) for y in range(len(rows)) for x in range(y) if k[x] == k[y] and (rows[x][2] ^ rows[y][2]).bit_count() <= H.WIDE_DISTANCE]
    got = list(zip(a.tolist(), b.tolist(), strict=True))
    assert set(got) <= set(near) and len(got) <= 2 * len(rows)
    apart = lambda p: (rows[p[0]][2] ^ rows[p[1]][2]).bit_count()
    for side in (0, 1):  # the closest row of each row, behind and before
        closest = lambda pairs: {p[side]: min(apart(q) for q in pairs if q[side] == p[side]) for p in pairs if k[p[0]] < 6}
        assert closest(got) == closest(near)
    large = lambda pairs: union_find(len(rows), [p for p in pairs if k[p[0]] >= 6])
    assert large(got) == large(near)
