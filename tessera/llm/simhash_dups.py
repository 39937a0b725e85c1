"""SimHash near-dedup with pigeonring filtering.

Fingerprints: XXH64 of word shingles, majority of each bit. Documents of equal fingerprints collapse first
(a pre-aggregation). The 64 bits form a ring of SEGMENTS segments. Two fingerprints within 3 bits agree on
at least SEGMENTS - 3 segments, so every set of so many segments is a join key and each linked pair meets
under one. A pair that meets must pass the pigeonring: from some segment on, each chain of l consecutive
segments differs in at most l * 3 / SEGMENTS bits. Only then are all bits compared.

A key's fingerprints are linked by breadth-first search inside the task, which gives a spanning forest: as
many edges as fingerprints at most, never all pairs, and the same components. In a key with more than GROUP
fingerprints the bits that are no part of it form a ring of six segments again, of which linked fingerprints agree on
three too; so each is dealt to 20 keys of about 48 bits, and no key can have more than 2^17 fingerprints.

Similar sets of shingles (Jaccard 0.8, say) differ in far more than 3 bits. For them wide_candidates() takes wide
fingerprints of WIDE words. Their bits form rings, each in a seeded order and cut into segments that are keys; a segment
has about as many bits as the number of fingerprints has, and there are so many segments that MEET of the pairs at the
given similarity have one in common. Pairs that meet pass the pigeonring and the Hamming distance of the first word at
WIDE_DISTANCE bits. Of a key each fingerprint keeps the closest one before and behind it. These pairs are candidates for an exact check; what
never meets needs an exact way beside it.

Defined results: null, empty and white-space texts have fingerprint 0 and link like others; texts shorter
than a shingle are one shingle; repeated rows link; a null id keeps its row in near_duplicates (it names no
component), and keep_one tells rows apart by id and text hash; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, cut, named, pick, slices, typed
from tessera.llm._words import mixed
from tessera.llm.graph import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Bits of the ring's segments, from the lowest.
SEGMENT_BITS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a key that one task links; beyond, they are dealt to keys of more bits.
GROUP = 16_384
#: Words of 64 bits of a wide fingerprint, differing bits of its first word, share of similar pairs that meet.
WIDE, WIDE_DISTANCE, MEET = [f"p{i}" for i in range(4)], 18, 0.95
#: Wide fingerprints of a key up to which the closest are taken from all pairs; beyond, a spanning forest links them.
SMALL_GROUP = 64

_STARTS = np.concatenate([[0], np.cumsum(SEGMENT_BITS)])
MASKS = [((1 << b) - 1) << int(s) for b, s in zip(SEGMENT_BITS, _STARTS, strict=False)]
COMBINED = [sum(MASKS[i] for i in c) for c in itertools.combinations(range(len(MASKS)), len(MASKS) - DISTANCE)]


def _inner_masks(mask: int) -> list[int]:
    """The key masks of a ring over the bits outside of mask."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edges = [round(i * len(rest) / len(SEGMENT_BITS)) for i in range(len(SEGMENT_BITS) + 1)]
    parts = [sum(1 << b for b in rest[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(parts[i] for i in c) for c in itertools.combinations(range(len(parts)), len(parts) - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Plain definition, for one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _shingle_hashes(text: str, shingle: int, seed: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    if len(words) <= shingle:
        return [digest(joined, seed)]
    return [digest(joined[a : b - 1], seed) for a, b in zip(ends, ends[shingle:], strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): the id and the fingerprint as a signed long, for every row."""
    schema = pa.schema([("key", arrow_type(docs, id_col)), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = np.zeros(part.num_rows, np.uint64)
                for i, text in enumerate(part.column("text").to_pylist()):
                    hashes = np.array(_shingle_hashes(text or "", shingle, seed), np.uint64)
                    ones = np.zeros(64, np.int64)
                    for a in range(0, len(hashes), 1 << 16):
                        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
                yield named(schema, key=part.column("key"), fp=out.view(np.int64))

    return arrow_map(pick(docs, key=id_col, text=text_col), run, f"{typed(docs, id_col, 'key')}, fp bigint")


def ring_passes(x: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether differences x pass the pigeonring: some start whose chains all stay within their budgets."""
    m = len(MASKS)
    d = [np.bitwise_count(x & np.uint64(mask)) for mask in MASKS]
    out = np.zeros(x.shape, bool)
    for start in range(m):
        total = d[start]
        good = total <= distance // m
        for length in range(2, m):
            total = total + d[(start + length - 1) % m]
            good &= total <= length * distance // m
        out |= good
    return out


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """Edges (places) of a spanning forest of distinct fingerprints linked at `distance` bits or fewer."""
    left, parents, children = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            x = fps[left] ^ fps[u]
            near = np.flatnonzero(ring_passes(x, distance))
            near = near[np.bitwise_count(x[near]) <= distance]
            if len(near):
                found = left[near]
                parents += [u] * len(found)
                children += found.tolist()
                queue += found.tolist()
                left = np.delete(left, near)
    return parents, children


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by both: forest edges of each group of one k; groups may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def link(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        u = f.view(np.uint64)
        pairs = starts[sizes == 2]
        x = u[pairs] ^ u[pairs + 1]
        passed = ring_passes(x)
        passed[passed] = np.bitwise_count(x[passed]) <= DISTANCE
        a, b = [f[pairs[passed]]], [f[pairs[passed] + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            p, c = forest(u[s : s + n])
            a.append(f[s + np.array(p, np.int64)])
            b.append(f[s + np.array(c, np.int64)])
        return named(schema, a=np.concatenate(a), b=np.concatenate(b))

    for batch in batches:
        k = np.concatenate([held_k, batch.column("k").to_numpy()])
        f = np.concatenate([held_f, batch.column("fp").to_numpy()])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield link(k[:last], f[:last])
        held_k, held_f = k[last:], f[last:]
    if len(held_k):
        yield link(held_k, held_f)


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): edges between fingerprints (column fp, distinct) whose components are those of all links."""
    masks = F.array(*[F.lit(_signed(m)) for m in COMBINED])
    keys = distinct.select("fp", F.posexplode(masks).alias("i", "mask")).select("fp", "i", F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
    hot = cut(keys.groupBy("k").count().where(F.col("count") > group).select("k"))
    grouped = keys.select("k", "fp")
    if not hot.isEmpty():
        inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in _inner_masks(outer)]) for outer in COMBINED])
        dealt = keys.join(hot, "k", "left_semi").select("k", "fp", F.posexplode(F.element_at(inner, F.col("i") + 1)).alias("j", "mask")).select(F.xxhash64("k", "j", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp")
        grouped = keys.join(hot, "k", "left_anti").select("k", "fp").unionAll(dealt)
    return arrow_map(grouped.repartition("k").sortWithinPartitions("k", "fp"), _link_groups, "a bigint, b bigint")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The majority bits of shingle hashes, then those of the hashes remixed, as signed longs."""
    ones = np.zeros(64 * len(WIDE), np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a : a + (1 << 14)]
        words = np.stack([part, *[mixed(part + np.uint64(i)) for i in range(1, len(WIDE))]], axis=1)
        ones += np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def wide_masks(count: int, similarity: tuple[int, int]) -> np.ndarray:
    """The key masks (one row of words each) for so many fingerprints of sets whose Jaccard similarity matters from there on."""
    share = 2 * similarity[0] / (similarity[0] + similarity[1])  # cosine of two sets, at least
    agree = 1 - math.acos(min(share, 1)) / math.pi
    bits = max(8, math.ceil(math.log2(count + 1)))
    keys = math.ceil(math.log(1 - MEET) / math.log(1 - agree**bits)) if agree < 1 else 1
    rng, out = np.random.default_rng(SEED), []
    while len(out) < keys:
        ring = rng.permutation(64 * len(WIDE))
        for a in range(0, len(ring) - bits + 1, bits):
            chosen = np.zeros(len(ring), np.uint8)
            chosen[ring[a : a + bits]] = 1
            out.append(np.packbits(chosen, bitorder="little").view("<u8"))
    return np.stack(out[:keys])


def _deal_wide(masks: np.ndarray):
    """(k, s, fp): the keys of each wide fingerprint, with its set and first word."""
    schema = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, words = batch.column("s").to_numpy(), [batch.column(w).to_numpy().view(np.uint64) for w in WIDE]
            keys = []
            for i, mask in enumerate(masks):
                k = np.full(len(s), i, np.uint64)
                for word, part in zip(words, mask, strict=True):
                    k = mixed(k * np.uint64(31) + (word & part))
                keys.append(k)
            yield named(schema, k=np.concatenate(keys).view(np.int64), s=np.tile(s, len(masks)), fp=np.tile(words[0].view(np.int64), len(masks)))

    return run


def _wide_pairs(k: np.ndarray, s: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of sets of one key whose first words are close, at most two for each row; rows are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    u, small = fp.view(np.uint64), np.repeat(sizes <= SMALL_GROUP, sizes)
    left, right, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    at = np.flatnonzero(small)
    for step in range(1, min(SMALL_GROUP, int(sizes.max()))):
        at = at[at + step < len(k)]
        at = at[k[at] == k[at + step]]
        x = u[at] ^ u[at + step]
        near = np.flatnonzero(np.bitwise_count(x) <= WIDE_DISTANCE)
        near = near[ring_passes(x[near], WIDE_DISTANCE)]
        left.append(at[near])
        right.append(at[near] + step)
        bits.append(np.bitwise_count(x[near]))
    a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(bits)
    # Of each row the closest row before it and the closest behind it.
    best = [order[np.unique(side[order], return_index=True)[1]] for side in (a, b) for order in [np.argsort(d, kind="stable")]]
    chosen = np.unique(np.concatenate(best))
    left, right = [a[chosen]], [b[chosen]]
    for start, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        p, c = forest(u[start : start + n], WIDE_DISTANCE)
        left.append(start + np.array(p, np.int64))
        right.append(start + np.array(c, np.int64))
    a, b = s[np.concatenate(left)], s[np.concatenate(right)]
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def _meet_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, s, fp) sorted by k and s: the close pairs of each key; keys may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("k", "s", "fp"), strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last:
            a, b = _wide_pairs(*[x[:last] for x in rows])
            if len(a):
                yield named(schema, a=a, b=b)
        held = [x[last:] for x in rows]
    if len(held[0]):
        a, b = _wide_pairs(*held)
        yield named(schema, a=a, b=b)


def wide_candidates(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b), a < b: pairs of sets that are close by SimHash; sets holds s, once each, and the words of wide fingerprints."""
    keys = arrow_map(sets.select("s", *WIDE), _deal_wide(wide_masks(sets.count(), similarity)), "k bigint, s bigint, fp bigint")
    return arrow_map(keys.repartition("k").sortWithinPartitions("k", "s"), _meet_wide, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """id, fp (signed long), fingerprint (16 hex digits) and component_id for every row."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = fps.groupBy("fp").agg(F.min("key").alias("least"))
    linked = components(links(distinct.select("fp"), group))
    named_nodes = linked.join(distinct, linked["node"] == distinct["fp"]).select("node", "component", "least")
    least = named_nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named_nodes.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    # Stored, so that the optimizer can split a fingerprint of very many rows in the join with the rows.
    of_fp = cut(distinct.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(of_fp, "fp").select(F.col("key").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row with the smallest id of each component; rows holds key, tag (XXH64 of the text) and component of every row.

    Rows are told apart by id and text; rows that repeat both count as one. A null id is the largest.
    """
    sized = rows.groupBy("component", "key", "tag").agg(F.count("*").alias("n"))
    least = sized.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "tag", "n")).alias("r"))
    kept = cut(least.select(F.col("r.key").alias("__key"), F.col("r.tag").alias("__tag"), F.col("r.n").alias("__n")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__tag"))
    out = docs.join(kept.select("__key", "__tag"), same, "left_semi")
    return out if kept.where("__n > 1").isEmpty() else out.dropDuplicates([id_col, text_col])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """One row of each component, the one with the smallest id; rows that share an id are decided each."""
    row = F.struct(F.col(f"`{id_col}`").alias("key"), F.xxhash64(F.col(f"`{text_col}`")).alias("tag"))
    fps = cut(fingerprints(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", shingle, seed).select("key.key", "key.tag", "fp"))
    linked = components(links(fps.select("fp").distinct(), group)).withColumnRenamed("node", "fp")
    of_row = fps.join(linked, "fp", "left").select("key", "tag", F.coalesce("component", "fp").alias("component"))
    return one_of_each(docs, of_row, id_col, text_col)
