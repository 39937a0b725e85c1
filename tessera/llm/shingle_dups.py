"""Near-dedup by SimHash with an exact check: Jaccard similarity of word shingles. An exact set join finds what SimHash leaves apart.

Words are those of simhash_dups; a document is the set of its shingles' XXH64. Equal sets collapse first. Wide SimHash
fingerprints of the sets meet under ring keys and pass the pigeonring and the Hamming distance (simhash_dups.wide_candidates);
their texts are compared if sizes and sketches (below) allow it, first each set with its most central candidate, then candidates whose components differ. These
links find most copies, but no number of bits can promise a similarity, so a set join runs between the components
that SimHash made and no link is lost: two sets of similarity SIMILARITY or more share a shingle among the first n - ceil(SIMILARITY x n) + 1 of each in
any common order, so these are the join keys and no linked pair is missed. The order is by hash, with the keys
of more than HOT sets last; it changes the cost only.

Each set has a sketch of SKETCH_BITS parity bits of its hashes. A shingle that only one of two sets holds flips one
bit, so sketches that differ in more bits than linked sets may differ in shingles rule a pair out inside the join.
Two sets share no more than their common keys and what the larger one has beyond its keys, so pairs with too few
common keys can't link either. Keys all of whose sets are in one component of SimHash's links are done. The pairs of
others are compared with their texts, in rounds: the first takes each key's sets
with its most central one (the set with the most shared keys), the second with the most central one of another
component, which joins large groups of copies by few pairs; the last round takes all pairs of a key whose components
still differ, so no link between components is missed. Documents of one component are near-duplicates of each other.

Defined results: null, empty and white-space texts are one empty set; texts shorter than a shingle are one
shingle; rows are told apart by id and text, so rows that share an id, a null one too, are decided each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, cut, cut_to_table, named, pick, slices, typed
from tessera.llm.graph import components
from tessera.llm.simhash_dups import SEED, WIDE, _shingle_hashes, one_of_each, wide_candidates, wide_fingerprint

#: Words of a shingle; similarity of linked documents as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Sets of a key from which it goes last in the order, and how many such keys are told to all tasks.
HOT, HOT_KEYS = 100, 100_000
#: Parity bits of a set, in longs of 64.
SKETCH_BITS = 256
SKETCH = [f"q{i}" for i in range(SKETCH_BITS // 64)]
#: Sets that a task remembers in order not to send the keys of a copy again.
REMEMBERED = 1 << 17


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.array(_shingle_hashes(text or "", shingle, SEED), np.uint64))


def set_hash(own: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0
    return h - (1 << 64) if h >= 1 << 63 else h


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * similarity[1] >= similarity[0] * (len(a) + len(b) - common)


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits of a set of hashes, as signed longs."""
    bit = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _sets(key_type: pa.DataType, shingle: int):
    """(key, tag, s, n, sketch, fingerprint) of every row: the hash and size of its set, the set's parity bits and its wide SimHash."""
    schema = pa.schema([("key", key_type), ("tag", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), *[(c, pa.int64()) for c in (*SKETCH, *WIDE)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                own = [shingles(t, shingle) for t in part.column("text").to_pylist()]
                bits = np.stack([np.concatenate([sketch(x), wide_fingerprint(x)]) for x in own])
                yield named(schema, key=part.column("key"), tag=part.column("tag"), s=[set_hash(x) for x in own], n=[len(x) for x in own], **{c: np.ascontiguousarray(bits[:, i]) for i, c in enumerate((*SKETCH, *WIDE))})

    return run


def _keys(shingle: int, similarity: tuple[int, int], late: np.ndarray):
    """(k, s, n): the keys of each set that isn't empty, with its hash and size; `late` keys go last in the order."""
    schema = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                keys, hashes, sizes = [np.zeros(0, np.uint64)], [], []
                for text in part.column("text").to_pylist():
                    own = shingles(text, shingle)
                    s, n = set_hash(own), len(own)
                    if not n or s in seen:
                        continue
                    seen.add(s)
                    if len(late):
                        hot = np.isin(own, late)
                        own = np.concatenate([own[~hot], own[hot]])
                    keys.append(own[: n + (-over * n // under) + 1])
                    hashes.append(s)
                    sizes.append(n)
                counts = [len(x) for x in keys[1:]]
                yield named(schema, k=np.concatenate(keys).view(np.int64), s=np.repeat(np.array(hashes, np.int64), counts), n=np.repeat(np.array(sizes, np.int32), counts))
                if len(seen) > REMEMBERED:
                    seen.clear()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, s, n) sorted by k and s: each once, without keys of one set. One row is held between batches."""
    schema = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int32())])
    held, sent = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
    for batch in batches:
        if not batch.num_rows:
            continue
        k, s, n = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("k", "s", "n"), strict=True))
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        k, s, n = k[fresh], s[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        out = np.repeat(sizes > 1, sizes)
        last = bool(out[-1]) or (sent and len(k) == 1)
        if sent:  # the held row went out before
            out[0] = False
        if out.any():
            yield named(schema, k=k[out], s=s[out], n=n[out])
        held, sent = [k[-1:], s[-1:], n[-1:]], last


def _verified(shingle: int, similarity: tuple[int, int]):
    """(a, b) of the pairs whose texts are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if last is None or last[0] != a[i]:
                    last = (a[i], shingles(batch.column("text_a")[i].as_py(), shingle))
                good[i] = similar(last[1], shingles(batch.column("text_b")[i].as_py(), shingle), similarity)
            if good.any():
                yield named(schema, a=np.array(a, np.int64)[good], b=np.array(b, np.int64)[good])

    return run


def _verify(texts: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of sets that are similar by their texts."""
    # One text of each set of a pair; equal texts have equal tags.
    wanted = rows.join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s").groupBy("s").agg(F.min("tag").alias("tag"))
    found = cut_to_table(texts.withColumn("tag", F.xxhash64("text")).join(wanted, "tag").groupBy("s").agg(F.first("text").alias("text")))
    sides = pairs.join(found.select(F.col("s").alias("b"), F.col("text").alias("text_b")), "b").join(found.select(F.col("s").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(arrow_map(sides.select("a", "b", "text_a", "text_b"), _verified(shingle, similarity), "a bigint, b bigint"))


def _may_link(similarity: tuple[int, int]):
    """Of two sets (n, sketch) and (m, osketch): whether sizes and sketches allow the similarity, and the shingles it takes in common."""
    over, under = similarity
    fits = F.least("n", "m") * under >= F.greatest("n", "m") * over
    both = F.ceil((F.col("n") + F.col("m")) * over / (over + under) - 1e-6)
    differ = sum((F.bit_count(F.col(q).bitwiseXOR(F.col(f"o{q}"))) for q in SKETCH), F.lit(0))
    return fits & (differ <= F.col("n") + F.col("m") - 2 * both), both


def simhash_links(texts: DataFrame, rows: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b): links between sets that SimHash finds, exactly checked; rows holds the (tag, s, n, sketch, fingerprint) of all texts."""
    sets = cut(rows.groupBy("s").agg(*[F.first(c).alias(c) for c in ("n", *SKETCH, *WIDE)]))
    one = sets.select(F.col("s").alias("a"), "n", *SKETCH)
    other = sets.select(F.col("s").alias("b"), F.col("n").alias("m"), *[F.col(q).alias(f"o{q}") for q in SKETCH])
    close = cut(wide_candidates(sets, similarity).join(one, "a").join(other, "b").where(_may_link(similarity)[0]).select("a", "b"))
    both = close.unionAll(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.join(both.groupBy("b").agg(F.count("*").alias("score")), "b").groupBy("a").agg(F.max(F.struct("score", "b")).alias("lead"))
    first = lead.select(F.least("a", "lead.b").alias("a"), F.greatest("a", "lead.b").alias("b")).distinct()
    linked = _verify(texts, rows, cut(first), shingle, similarity)
    # Of the other pairs those matter whose components still differ.
    of_set = components(linked)
    sides = close.join(first, ["a", "b"], "left_anti").join(of_set.select(F.col("node").alias("a"), F.col("component").alias("c")), "a", "left").join(of_set.select(F.col("node").alias("b"), F.col("component").alias("d")), "b", "left")
    apart = sides.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")
    return linked.unionAll(_verify(texts, rows, cut(apart), shingle, similarity))


def set_links(docs: DataFrame, rows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(node, component) of sets that link; rows holds the (tag, s, n, sketch, fingerprint) of all texts."""
    texts = pick(docs, text=text_col)
    linked = components(simhash_links(texts, rows, shingle, similarity))

    def share(late: np.ndarray) -> DataFrame:
        keys = arrow_map(texts, _keys(shingle, similarity, late), "k bigint, s bigint, n int")
        return cut_to_table(arrow_map(keys.repartition("k").sortWithinPartitions("k", "s"), _shared, "k bigint, s bigint, n int"))

    shared = share(np.zeros(0, np.uint64))
    late = shared.groupBy("k").count().where(F.col("count") > hot).orderBy(F.col("count").desc()).limit(HOT_KEYS).collect()
    if late:
        shared = share(np.array([r.k for r in late], np.int64).view(np.uint64))

    over, under = similarity
    near, both = _may_link(similarity)
    # Of the larger set, ceil(similarity x size) - 1 shingles are no keys.
    needed = both - F.ceil(F.greatest("n", "m") * over / under - 1e-6) + 1
    of_set = rows.groupBy("s").agg(*[F.first(q).alias(q) for q in SKETCH]).join(shared.groupBy("s").agg(F.count("*").alias("score")), "s")
    side = ["s", "n", "c", *SKETCH]
    opposite = lambda x: [x("s").alias("o"), x("n").alias("m"), x("c").alias("d"), *[x(q).alias(f"o{q}") for q in SKETCH]]
    left = None
    for leaders in (1, 2, None):
        of_node = linked.select(F.col("node").alias("s"), "component")
        component = F.coalesce("component", "s").alias("c")
        named_sets = (shared if left is None else left).select("k", "s").join(of_node, "s", "left").select("k", component)
        open_keys = named_sets.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("k")
        rest = (shared.join(open_keys, "k").join(of_set, "s") if left is None else left.join(open_keys, "k")).join(of_node, "s", "left")
        left = cut_to_table(rest.select("k", "s", "n", *SKETCH, "score", component))
        central = lambda df: df.groupBy("k").agg(F.max(F.struct("score", *side)).alias("lead"))
        if leaders == 2:
            first = central(left).select("k", F.col("lead.c").alias("first"))
            lead = central(left.join(first, "k").where("c <> first"))
        elif leaders == 1:
            lead = central(left)
        if leaders is not None:
            other = lead.select("k", *opposite(lambda name: F.col(f"lead.{name}")))
            apart = F.col("s") != F.col("o")
        else:
            other = left.select("k", *opposite(F.col))
            apart = F.col("s") > F.col("o")
        pairs = left.join(other, "k").where(apart & (F.col("c") != F.col("d")) & near)
        counted = pairs.groupBy(F.col("o").alias("a"), F.col("s").alias("b"), "n", "m").agg(F.count("*").alias("common"))
        found = _verify(texts, rows, cut(counted.where(F.col("common") >= needed).select("a", "b")), shingle, similarity)
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found))
    return linked


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row of each component of similar documents, the one with the smallest id; a null id is the largest."""
    frame = pick(docs, key=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))
    rows = cut(arrow_map(frame, _sets(arrow_type(docs, id_col), shingle), f"{typed(docs, id_col, 'key')}, tag bigint, s bigint, n int, {", ".join(f"{c} bigint" for c in (*SKETCH, *WIDE))}"))
    linked = set_links(docs, rows, text_col, shingle, similarity, hot)
    of_row = rows.join(linked.withColumnRenamed("node", "s"), "s", "left").select("key", "tag", F.coalesce("component", "s").alias("component"))
    return one_of_each(docs, of_row, id_col, text_col)
