"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH words of a benchmark item (all of a shorter item). Documents that share a seed
with an item are candidates for it. For each candidate pair, tiles are the longest common runs of words,
found by running Karp-Rabin hashes of falling length, marked without overlap, the longest first; tiles may
come in any order, so reordered passages count. The share of an item's words under tiles is its coverage;
a document is contaminated if the coverage of some item reaches the threshold.

Tiling: common runs are read off the diagonals, from the equal seeds where these are few and row by row where words
repeat so much that they are many, with the same runs. The longest goes first; a run that lost a part to a longer
tile returns with what is left of it. So equal words over both texts cost one row operation a word.

The seed index of the benchmark is broadcast if the benchmark has at most BROADCAST_WORDS words; a larger
benchmark meets the documents in a shuffled join on seeds, with the same result. There, texts stand for their rows,
seeds are dealt over SALTS tasks, and a document's text moves once, its items' texts after it.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased.
Defined results: null and empty texts match nothing; an item without words is never covered; every row of either
table is judged by its text, whatever its id (ids may repeat or be null), and every benchmark row counts; items are
listed by id, null first, then by the MD5 of their texts; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, cut, named, pick, slices, typed, utf8
from tessera.llm._words import PRIME, gram_hashes, word_hashes, words_of

#: Words of the shortest tile and of a seed; share of an item's words that makes a document contaminated.
MIN_MATCH, COVERAGE = 5, 0.5
#: Benchmark words up to which the index is broadcast: 8 bytes a word and 16 a seed, 48 MB at most.
BROADCAST_WORDS = 2_000_000
#: Tasks over which a seed's documents are dealt in the join.
SALTS = 8
#: Equal seeds for each word of the two texts from which runs are read row by row.
DENSE = 4


def _sparse_runs(item: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray | None:
    """(words, place in item, place in doc) of all maximal common runs from the pairs of equal seeds; None if these are too many."""
    seeds_i, seeds_d = gram_hashes(item, shortest), gram_hashes(doc, shortest)
    order = np.argsort(seeds_i, kind="stable")
    ranked = seeds_i[order]
    lo, hi = np.searchsorted(ranked, seeds_d, side="left"), np.searchsorted(ranked, seeds_d, side="right")
    counts = hi - lo
    total = int(counts.sum())
    if total > DENSE * (len(item) + len(doc)):
        return None
    d = np.repeat(np.arange(len(seeds_d)), counts)
    i = order[np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)]
    same = np.ones(total, bool)
    for k in range(shortest):
        same &= item[i + k] == doc[d + k]
    i, d = i[same], d[same]
    by = np.lexsort((d, d - i))
    i, d = i[by], d[by]
    new = np.ones(len(i), bool)
    new[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([np.diff(np.append(first, len(i))) + shortest - 1, i[first], d[first]], axis=1)


def _dense_runs(item: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """The same runs, a row of the item at a time; memory holds two rows and the runs."""
    found, run = [], np.zeros(len(doc) + 1, np.int64)
    for i in range(len(item) + 1):
        now = np.zeros_like(run)
        if i < len(item):
            now[1:] = np.where(doc == item[i], run[:-1] + 1, 0)
        # A run that ends in the row before, at doc place d - 1, isn't continued at d.
        ended = run >= shortest
        ended[:-1] &= now[1:] == 0
        d = np.flatnonzero(ended)
        found.append(np.stack([run[d], i - run[d], d - run[d]], axis=1))
        run = now
    return np.concatenate(found)


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of greedy string tiling over two arrays of word hashes."""
    shortest = min(shortest, len(item))
    if not shortest or len(doc) < shortest:
        return []
    runs = _sparse_runs(item, doc, shortest)
    if runs is None:
        # Only words of the document under a seed can lie under a tile; a word of the rest parts them.
        hit = np.flatnonzero(np.isin(gram_hashes(doc, shortest), gram_hashes(item, shortest)))
        under = np.zeros(len(doc) + 1, np.int64)
        np.add.at(under, hit, 1)
        np.add.at(under, hit + shortest, -1)
        at = np.flatnonzero(np.cumsum(under[:-1]) > 0)
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        at = np.insert(at, gaps, -1)
        stopper = np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[0]
        runs = _dense_runs(item, np.where(at < 0, stopper, doc[at]), shortest)
        runs[:, 2] = at[runs[:, 2]]
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    heap = [(-k, i, d) for k, i, d in runs.tolist()]
    heapq.heapify(heap)
    out: list[tuple[int, int, int]] = []
    while heap:
        k, i, d = heapq.heappop(heap)
        free = free_i[i : i - k] & free_d[d : d - k]
        if free.all():
            free_i[i : i - k] = False
            free_d[d : d - k] = False
            out.append((i, d, -k))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= shortest:
                heapq.heappush(heap, (a - b, i + a, d + a))
    return out


def coverage(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_MATCH) -> float:
    return sum(k for _, _, k in tiles(item, doc, shortest)) / len(item) if len(item) else 0.0


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(*words_of(raw, np.array([0, len(raw)]))[:3])


def seeds_of(words: np.ndarray, size: int = MIN_MATCH) -> np.ndarray:
    return gram_hashes(words, min(size, len(words))) if len(words) else np.zeros(0, np.uint64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = COVERAGE, min_match: int = MIN_MATCH, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """id, n_items int (items that reach the threshold), items array (their ids), coverage double (the largest
    of any item), contaminated boolean, for every document."""
    items = pick(benchmark, item=item_col, text=item_text_col)
    item_type = arrow_type(benchmark, item_col)
    result = pa.schema([("key", arrow_type(docs, id_col)), ("items", pa.list_(item_type)), ("coverage", pa.float64())])
    ddl = f"{typed(docs, id_col, 'key')}, items array<{benchmark.schema[item_col].dataType.simpleString()}>, coverage double"
    words = items.agg(F.sum(F.length("text")), F.count("*")).first()
    if (words[0] or 0) <= broadcast_words * 2 and words[1] <= broadcast_words:  # a word and what parts it take two characters at least
        found = _by_broadcast(docs, items, id_col, text_col, result, ddl, threshold, min_match)
    else:
        found = _by_join(docs, items, id_col, text_col, result, ddl, threshold, min_match)
    hits = F.size("items")
    return found.select(F.col("key").alias(id_col), hits.alias("n_items"), "items", "coverage", (hits > 0).alias("contaminated"))


def _by_broadcast(docs, items, id_col, text_col, result, ddl, threshold, min_match) -> DataFrame:
    rows = [(r.item, w) for r in items.orderBy("item", F.md5("text")).toLocalIterator() if len(w := _words(r.text))]
    sizes = sorted({min(min_match, len(w)) for _, w in rows})
    index = {}
    for size in sizes:
        own = [(seeds_of(w, min_match), i) for i, (_, w) in enumerate(rows) if min(min_match, len(w)) == size]
        seeds = np.concatenate([s for s, _ in own])
        owner = np.concatenate([np.full(len(s), i) for s, i in own])
        order = np.argsort(seeds, kind="stable")
        index[size] = (seeds[order], owner[order])
    shared = docs.sparkSession.sparkContext.broadcast((rows, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, index = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = utf8(part.column("text"))
                lower, starts, stops, begins = words_of(raw, offsets)
                hashes = word_hashes(lower, starts, stops)
                pairs: set[tuple[int, int]] = set()
                for size, (seeds, owner) in index.items():
                    grams = gram_hashes(hashes, size)
                    if not len(grams):
                        continue
                    lo = np.searchsorted(seeds, grams)
                    hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == grams)
                    text = np.searchsorted(begins, hit, side="right") - 1
                    inside = hit + size <= begins[text + 1]
                    hit, text = hit[inside], text[inside]
                    hi = np.searchsorted(seeds, grams[hit], side="right")
                    for t, a, b in zip(text.tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                        pairs.update((t, int(o)) for o in owner[a:b])
                covered = np.zeros(part.num_rows)
                items: list[list] = [[] for _ in range(part.num_rows)]
                for t, o in sorted(pairs):
                    share = coverage(rows[o][1], hashes[begins[t] : begins[t + 1]], min_match)
                    covered[t] = max(covered[t], share)
                    if share >= threshold:
                        items[t].append(rows[o][0])
                yield named(result, key=part.column("key"), items=items, coverage=covered)

    return arrow_map(pick(docs, key=id_col, text=text_col), run, ddl)


def _by_join(docs, items, id_col, text_col, result, ddl, threshold, min_match) -> DataFrame:
    """The same for a benchmark of any size: distinct seeds of both sides meet in a shuffled join of texts."""
    by_text = lambda df, name: df.withColumn(name, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    frame, wanted = by_text(pick(docs, key=id_col, text=text_col), "d"), by_text(items, "i")
    texts, questions = frame.select("d", "text").dropDuplicates(["d"]), wanted.select("i", "text").dropDuplicates(["i"])
    item_seeds = cut(arrow_map(questions, _seed_rows("i", None, min_match), "i binary, size int, seed bigint"))
    lengths = [r[0] for r in item_seeds.select("size").distinct().collect()]  # min_match of them at most
    dealt = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    doc_seeds = arrow_map(frame.select("d", "text"), _seed_rows("d", lengths, min_match), "d binary, size int, seed bigint").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    pairs = cut(doc_seeds.join(dealt, ["size", "seed", "salt"]).select("d", "i").distinct())
    none = lambda kind: F.lit(None).cast(kind)
    found = texts.join(pairs.select("d").distinct(), "d", "left_semi").select("d", none("binary").alias("i"), "text")
    rows = found.unionAll(pairs.join(questions, "i").select("d", "i", "text")).repartition("d").sortWithinPartitions("d", "i")
    schema = pa.schema([("d", pa.binary()), ("i", pa.binary()), ("share", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = np.zeros(0, np.uint64)  # of the row with a null item, which goes before the items of its document
        for batch in batches:
            shares = []
            for item, text in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if item is None:
                    doc = _words(text)
                shares.append(None if item is None else coverage(_words(text), doc, min_match))
            yield named(schema, d=batch.column("d"), i=batch.column("i"), share=shares)

    scored = arrow_map(rows, score, "d binary, i binary, share double").where("i is not null")
    each = scored.join(wanted.select("i", "item"), "i")
    by_doc = each.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("share") >= threshold, F.struct("item", "i")))), lambda x: x["item"]).alias("items"), F.max("share").alias("coverage"))
    return frame.join(by_doc, "d", "left").select("key", F.coalesce("items", F.array().cast(by_doc.schema["items"].dataType)).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def _seed_rows(key: str, lengths: list[int] | None, min_match: int):
    """Distinct seeds of each text: of its own length (lengths None) or of all the lengths given."""
    schema = pa.schema([(key, pa.binary()), ("size", pa.int32()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows, sizes, seeds = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = _words(text)
                    for size in lengths if lengths is not None else [min(min_match, len(words))] if len(words) else []:
                        own = np.unique(gram_hashes(words, size))
                        rows.append(np.full(len(own), i))
                        sizes.append(np.full(len(own), size, np.int32))
                        seeds.append(own.view(np.int64))
                if rows:
                    yield named(schema, **{key: part.column(key).take(pa.array(np.concatenate(rows)))}, size=np.concatenate(sizes), seed=np.concatenate(seeds))

    return run
