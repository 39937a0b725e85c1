"""Suffix-array dedup by prefix-free parsing, spread over a cluster.

A byte is removed if some LENGTH-byte string over it starts elsewhere too. A rolling hash of GRAM bytes is
taken at every byte; the smallest hashes are the triggers. Each window of LENGTH bytes has its smallest
trigger as key, so equal windows have equal keys wherever they stand. Consecutive windows with one key
form a segment, at most a few hundred bytes longer than the windows it covers.

1. Keys are counted (pre-aggregated longs). A key with one segment, in which it occurs once, repeats nothing.
2. Segments of other keys are cut out, their bytes once for each task. A bitmap of fixed size drops the rest
   before anything is shuffled; bits that clash let some through that repeat nothing, which does no harm.
3. Equal segments are counted (pre-aggregated, by 128-bit hash): all of a segment that occurs twice repeats.
4. Where a key has several distinct segments, they are sorted by prefix-free parsing: triggers cut them into
   overlapping phrases, the suffixes of the distinct phrases (dictionary) and the suffixes of the phrase
   sequences (parse) are sorted, and the pair (rank of the phrase's suffix, rank of the parse behind it)
   puts all windows in corpus order. Equal windows are neighbours there.
5. Repeated windows go back to the documents as spans.

A key with more than HOT_BYTES of distinct segments is parsed on: its segments are cut again where any of SUB further
triggers of a window changes, each the smallest by another hash, and the same steps run on these shorter segments
with all triggers as their key, LEVELS times at most. What is still together then are windows that differ in a few
bytes only; there the whole window is the key, counted by a pre-aggregation of its hash. So no task sorts more than
HOT_BYTES of one key, and nothing is dropped. Equality of segments and windows is that of two 64-bit hashes.

Defined results: null counts as empty; texts shorter than LENGTH bytes keep all; repeated rows are copies of
each other; an empty table gives an empty result; windows never run over the end of a text. Cut bytes
may leave parts of characters, so results are digests of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, cut, cut_to_table, named, pick, slices, typed, utf8
from tessera.llm._words import PRIME_2, Spans, mixed

LENGTH, GRAM = 400, 16
#: One gram in so many is a trigger of the parse inside a key.
TRIGGER = np.uint64(48)
#: Distinct bytes of a key that are sorted in one task.
HOT_BYTES = 4 << 20
#: Further triggers that part a hot key at each level, and levels.
SUB, LEVELS = 4, 2
#: Bytes that go through one sort; text that is scanned at once (positions fit in 20 bits).
SORT_BYTES, SCAN_BYTES = 1 << 20, 1 << 20
FILTER_BITS = 1 << 26
#: Segment hashes that a task remembers in order not to send the bytes of a frequent segment again and again.
REMEMBERED = 1 << 17

_PLACE = np.uint64((1 << 20) - 1)


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of `size` values, from block-wise prefix and suffix minima."""
    n = len(values) - size + 1
    blocks = -(-len(values) // size)
    grid = np.full(blocks * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(values)] = values
    grid = grid.reshape(blocks, size)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[size - 1 : size - 1 + n])


def _segments(raw: np.ndarray, offsets: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first window, last window, whether the key's place moves) of every run of windows with one key.

    The key is a window's smallest trigger; from level 1 on, the triggers that are smallest by SUB x level further hashes.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.astype(bool)
    grams = len(raw) - GRAM + 1
    at = np.arange(grams)
    grams_hash = mixed(Spans(raw)(at, at + GRAM))
    starts = np.arange(grams - (length - GRAM))
    text = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + length <= offsets[text + 1]
    starts, text = starts[valid], text[valid]
    if not len(starts):
        return none, none, none, none, none.astype(bool)
    key, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    for salt in range(level * SUB + 1) if level else (0,):
        h = mixed(grams_hash ^ np.uint64(salt * 0x9E3779B9)) if salt else grams_hash
        best = _window_min((h & ~_PLACE) | at.astype(np.uint64), length - GRAM + 1)[valid]
        own = (best & _PLACE).astype(np.int64)
        key = mixed(key * np.uint64(31) + h[own]) if level else h[own]
        place = place * 31 + own
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return key[first].view(np.int64), text[first], starts[first], starts[last], place[first] != place[last]


def _pieces(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each text, byte in the row where it starts): long texts in overlapping pieces."""
    raw, offsets = utf8(part.column("text"))
    if len(raw) <= SCAN_BYTES:
        yield raw, offsets, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
        return
    for i in range(part.num_rows):
        own = raw[offsets[i] : offsets[i + 1]]
        for a in range(0, max(1, len(own) - length + 1), SCAN_BYTES - length + 1):
            piece = own[a : a + SCAN_BYTES]
            yield piece, np.array([0, len(piece)]), np.array([i]), np.array([a])


def _count_keys(length: int):
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SCAN_BYTES):
                for raw, offsets, _, _ in _pieces(part, length):
                    k, _, _, _, moves = _segments(raw, offsets, length)
                    keys, inverse = np.unique(k, return_inverse=True)
                    yield named(schema, k=keys, n=np.bincount(inverse, 1 + moves, len(keys)).astype(np.int64))

    return run


def _identity(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of bytes, which stand for it."""
    return tuple(mixed(spans(a, b) + (b - a).astype(np.uint64)).view(np.int64) for spans in (Spans(raw), Spans(raw, PRIME_2)))


def _cut_segments(shared, length: int, key_type: pa.DataType):
    """Occurrences of segments with wanted keys. The bytes are there where a task meets a segment first."""
    schema = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("size", pa.int32()), ("moves", pa.bool_()), ("key", key_type), ("tag", pa.int64()), ("start", pa.int64()), ("seg", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint8)
        met = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SCAN_BYTES):
                for raw, offsets, rows, begins in _pieces(part, length):
                    k, text, first, last, moves = _segments(raw, offsets, length)
                    place = k % FILTER_BITS
                    hit = np.flatnonzero(wanted[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    if not len(hit):
                        continue
                    a, b = first[hit], last[hit] + length
                    s1, s2 = _identity(raw, a, b)
                    one = np.zeros(len(hit), bool)
                    one[np.unique(s1, return_index=True)[1]] = True
                    one &= ~np.isin(s1, met)
                    met = s1[one] if len(met) > REMEMBERED else np.concatenate([met, s1[one]])
                    data = raw.tobytes()
                    segs = [data[x:y] if z else None for x, y, z in zip(a.tolist(), b.tolist(), one.tolist(), strict=True)]
                    row = pa.array(rows[text[hit]])
                    yield named(schema, k=k[hit], s1=s1, s2=s2, size=(b - a).astype(np.int32), moves=moves[hit], key=part.column("key").take(row), tag=part.column("tag").take(row), start=a - offsets[text[hit]] + begins[text[hit]], seg=segs)

    return run


def _of_keys(shared):
    """Rows (k, s1, s2, seg) whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            place = batch.column("k").to_numpy() % FILTER_BITS
            yield batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(dense rank, number of ranks) of rows by several keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1 if len(order) else 0


def _suffix_ranks(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lexicographic ranks of the strings raw[at : at + size]; equal strings share a rank.

    Eight bytes are compared in a round, and only strings that tied so far go on.
    """
    padded = np.zeros(len(raw) + 16, np.uint64)
    padded[: len(raw)] = raw
    words = np.zeros(len(raw) + 8, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + len(words)]
    rank = np.zeros(len(at), np.int64)
    open_rows, done = np.arange(len(at)), 0
    while len(open_rows):
        left = np.clip(size[open_rows] - done, 0, 8)
        word = words[np.minimum(at[open_rows] + done, len(words) - 1)]
        word = np.where(left == 8, word, word >> ((8 - left) * 8 % 64).astype(np.uint64) << ((8 - left) * 8 % 64).astype(np.uint64))
        word = np.where(left == 0, np.uint64(0), word)
        group, n = _ranks([rank[open_rows], word, left])
        # A group's strings share a rank: the number of strings before its predecessors' ties are spread.
        counts = np.bincount(group, minlength=n)
        before = np.cumsum(counts) - counts
        base = np.full(int(rank[open_rows].max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(base, rank[open_rows], before[group])
        rank[open_rows] += before[group] - base[rank[open_rows]]
        done += 8
        open_rows = open_rows[(counts[group] > 1) & (left == 8)]
    return rank


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment a mask of its windows that occur again in any of the segments, by prefix-free parsing."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(x) for x in segments], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if not len(raw):
        return [np.zeros(0, bool) for _ in segments]
    first, second = Spans(raw), Spans(raw, PRIME_2)
    # Phrases: from a trigger (or the segment's start) to the end of the next trigger (or the segment's end).
    grams = np.arange(max(0, len(raw) - GRAM + 1))
    trigger = mixed(first(grams, grams + GRAM)) % TRIGGER == 0
    owner = np.repeat(np.arange(len(segments)), sizes)
    places = np.flatnonzero(trigger)
    places = places[places + GRAM <= ends[owner[places]]]
    starts = np.unique(np.concatenate([begins[sizes > 0], places]))
    of = owner[starts]
    following = np.append(starts[1:], len(raw))
    last = np.append(of[1:] != of[:-1], True)
    stops = np.where(last, ends[of], following + GRAM)
    # Dictionary: distinct phrases (a phrase counts with its first `length` bytes, a window sees no more).
    seen = np.minimum(stops - starts, length)
    content = mixed(first(starts, starts + seen) ^ mixed(second(starts, starts + seen) + seen.astype(np.uint64)))
    _, sample, phrase = np.unique(content, return_index=True, return_inverse=True)
    # Parse: ranks of the phrases by content, then of the phrase sequences by doubling, within segments.
    rank = _suffix_ranks(raw, starts[sample], seen[sample])[phrase]
    n = len(starts)
    segment_end = np.searchsorted(of, of, side="right")
    step = 1
    while step <= length:
        after = np.arange(n) + step
        tail = np.where(after < segment_end, rank[np.minimum(after, n - 1)] + 1, 0)
        rank, distinct = _ranks([rank, tail])
        if distinct == n:
            break
        step *= 2
    behind = np.where(np.arange(n) + 1 < segment_end, np.append(rank[1:], 0) + 1, 0)
    # Windows: the suffix of their phrase from where they start, then the parse behind it.
    window = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]) if len(segments) else grams
    at = np.searchsorted(starts, window, side="right") - 1
    tail = np.minimum(stops[at] - window, length)
    suffix = mixed(first(window, window + tail) ^ mixed(second(window, window + tail) + tail.astype(np.uint64)))
    _, sample, suffix = np.unique(suffix, return_index=True, return_inverse=True)
    alpha = _suffix_ranks(raw, window[sample], tail[sample])[suffix]
    order = np.lexsort((behind[at], alpha))
    sorted_windows = window[order]
    a, b = first(sorted_windows, sorted_windows + length), second(sorted_windows, sorted_windows + length)
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    counts = np.maximum(0, sizes - length + 1)
    return np.split(twice, np.cumsum(counts)[:-1])


def _spans_of(mask: np.ndarray, length: int) -> list[int]:
    """Byte spans (start, stop, start, stop, ...) under the windows of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + length - 1).tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = b
        else:
            out += [a, b]
    return out


def _sort_keys(length: int):
    """Rows (k, s1, s2, seg) sorted by these: the repeated byte spans of each distinct segment."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        s1, s2 = table.column("s1").to_numpy(), table.column("s2").to_numpy()
        one = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        table = table.filter(pa.array(one))
        k, s1, s2, segs = table.column("k").to_numpy(), s1[one], s2[one], table.column("seg").to_pylist()
        rows, spans = [], []
        start, size = 0, 0
        for i in range(len(segs) + 1):
            if i == len(segs) or (size > SORT_BYTES and k[i] != k[i - 1]):
                for j, mask in enumerate(repeated_windows(segs[start:i], length), start):
                    if found := _spans_of(mask, length):
                        rows.append(j)
                        spans.append(found)
                start, size = i, 0
            if i < len(segs):
                size += len(segs[i])
        if rows:
            yield named(schema, s1=s1[rows], s2=s2[rows], spans=spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            k = table.column("k").to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield from resolve(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from resolve(held)

    return run


def _cut_again(length: int, level: int):
    """(k, s1, s2, size, moves, p1, p2, start, seg): segments of the next level inside the segments p of hot keys."""
    schema = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("size", pa.int32()), ("moves", pa.bool_()), ("p1", pa.int64()), ("p2", pa.int64()), ("start", pa.int32()), ("seg", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "seg", SCAN_BYTES // 4):
                whole = part.column("seg").to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in whole])])
                data = b"".join(whole)
                raw = np.frombuffer(data, np.uint8)
                k, text, first, last, moves = _segments(raw, offsets, length, level)
                a, b = first, last + length
                s1, s2 = _identity(raw, a, b)
                of = pa.array(text)
                yield named(schema, k=k, s1=s1, s2=s2, size=(b - a).astype(np.int32), moves=moves, p1=part.column("s1").take(of), p2=part.column("s2").take(of), start=(a - offsets[text]).astype(np.int32), seg=[data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    return run


def _window_rows(length: int):
    """(w1, w2, s1, s2, at): every window of the segments of hot keys."""
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "s1", "s2")] + [("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s1, s2, seg in zip(*[batch.column(c).to_pylist() for c in ("s1", "s2", "seg")], strict=True):
                raw = np.frombuffer(seg, np.uint8)
                at = np.arange(len(raw) - length + 1)
                w1, w2 = Spans(raw)(at, at + length).view(np.int64), Spans(raw, PRIME_2)(at, at + length).view(np.int64)
                yield named(schema, w1=w1, w2=w2, s1=np.full(len(at), s1), s2=np.full(len(at), s2), at=at)

    return run


def _join_windows(length: int):
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("places").to_pylist():
                mask = np.zeros(max(places) + 1, bool)
                mask[places] = True
                spans.append(_spans_of(mask, length))
            yield named(schema, s1=batch.column("s1"), s2=batch.column("s2"), spans=spans)

    return run


_SPANS = "s1 bigint, s2 bigint, spans array<int>"


def repeated_spans(found: DataFrame, length: int, hot_bytes: int, level: int = 0) -> DataFrame:
    """(s1, s2, spans) of the segments that repeat something; a segment may have several rows."""
    counts = cut(found.groupBy("k", "s1", "s2").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("moves").alias("moves")))
    whole = counts.where("n > 1").select("s1", "s2", F.array(F.lit(0), "size").alias("spans"))
    # The bytes of a key matter if it has different segments, or one in which the key comes twice.
    keys = cut(counts.groupBy("k").agg(F.count("*").alias("d"), F.max(F.col("moves") & (F.col("n") < 2)).alias("self"), F.sum("size").alias("bytes")).where("d > 1 or self").select("k", "bytes"))
    wanted = found.sparkSession.sparkContext.broadcast(_bitmap(keys))
    segs = arrow_map(found.where("seg is not null").select("k", "s1", "s2", "seg"), _of_keys(wanted), "k bigint, s1 bigint, s2 bigint, seg binary")
    hot = keys.where(F.col("bytes") > hot_bytes).select("k")
    some = not hot.isEmpty()
    cool = segs.join(hot, "k", "left_anti") if some else segs
    out = whole.unionAll(arrow_map(cool.repartition("k").sortWithinPartitions("k", "s1", "s2"), _sort_keys(length), _SPANS))
    if not some:
        return out
    parents = segs.join(hot, "k", "left_semi").dropDuplicates(["s1", "s2"]).select("s1", "s2", "seg")
    if level < LEVELS:
        inner = cut_to_table(arrow_map(parents, _cut_again(length, level + 1), "k bigint, s1 bigint, s2 bigint, size int, moves boolean, p1 bigint, p2 bigint, start int, seg binary"))
        spans = cut(repeated_spans(inner.select("k", "s1", "s2", "size", "moves", "seg"), length, hot_bytes, level + 1))
        moved = F.transform("spans", lambda x: x + F.col("start"))
        return out.unionAll(inner.select("s1", "s2", "p1", "p2", "start").join(spans, ["s1", "s2"]).select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), moved.alias("spans")))
    windows = cut_to_table(arrow_map(parents, _window_rows(length), "w1 bigint, w2 bigint, s1 bigint, s2 bigint, at int"))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    places = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("s1", "s2").agg(F.sort_array(F.collect_set("at")).alias("places"))
    return out.unionAll(arrow_map(places, _join_windows(length), _SPANS))


def _bitmap(keys: DataFrame) -> bytes:
    """FILTER_BITS bits of the column k, or-ed in Spark; the driver receives the bitmap's parts only."""
    position = F.pmod("k", F.lit(FILTER_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8 + (1 << 13))
    for r in parts:
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def _remove(key_type: pa.DataType, with_kept: bool):
    fields = [("key", key_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept", pa.binary())] if with_kept else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out: dict[str, list] = {f.name: [] for f in schema if f.name != "key"}
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    spans = sorted((x["start"] + a, x["start"] + b) for x in found or () for a, b in zip(x["spans"][::2], x["spans"][1::2], strict=True))
                    merged: list[list[int]] = []
                    for a, b in spans:
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *[x for span in merged for x in span], len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    values = {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(merged), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}
                    for name, column in out.items():
                        column.append(values[name])
                yield named(schema, key=part.column("key"), **out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES, with_kept: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 (and kept, the remaining bytes) for every row."""
    key_type = arrow_type(docs, id_col)
    # Rows that share an id are told apart by a hash of their text.
    frame = pick(docs, key=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))
    counted = arrow_map(frame.select("text"), _count_keys(length), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(counted))
    cut_out = arrow_map(frame, _cut_segments(wanted, length, key_type), f"k bigint, s1 bigint, s2 bigint, size int, moves boolean, {typed(frame, 'key', 'key')}, tag bigint, start bigint, seg binary")
    found = cut_to_table(cut_out)
    spans = cut(repeated_spans(found, length, hot_bytes))
    of_doc = found.select("s1", "s2", "key", "tag", "start").join(spans, ["s1", "s2"]).groupBy(F.col("key").alias("k2"), F.col("tag").alias("t2")).agg(F.collect_set(F.struct("start", "spans")).alias("found"))
    joined = frame.join(of_doc, F.col("key").eqNullSafe(F.col("k2")) & F.col("tag").eqNullSafe(F.col("t2")), "left").select("key", "text", "found")
    ddl = f"{typed(frame, 'key', 'key')}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else "")
    return arrow_map(joined, _remove(key_type, with_kept), ddl).withColumnRenamed("key", id_col)
