"""Line dedup by a segment-partition edit join.

Two lines are linked if their edit distance is at most EDITS (lines of at least LONG_LINE bytes) or if they are
equal (shorter lines). Equal lines collapse first, by a pre-aggregation on a 128-bit hash. Each long line is
split into EDITS + 1 segments whose places depend on its length only. If two lines are linked, one of the longer one's substrings equals a segment of the shorter one; which substrings can,
follows from the lengths (the multi-match-aware window), so a line probes few of them. Lines that share a
key (length, segment, content) are verified by banded bit-parallel edit distance.

Texts move as little as possible: keys are 16 bytes (key and line hash), and only lines that share a key are
fetched with their text, behind a bitmap of fixed size that drops other lines before the exact join.
Inside a key, lines are linked by breadth-first search, so a spanning forest is emitted, never all pairs;
a sound bound on byte counts prunes before the edit distance. Keys with more than GROUP lines or GROUP_BYTES bytes
are dealt out as pairs of blocks, which grows with the square of such a key. Linked lines are known by 64-bit hashes,
equal ones by 128 bits. Classes are the connected components of the links. Of each class the line that stands
first (smallest id, then text hash and line number) stays; all others are removed from their documents, and the remaining lines keep their order.

Lines are parted by line feeds. Lengths and edits count UTF-8 bytes. Defined results: null texts stay null and
empty texts stay empty, with no lines; empty lines are never duplicates and stay; a document all of whose
lines are removed gets an empty text; rows that share an id, a null one too, are told apart by
a hash of their text, and only rows of equal id and text count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._arrow import arrow_map, arrow_type, cut, cut_to_table, named, pick, slices, typed, utf8
from tessera.llm._words import PRIME_2, Spans, mixed
from tessera.llm.graph import components

#: Edits between linked lines, and bytes from which lines may differ at all.
EDITS, LONG_LINE = 2, 24
#: Lines of a key that one task links; beyond, they are dealt out in blocks of half as many.
GROUP = 4096
#: Bytes of a key's lines that one task holds; a longer line stays whole.
GROUP_BYTES = 32 << 20
#: Bits of the bitmap that goes before the join which fetches lines: 4 MB, whatever the data.
FILTER_BITS = 1 << 25
#: Line hashes that a task remembers in order not to send the keys of a frequent line again and again.
REMEMBERED = 1 << 17


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones take what is left over."""
    parts = edits + 1
    base, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, shorter: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(segment, start in the longer line, size): substrings that can equal a segment of a shorter line.

    Segment i (from 0) with i errors at most before it and edits - i after it; a line that is delta longer
    shifts it by i - edits to i errors from the left, and by delta less from the right.
    """
    delta, out = length - shorter, []
    for i, (at, size) in enumerate(segments(shorter, edits)):
        lo = max(0, at - i, at + delta - (edits - i))
        hi = min(length - size, at + i, at + delta + (edits - i))
        out += [(i, p, size) for p in range(lo, hi + 1)]
    return out


def banded(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether the edit distance of line pairs is at most `edits`; vectorised over the pairs.

    a and b are byte buffers, *_at the (n, 2) start and length in them. The band of 2 x edits + 1 diagonals is
    a word of bits for each number of errors: bit k of reach[e] says that the diagonal k can stand at the
    present row with e errors. A row advances all diagonals of all pairs by shifts and masks.
    """
    n = len(a_at)
    out = np.zeros(n, bool)
    la, lb = a_at[:, 1], b_at[:, 1]
    alive = np.flatnonzero(np.abs(la - lb) <= edits)
    if not len(alive):
        return out
    width = 2 * edits + 1
    full = np.uint8((1 << width) - 1)
    reach = [np.zeros(len(alive), np.uint8) for _ in range(edits + 1)]
    for e in range(edits + 1):  # before the first row, e insertions into b reach the diagonals 0 .. e
        reach[e][:] = sum(1 << k for k in range(edits, edits + e + 1))
    row = 0
    sa, sb = a_at[alive, 0], b_at[alive, 0]
    ra, rb = la[alive], lb[alive]
    offsets = np.arange(-edits, edits + 1)
    weights = (1 << np.arange(width)).astype(np.uint8)
    while len(alive):
        done = ra == row
        if done.any():
            # Diagonal lb - la at the end of a; what is left of b was counted by its diagonal already.
            k = (rb - ra + edits)[done].astype(np.uint8)
            out[alive[done]] = (reach[edits][done] >> k & 1).astype(bool)
            keep = ~done
            alive, sa, sb, ra, rb = alive[keep], sa[keep], sb[keep], ra[keep], rb[keep]
            reach = [r[keep] for r in reach]
            if not len(alive):
                break
        at = row + offsets[None, :]
        inside = (at >= 0) & (at < rb[:, None])
        same = (b[np.where(inside, sb[:, None] + at, 0)] == a[sa + row][:, None]) & inside
        match = (same * weights).sum(axis=1).astype(np.uint8)
        before = None
        new = []
        for e in range(edits + 1):
            r = reach[e] & match  # equal characters: same diagonal, no error
            if e:
                r = r | before | (before >> 1)  # substitution keeps the diagonal, a deletion from a lowers it
                r = (r | (new[e - 1] << 1)) & full  # an insertion from b raises it within the row
            before = reach[e]
            new.append(r)
        reach = new
        row += 1
        dead = reach[edits] == 0
        if dead.any():
            keep = ~dead
            alive, sa, sb, ra, rb = alive[keep], sa[keep], sb[keep], ra[keep], rb[keep]
            reach = [r[keep] for r in reach]
    return out


def edit_distance(a: bytes, b: bytes) -> int:
    """Bit-parallel edit distance of two lines (Myers' vectors as Python integers), for checks."""
    if not a:
        return len(b)
    peq: dict[int, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top, pv, mv, score = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & mask
        pv, mv = (mh << 1 | ~(xv | ph)) & mask, ph & xv
    return score


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text, line number) of every line of concatenated texts; an empty text has no line."""
    feeds = np.flatnonzero(raw == 10)
    texts = np.flatnonzero(np.diff(offsets) > 0)
    counts = np.searchsorted(feeds, offsets[texts + 1]) - np.searchsorted(feeds, offsets[texts]) + 1
    starts = np.sort(np.concatenate([offsets[texts], feeds + 1]))
    stops = np.sort(np.concatenate([feeds, offsets[texts + 1]]))
    return starts, stops, np.repeat(texts, counts), np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)


def line_hash(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mixed(Spans(raw)(starts, stops) + (stops - starts).astype(np.uint64)).view(np.int64)


def _hash_rows(key_type: pa.DataType):
    """(key, tag, n, h1, h2) of every line that isn't empty."""
    schema = pa.schema([("key", key_type), ("tag", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = utf8(part.column("text"))
                starts, stops, owner, number = line_spans(raw, offsets)
                real = stops > starts
                starts, stops = starts[real], stops[real]
                second = mixed(Spans(raw, PRIME_2)(starts, stops)).view(np.int64)
                of = pa.array(owner[real])
                yield named(schema, key=part.column("key").take(of), tag=part.column("tag").take(of), n=number[real].astype(np.int32), h1=line_hash(raw, starts, stops), h2=second)

    return run


def _probe_plan(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(delta, segment, shift from the segment's place in the shorter line) of all probes but the own segments."""
    big = 1000 * (edits + 1)
    out = []
    for delta in range(edits + 1):
        places = segments(big - delta)
        out += [(delta, i, p - places[i][0]) for i, p, _ in probes(big, big - delta) if delta or p != places[i][0]]
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, h): segment keys of long lines. h is the line's hash without its top bit, which is set where the
    key is a segment of the line itself, so that such rows sort first; a line's other rows are probes."""
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64())])
    parts, plan = EDITS + 1, _probe_plan()
    low, own_bit = np.uint64((1 << 63) - 1), np.uint64(1 << 63)
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            raw, offsets = utf8(part.column("text"))
            starts, stops, _, _ = line_spans(raw, offsets)
            real = stops - starts >= LONG_LINE
            starts, stops = starts[real], stops[real]
            content = Spans(raw)
            h = mixed(content(starts, stops) + (stops - starts).astype(np.uint64)).view(np.int64)
            h, place = np.unique(h, return_index=True)
            fresh = ~np.isin(h, seen, assume_unique=True)
            h, place = h[fresh], place[fresh]
            seen = h if len(seen) + len(h) > REMEMBERED else np.concatenate([seen, h])
            starts, length = starts[place], (stops - starts)[place]
            u = h.view(np.uint64) & low
            keys, hashes = [], []

            def add(of: np.ndarray, shorter: np.ndarray, i: int, shift: int, own: bool):
                base, longer = shorter // parts, shorter % parts
                size = base + (i >= parts - longer)
                at = i * base + np.maximum(0, i - (parts - longer)) + shift
                good = of & (at >= 0) & (at + size <= length) & (shorter >= LONG_LINE)
                a, n = (starts + at)[good], size[good]
                tag = mixed((shorter[good] * parts + i).astype(np.uint64))
                keys.append(mixed(content(a, a + n) ^ tag).view(np.int64))
                hashes.append((u[good] | own_bit if own else u[good]).view(np.int64))

            everything = np.ones(len(starts), bool)
            for i in range(parts):
                add(everything, length, i, 0, True)
            for delta, i, shift in plan:
                add(everything, length - delta, i, shift, False)
            yield named(schema, k=np.concatenate(keys), h=np.concatenate(hashes))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, h) sorted by both: those of keys where an own segment meets another line, own bit removed.

    Of the present key only its first row is held between batches, and whether it went out.
    """
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64())])
    low = np.int64((1 << 63) - 1)
    now: tuple[int, int, bool, bool] | None = None  # key, its first line, whether that is an own segment, sent
    for batch in batches:
        k, h = batch.column("k").to_numpy(), batch.column("h").to_numpy()
        if not len(k):
            continue
        line = h & low
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
        first, own, sent = line[starts].copy(), h[starts] < 0, np.zeros(len(starts), bool)
        if now is not None and now[0] == k[0]:
            _, first[0], own[0], sent[0] = now
        other = (line != first[group]) & own[group]
        met = np.zeros(len(starts), bool)
        met[group[other]] = True
        fresh = met & ~sent
        if other.any():
            yield named(schema, k=np.concatenate([k[other], k[starts[fresh]]]), h=np.concatenate([line[other], first[fresh]]))
        now = (int(k[-1]), int(first[-1]), bool(own[-1]), bool(sent[-1] or met[-1]))


def _fetch(bits: bytes):
    """(h, h1, line) of long lines whose hash may be wanted, each once in a slice."""
    schema = pa.schema([("h", pa.int64()), ("h1", pa.int64()), ("line", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = utf8(part.column("text"))
                starts, stops, _, _ = line_spans(raw, offsets)
                real = stops - starts >= LONG_LINE
                starts, stops = starts[real], stops[real]
                h1 = line_hash(raw, starts, stops)
                h = h1 & np.int64((1 << 63) - 1)
                place = h % FILTER_BITS
                _, one = np.unique(h1, return_index=True)
                one = one[(wanted[place[one] >> 3] >> (place[one] & 7).astype(np.uint8) & 1).astype(bool)]
                if len(one):
                    data = raw.tobytes()
                    yield named(schema, h=h[one], h1=h1[one], line=[data[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)])

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """FILTER_BITS bits of the column h, or-ed in Spark; the driver receives the bitmap's parts only."""
    position = F.pmod("h", F.lit(FILTER_BITS)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8 + (1 << 13))
    for r in parts:  # buckets and positions count from 1
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, h1, line) sorted by k: forest edges of the links inside each k; groups may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: pa.Table | None = None

    def link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, h1 = table.column("k").to_numpy(), table.column("h1").to_numpy()
        lines = table.column("line").to_pylist()
        raw = np.frombuffer(b"".join(lines), np.uint8)
        sizes = np.array([len(x) for x in lines], np.int64)
        at = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        counts = np.diff(np.append(starts, len(k)))
        two = starts[counts == 2]
        good = banded(raw, at[two], raw, at[two + 1]) if len(two) else np.zeros(0, bool)
        a, b = [two[good]], [two[good] + 1]
        for s, n in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
            # An edit changes the counts of two byte classes at most, so linked lines differ by 2 x EDITS at most.
            owner = np.repeat(np.arange(n), sizes[s : s + n])
            own = raw[at[s, 0] : at[s, 0] + int(sizes[s : s + n].sum())]
            histogram = np.bincount(owner * 32 + (own & 31), minlength=n * 32).reshape(n, 32).astype(np.int32)
            left = np.arange(n)
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    u = queue.pop()
                    close = np.abs(histogram[left] - histogram[u]).sum(axis=1) <= 2 * EDITS
                    near = left[close]
                    if len(near):
                        near = near[banded(raw, np.broadcast_to(at[s + u], (len(near), 2)), raw, at[s + near])]
                    if len(near):
                        a.append(np.full(len(near), s + u))
                        b.append(s + near)
                        queue += near.tolist()
                        left = left[~np.isin(left, near, assume_unique=True)]
        p, c = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        if len(p):
            yield named(schema, a=h1[p], b=h1[c])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        k = table.column("k").to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield from link(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from link(held)


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b): hashes of linked long lines, a forest with the components of all links."""
    texts = pick(docs, text=text_col)
    keys = arrow_map(texts, _keys, "k bigint, h bigint")
    shared = cut(arrow_map(keys.repartition("k").sortWithinPartitions("k", "h"), _shared, "k bigint, h bigint").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(shared.select("h")))
    lines = cut_to_table(arrow_map(texts, _fetch(bits), "h bigint, h1 bigint, line binary").groupBy("h1", "line").agg(F.first("h").alias("h")))
    counts = shared.join(lines.select("h", F.octet_length("line").alias("size")), "h").groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    hot = (F.col("n") > group) | (F.col("bytes") > group_bytes)
    blocks = F.greatest(F.ceil(F.col("n") / (group // 2)), F.ceil(F.col("bytes") / (group_bytes // 2))).cast("int")
    sized = shared.join(counts, "k")
    cool = sized.where(~hot).select("k", "h")
    dealt = (
        sized.where(hot)
        .select("k", "h", F.pmod(F.xxhash64("h"), blocks).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "h")
        .distinct()
    )
    candidates = cool.unionAll(dealt).join(lines, "h").select("k", "h1", "line")
    return arrow_map(candidates.repartition("k").sortWithinPartitions("k", "h1"), _verify, "a bigint, b bigint")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(key, tag, n): the lines that are removed, those that aren't the first of their class; tag is the text's hash."""
    frame = pick(docs, key=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))
    hashed = cut(arrow_map(frame, _hash_rows(arrow_type(docs, id_col)), f"{typed(docs, id_col, 'key')}, tag bigint, n int, h1 bigint, h2 bigint"))
    distinct = hashed.groupBy("h1", "h2").agg(F.min(F.struct("key", "tag", "n")).alias("least"), F.count("*").alias("copies"))
    linked = components(line_links(docs, id_col, text_col, group)).select(F.col("node").alias("h1"), "component")
    # Only classes with another line matter: copies, or links to other lines.
    members = cut(distinct.join(linked, "h1", "left").where("copies > 1 or component is not null").select("h1", "h2", "least", F.coalesce("component", "h1").alias("c"), F.when(F.col("component").isNull(), F.col("h2")).alias("c2")))
    classes = members.groupBy("c", "c2").agg(F.min("least").alias("keeper"))
    keepers = members.select("h1", "h2", "c", "c2").join(classes.withColumnsRenamed({"c": "cc", "c2": "cc2"}), (F.col("c") == F.col("cc")) & F.col("c2").eqNullSafe(F.col("cc2"))).select("h1", "h2", "keeper")
    return hashed.join(keepers, ["h1", "h2"]).where(~F.struct("key", "tag", "n").eqNullSafe(F.col("keeper"))).select("key", "tag", "n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines, n_removed."""
    gone = duplicate_lines(docs, id_col, text_col, group).groupBy(F.col("key").alias("__key"), F.col("tag").alias("__tag")).agg(F.collect_set("n").alias("__gone"))
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    joined = docs.join(gone, key.eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__tag")), "left").withColumn("__lines", F.when(F.length(text) > 0, F.split(text, "\n")))
    # Split once: a column that is read more than once stays below; then one pass over the places of the lines that stay.
    lines, size = F.col("__lines"), F.coalesce(F.size("__lines"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), size - 1), F.col("__gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    out = F.when(F.col("__gone").isNull(), text).otherwise(kept)
    return joined.select(*[out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], size.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))
