"""Mixing sources to target weights: whole certain copies, then Pareto order sampling of the fraction.

Native: DataFrame functions only. A source's target says how many of its words are wanted. Each document gets an
expected number of copies, min(cap, level x lean), where lean grows with the document's size class (the power of
two below its size), from LEAN_FROM up to LEAN_TO shares: longer documents are up to twice as likely. The source's
level is the one at which the expected words of its documents add up to the target. The whole part of the
expected copies is allocated with certainty; the fraction f is the inclusion probability of one more copy, and it
differs between the documents of a source. Pareto order sampling ranks them by random odds over inclusion odds,
q = U/(1-U) / (f/(1-f)), and takes the best ranked ones until the words that the fractions ask for are reached (the
document that crosses the mark is taken if that comes nearer): a sample of fixed size, in words, with unequal
probabilities.

The texts are read once; sizes are stored in the checkpoint folder. Levels need one row for each source and size
class. The mark is found without sorting a source in one task: words are summed by (source, bucket of q / (1 + q)),
the buckets of each source are accumulated (BUCKETS rows at most), and only the bucket that crosses the mark is
ordered by document. U comes from a hash of the id, the text and the seed, so reruns agree.

Defined results: null or empty texts and texts of white space have size 0 and 0 words taken; a null source
is a source of its own, after all others; documents of equal id and other text draw apart, rows that repeat both
share one draw and are ordered together; an empty table gives an empty mix; if all sizes are 0, all targets are 0.
Clashing column names are allowed: internal columns live in a frame of renamed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._arrow import cut

#: Sources up to which their plan (one short row each) is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000
#: Rank buckets of a source; the documents of one bucket are the most that are ordered together.
BUCKETS = 1 << 16
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Shares of expected copies of a one-word document and of those of 2 ^ (LEAN_TO - LEAN_FROM) words or more.
LEAN_FROM, LEAN_TO = 10, 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(n: int = 3) -> Column:
    """1, 2, ..., n, 1, 2, ... over the sources in code point order, null last; `rank` starts at 1."""
    return ((F.col("rank") - 1) % n + 1).cast("double")


def targets(sizes: DataFrame, weight: Column | None = None, cap: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size, rank): shares of the whole by weight, capped at cap x size.

    The excess over a cap goes to the others by weight until none is above. With level = words for each unit
    of weight, every target is min(cap x size, level x weight); sources reach their caps in the order of
    cap x size / weight, so one pass over the sources in that order finds the level. One row per source.
    """
    w = weight if weight is not None else cyclic_weights()
    caps = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scored = (
        caps.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    )
    # The level is that of the first source whose cap isn't reached; sources before it are at their caps.
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(reached, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scored.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "rank", "source_size", "target")


def uniform(*key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(key:...:seed), the same in every engine."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts, F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """0 for one word or none, then the power of two that a size reaches, up to the last class."""
    return F.least(F.lit(LEAN_TO - LEAN_FROM), F.length(F.bin(F.greatest(size, F.lit(1)))) - 1)


def levels(classes: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """(source, class, expected): expected copies of each document of a class.

    With level = copies for each share of lean, the expected copies are min(cap, level x lean). The classes of the
    largest lean reach the cap first, so one pass over a source's classes from there finds the level.
    """
    lean = F.col("class") + LEAN_FROM
    joined = classes.join(wanted, F.col("source").eqNullSafe(F.col("s"))).withColumn("mass", F.col("words") * lean)
    order = Window.partitionBy("s").orderBy(F.col("class").desc())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scored = joined.withColumn("level", (F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum("mass").over(rest), F.lit(0)))
    reached = F.when(F.col("level") * lean <= cap, F.col("level"))
    level = F.first(reached, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scored.select("source", "class", "words", "s", "source_size", "target", F.least(F.lit(cap), F.coalesce(level * lean, F.lit(cap))).alias("expected"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, cap: float = 3.0, seed: str = SEED) -> DataFrame:
    """One row per document: its id, source, size, source_size, target, expected and taken copies, and taken words."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    sized = docs.select(key.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"), uniform(key, F.md5(F.coalesce(text, F.lit("")).cast("binary")), seed=seed).alias("u"))
    return mix_sized(cut(sized), weight, cap).withColumnRenamed("id", id_col)


def mix_sized(sized: DataFrame, weight: Column | None = None, cap: float = 3.0) -> DataFrame:
    """mix() for frames (id, source, size, u); u is the uniform draw."""
    classed = sized.withColumn("class", size_class(F.col("size")))
    classes = cut(classed.groupBy("source", "class").agg(F.sum("size").alias("words")))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    wanted = targets(ranked, weight, cap).select(F.col("source").alias("s"), "source_size", "target")
    shares = levels(classes, wanted, cap).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("int")).withColumn("fraction", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    marks = shares.groupBy("s").agg(F.sum(F.col("fraction") * F.col("words")).alias("mark"))
    plan = cut(shares.join(marks.withColumnRenamed("s", "ms"), F.col("s").eqNullSafe(F.col("ms"))).select("s", F.col("class").alias("c"), "source_size", "target", "expected", "whole", "fraction", "mark"))
    few = plan.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    joined = classed.join(small(plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    # q = random odds / inclusion odds, and q / (1 + q) for the buckets; documents without a fraction come last.
    q = F.when(F.col("fraction") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("fraction") / (1 - F.col("fraction"))))
    drawn = joined.withColumn("q", q).withColumn("bucket", F.coalesce(F.least(F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"), F.lit(BUCKETS - 1)), F.lit(BUCKETS)))
    by_bucket = drawn.where("fraction > 0").groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.first("mark").alias("mark"))
    running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        by_bucket.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .where((F.col("before") < F.col("mark")) & (F.col("before") + F.col("words") >= F.col("mark")))
        .groupBy(F.col("s").alias("cs"))
        .agg(F.min("bucket").alias("cross_bucket"), F.min_by("before", "bucket").alias("cross_before"))
    )
    sides = drawn.join(small(crossing), F.col("s").eqNullSafe(F.col("cs")), "left")
    # Only rows of the crossing buckets are ordered; all others are decided by their bucket.
    inner = Window.partitionBy("s").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = F.coalesce(F.col("bucket") == F.col("cross_bucket"), F.lit(False))
    edge = sides.where(at_edge).withColumn("reached", F.col("cross_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("extra", (F.col("reached") + F.col("size") / 2 <= F.col("mark")).cast("int")).drop("reached")
    rest = sides.where(~at_edge).withColumn("extra", ((F.col("fraction") > 0) & (F.col("bucket") < F.coalesce(F.col("cross_bucket"), F.lit(BUCKETS)))).cast("int"))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return edge.unionByName(rest).select("id", "source", "size", "source_size", "target", "expected", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


#: The same for DuckDB: one query over the view documents, ranking by the odds in one sort of each source.
MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':{SEED}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
classed AS (SELECT *, least({LEAN_TO - LEAN_FROM}, length(bin(greatest(size, 1))) - 1) AS class FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
caps AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM sizes),
source_levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM caps WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce(arg_min(level, cap / weight) FILTER (WHERE level * weight <= cap), 0) AS level FROM source_levels),
wanted AS (SELECT l.source, l.source_size, least(l.cap, c.level * l.weight) AS target FROM source_levels l, chosen c),
classes AS (SELECT source, class, sum(size)::DOUBLE AS words, class + {LEAN_FROM} AS lean FROM classed GROUP BY source, class),
class_levels AS (
  SELECT k.*, w.source_size, w.target,
         (w.target - 3.0::DOUBLE * coalesce(sum(k.words) OVER (PARTITION BY k.source ORDER BY k.class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(k.words * k.lean) OVER (PARTITION BY k.source ORDER BY k.class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM classes k JOIN wanted w ON k.source IS NOT DISTINCT FROM w.source),
own_level AS (SELECT source, arg_max(level, class) FILTER (WHERE level * lean <= 3.0) AS level FROM class_levels GROUP BY source),
shares AS (
  SELECT k.source, k.class, k.words, k.source_size, k.target, least(3.0::DOUBLE, coalesce(o.level * k.lean, 3.0::DOUBLE)) AS expected
  FROM class_levels k JOIN own_level o ON k.source IS NOT DISTINCT FROM o.source),
parts AS (SELECT *, CAST(floor(expected + 1e-9) AS BIGINT) AS whole, greatest(0, expected - floor(expected + 1e-9)) AS fraction FROM shares),
marks AS (SELECT source, sum(fraction * words) AS mark FROM parts GROUP BY source),
odds AS (
  SELECT c.doc_id, c.source, c.size, p.source_size, p.target, p.whole, p.fraction, m.mark,
         CASE WHEN p.fraction > 0 THEN (c.u / (1 - c.u)) / (p.fraction / (1 - p.fraction)) END AS q
  FROM classed c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class JOIN marks m ON c.source IS NOT DISTINCT FROM m.source),
ranked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM odds)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN fraction > 0 AND reached + size / 2.0::DOUBLE <= mark THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
