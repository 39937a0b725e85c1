"""Window building blocks over ordered series; every order is total if the given columns make it so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def numbered(df: DataFrame, draw: str, ties: Sequence[str], name: str, keys: Sequence[str] = (), buckets: int = 1 << 16) -> DataFrame:
    """Adds the rank from 0 by a draw in [0, 1), in all rows or in each group, without sorting all in one task.

    Rows are ordered inside buckets of the draw; a bucket's offset is the number of rows in the buckets before it.
    Only the counts of buckets, `buckets` for each group at most, are accumulated together.
    """
    b = df.withColumn("__bucket", F.floor(F.col(draw) * buckets).cast("int"))
    counts = b.groupBy(*keys, "__bucket").agg(F.count("*").alias("__count"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(draw, *ties)) - 1
    return b.withColumn("__inside", inside).join(offsets, [*keys, "__bucket"]).withColumn(name, F.col("__inside") + F.col("__offset")).drop("__bucket", "__inside", "__offset")


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def neighbours(value: str, keys: Sequence[str], order: str, each_side: int) -> Column:
    """Array of the values up to each_side rows before and after, without the row itself."""
    w = Window.partitionBy(*keys).orderBy(order)
    return F.concat(F.collect_list(value).over(w.rowsBetween(-each_side, -1)), F.collect_list(value).over(w.rowsBetween(1, each_side)))


def nearest(df: DataFrame, keys: Sequence[str], at: str, reference: float | int, tolerance: float | int) -> DataFrame:
    """As-of nearest: the row of each group nearest to the reference within the tolerance, ties to the earlier one."""
    close = df.where(F.abs(F.col(at) - F.lit(reference)) <= tolerance)
    return first_by(close, keys, [F.abs(F.col(at) - F.lit(reference)), F.col(at)])


def islands(keys: Sequence[str], order: str) -> Column:
    """A number that is the same for rows whose integer order column runs without gaps."""
    return F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))


def run_lengths(df: DataFrame, keys: Sequence[str], order: str, value: str, tolerance: float) -> DataFrame:
    """Adds run_id and run_length: runs of consecutive integers in `order` whose values stay within tolerance
    of the run's first value. A new run starts where the step isn't 1 or the value leaves the anchor's band.

    The anchor is carried by a fold over the ordered series, as adjacent comparison would let slow drift pass.
    """
    item = F.struct(F.col(order).alias("t"), F.col(value).alias("v"))
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"))
    start = F.struct(F.lit(None).cast(df.schema[order].dataType).alias("t"), F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("run"), F.array().cast(f"array<struct<t:{df.schema[order].dataType.simpleString()},run:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce((x["t"] - acc["t"] == 1) & (F.abs(x["v"] - acc["anchor"]) <= tolerance), F.lit(False))
        run = F.when(same, acc["run"]).otherwise(acc["run"] + 1)
        return F.struct(x["t"].alias("t"), F.when(same, acc["anchor"]).otherwise(x["v"].cast("double")).alias("anchor"), run.alias("run"), F.array_append(acc["out"], F.struct(x["t"].alias("t"), run.alias("run"))).alias("out"))

    runs = series.select(*keys, F.explode(F.aggregate("s", start, step)["out"]).alias("x")).select(*keys, F.col("x.t").alias(order), F.col("x.run").alias("run_id"))
    length = F.count("*").over(Window.partitionBy(*keys, "run_id"))
    return df.join(runs, [*keys, order]).withColumn("run_length", length)


def lag_at(value: str, keys: Sequence[str], order: str, steps: int) -> Column:
    """The value `steps` units of the integer order column before, null where there is no such row."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-steps, -steps)
    return F.max(value).over(w)
