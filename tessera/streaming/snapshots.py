"""Optional streaming entry: new rows of a staged source flow through the same batch functions.

The reference platform is batch only; this adds no operator, it runs the batch quality metrics on every
micro-batch of a file stream and keeps them by batch id, so that a replayed batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import quality


def watch_quality(spark: SparkSession, observations_dir: str, schema, ranges: DataFrame, countries: list[str], years: tuple[int, int], out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Row-level metrics of each batch of new observation files, in out_dir/batch=<id>; stops when all is read."""

    def measure(batch: DataFrame, batch_id: int) -> None:
        quality.row_level(batch, ranges, countries, years).withColumn("measured_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(observations_dir)
    return stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
