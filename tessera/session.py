"""SparkSession construction with the settings every operator assumes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Settings that operators rely on for results (UTC, ANSI) or for plans (AQE).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "tessera", cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster, pass a session of your own to the operators instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    settings = BASE_CONF | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame that several steps read, in the shared folder of spark.checkpoint.dir.

    Lost executors don't lose it, and later plans start here instead of repeating all that came before. A local
    folder is taken only where the session names none on one machine, as in tests; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint(eager=True)
