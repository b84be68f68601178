"""Spark session settings shared by the library, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for. All can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # joins on hot keys are split at run time, even where the split costs another shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str | None:
    """The folder written tables go to: `spark.checkpoint.dir`, which the cluster must set to a place all executors share.

    None where it is unset: no folder of one machine is there for all executors, so none is made up.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or None


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder where the session has one, so that what is read several times is made once."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df
