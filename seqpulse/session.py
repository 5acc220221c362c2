"""Session settings the jobs expect, and intermediates that outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local master may use one below the warehouse; on a cluster it is an error, as that may be a folder of the driver's machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back; the same plan on every master.

    Reused intermediate results go to shared storage, so that a lost executor costs a re-read and not a
    re-scan of the history.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
