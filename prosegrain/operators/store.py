"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where that is unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/prosegrain/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows may read it often and never computes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as a shuffle has: a file of one row group is read by one task, which would do all
    work in the row alone. Rows go round, so no key decides where they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def purge(spark: SparkSession) -> None:
    """Delete what this application wrote on the way, once its results are elsewhere. DataFrames made before can no longer be read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
