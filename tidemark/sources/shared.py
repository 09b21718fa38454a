"""Tables between steps, in the folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a writing task buffers.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. In local mode, where one process is all there is, a folder of our own if that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors see")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        shared_dir.own = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deals(spark: SparkSession) -> int:
    """How many parts a key's rows are dealt into by ``dealt``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``written`` in buckets of ``key``, so that windows, groups and joins by ``key`` alone read it without a shuffle.

    ``df`` comes dealt by ``repartition(deals(spark), key)``, which makes a bucket the file of one task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.write.option("parquet.block.size", ROW_GROUP).option("path", path).bucketBy(deals(spark), key).saveAsTable(table)
    return spark.table(table)
