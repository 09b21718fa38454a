"""Stores of Parquet: several tables committed as one, and upserts that rewrite only the partitions that a load touches."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .shared import written

MANIFEST = "run string, version string, tables array<string>, committed_at timestamp"


def commit_run(tables: Mapping[str, DataFrame], root: str, run: str) -> str:
    """Write the tables of a run under ``root``, and last a row of the manifest that names their version; what has no such row does not exist for readers."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/version={version}")
    row = spark.range(1).select(F.lit(run).alias("run"), F.lit(version).alias("version"), F.array(*map(F.lit, tables)).alias("tables"), F.current_timestamp().alias("committed_at"))
    row.write.mode("append").parquet(f"{root}/_manifest")
    return version


def committed(spark: SparkSession, root: str, name: str, schema: str, run: str | None = None) -> DataFrame:
    """Rows of a table of all committed runs (or of one), with ``run``; of a run that was committed again the last version counts. Uncommitted files are not read."""
    empty = spark.createDataFrame([], schema).withColumn("run", F.lit(""))
    try:
        m = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    except AnalysisException:  # nothing was ever committed
        return empty
    m = m.where(F.array_contains("tables", name))
    m = m if run is None else m.where(F.col("run") == run)
    last = m.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("committed_at"), F.desc("version")))).where("k = 1").select("run", "version")
    paths = [f"{root}/{name}/version={r.version}" for r in last.select("version").collect()]  # a path a run
    if not paths:
        return empty
    rows = spark.read.schema(schema).parquet(*paths).withColumn("version", F.regexp_extract(F.input_file_name(), "version=([0-9a-f]+)", 1))
    return rows.join(F.broadcast(last), "version").drop("version")


def upsert(store: str, updates: DataFrame, keys: list[str], order: list[str], partition: str) -> None:
    """Bring ``updates`` into the store: of a key the row that is greatest by ``order``, then by all columns, stays.

    Loads in any order and any number of times give the same table. Only partitions with updates are read and written anew,
    first to a table beside the store, so that one that is being read is never overwritten; Spark swaps whole partitions. The key
    must tell the partition.
    """
    spark = updates.sparkSession
    columns = updates.columns
    rest = [c for c in columns if c not in (*keys, *order)]
    touched = updates.select(partition).distinct()
    try:
        old = spark.read.schema(updates.schema).parquet(store).select(columns)
        both = old.join(touched, old[partition].eqNullSafe(touched[partition]), "left_semi").unionByName(updates)
    except AnalysisException:  # the first load
        both = updates
    newest = both.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    out = written(newest.select(*keys, "r.*").select(columns), "upsert")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(store)
