"""Shared scratch tables that cut lineage.

A staged table is plain parquet in the folder named by ``spark.checkpoint.dir``.
It survives lost executors, and later passes read only the columns they need.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a table of levels: the stretch of a file that a task reads, and whether levels of the file lie in others too.
STRETCH, SCATTERED = "_stretch", "_scattered"
#: Partitions of a table of levels for each one of other shuffles, so that only those with a hot level are split.
_FINER = 8


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's own, or a fresh one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors share; "
            "a machine-local folder cannot hold staged tables on a cluster"
        )
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="commercium-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, cluster_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table.

    Eager.  Use it where several passes must see the very same values (ranks
    over summed floats, range slices) or would repeat an expensive join.

    ``cluster_by`` brings equal values of a column next to each other in the same
    files, so later groupings on it combine almost everything before their
    shuffle.  It is a rebalance, not a repartition: adaptive execution splits a
    hot value over several files and merges small ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if cluster_by is not None:
        df = df.hint("rebalance", cluster_by).sortWithinPartitions(cluster_by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_levels(df: DataFrame, label: str, level: str, spread: bool = True) -> DataFrame:
    """``stage`` with the rows of a level next to each other, and two columns that say where they lie.

    Without ``spread`` the rows of a task are sorted but not moved, for rows that were just joined
    by the level.  A level that is neither in a scattered file nor the first or last of its
    stretch lies there whole.  The columns hold for rows in the order of the files: after
    a join that may shuffle them, they have to be staged again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    placed = df
    if spread:
        parts = _FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.hint("rebalance", parts, level)
    placed.sortWithinPartitions(level).write.parquet(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    read = spark.read.schema(df.schema).parquet(path)
    rows = read.select("*", F.xxhash64(file, start).alias(STRETCH), F.xxhash64(file).alias("_file"))
    span = rows.groupBy(level).agg(F.min("_file").alias("a"), F.max("_file").alias("b"))
    split = stage(span.where("a <> b").select(level), "split-levels")
    files: list[int] = []
    if not split.isEmpty():
        pairs = rows.select(level, "_file").distinct()
        files = [r[0] for r in pairs.join(split, level, "left_semi").select("_file").distinct().collect()]
    scattered = F.col("_file").isin(files) if files else F.lit(False)
    return rows.withColumn(SCATTERED, scattered).drop("_file")
