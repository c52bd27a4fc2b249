"""Cues and segments as one table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """record_kind (cue, segment), media_id, record_idx, text; re-delivered rows are still there."""
    a = cues.select(F.lit("cue").alias("record_kind"), F.col("media_id").cast("string"), F.col("cue_index").cast("int").alias("record_idx"), F.col("text").cast("string"))
    b = segments.select(F.lit("segment").alias("record_kind"), F.col("media_id").cast("string"), F.col("seg_idx").cast("int").alias("record_idx"), F.col("text").cast("string"))
    return a.unionByName(b)


def spread(df: DataFrame) -> DataFrame:
    """Python work on a small input in as many tasks as there are cores; a scan with enough splits is left alone.

    The number of scan partitions is known to the driver without a job. A shuffle is only worth it where the scan has
    fewer tasks than cores, that is on inputs of a few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
