"""Job snapshots and counters as streams. The reference has no unbounded input; these are the nearest analogues, with a watermark that bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import job_kind


def state_counts(snapshots: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """window_start, job_kind, job_state, n per tumbling window of updated_at; repeated snapshots count once, snapshots later than `late` not at all."""
    d = snapshots.where("updated_at is not null").withColumn("at", F.col("updated_at").cast("timestamp")).withWatermark("at", late)
    d = d.dropDuplicatesWithinWatermark(["job_id", "job_state", "attempt"])
    return d.groupBy(F.window("at", window), job_kind(F.col("job_kind")).alias("job_kind"), "job_state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "job_kind", "job_state", "n")
