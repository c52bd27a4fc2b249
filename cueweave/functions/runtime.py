"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach: spark.checkpoint.dir, or what the session has set as such. Only a local session without any (tests) gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return (named or current.get()).rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder: on a cluster, intermediate tables need one that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cueweave-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, within the shared one unless the session has set its own."""
    sc = spark.sparkContext
    folder = shared_folder(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
