"""The folder that driver and executors share, and tables settled there so that nothing above them runs again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster this is ``spark.checkpoint.dir``. Where it is unset (tests, a single machine) a
    temporary folder is set as the checkpoint folder of this session.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint; for tables that are small or used often."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
