"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may leave it unset and gets a folder of this machine."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: the rows lie in the shared folder, so that a lost executor loses none."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
