"""What is written between the steps of a job: checkpoints and tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
            shared = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


_COALESCE = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its size is known to the planner and its columns are read one by one.

    Small partitions behind a shuffle are joined to full ones, so that a small table
    is a few files; ``wide`` leaves them apart, for costly work on each row.
    """
    spark = df.sparkSession
    folder, before = new_folder(spark), spark.conf.get(_COALESCE)
    spark.conf.set(_COALESCE, before if wide else "false")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_COALESCE, before)
    return spark.read.schema(df.schema).parquet(folder)
