"""Cutting lineage: rows that are stored once and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all run on it (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="wakeline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settled(df: DataFrame) -> DataFrame:
    """df with its rows stored in the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
