"""Reading inputs; how lineage is cut is in ``lineage``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settled, shared_dir  # noqa: F401
from ..shipping import ship


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and Arrow batches of BATCH_BYTES at most.

    Spark's own bound of 64 MB a batch exists several times over in each task, in the JVM and in Python.
    """
    spark.conf.set(BATCH, str(BATCH_BYTES))
    return ship(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def set_apart(df: DataFrame) -> tuple[DataFrame, dict[str, Column], list[Column]]:
    """df with its columns numbered, so that names of an operator's own clash with none; the column of each old name; what restores the names."""
    numbered = df.toDF(*(f"in_{i}" for i in range(len(df.columns))))
    return numbered, {c: F.col(f"in_{i}") for i, c in enumerate(df.columns)}, [F.col(f"in_{i}").alias(c) for i, c in enumerate(df.columns)]
