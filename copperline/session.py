"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_scratch: list[str] = []


def build_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass in your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("copperline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="copperline-"))
    return _local_scratch[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder.

    The rows are computed once and survive the loss of executors, and the table's size lets
    the next join pick its strategy.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/copperline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
