"""Session helpers: shared folder, lineage cuts, table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, app: str = "lexmill") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found:
        current = jsc.getCheckpointDir()
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="lexmill-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; survives the loss of executors, keeps the partitioning."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; nothing is read but the columns the plan needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
