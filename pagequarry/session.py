"""What operators need from the session: checkpoints in the shared folder and size checks before broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its own content, that an operator sends whole to every executor.
BROADCAST_BYTES = 32 << 20


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir and read from there, so that a lost executor loses nothing.

    A folder of its own is made only in local mode where the session names none (tests); on a cluster that is an error.
    What is written is removed once nothing refers to it, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def drop_shuffles(df: DataFrame) -> None:
    """Removes the files of df's own shuffles, once nothing will run it again; else they stay until the driver happens to
    collect its garbage."""
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    plan = df._jdf.queryExecution().executedPlan()
    if cleaner.isEmpty() or plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return
    for shuffle in list(plan.context().shuffleIds()):
        cleaner.get().doCleanupShuffle(shuffle, True)


def content_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, by a distributed sum."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that it needn't be installed there."""
    context = spark.sparkContext
    if getattr(context, "_pagequarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver's own session folder: executors fetch the file from the driver, and Spark removes it at the end.
    archive = Path(context._temp_dir, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name, file.relative_to(root)))
    context.addPyFile(str(archive))
    context._pagequarry_shipped = True
