"""Keeping a table of sections up to date with a stream of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators.slicer import sections_of


def newest(pages: DataFrame) -> DataFrame:
    """Of each path, the row ingested last; of equal ones, any."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.col("ingested_at").desc_nulls_last()))
    return pages.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def slice_stream(pages: DataFrame, to: str, checkpoint: str, max_level: int = 3, once: bool = False) -> StreamingQuery:
    """Writes the sections of each micro-batch's pages as one Parquet folder per batch (batch=N): a batch that is run
    again after a failure overwrites its own folder, so each page's sections are written once."""

    def write(batch: DataFrame, number: int) -> None:
        sections_of(newest(batch), max_level).write.mode("overwrite").parquet(f"{to}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_sections(spark: SparkSession, to: str) -> DataFrame:
    """Sections of the last batch in which each page came."""
    rows = spark.read.option("basePath", to).parquet(to)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").drop("batch")
