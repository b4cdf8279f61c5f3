"""A day log that a stream appends to exactly once.

Each micro-batch is written to a folder of its own, by day, replacing what an attempt that
failed may have left there; then its number is entered into a manifest by renaming a file
that is complete. A batch that is replayed and finds its entry writes nothing. Readers
take the batches of the manifest alone, so they see a batch whole or not at all.

    folder/data/batch=7/day=2024-01-15/part-...json
    folder/manifest/7

A log belongs to one stream, with one checkpoint: batch numbers are the checkpoint's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def commit(rows: DataFrame, batch: int, folder: str, day: str, before_entry: Callable[[int], None] | None = None) -> bool:
    """Writes a batch and enters it; False if it had been entered before. before_entry is
    called between the two (a place to fail, for tests)."""
    spark = rows.sparkSession
    files, entry = _files(spark, f"{folder}/manifest/{batch}")
    if files.exists(entry):
        return False
    rows.withColumn("day", F.to_date(day)).write.mode("overwrite").partitionBy("day").option("ignoreNullFields", "true").json(f"{folder}/data/batch={batch}")
    if before_entry:
        before_entry(batch)
    new = entry.suffix(".new")
    out = files.create(new, True)
    out.writeBytes(f"{batch}\n")  # Spark leaves out empty files
    out.close()
    if not files.rename(new, entry):
        raise OSError(f"batch {batch} could not be entered")
    return True


def append(stream: DataFrame, folder: str, day: str, checkpoint: str, before_entry: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a stream that appends its rows to the log."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: commit(rows, batch, folder, day, before_entry) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch: the numbers in the manifest."""
    files, where = _files(spark, f"{folder}/manifest")
    if not files.exists(where):
        return spark.createDataFrame([], "batch long")
    names = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.text(f"{folder}/manifest").where(names.rlike("^[0-9]+$")).select(F.col("value").cast("long").alias("batch"))


def read(spark: SparkSession, folder: str, schema: str, day: str | None = None) -> DataFrame:
    """Rows of the batches that are entered, of one day if it is given: only its folders
    are read. Spark joins with the manifest, and prunes batches by it where it is small."""
    files, where = _files(spark, f"{folder}/data")
    if not files.exists(where):
        return spark.createDataFrame([], f"{schema}, batch long, day date").drop("batch")
    rows = spark.read.schema(f"{schema}, batch long, day date").json(f"{folder}/data")
    if day:
        rows = rows.where(F.col("day") == F.lit(day).cast("date"))
    return rows.join(committed(spark, folder), "batch", "left_semi").drop("batch")
