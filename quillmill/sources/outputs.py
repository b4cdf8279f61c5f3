"""What is written: envelopes, day logs, and Markdown made of ordered lines."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What access classes are called.
ACCESS = {"pmc": "PMC (libre)", "oa": "Open access", "paywall": "Paywall — requiere proxy UC"}


def access_label(access: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, label in ACCESS.items():
        out = F.when(access == key, label).otherwise(out)
    return F.coalesce(out, access)


def lines_joined(rows: DataFrame, order: str, line: str, key: str | None = None) -> DataFrame:
    """One text of the lines in order, for each key; without a key the table must be a
    report's, whose lines fit a row."""
    grouped = rows.groupBy(key) if key else rows.groupBy()
    return grouped.agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))["l"], "\n").alias("text"))


def bibliography_line(number: Column, cite: Column, stratum: Column, access: Column, url: Column) -> Column:
    line = F.concat(number.cast("string"), F.lit(". "), cite, F.lit(" — *"), stratum, F.lit("* · "), access_label(access))
    return F.when(url != "", F.concat(line, F.lit("\n   - Texto completo: "), url)).otherwise(line)


def envelope_json(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and a JSON envelope with its records in order and their number."""
    record = F.struct(F.col(order).alias("o"), F.struct(*[c for c in rows.columns if c not in (key, order)]).alias("r"))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("x"))
    return got.select(key, F.to_json(F.struct(F.size("x").alias("n"), F.col("x.r").alias("records"))).alias("json"))


def append_log(rows: DataFrame, folder: str, day: str) -> None:
    """Day logs: one folder a day, appended to."""
    rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").json(folder)


_made: list[tuple] = []


@atexit.register
def _clear() -> None:
    for files, path in _made:
        try:
            files.delete(path, True)
        except (Py4JError, OSError):  # the JVM has ended before
            return


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder that results are read from once the driver's process ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where))


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, removed when the driver's
    process ends. On one machine without spark.checkpoint.dir it is a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"quillmill-{os.getpid()}")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base.rstrip('/')}/landed/{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def overwrite_json(rows: DataFrame, path: str) -> None:
    """Puts `rows` in the place of the JSON at `path`, which they may be read from: they
    are written beside it first, and then renamed. Between the two renames there is nothing
    at `path`; read_json() then takes what was there before."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, beside, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".old"))
    files = where.getFileSystem(conf)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path + ".new")
    if files.exists(where):
        files.delete(old, True)
        files.rename(where, old)
    if not files.rename(beside, where):
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What overwrite_json() has put at `path`, or, where it died between its renames, what
    was there before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path if there else path + ".old")


def land_xml(records: DataFrame, key: str, xml: str, folder: str, coarse: list[Column] | None = None, size: int = 150) -> None:
    """Lands XML records in files of `size`, in the order of their keys, and an index of
    which file has which key. coarse: the beginning of that order, of the column `id`."""
    from quillmill.operators.selection import ranked

    rows = ranked(records.select(F.col(key).alias("id"), F.col(xml).alias("xml")), [], coarse or [], [F.col("id")], "n")
    rows = rows.select(F.col("id").cast("string").alias("id"), F.floor((F.col("n") - 1) / size).alias("batch"), "xml")
    rows.select("id", "batch").write.parquet(f"{folder}/index")
    whole = rows.groupBy("batch").agg(F.array_join(F.collect_list("xml"), "\n").alias("xml"))  # of `size` records
    whole.select("batch", F.concat(F.lit("<Set>\n"), "xml", F.lit("\n</Set>")).alias("value")).write.partitionBy("batch").text(f"{folder}/records")


def with_spec(rows: DataFrame, spec: list[str], path: str) -> None:
    """Writes rows as JSON, and what they were made from (the columns `spec`) beside them,
    as <path>.spec, for trace."""
    rows.write.json(path)
    rows.select(F.to_json(F.struct(*spec)).alias("value")).write.text(path + ".spec")


def proposal(ident: Column, title: Column, section: Column, change: Column, status: Column) -> Column:
    """A proposal as Markdown lines."""
    return F.concat_ws("\n", F.concat(F.lit("# "), ident), F.concat(F.lit("- titulo: "), title), F.concat(F.lit("- seccion: "), section.cast("string")), F.concat(F.lit("- estado: "), status), F.lit(""), change)


def changelog(version: Column, day: Column, title: Column, before: Column) -> Column:
    """The log with an entry put before the others."""
    return F.concat(F.lit("## "), version, F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")\n- "), title, F.lit("\n"), before)
