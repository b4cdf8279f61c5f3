"""What the training-data operators share: places to write, ordering, and text rules."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources.outputs import remove_at_exit
from quillmill.workers import slices  # noqa: F401  its users are beside this module

#: White space of every word rule: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_own: dict[str, str] = {}


#: Rows of an Arrow batch. Texts are long: Spark's default of 10,000 makes batches of tens
#: of megabytes, held several times over by the JVM and its Python workers.
BATCH = "1000"


def ready(spark: SparkSession) -> None:
    """Python workers started from now on can import this package, and get smaller Arrow
    batches than by default (a setting of the session)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is
    unset (tests on one machine), a folder of this session, removed at exit."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


class Workspace:
    """A new folder in the shared one. Lineage is cut by writing tables there: they
    survive lost executors, and are read with their columns pruned. Results are read from
    it, so it is removed when the driver's process ends."""

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/quillmill/{uuid.uuid4().hex}"
        remove_at_exit(spark, self.path)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no result to come reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    """Joins with a table of one row a key. `hot` lists keys that many rows of `left` have;
    the caller bounds their number. Their rows meet a broadcast of those keys alone."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right.where(~is_hot), key, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, as the rule for words does."""
    return (text or "").encode().lower().split()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def offsets(df: DataFrame, part: str, size: str) -> DataFrame:
    """One row per part, in order of part: part, and `offset`, the sizes of all parts
    before it. `part` numbers the partitions of an ordered table, so that rows here
    are as many as its files, whatever the table holds."""
    from pyspark.sql import Window

    sums = df.groupBy(part).agg(F.sum(size).alias("__size"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("long").alias("offset"))
