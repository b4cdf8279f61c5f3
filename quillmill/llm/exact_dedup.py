"""Exact dedup by a content sort, with DataFrame functions only.

Texts are normalised (A-Z lower-cased, null as empty) and dealt out by sampled
splitters over the content: repartitionByRange samples the leading characters of the
texts and a hash of the whole, so that splitters stay small however long the texts are
and texts that only share their start are still spread. Each partition is sorted by the
whole text (Spark's external sorter), which places equal texts side by side; the window
over them compares neighbours in full, not by a digest, and takes the identifier that
stays.

A group of copies that would fill a task is dealt out by a salt as well. Whether a text
belongs to such a group is told by the counts of a 64-bit hash; at most `4 * partitions`
hashes can each have more than a 1 / (4 * partitions) share of the rows, so that list is
bounded by the partitions, not by the data. The totals of those groups come from an
aggregation by whole text, which shrinks to a row per text and task before it is
shuffled.

Defined results: a null text equals the empty text. A row whose id is null stays only
where no row of its group has an id; keep_id is null then.
Rows that agree in id and text are one group; exactly one row of each group is kept.
An empty table gives an empty table. Further columns pass through untouched; those named
like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import ascii_lower

#: Leading characters of a text that the splitters see.
HEAD = 64
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hot_rows: int = 1000) -> DataFrame:
    """All rows and columns of `docs`, with keep_id, group_size, kept and text_sha256.

    keep: whether the "largest" or the "smallest" id of equal texts stays.
    hot_rows: groups of no more rows are never salted."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm, hashed = ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "__hash"
    best = (lambda c: F.max(c)) if keep == "largest" else (lambda c: F.min(c))
    rows = docs.drop(*RESULT).withColumn("__norm", norm).withColumn(hashed, F.xxhash64("__norm"))

    counts = docs.select(F.xxhash64(norm).alias(hashed)).groupBy(hashed).agg(F.count("*").alias("__n"))
    n = docs.count()
    least = max(hot_rows, n // (4 * parts))
    hot = [r[0] for r in counts.where(F.col("__n") > least).select(hashed).collect()]  # at most 4 * parts hashes

    is_hot = F.col(hashed).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64(id_col), F.lit(4 * parts))).otherwise(F.lit(0))
    place = ["__head", hashed, *["__salt"] * bool(hot)]  # a constant would keep Spark from seeing that the window needs no further exchange
    dealt = rows.withColumns({"__head": F.substring("__norm", 1, HEAD), "__salt": salt}).repartitionByRange(*place)
    group = Window.partitionBy(*place, "__norm")
    first = group.orderBy(F.col(id_col).desc() if keep == "largest" else F.col(id_col).asc_nulls_last())
    out = dealt.withColumns({
        "__rank": F.row_number().over(first),
        "keep_id": best(id_col).over(group),
        "group_size": F.count("*").over(group),
    }).withColumn("text_sha256", F.sha2("__norm", 256))
    if hot:
        totals = (
            docs.select(F.col(id_col).alias("__id"), norm.alias("__norm")).where(F.xxhash64("__norm").isin(hot))
            .groupBy("__norm").agg(best("__id").alias("__best"), F.count("*").alias("__all"))
            .select(F.sha2("__norm", 256).alias("text_sha256"), "__best", "__all", F.lit(True).alias("__hot"))
        )
        # at most 4 * parts rows of fixed width
        out = out.join(F.broadcast(totals), "text_sha256", "left")
        out = out.withColumns({
            "keep_id": F.when(F.col("__hot"), F.col("__best")).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("__all", "group_size"),
        })
    out = out.withColumn("kept", (F.col("__rank") == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
    return out.select(*[c for c in docs.columns if c not in RESULT], *RESULT)


def op3_content_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
