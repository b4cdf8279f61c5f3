"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: a budget of words is shared over the sources in proportion to their weights. A
source whose share is above `max_epochs` times its size is clamped there; what it can't
take goes to the others by weight, and so on until no share is above its clamp. Each
round is one small aggregation over the table of sources (a row per source, in the
shared folder); the driver sees sums only.

Repetitions: a source with a target of e times its size takes floor(e) whole repetitions
of each document, and a seeded sample for the rest. The sample is the documents in the
order of a seeded hash of their ids, up to the words that are still to be taken; the
document at which they run out is taken in part, so that a source's words sum up to its
target, rounded. To find that place, documents are summed by ranges of the hash (about
`bucket_rows` each, as many as a source needs): only one range of each source is ever
sorted, so no task holds a whole source.

Defined results: a null text has size 0, as has an empty one. Rows with a null source
are one source, the last. A source without words has target 0. Rows that agree in id are
taken in the order of their sizes. Texts of any length are counted whole. mix() reads the
id, the text and the source alone, whatever other columns are named; repeat() passes all
columns through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, Workspace

#: Hex digits of the MD5 that orders documents: 52 bits.
DIGITS = 13


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_weights(weights: tuple[float, ...] = (3, 1, 2)):
    """Weights by the place of a source in code point order, null last, repeating."""

    def give(sources: DataFrame) -> DataFrame:
        # a row per source, not per document, is ordered here
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        listed = F.array(*[F.lit(float(w)) for w in weights])
        return sources.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))

    return give


def water_fill(ws: Workspace, sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds `target` to sources(source, size, rows, weight)."""
    cap = F.col("size") * F.lit(float(max_epochs))
    level, clamped = None, F.lit(False)
    while True:
        left, weight, full = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)),
            F.count_if(clamped),
        ).first()
        if not weight:
            return sources.withColumn("target", cap)
        level = max(0.0, budget - left) / weight
        above = clamped | (F.col("weight") * F.lit(level) > cap)
        if sources.agg(F.count_if(above)).first()[0] == full:
            return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))
        # the clamped stay clamped: the level only rises
        clamped = F.col("weight") * F.lit(level) > cap if full == 0 else above
        sources = ws.write(sources.withColumn("__clamped", clamped).select("source", "size", "rows", "weight", "__clamped"), f"sources{full}")
        clamped = F.col("__clamped")


def mix(docs: DataFrame, weigh=None, budget_ratio: float = 1.5, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken."""
    ws = Workspace(docs.sparkSession)
    sized = ws.write(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, DIGITS), 16, 10).cast("long").alias("u"),
        ),
        "sized",
    )
    sources = ws.write((weigh or rank_weights())(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))).select("source", "size", "rows", "weight"), "sources")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(ws, sources, budget_ratio * total, max_epochs)
    need = F.round("target").cast("long")
    plan = ws.write(
        filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(need / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("rest", need - F.col("whole") * F.col("size"))
        .select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "whole", "rest", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("long").alias("buckets")),
        "plan",
    )
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["s"])).drop("s")
    rows = rows.withColumn("bucket", F.floor(F.col("u") / F.lit(float(16**DIGITS)) * F.col("buckets")).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    cut = ws.write(
        sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left")),
        "cut",
    )
    rows = rows.join(cut, rows["source"].eqNullSafe(cut["s"]), "left").drop("s")
    inside = (F.col("bucket") == F.col("cut")) & (F.col("left") > 0)
    within = rows.where(inside)
    ahead = F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(ahead, F.lit(0)))).cast("long")
    extra = F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0)).cast("long")
    rows = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", extra).unionByName(within.withColumn("extra", part))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, always whole. The last
    one of a source, of which mix() takes a part, comes once more as a whole, so a source's
    words are above its target by less than that document's. Documents of which nothing is
    taken, and those without words, are left out. Rows that agree in id and text are
    treated alike."""
    rows = docs.withColumn("__row", F.xxhash64(id_col, text_col))
    taken = mix(rows, id_col="__row", text_col=text_col, **options).where("taken > 0").select(F.col("doc_id").alias("__row"), "size", "taken").dropDuplicates(["__row"])
    taken = taken.select("__row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    out = rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*docs.columns)


def op1_capped_water_filling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows_,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
tot AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM src),
ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS k FROM src),
lev AS (
  SELECT o.*, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM ordered o),
pick AS (
  SELECT (budget - capped) / open_w AS level, k FROM lev, tot
  WHERE weight * ((budget - capped) / open_w) <= cap ORDER BY k LIMIT 1),
tgt AS (
  SELECT source, source_size, CASE WHEN o.k < pick.k THEN cap ELSE weight * level END AS target FROM ordered o, pick),
plan AS (
  SELECT *, round(target)::BIGINT AS need FROM tgt),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN need // source_size ELSE 0 END AS whole FROM plan),
ranked AS (
  SELECT z.doc_id, z.size, c.source_size, c.target, c.whole, c.need - c.whole * c.source_size AS rest,
         coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.u, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized z JOIN cut c ON z.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken
FROM ranked
"""
