"""From documents to token ids: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before it kept. The fit of the classifier and
the vocabularies are the only things that don't come from the stage's own input.

Defined results, in all stages: texts of any length are read whole; a null text counts as
an empty one and stays null. An empty table gives an empty one. All but the last stage
return the columns that they are given, with their values, whatever the columns are named;
the last one returns its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, exact_dedup, jaccard, mixing, quality
from quillmill.llm.common import Workspace


READ = ("doc_id", "text")


def _packed(docs: DataFrame) -> DataFrame:
    """The id, the text, and all else in one column, which no result's can clash with."""
    return docs.select(*READ, F.struct(F.lit(0).alias("__none"), *[c for c in docs.columns if c not in READ]).alias("__others"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in READ else F.col("__others")[c].alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go. Rows are judged alone, by their texts, so
    rows that agree in the text stay or go together, and a null id makes no difference. A
    score at the threshold is kept."""
    model = quality.fit(docs.select(*READ), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return _unpacked(quality.score(_packed(docs), model).where("predicted = 1"), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, one with a null id only where no
    other has one. Of rows that agree in both, one stays."""
    return _unpacked(exact_dedup.exact_dedup(_packed(docs)).where("kept"), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the least id stays, null ids being the last. Rows
    without words are linked with nothing and stay; rows that agree in id and text stay or
    go together."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, always whole. Null sources
    are one source. Documents without words are in no mix; rows that agree in id and text
    are taken alike."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and a digest of what they decode to. Rows are encoded alone;
    a null text has no ids and decodes to no bytes."""
    import public_tokenizers as vocabularies

    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, decode=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier, the shingle hashes and the encoder have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        rows = ws.write(stage(spark, rows, sf_dir), f"stage{k}")
    return rows
