"""Reading landed files: envelopes, day logs, key-value files, XML records, signals, PDFs."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.workers import importable

RECORD = (
    "pmid string, doi string, pmcid string, titulo string, revista string, anio string, autores array<string>, tipos array<string>, "
    "mesh array<string>, abstract string, url_pubmed string, estrato string, acceso string, url_pdf string, url_texto string, licencia string, ruta_pdf string"
)
ENVELOPE = f"tema string, enfoque string, generado string, n_fuentes int, fuentes array<struct<{RECORD.replace(' string', ':string').replace(' array', ':array')}>>"
TRACE = "ts string, agent string, project string, turns array<struct<role:string,summary:string>>, tools array<struct<name:string,ok:boolean>>, usage struct<model:string,input:bigint,output:bigint,cost_usd:double>, latency_s double"
#: A record as the XML reader gives it: only what is needed is read.
ARTICLE = (
    "MedlineCitation struct<PMID:string,DateCompleted:struct<Year:string>,Article:struct<Journal:struct<ISOAbbreviation:string,Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "ArticleDate:struct<Year:string>,ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,Initials:string,CollectiveName:string>>>,PublicationTypeList:struct<PublicationType:array<string>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>,PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def envelope(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per record of JSON envelopes (a file each, or with `lines` a line each), with
    the envelope's topic and focus."""
    rows = spark.read.schema(ENVELOPE).json(path, multiLine=not lines)
    return rows.select("tema", "enfoque", F.posexplode("fuentes").alias("seq", "f")).select("tema", "enfoque", "seq", "f.*")


def day_log(spark: SparkSession, folder: str, day: str) -> DataFrame:
    return spark.read.schema(TRACE).json(f"{folder}/{day}.jsonl")


def day_rows(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """A day of an appended log (see outputs.append_log): only its folder is read."""
    return spark.read.schema(f"{TRACE}, day date").json(folder).where(F.col("day") == F.lit(day).cast("date"))


def sorted_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, name and length of the files under a folder that match, in the order of their
    paths; their contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("path")


def specs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON specs, a line each or (a file that is one spec) whole."""
    return spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))


def parsed(rows: DataFrame, text: str, schema: str, most: int = 200, stop: bool = False) -> DataFrame:
    """Adds `value`, the JSON of a column, and `error`: an excerpt of what is no JSON, else
    null. stop: the first such text ends the job with its excerpt."""
    bad = F.col(text).isNotNull() & F.try_parse_json(F.col(text)).isNull()
    excerpt = F.concat(F.lit("JSON inválido: "), F.substring(text, 1, most))
    error = F.when(bad, F.raise_error(excerpt).cast("string") if stop else excerpt)
    return rows.withColumns({"error": error, "value": F.when(~bad, F.from_json(F.col(text), schema))})


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Flat records of XML files."""
    return flat(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path))


#: Batches that are a filter rather than a join.
PRUNED = 1000


def fetch(spark: SparkSession, folder: str, ids: DataFrame, key: str) -> DataFrame:
    """`key`, status and the record's columns of each id asked for, out of what
    outputs.land_xml() has landed: ok, missing (never landed), or broken (landed, but its
    XML can't be read). Batch numbers come from the index: up to PRUNED of them are a
    filter on folders, so that no other file is read; more are joined."""
    index = spark.read.schema("id string, batch long").parquet(f"{folder}/index")
    asked = ids.select(F.col(key).cast("string").alias("id")).distinct().join(index, "id", "left")
    batches = asked.select("batch").where("batch IS NOT NULL").distinct()
    texts = spark.read.schema("value string, batch long").option("wholetext", "true").text(f"{folder}/records")
    few = [r["batch"] for r in batches.limit(PRUNED + 1).collect()]
    texts = texts.where(F.col("batch").isin(few)) if len(few) <= PRUNED else texts.join(batches, "batch", "left_semi")
    # record by record, for the XML source gives up a file at its first broken one
    each = texts.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"), F.lit(0))).alias("x"))
    found = flat(each.select(F.from_xml("x", ARTICLE).alias("a")).select("a.*")).where("pmid <> ''").dropDuplicates(["pmid"])
    out = asked.join(found, asked["id"] == found["pmid"], "left")
    status = F.when(F.col("pmid").isNotNull(), "ok").when(F.col("batch").isNull(), "missing").otherwise("broken")
    return out.select(F.col("id").alias(key), status.alias("status"), *[c for c in found.columns if c != key])


def flat(rows: DataFrame) -> DataFrame:
    """Nested articles to records: the first year there is, authors with a name, labelled
    abstract, the last identifier of each kind, twelve headings."""
    a, some = "MedlineCitation.Article.", lambda *c: F.coalesce(*[F.nullif(F.trim(F.col(x)), F.lit("")) for x in c], F.lit(""))
    name = lambda x: F.when(F.coalesce(x["LastName"], F.lit("")) != "", F.trim(F.concat_ws(" ", x["LastName"], x["Initials"]))).otherwise(F.nullif(x["CollectiveName"], F.lit("")))
    part = lambda x: F.concat(F.when(F.coalesce(x["_Label"], F.lit("")) != "", F.concat(x["_Label"], F.lit(": "))).otherwise(""), F.trim(F.coalesce(x["_VALUE"], F.lit(""))))
    lists = lambda c: F.coalesce(c, F.array())
    last = lambda kind: F.coalesce(F.trim(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(lists(F.col("PubmedData.ArticleIdList.ArticleId")), lambda x: x["_IdType"] == kind), lambda x: F.coalesce(x["_VALUE"], F.lit("")))), -1)), F.lit(""))
    medline = F.substring(F.col(a + "Journal.JournalIssue.PubDate.MedlineDate"), 1, 4)
    year = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (a + "Journal.JournalIssue.PubDate.Year", a + "ArticleDate.Year", "MedlineCitation.DateCompleted.Year")], medline, F.lit(""))
    pmid = F.coalesce(F.col("MedlineCitation.PMID"), F.lit(""))
    return rows.select(
        pmid.alias("pmid"), last("doi").alias("doi"), last("pmc").alias("pmcid"), some(a + "ArticleTitle").alias("titulo"),
        some(a + "Journal.ISOAbbreviation", a + "Journal.Title").alias("revista"), year.alias("anio"),
        F.filter(F.transform(lists(F.col(a + "AuthorList.Author")), name), lambda x: x.isNotNull()).alias("autores"),
        lists(F.col(a + "PublicationTypeList.PublicationType")).alias("tipos"),
        F.slice(lists(F.transform("MedlineCitation.MeshHeadingList.MeshHeading", lambda x: x["DescriptorName"])), 1, 12).alias("mesh"),
        F.trim(F.array_join(F.transform(lists(F.col(a + "Abstract.AbstractText")), part), " ")).alias("abstract"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url_pubmed"),
    )


def key_values(lines: DataFrame, line: str = "line", order: str = "ord") -> DataFrame:
    """key, value and place: blank lines, comments and lines without '=' are left out, the
    first '=' divides, quotes around go; of a key's lines the first counts."""
    t = F.trim(F.col(line))
    rows = lines.where((t != "") & ~t.startswith("#") & F.contains(t, F.lit("="))).select(F.col(order).alias("ord"), F.split(t, "=", 2).alias("kv"))
    rows = rows.select("ord", F.trim(F.col("kv")[0]).alias("key"), F.regexp_replace(F.trim(F.col("kv")[1]), r"""\A["']+|["']+\z""", "").alias("value"))
    return rows.groupBy("key").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def front_matter(files: DataFrame, text: str = "text", folder: str = "folder") -> DataFrame:
    """name (else the folder) and description of each skill file."""
    first = lambda key: F.nullif(F.trim(F.regexp_extract(F.col(text), rf"(?md)^{key}:\s*(.+)$", 1)), F.lit(""))
    return files.withColumns({"name": F.coalesce(first("name"), F.col(folder)), "description": F.coalesce(first("description"), F.lit(""))})


def pdf_verdict(length: Column, head: Column) -> Column:
    return F.when(length.isNull(), "no existe").when(length < 20_000, "demasiado pequeño").when(F.substring(head, 1, 4) != F.lit("%PDF").cast("binary"), "no es PDF").otherwise("ok")


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """name, length and verdict of the PDF files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", pdf_verdict(F.col("length"), F.col("content")).alias("verdict"))


#: Fixed value: why a file of this kind isn't read.
UNREAD = "ERROR: .sd es binario propietario (Cadwell). Conecta aquí el parser OLE/binario para extraer NCV/EMG antes de de-identificar."


def study(spark: SparkSession, path: str) -> DataFrame:
    """One row, text and error: a file's whole text, bad bytes replaced and line ends made
    the same; or no text, and why the file isn't read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    error = None
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        error = f"ERROR: no existe {path}"
    elif PurePosixPath(path).suffix.lower() == ".sd":
        error = UNREAD
    if error:
        return spark.createDataFrame([(None, error)], "text string, error string")
    whole = F.make_valid_utf8(F.col("content").cast("string"))
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(whole, "\r\n?", "\n").alias("text"), F.lit(None).cast("string").alias("error"))


def studies(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text and error of all files under a folder, as study() gives them for one: a
    row a file, whose contents are read only where its suffix is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    closed = F.lower("path").endswith(".sd")
    whole = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return rows.select("path", F.when(~closed, whole).alias("text"), F.when(closed, UNREAD).alias("error"))


def matrices(spark: SparkSession, folder: str) -> DataFrame:
    """path, channel, t and v of the CSV matrices and NPY files under a folder: files are
    dealt over the tasks, and each is read whole by one."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,npy}").option("recursiveFileLookup", "true").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                for c, v in enumerate(_channels(raw, path.endswith(".npy"))):
                    yield pd.DataFrame({"path": path, "channel": np.int32(c), "t": np.arange(len(v), dtype=np.int32), "v": v.astype(float)})

    importable(spark)
    return rows.select("path", "content").mapInPandas(run, "path string, channel int, t int, v double")


def _channels(raw: bytes, npy: bool) -> list[np.ndarray]:
    a = np.load(io.BytesIO(raw)) if npy else np.loadtxt(io.BytesIO(raw), delimiter=",")
    if a.ndim not in (1, 2):
        raise ValueError(f"a matrix is needed, not {a.ndim} dimensions")
    return list(a.T) if a.ndim == 2 else [a]


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(channel, t, v) of a CSV matrix or an NPY file: a row a sample, a column a channel; a
    single row or column is one channel. One task reads the file."""
    npy = path.endswith(".npy")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                for c, v in enumerate(_channels(raw, npy)):
                    yield pd.DataFrame({"channel": np.int32(c), "t": np.arange(len(v), dtype=np.int32), "v": v.astype(float)})

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "channel int, t int, v double")


def first_pages(pages: DataFrame, key: str, page: str, text: str, most: int = 4) -> DataFrame:
    """Lower-cased text of the first pages, joined by spaces."""
    got = pages.where(F.col(page) < most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("x"))
    return got.select(key, F.lower(F.array_join(F.col("x")[text], " ")).alias(text))
