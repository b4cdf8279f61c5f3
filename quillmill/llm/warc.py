"""WARC archives in which equal payloads are kept once.

Only headers are shuffled by payload digest: each page's id, address, size and SHA-1. Of
equal payloads of at least `min_bytes` the one of the largest page id is the response, and
the others become revisit records that name it. What the headers decide is joined with the
pages by a key of their own (where the decisions are small, Spark sends them to the pages),
and the records are written with fresh headers by Spark's text writer, gzipped: a record is
a value, and the blank lines that end it are the line separator.

To read archives, Spark's text source gives their lines in order (gzip files are never
split), and a task puts records together by Content-Length, one at a time. Revisit records
are then joined with the responses that they name, by record id and digest.

A digest, page or response that more than 1 / (4 * partitions) of the rows have is in a list
of fewer than 4 * partitions; its rows meet a broadcast of so many rows, and the others a
shuffle join.

Defined results: a null payload counts as empty. Null ids and addresses are headers left
out, and null again when read; a null id is the response only where no equal payload has an
id. Rows that agree in id, address and payload become a record each, of which at most one is
the response. Control characters in addresses are percent-encoded. Payloads of any length
are written whole. Only the columns named are read, whatever others there are. An empty
table gives archives without records. Reading: a revisit of a response that isn't there has
null sizes and digests; records cut off at the end of a file are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace, join_hot, ready

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD = "record_id string, record_type string, page_id string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, payload binary"
#: Bytes of payloads and records in an Arrow batch of what is read.
BYTES, ROWS = 1 << 23, 500


def _uuid(text: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _key() -> Column:
    """Null fields are left out of the JSON, so they differ from empty ones."""
    return F.md5(F.to_json(F.struct("page_id", "url", "digest")).cast("binary"))


def prepared(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")}).withColumn("key", _key())


def resolve(ws: Workspace, rows: DataFrame, min_bytes: int) -> tuple[DataFrame, list[str]]:
    """Of prepared rows: key, digest, copies, kept, and page and address of the response,
    for those whose payload is there more than once; and the keys that many rows have."""
    heads = ws.write(rows.where(F.col("bytes") >= min_bytes).groupBy("key", "page_id", "url", "digest").agg(F.count("*").alias("copies")), "heads")
    parts = 4 * int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    least = (heads.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]) // parts
    # nulls are the least in a struct
    best = ws.write(heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("to"), F.sum("copies").alias("n"), F.count("*").alias("keys")).where("n > 1"), "best")
    common = [r[0] for r in best.where(F.col("keys") > max(1000, least)).select("digest").collect()]  # fewer than `parts`
    hot = [r[0] for r in heads.where(F.col("copies") > max(1000, least)).select("key").collect()]  # fewer than `parts`
    found = join_hot(heads, best.select("digest", "to"), "digest", "inner", common)
    kept = F.col("page_id").eqNullSafe(F.col("to.page_id")) & F.col("url").eqNullSafe(F.col("to.url"))
    return ws.write(found.select("key", "digest", "page_id", "url", "copies", kept.alias("kept"), F.col("to.url").alias("to_url")), "decisions"), hot


def record(rows: DataFrame, revisit: Column, record_id: Column, date: str) -> DataFrame:
    """The records of rows(page_id, url, digest, payload, to_url) as one column of text."""
    def line(name: str, value: Column) -> Column:  # null where the value is
        return F.concat(F.lit(f"{name}: "), value)

    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END))), F.lit(END)).cast("binary")
    block = F.concat(http, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat_ws(
        END, F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))), line("X-Page-ID", clean(F.col("page_id").cast("string"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat_ws(END, line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(F.col("digest"))), line("WARC-Refers-To-Target-URI", clean(F.col("to_url"))), line("WARC-Refers-To-Date", F.lit(date)))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head.cast("binary"), F.lit(b"\r\n\r\n"), block).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    ws = Workspace(pages.sparkSession)
    rows = prepared(pages, id_col, url_col, payload_col)
    decisions, hot = resolve(ws, rows, min_bytes)
    found = join_hot(rows, decisions.select("key", "copies", "kept", "to_url"), "key", "left", hot)
    many = F.coalesce(F.col("kept") & (F.col("copies") > 1), F.lit(False))
    fresh = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    # a response that others refer to has the id that they name
    out = [record(found.where(~many), F.coalesce(~F.col("kept"), F.lit(False)), F.when(F.col("kept"), _uuid(F.col("digest"))).otherwise(fresh), date)]
    if not decisions.where(many).isEmpty():  # of rows that agree in all, one is the response
        once = found.where(many).groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "digest", "payload", "to_url")])
        out.append(record(once, F.lit(False), _uuid(F.col("digest")), date))
        others = decisions.where(many).withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), "copies"))).withColumn("payload", F.lit(b""))
        out.append(record(others, F.lit(True), fresh, date))
    reduce(DataFrame.union, out).write.option("lineSep", 2 * END).option("compression", "gzip").text(path)
    for name in ("heads", "best", "decisions"):
        ws.drop(name)


class Lines:
    """Records out of an archive's lines, given one by one without their line feeds."""

    def __init__(self) -> None:
        self.head: list[bytes] = []
        self.need, self.block = -1, []

    def feed(self, text: bytes):
        """The headers and the block of the record that this line ends, or None."""
        if self.need >= 0:
            self.block.append(text)
            self.need -= len(text) + 1
            return self._ended() if self.need < 0 else None  # with what follows the block
        text = text.rstrip(b"\r")
        if text and (self.head or text.startswith(b"WARC/")):
            self.head.append(text)
        elif self.head:
            pairs = [x.partition(b":") for x in self.head[1:]]
            self.fields = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}
            length = self.fields.get("content-length", "0")
            self.head, self.need, self.block = [], int(length) if length.isdigit() else 0, []
            if not self.need:
                return self._ended()
        return None

    def _ended(self):
        block = b"\n".join([*self.block, b""])
        block = block[: len(block) + self.need] if self.need < 0 else block
        self.need, self.block = -1, []
        return self.fields, block


def hex_digest(value: str | None) -> str | None:
    """A labelled SHA-1, in base 32 or hexadecimal digits, as the latter."""
    label, _, digits = (value or "").partition(":")
    if label.lower() != "sha1":
        return None
    try:
        return base64.b32decode(digits.upper()).hex() if len(digits) == 32 else digits.lower()
    except ValueError:
        return None


def _payload(fields: dict, block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def read_records(spark, path: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of gzipped archives, in their order in each file.
    payload: without it, payloads are measured and digested, but not given."""
    ready(spark)
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))

    def run(batches):
        lines, file, out, size = Lines(), None, [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    lines, file = Lines(), name
                if not (got := lines.feed(text)) or got[0].get("warc-type") not in ("response", "revisit"):
                    continue
                f, body = got[0], _payload(*got)
                full = f["warc-type"] == "response"
                out.append((f.get("warc-record-id"), f["warc-type"], f.get("x-page-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), hex_digest(f.get("warc-payload-digest")), len(body) if full else None, hashlib.sha1(body).hexdigest() if full else None, body if full and payload else None))
                size += len(body)
                if size > BYTES or len(out) >= ROWS:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return rows.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], names=names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes and payload_digest of the full payload, and
    refers_to, the page of the response, of all records of read_records()."""
    ws = Workspace(records.sparkSession)
    heads = ws.write(records.drop("payload", "target_uri"), "records")
    revisits, parts = heads.where("record_type = 'revisit'"), 4 * int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.concat_ws(" ", "refers_to", "declared_digest")
    revisits = revisits.select("page_id", "record_type", name.alias("name"))
    counts = ws.write(revisits.groupBy("name").agg(F.count("*").alias("n")), "named")
    least = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // parts
    hot = [r[0] for r in counts.where(F.col("n") > max(1000, least)).collect()]  # fewer than `parts`
    responses = heads.where("record_type = 'response'")
    originals = responses.select(F.concat_ws(" ", "record_id", "payload_digest").alias("name"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    same = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(*same).unionByName(join_hot(revisits, originals, "name", "left", hot).select(*same))


def op13_warc_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{Workspace(spark).path}/archives"
    write_archives(pages, path)
    out = resolve_revisits(read_records(spark, path, payload=False))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT *, payload_bytes >= 1000 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) > 1 AS again,
         max(page_id) OVER (PARTITION BY payload_digest) AS best
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN best END AS refers_to
FROM r
"""
