"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded where they then are, and each
partition is written as one file of the table: stripes with run-length encoded integers,
row indexes, and Bloom filters on the document id, so that a lookup by id reads only
files and strides that may hold it, and readers take stripes in parallel. Columns: part
(the number of the partition), seq (the place in it), doc_id and ids. Global positions
are made from what is read back: running sums within parts, and the sums of the parts
before, of which there are as many as files.

Defined results: null and empty texts are the end id alone. Null document ids come
first; rows that agree in id are ordered by text, and those that agree in both are all
written. Texts of any length are encoded whole, a document's ids being one row. Only the id
and the text are read, whatever other columns are named. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace, offsets, ready, slices
from quillmill.llm.segments import Memo, pack

SCHEMA = "part int, seq long, doc_id long, ids array<int>"
_ready: dict[int, Memo] = {}


def coder_memo(spec: str, special_as_text: bool = False) -> Memo:
    """Encodes as the tokenizer of this JSON does, without special tokens around a text.
    Texts that hold an added token's are never cut, nor are any of a tokenizer that is not
    plain byte-level BPE."""
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    coder, parts = Tokenizer.from_str(spec), json.loads(spec)
    coder.encode_special_tokens = special_as_text
    before = parts.get("pre_tokenizer") or {}
    plain = not parts.get("normalizer") and not parts.get("truncation") and not parts.get("padding") and before.get("type") == "ByteLevel"
    plain = plain and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    # pre-tokens are given to the model apart, by line ends between them
    words = Tokenizer.from_str(spec)
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    line = words.encode("\n", add_special_tokens=False).ids

    def many(texts: list[str], pure: bool) -> list[bytes]:
        if not pure or len(line) != 1:
            return [pack(x.ids) for x in coder.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for at in range(0, len(texts), 10_000):
            some = texts[at : at + 10_000]
            ids = np.array(words.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends, raw = [*(4 * np.flatnonzero(ids == line[0])).tolist(), 4 * len(ids)], ids.tobytes()
            if len(ends) != len(some):
                raise RuntimeError("a pre-token holds a line end")
            out += [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]
        return out

    return Memo(many, pieces=bool(plain), whole=[t.content for t in coder.get_added_tokens_decoder().values()])


def _memo(spec, special_as_text: bool) -> Memo:
    """One for each worker process, whatever the number of its tasks."""
    key = hash((spec.value, special_as_text))
    if key not in _ready:
        _ready.clear()
        _ready[key] = coder_memo(spec.value, special_as_text)
    return _ready[key]


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Writes the table described above to `path`. special_as_text: the strings of special
    tokens are ordinary text; by default they are those tokens, as in the library."""
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # as large as the vocabulary file
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        memo, part, seq = _memo(spec, special_as_text), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 1):
                n = batch.num_rows
                lists = memo.lists(batch.column(1))
                ends = lists.offsets.to_numpy()
                flat = np.insert(lists.values.to_numpy(), ends[1:], np.int32(end_id))
                lists = pa.ListArray.from_arrays(pa.array(ends + np.arange(n + 1, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column(0), lists], names=["part", "seq", "doc_id", "ids"])
                seq += n

    (
        dealt.mapInArrow(run, SCHEMA).write.option("orc.compress", "ZSTD").option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_tokens(spark, path: str) -> DataFrame:
    """part, seq, doc_id, ids. Filters on doc_id reach the files' statistics and Bloom
    filters."""
    return spark.read.schema(SCHEMA).orc(path)


def summarise(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of a table of tokens."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    ready(tokens.sparkSession)
    rows = Workspace(tokens.sparkSession).write(tokens.mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long"), "rows")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("before", before).join(offsets(rows, "part", "n_tokens"), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op6_orc_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{Workspace(spark).path}/tokens.orc"
    write_tokens(docs, vocabularies.path("byte_bpe_50k.json"), path, end_id=2)
    return summarise(read_tokens(spark, path))
