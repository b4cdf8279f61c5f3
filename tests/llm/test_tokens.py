import base64
import glob
import hashlib
import struct
import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe, token_orc
from quillmill.llm.common import Workspace
from quillmill.llm.segments import Memo

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe(*bpe.load_ranks(RANKS, P.PATTERN))


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def memo():
    return token_orc.coder_memo(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_perfect_hash():
    keys = [b"", *[str(k).encode() for k in range(3000)]]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(3001))
    assert len(table.slots) == 3001 and table.find(b"x") == -1 and bpe.PerfectHash([]).find(b"a") == -1
    for n in range(1, 60):
        small = bpe.PerfectHash(keys[:n])
        assert sorted(small.find(k) for k in keys[:n]) == list(range(n))


ODD = st.text(st.one_of(st.sampled_from("ab EÉ\n\t's'll12٠\x1c\x85​😀-!<|endoftext|>　 "), st.characters(exclude_categories=["Cs"])), max_size=60)
PLAIN = st.text(st.sampled_from("ab,.\n  'éx19-"), max_size=40)
MIXED = st.lists(st.one_of(ODD, PLAIN, st.sampled_from(["<|endoftext|>", "x <|endoftext|> y", "a  ", "  b"])), max_size=4).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), MIXED), max_size=5))
def test_as_the_libraries(ours, theirs, library, memo, texts):
    column = pa.array(texts, pa.string())
    got = ours.memo.lists(column).to_pylist()
    assert got == [theirs.encode_ordinary(t or "") for t in texts]
    assert [ours.decode(x) for x in got] == [(t or "").encode() for t in texts]
    assert memo.lists(column).to_pylist() == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_added_tokens(library, memo):
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|>"):
        assert 50256 in memo.ids(text) and memo.ids(text) == library.encode(text, add_special_tokens=False).ids
    text = token_orc.coder_memo(library.to_str(), special_as_text=True)
    assert 50256 not in text.ids("x <|endoftext|> y") and text.ids("x y") == memo.ids("x y")


@settings(max_examples=60, deadline=None)
@given(text=st.text(st.sampled_from("ab \n\t.,1é'"), max_size=25), more=st.lists(st.text(st.sampled_from("ab \n\t.,1é'"), min_size=2, max_size=3), max_size=12, unique=True))
def test_any_vocabulary(text, more):
    """With tokens of white space and of marks and line ends, too."""
    tokens = [bytes([i]) for i in range(256)]
    tokens += [x for x in dict.fromkeys(x.encode() for x in ["  ", "\n\n", " \n", *more]) if x not in tokens]
    own = bpe.ByteBpe(tokens, list(range(len(tokens))), P.PATTERN)
    other = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert own.encode(text) == other.encode_ordinary(text)
    whole = r"\s+|\S+\s?"  # cuts elsewhere
    own = bpe.ByteBpe(tokens, list(range(len(tokens))), whole)
    other = tiktoken.Encoding("odd", pat_str=whole, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert own.encode(text) == other.encode_ordinary(text)


def test_small_memo_forgets_rightly(ours, theirs):
    small = Memo(ours.encode_many, most=3)
    for k in range(6):
        text = f"to be or not to be, that is the question{k}; to be or not\n" * 5
        assert small.ids(text) == theirs.encode_ordinary(text)


def test_encode_and_decode(edge, empty, theirs):
    rows = bpe.encode(edge.select("doc_id", "score", "text"), RANKS, P.PATTERN, decode=True)
    got = rows.collect()
    want = sorted(map(str, [theirs.encode_ordinary(r["text"] or "") for r in edge.collect()]))
    assert sorted(str(r["ids"]) for r in got) == want
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((r["text"] or "").encode() for r in edge.collect())
    again = bpe.decode(rows.select("doc_id", "ids"), RANKS, P.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((r["text"] or "").encode() for r in edge.collect())
    assert bpe.encode(empty, RANKS, P.PATTERN).collect() == []


def test_orc(spark, edge, empty, library):
    path = f"{Workspace(spark).path}/t.orc"
    token_orc.write_tokens(edge, P.path("byte_bpe_50k.json"), path, end_id=2)
    rows = token_orc.summarise(token_orc.read_tokens(spark, path)).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, t) in zip(rows, docs, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    found = token_orc.read_tokens(spark, path).where("doc_id = 9")
    assert found.count() == 1 and "EqualTo(doc_id,9)" in found._jdf.queryExecution().toString()
    # the files' footers: Bloom filters on the ids, row indexes, and run lengths
    files = glob.glob(f"{path}/*.orc")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds = set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        rows_reader = reader.rows()
        for stripe in reader.getStripes():
            footer = rows_reader.readStripeFooter(stripe)
            kinds |= {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert any(e.getKind().toString() == "DIRECT_V2" for e in footer.getColumnsList())
        rows_reader.close()
    at = token_orc.read_tokens(spark, path).columns.index("doc_id") + 1
    assert {(at, "ROW_INDEX"), (at, "BLOOM_FILTER_UTF8")} <= kinds
    token_orc.write_tokens(empty, P.path("byte_bpe_50k.json"), path + "0", end_id=2)
    assert token_orc.summarise(token_orc.read_tokens(spark, path + "0")).collect() == []


def test_query_digests(spark, data, theirs):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in bpe.op4_two_tier_bpe(spark, data).collect():
        ids = theirs.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
