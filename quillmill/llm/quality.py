"""Quality of documents: a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's score uses its own features and those of
the lines before and after it; neighbouring labels are tied by transition weights.
Forward and backward sums give each line's probability of being good, and a document's
raw score is the mean of those, weighted by the lines' lengths; a logistic map fitted on
the training documents turns it into a probability.

Features are shares of kinds of bytes, lengths of words, repetition of words and lines;
never ids, languages, sources or labels. Fitting: at most `sample` labelled documents
(a parameter), those with the smallest hashes of their ids, each with all its lines, which
carry the label of the document. Only features, not texts, come to the driver: a row a
line. Scoring reads whole texts, too. Sums over a text of n lines are made block by block,
in a number of numpy steps that grows with log n, so that one very long text doesn't hold
up the others.

Defined results: a null text is an empty one, and an empty text is one empty line. Rows
of the same id are scored alone. Of several labels of a document the smallest counts;
null labels don't. Without labels of both kinds the score is the share of good labels,
and 0.5 without any. Texts of any length are scored whole. A score at the threshold is
predicted 1. Columns of `docs` named score or predicted give way to the results, all
others pass through. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import fold, ready, slices

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:", b"!?", b"|", b"*$&%#@^~", b"\"'()[]{}<>/\\-_=+`", bytes(range(128, 256))]
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _k in enumerate(_KINDS):
    _CLASS[list(_k)] = _i
N_FEATURES = len(_KINDS) + 8


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lengths of lines, number of lines of each text)."""
    split = [(t or "").encode().split(b"\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lines = list(chain.from_iterable(split))
    lengths = np.array([len(x) for x in lines])
    kinds = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    out = np.zeros((len(lines), N_FEATURES), np.float32)
    size = np.maximum(lengths, 1)
    for k in range(len(_KINDS)):
        out[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64) / size
    k = len(_KINDS)
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words])
    some = np.maximum(n, 1)
    out[:, k] = np.array([len(set(w)) for w in words]) / some
    out[:, k + 1] = np.log1p(lengths)
    out[:, k + 2] = np.minimum((lengths - n + 1) / some, 40) / 10
    out[:, k + 3] = n == 0
    out[:, k + 4] = np.array([len({*map(len, w)}) for w in words]) / np.sqrt(some)
    out[:, k + 5] = np.array([x[-1:] == b"." for x in lines])
    out[:, k + 6] = np.array([x[:1].isupper() for x in lines])
    out[:, k + 7] = np.fromiter(chain.from_iterable(_repeated(x) for x in split), bool, len(lines))
    return out, lengths, counts


def _repeated(lines: list[bytes]):
    seen: set[bytes] = set()
    for x in lines:
        yield bool(x) and x in seen
        seen.add(x)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it in its text."""
    ends = np.cumsum(counts)
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[ends - counts], after[ends - 1] = 0, 0
    edge = np.zeros((len(x), 2), np.float32)
    edge[ends - counts, 0], edge[ends - 1, 1] = 1, 1
    return np.hstack([x, before, after, edge, np.ones((len(x), 1), np.float32)])


#: Lines that are walked one after another; longer texts are cut into blocks of so many.
BLOCK = 64


def _walk(maps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-weights of the two labels before each item: `first` before the first one of a
    stretch, then on by its 2 x 2 maps. Stretches advance side by side, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, out = starts[order], sizes[order], np.empty((len(maps), 2))
    out[starts] = first[order]
    for t in range(1, int(sizes[0])):
        at = starts[: np.searchsorted(-sizes, -t, side="left")] + t - 1
        v, m = out[at], maps[at]
        out[at + 1] = np.logaddexp(v[:, :1] + m[:, 0], v[:, 1:] + m[:, 1])
    return out


def _before(maps: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As _walk() over whole texts. Where one is longer than a block, the maps of blocks are
    multiplied out, all blocks at once, and what lies before each block is found in the same
    way over blocks: for n lines some 2 * BLOCK * log(n) / log(BLOCK) steps are made."""
    starts = np.cumsum(counts) - counts
    if counts.max() <= BLOCK:
        return _walk(maps, starts, counts, first)
    blocks = -(-counts // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = np.repeat(starts, blocks) + nth * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(counts, blocks) - nth * BLOCK)
    whole = maps[own].copy()
    for t in range(1, BLOCK):
        some = np.flatnonzero(sizes > t)
        x, m = whole[some], maps[own[some] + t]
        whole[some] = np.logaddexp(x[:, :, :1] + m[:, None, 0], x[:, :, 1:] + m[:, None, 1])
    return _walk(maps, own, sizes, _before(whole, blocks, first))


def forward_backward(good: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """good: each line's log-odds of label 1 before its neighbours count; move: 2 x 2
    log weights. Gives each line's probability of label 1, and the sums of the expected
    transitions."""
    if not len(good):
        return np.zeros(0), np.zeros((2, 2))
    score, first = np.stack([np.zeros(len(good)), good], 1), np.cumsum(counts) - counts
    maps = move + score[:, None, :]
    maps[first] = score[first][:, None, :]  # nothing moves to a first line
    start = np.tile([0.0, -np.inf], (len(counts), 1))
    v = _before(maps, counts, start)
    fore = np.logaddexp(v[:, :1] + maps[:, 0], v[:, 1:] + maps[:, 1])
    turned = _before(maps[::-1].transpose(0, 2, 1), counts[::-1], np.zeros((len(counts), 2)))
    back = turned[::-1]
    both = fore + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(good), bool)
    inner[first] = False
    pairs, at = np.zeros((2, 2)), np.flatnonzero(inner)
    if len(at):
        joint = fore[at - 1][:, :, None] + move + (score[at] + back[at])[:, None, :]
        pairs = np.exp(joint - total[at][:, None, None]).sum(0)
    return np.exp(both[:, 1] - total), pairs


def raw_score(p: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts, weight = np.cumsum(counts) - counts, lengths + 1.0
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_lines(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> dict:
    """Adam on the mean log-likelihood of the lines' labels, whitened features."""
    mean, std = x.mean(0), x.std(0) + 1e-3
    z = with_neighbours((x - mean) / std, counts)
    y = np.repeat(labels, counts).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        p, pairs = forward_backward(z @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        grad = np.concatenate([z.T @ (y - p), (seen - pairs).ravel()]) / len(y) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    p, _ = forward_backward(z @ theta[:-4], counts, theta[-4:].reshape(2, 2))
    s, ab = _logit(raw_score(p, lengths, counts)), np.array([1.0, 0.0])
    d, start = np.stack([s, np.ones_like(s)]), np.array([1.0, 0.0])
    cost = lambda ab: np.logaddexp(0, ab @ d).sum() - labels @ (ab @ d) + 0.05 * ((ab - start) ** 2).sum()
    for _ in range(50):  # logistic map, by Newton's method with steps that lower the cost
        q = _sigmoid(ab @ d)
        step = np.linalg.solve((d * (q * (1 - q) + 1e-6)) @ d.T + 0.1 * np.eye(2), d @ (labels - q) - 0.1 * (ab - start))
        size = next((k for k in 0.5 ** np.arange(30) if cost(ab + k * step) < cost(ab)), 0.0)
        if not size:
            break
        ab = ab + size * step
    return {"mean": mean, "std": std, "theta": theta, "map": ab}


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    if not texts:
        return np.zeros(0)
    x, lengths, counts = line_features(texts)
    z = with_neighbours((x - model["mean"]) / model["std"], counts)
    p, _ = forward_backward(z @ model["theta"][:-4], counts, model["theta"][-4:].reshape(2, 2))
    return _sigmoid(model["map"][0] * _logit(raw_score(p, lengths, counts)) + model["map"][1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Learns from labelled documents outside the held-out fold."""
    ready(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isNotNull() & (fold(F.col(id_col), modulus) != held_out)).groupBy(F.col(id_col).alias("__id"))
        .agg(F.min("quality").cast("int").alias("__quality")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 200):
                x, lengths, counts = line_features(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([x[b - n : b].ravel().tobytes() for b, n in zip(ends, counts)], pa.binary()),
                    pa.array([lengths[b - n : b].astype(np.int64).tobytes() for b, n in zip(ends, counts)], pa.binary()),
                ], names=["quality", "x", "lengths"])

    # of rows of one id the one with the least hash: at most `sample` rows in all
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    known = known.groupBy("__id").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__quality", "__text")).alias("__r"))
    rows = known.select("__r.__quality", "__r.__text").mapInArrow(run, "quality int, x binary, lengths binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    good = np.array([r["quality"] for r in rows])
    if not len(good) or len(set(good.tolist())) < 2:
        return {"constant": float(good.mean()) if len(good) else 0.5}
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, N_FEATURES)
    lengths = np.frombuffer(b"".join(r["lengths"] for r in rows), np.int64)
    return fit_lines(x, lengths, np.array([len(r["lengths"]) // 8 for r in rows]), good)


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns of `docs` with score and predicted."""
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index(text_col)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                s = score_texts(model, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kept = docs.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op8_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
