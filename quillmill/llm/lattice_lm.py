"""Language-model scores by subword lattices.

A text is its words (A-Z lower-cased), each with the vocabulary's mark in front, and one
end token. Its probability is the sum over all its segmentations into pieces of an
existing vocabulary of the product of their unigram probabilities: no piece reaches over
a mark, so that the text's lattice is a chain of its words', and its log probability the
sum of theirs, found by the forward recursion in logs. A character without a piece is its
bytes.

The vocabulary orders its pieces by scores that are no probabilities (ranks of merges).
They give the first unigram probabilities, by Zipf's law; rounds of expectation and
maximisation then fit these to the training documents, until one adds less than GAIN to
their log-likelihood: expected counts of pieces over all segmentations, by forward and
backward sums. Counts of words and pieces are those of
all training documents, at any size.

Words repeat, so lattices are run once for each distinct word, not for each place, and
for words of one length together. Counts are gathered by a shuffled aggregation. The
scores of at most COMMON words, the most frequent of all documents, are broadcast (a
bounded table: words of more than SHORT bytes are known by their digest) and serve most
places and all skewed words; those of the others are joined by word.

Defined results: a null or empty text is the end token alone. Rows of the same id are
scored apart, so repeated rows agree. A null id counts as the empty text for the fold.
Without training documents the vocabulary's own probabilities are left, and the base
score is 0. Texts and words of any length are read whole. Only the id and the text of
`docs` are used, whatever other columns are named. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace, fold, slices

COMMON = 100_000
#: Words of more bytes are known by their digest in tables and joins.
SHORT = 64
#: Rounds of the fit end where one adds less than this share to the log-likelihood; there are no more than ROUNDS.
GAIN, ROUNDS = 0.005, 20
#: Words of more characters are done one by one.
LONG = 64
MARK = "▁"
#: Added to the expected count of each piece.
ALPHA = 0.1
#: What a character costs beyond the least piece if not even its bytes are pieces.
UNKNOWN = 10.0


def key_of(word: str) -> str:
    """What stands for a word; none holds a space."""
    raw = word.encode()
    return word if len(raw) <= SHORT else " " + hashlib.sha256(raw).hexdigest()


class Pieces:
    """A vocabulary: the places of its pieces, by a hash of their characters."""

    BASE, MIX, BITS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 20

    def __init__(self, pieces: list[str]):
        """pieces: in the order of their scores; bytes as <0xNN>."""
        self.size = len(pieces)
        self.bytes = [-1] * 256
        self.ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.bytes[int(p[3:5], 16)] = i
            elif p and MARK not in p[1:]:
                self.ids.setdefault(p, i)
        self.longest = max(map(len, self.ids), default=1)
        powers = [1]
        for _ in range(self.longest):
            powers.append(powers[-1] * self.BASE % 2**64)
        self.powers = np.array(powers, np.uint64)
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.fromiter(self.ids.values(), np.int32, len(self.ids))[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("hashes of pieces clash")
        self.held = np.zeros(1 << self.BITS, bool)
        self.held[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) % 2**64
        return (h + len(piece)) * self.MIX % 2**64

    def zipf(self) -> np.ndarray:
        """The first log probabilities: pieces by rank, and the end, as the last of these,
        like the first piece."""
        p = 1 / np.r_[np.arange(2, self.size + 2), 2]
        return np.log(p / p.sum())

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """For words of one length, as code points: ids [word, start, length - 1] of the
        pieces that fit (-1: none), and characters without a piece; the k-th of those is
        known as size + 1 + k."""
        m, n = codes.shape
        longest = min(n, self.longest)
        sums = np.zeros((m, n + 1), np.uint64)
        base, mix = np.uint64(self.BASE), np.uint64(self.MIX)
        for j in range(n):
            sums[:, j + 1] = sums[:, j] * base + codes[:, j] + np.uint64(1)
        ids = np.full((m, n, longest), -1, np.int32)
        for k in range(1, longest + 1):
            part = (sums[:, k:] - sums[:, : n + 1 - k] * self.powers[k] + np.uint64(k)) * mix
            rows, starts = np.nonzero(self.held[(part >> np.uint64(64 - self.BITS)).astype(np.int64)])
            found = part[rows, starts]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            same = self.hashes[at] == found
            ids[rows[same], starts[same], k - 1] = self.places[at[same]]
        without = ids[:, :, 0] < 0
        chars: list[str] = []
        if without.any():
            odd, at = np.unique(codes[without], return_inverse=True)
            ids[:, :, 0][without] = self.size + 1 + at
            chars = [MARK if c == 0x110000 else chr(c) for c in odd.tolist()]
        return ids, chars


class Unigram:
    """Log probabilities of pieces and of the end (the last), and the sums over lattices."""

    def __init__(self, pieces: Pieces, logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        self.least, self.end = float(logs.min()) - UNKNOWN, float(logs[-1])

    def char(self, c: str) -> float:
        return sum(float(self.logs[i]) if i >= 0 else self.least for i in self.pieces.byte_ids(c))

    def forward(self, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """[word, place]: log of the sum over the segmentations up to there."""
        m, n, longest = ids.shape
        fore = np.full((m, n + 1), -np.inf)
        fore[:, 0] = 0
        for j in range(1, n + 1):
            k = np.arange(min(j, longest))
            ways = fore[:, j - 1 - k] + scores[:, j - 1 - k, k]
            top = ways.max(1)
            fore[:, j] = top + np.log(np.exp(ways - top[:, None]).sum(1))
        return fore

    def _scores(self, ids: np.ndarray, chars: list[str]) -> np.ndarray:
        table = np.r_[self.logs, [self.char(c) for c in chars], -np.inf]
        return table[ids]

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length (at most LONG), and their code points."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes <= LONG]).tolist():
            at = np.flatnonzero(sizes == n)
            for some in np.array_split(at, -(-len(at) // 2000)):
                codes = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                codes = np.where(codes == ord(MARK), 0x110000, codes).astype(np.uint64)  # in a word it is no mark
                yield some, np.hstack([np.full((len(some), 1), ord(MARK), np.uint64), codes])

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word under all segmentations, natural logs."""
        out = np.zeros(len(words))
        for at, codes in self.groups(words):
            ids, chars = self.pieces.lattice(codes)
            out[at] = self.forward(ids, self._scores(ids, chars))[:, -1]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.one(w)[-1]
        return out

    def expect(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of pieces in words that come so many times, and the words'
        log-likelihood."""
        counts, total = np.zeros(self.pieces.size + 1), 0.0
        for at, codes in self.groups(words):
            ids, chars = self.pieces.lattice(codes)
            scores = self._scores(ids, chars)
            fore = self.forward(ids, scores)
            m, n, longest = ids.shape
            total += float(fore[:, n] @ times[at])
            back = np.full((m, n + 1), -np.inf)
            back[:, n] = 0
            wide = np.zeros(self.pieces.size + 1 + len(chars))
            for i in range(n - 1, -1, -1):
                k = min(n - i, longest)
                ways = scores[:, i, :k] + back[:, i + 1 : i + 1 + k]
                top = ways.max(1)
                back[:, i] = top + np.log(np.exp(ways - top[:, None]).sum(1))
                share = np.exp(ways + (fore[:, i] - fore[:, n])[:, None]) * times[at][:, None]
                real = ids[:, i, :k] >= 0
                wide += np.bincount(ids[:, i, :k][real], share[real], len(wide))
            counts += wide[: len(counts)]
            for c, x in zip(chars, wide[len(counts) :].tolist()):
                self._add(counts, c, x)
        for w, c in zip(words, times.tolist()):
            if len(w) > LONG:
                total += c * self.one(w, counts, c)[-1]
        return counts, total

    def _add(self, counts: np.ndarray, char: str, times: float) -> None:
        for b in self.pieces.byte_ids(char):
            if b >= 0:
                counts[b] += times

    def one(self, word: str, counts: np.ndarray | None = None, times: float = 0.0) -> list[float]:
        """The forward sums of one word, piece by piece; with `counts`, what it is expected
        to hold is added there."""
        get, longest, n = self.pieces.ids.get, self.pieces.longest, len(word) + 1

        def ways(i: int):
            for j in range(i + 1, min(n, i + longest) + 1):
                p = get(MARK + word[: j - 1]) if i == 0 else None if MARK in word[i - 1 : j - 1] else get(word[i - 1 : j - 1])
                if p is not None:
                    yield j, p, float(self.logs[p])
                elif j == i + 1:
                    yield j, -1, self.char(word[i - 1] if i else MARK)

        fore = [-math.inf] * (n + 1)
        fore[0] = 0.0
        for i in range(n):
            for j, _, s in ways(i):
                a, b = fore[j], fore[i] + s
                fore[j] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
        if counts is not None:
            back = [-math.inf] * n + [0.0]
            for i in range(n - 1, -1, -1):
                for j, p, s in ways(i):
                    a, b = back[i], back[j] + s
                    back[i] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
                    share = times * math.exp(fore[i] + s + back[j] - fore[n])
                    if p >= 0:
                        counts[p] += share
                    else:
                        self._add(counts, word[i - 1] if i else MARK, share)
        return fore


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a slice of texts: the text and the distinct word of each place, and the words.
    Arrow's ASCII functions know the same white space and upper case as the rules."""
    cuts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    text = np.repeat(np.arange(len(texts)), np.diff(cuts.offsets.to_numpy()))
    coded = cuts.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    inside = real[word] if len(names) else np.zeros(0, bool)
    return text[inside], (np.cumsum(real) - 1)[word[inside]], names.filter(pa.array(real))


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """docs(train boolean, text) to (word, c, n): all words, their counts in training
    documents and in all."""

    def run(batches):
        seen: dict[str, int] = {}
        names: list[str] = []
        counts = np.zeros((2, 1 << 16), np.int64)

        def out():
            k = len(names)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[0, :k]), pa.array(counts[1, :k])], names=["word", "c", "n"])

        for whole in batches:
            for batch in slices(whole, 1):
                learn = pc.fill_null(batch.column(0), False).to_numpy(zero_copy_only=False)
                text, word, listed = words_of(batch.column(1))
                listed = listed.to_pylist()
                for w in listed:
                    if w not in seen:
                        seen[w] = len(names)
                        names.append(w)
                while counts.shape[1] < len(names):
                    counts = np.hstack([counts, np.zeros_like(counts)])
                at = np.fromiter(map(seen.__getitem__, listed), np.int64, len(listed))
                counts[0, at] += np.bincount(word[learn[text]], minlength=len(listed))
                counts[1, at] += np.bincount(word, minlength=len(listed))
                if len(names) >= most:
                    yield out()
                    seen.clear()
                    names.clear()
                    counts = np.zeros((2, 1 << 16), np.int64)
        if names:
            yield out()

    return docs.select("train", "text").mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def gathered(batches, rows: int = 20_000):
    """Arrow batches, put together to so many rows: lattices are run for words of one
    length together. Words of great length are bounded by their bytes."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size > 1 << 23:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fit(words: DataFrame, pieces: Pieces, ends: int, rounds: int = ROUNDS) -> Unigram:
    """Unigram probabilities from words(word, c) of which any c is above 0. A round sends
    the driver a row per piece, and the log-likelihood that it began with."""
    spark, logs, before = words.sparkSession, pieces.zipf(), -math.inf
    shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary
    for _ in range(rounds):

        def run(batches, logs=logs):
            model = Unigram(shared.value, logs)
            total = np.zeros(len(logs) + 1)
            for batch in gathered(batches):
                counts, likely = model.expect(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
                total[:-1] += counts
                total[-1] += likely
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        counts = np.full(len(logs) + 1, ALPHA)
        for r in words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
            counts[r[0]] += r[1]
        counts, now = counts[:-1], counts[-1] - ALPHA
        counts[-1] += ends
        logs = np.log(counts / counts.sum())
        if now - before < GAIN * abs(now):
            break
        before = now
    return Unigram(pieces, logs)


def load_pieces(path: str) -> list[str]:
    """Those of a sentencepiece file that stand for text, by their scores."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [i for i in range(coder.get_piece_size()) if not (coder.is_control(i) or coder.is_unknown(i) or coder.is_unused(i))]
    return [coder.id_to_piece(i) for i in sorted(text, key=lambda i: (coder.is_byte(i), -coder.get_score(i), i))]


def score(docs: DataFrame, vocabulary: str, train, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score for each row.

    train: the condition on rows that the model learns from."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    words = ws.write(word_counts(rows), "words")
    ends = rows.where("train").count()
    units, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = units + ends, distinct + (ends > 0)
    model = fit(words, Pieces(load_pieces(vocabulary)), ends, rounds if units else 0)
    held, base_total, ten = spark.sparkContext.broadcast(model), math.log10(tokens + distinct + 1), math.log(10)

    def judge(batches):
        m = held.value
        for batch in gathered(batches):
            scores = m.log_probabilities(batch.column(0).to_pylist()) / ten
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], names=["key", "c", "n", "score"])

    key = F.when(F.octet_length("word") <= SHORT, F.col("word")).otherwise(F.concat(F.lit(" "), F.sha2("word", 256)))
    judged = ws.write(words.select("word", key.alias("key"), "c", "n").mapInArrow(judge, "key string, c long, n long, score double"), "judged")
    # the least count that no more than COMMON words reach, by bins of counts
    room, least = COMMON, math.inf
    for _, floor in sorted((-b, (m, f)) for b, m, f in judged.groupBy(F.floor(F.log2(F.col("n") + 1) * 32).alias("bin")).agg(F.count("*"), F.min("n")).collect()):
        if (room := room - floor[0]) < 0:
            break
        least = floor[1]
    top = judged.where(F.col("n") >= F.lit(float(least))).select("key", "c", "score").toArrow()
    common = spark.sparkContext.broadcast(({k: i for i, k in enumerate(top.column(0).to_pylist())}, top.column(1).to_numpy(), top.column(2).to_numpy()))

    def run(batches):
        known, count, marginal = common.value
        base, real = np.log10(count + 1) - base_total, count > 0
        for whole in batches:
            for batch in slices(whole, 3):
                n = batch.num_rows
                text, word, listed = words_of(batch.column(3))
                keys = [k if len(k) <= SHORT // 4 else key_of(k) for k in listed.to_pylist()]
                at = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
                place = at[word]
                here, place = text[place >= 0], place[place >= 0]
                add = lambda values: np.bincount(here, values[place], n)  # noqa: B023, E731
                rare = at[word] < 0
                pairs, times = np.unique(text[rare] * (len(keys) + 1) + word[rare], return_counts=True)
                ends_at = np.searchsorted(pairs, np.arange(n + 1) * (len(keys) + 1)).astype(np.int32)
                names = pa.array(keys, pa.string()).take(pa.array(pairs % (len(keys) + 1)))
                lists = [pa.ListArray.from_arrays(pa.array(ends_at), x) for x in (names, pa.array(times.astype(np.int64)))]
                sums = [
                    pa.array(np.bincount(text, minlength=n) + 1), pa.array(add(real).astype(np.int64) + (ends > 0)),
                    pa.array(add(base) + math.log10(ends + 1) - base_total), pa.array(add(marginal) + model_end),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sums, *lists], names=["rid", "doc_id", "train", "n_tokens", "n_known", "base", "score", "rare", "times"])

    model_end = model.end / ten
    schema = f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<long>"
    parts = ws.write(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", "text").mapInArrow(run, schema), "parts")
    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    worth = judged.where(F.col("n") < F.lit(float(least))).withColumn("base", F.log10(F.col("c") + 1) - F.lit(base_total))
    more = rare.join(worth, "key").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.col("base")).alias("more_base"),
        F.sum(F.col("times") * F.col("score")).alias("more_score"),
    )
    add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return parts.join(more, "rid", "left").select(
        "doc_id", "train", "n_tokens", add("n_known", "more_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        add("base", "more_base").alias("base_score"), add("score", "more_score"),
    )


def op2_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, vocabularies.path("piece_bpe_32k.model"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))
