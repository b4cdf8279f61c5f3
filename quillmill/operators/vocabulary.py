"""Vocabularies given as tables: which labels' words or patterns a text holds.

Of each pattern a literal part that all its matches hold is put into one automaton (a trie
with failure links, resolved to a table of states and byte classes). A text's bytes pass it
once, whatever the number of patterns; a pattern that is more than its literal is then tried
on those texts alone that hold it. Many stretches of a batch go through the table side by
side, each begun a longest literal early, so a step is a few numpy operations on all of them.

The automaton is broadcast. Its table is bounded by TABLE bytes; a larger vocabulary becomes
several automata, which texts pass one after another in the same stage. A worker holds a
slice of texts and what is found in it, however large a batch is."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.workers import importable, slices, small_batches

#: Bytes of an automaton's table, bytes of a literal that enter it, of a stretch, and of the texts scanned at once.
TABLE, LITERAL, STRETCH, SLICE = 1 << 26, 64, 512, 1 << 22
FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.IntegerType())]))


def literal(pattern: str) -> tuple[str, bool]:
    """The longest text that all matches of a pattern surely hold, and whether the pattern
    is that text and nothing else. Groups and classes are skipped; alternatives have none."""
    runs, run, k, plain = [""], "", 0, True
    while k < len(pattern):
        c = pattern[k]
        if c == "|":
            return "", False
        if c == "\\" and k + 1 < len(pattern) and not pattern[k + 1].isalnum():
            run, k = run + pattern[k + 1], k + 2
            continue
        if c in "*?{":  # what is before may be missing
            run = run[:-1]
        if c not in "\\[(.^$*?{+":
            run, k = run + c, k + 1
            continue
        plain = False
        runs.append(run)
        run = ""
        if c == "[":
            k += 2 if pattern[k + 1 : k + 2] == "^" else 1
            k = pattern.index("]", k + 1)
        elif c == "{":
            k = pattern.index("}", k)
        elif c == "(":
            depth = 0
            while True:
                if pattern[k] == "\\":
                    k += 1
                elif pattern[k] == "[":
                    k = pattern.index("]", k + 2)
                else:
                    depth += (pattern[k] == "(") - (pattern[k] == ")")
                k += 1
                if not depth:
                    break
            k -= 1
        k += 2 if c == "\\" else 1
    return max([*runs, run], key=len), plain


class Automaton:
    """Finds which of many byte strings texts hold."""

    def __init__(self, words: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            at = 0
            for b in word:
                if b not in children[at]:
                    children.append({})
                    children[at][b] = len(children) - 1
                at = children[at][b]
            ends.setdefault(at, []).append(k)
        self.longest = max(map(len, words), default=1)
        used = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        goto, outs, fail = np.zeros((len(children), width), np.int32), [ends.get(s, []) for s in range(len(children))], [0] * len(children)
        order = [0]
        for s in order:  # by depth: the state that failure leads to is done before
            if s:
                goto[s] = goto[fail[s]]
                outs[s] = outs[s] + outs[fail[s]]
            for b, to in children[s].items():
                fail[to] = int(goto[fail[s], self.classes[b]]) if s else 0
                order.append(to)
            for b, to in children[s].items():
                goto[s, self.classes[b]] = to
        # states with words get the highest numbers; a number is the place of its row
        place = np.empty(len(children), np.int64)
        quiet = [s for s in order if not outs[s]]
        loud = [s for s in order if outs[s]]
        place[quiet + loud] = np.arange(len(children))
        self.table = np.empty(goto.size, np.int32)
        self.table.reshape(goto.shape)[place] = place[goto] * width
        self.first, self.width = len(quiet) * width, width
        self.out_ends = np.cumsum([0, *[len(outs[s]) for s in loud]])
        self.outs = np.array([w for s in loud for w in outs[s]], np.int64)

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, word) of texts that lie in `data` one after another, each with a
        byte after it that no UTF-8 text has; ends: where these bytes are."""
        ahead = self.longest - 1
        stretch = max(STRETCH, 4 * ahead)
        n = -(-len(data) // stretch)
        wide = np.zeros(n * stretch + ahead, np.uint8)
        wide[ahead : ahead + len(data)] = self.classes[data]
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, stretch + ahead)[::stretch].T)
        state, at, seen = np.zeros(n, np.int32), [], []
        for step, c in enumerate(lanes):
            state = self.table[state + c]
            if step >= ahead and len(hit := np.flatnonzero(state >= self.first)):
                at.append(hit * stretch + (step - ahead))
                seen.append(state[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, out = np.searchsorted(ends, np.concatenate(at)), (np.concatenate(seen) - self.first) // self.width
        pairs = np.unique(text * len(self.out_ends) + out)
        text, out = pairs // len(self.out_ends), pairs % len(self.out_ends)
        sizes = self.out_ends[out + 1] - self.out_ends[out]
        where = np.repeat(self.out_ends[out] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(text, sizes) * (len(self.outs) + 1) + self.outs[where])
        return pairs // (len(self.outs) + 1), pairs % (len(self.outs) + 1)


class Vocabulary:
    """(label, pattern) pairs; plain: patterns are texts that are looked for as they are."""

    def __init__(self, pairs: list[tuple[str, str]], plain: bool):
        parts = [(p, True) if plain else literal(p) for _, p in pairs]
        self.labels, self.patterns = [x for x, _ in pairs], [p for _, p in pairs]
        cut = [x.encode()[:LITERAL] for x, _ in parts]
        words = sorted({x for x in cut if x})
        number = {w: k for k, w in enumerate(words)}
        self.by_word: list[list[int]] = [[] for _ in words]
        for k, w in enumerate(cut):
            if w:
                self.by_word[number[w]].append(k)
        self.always = [k for k, w in enumerate(cut) if not w]
        sure = lambda k: parts[k][1] and len(cut[k]) == len(parts[k][0].encode())
        self.sure, self.plain = [sure(k) for k in range(len(pairs))], plain
        # labels of a word that is all of its pattern are counted in numpy, the rest is tried one by one
        self.names = sorted(set(self.labels))
        place = {x: k for k, x in enumerate(self.names)}
        settled = [[place[self.labels[k]] for k in ks if self.sure[k]] for ks in self.by_word]
        self.settled, self.settled_ends = np.array([x for xs in settled for x in xs], np.int64), np.cumsum([0, *map(len, settled)])
        self.tried = [[k for k in ks if not self.sure[k]] for ks in self.by_word]
        self.is_tried = np.array([len(ks) > 0 for ks in self.tried], bool)
        self.automaton = Automaton(words) if words else None

    def _try(self, k: int, text: str) -> bool:
        return self.patterns[k] in text if self.plain else re.search(self.patterns[k], text) is not None

    def count(self, texts: list[str | None]) -> list[dict[str, int]]:
        """For each text its labels, and how many of a label's patterns it holds."""
        out: list[dict[str, int]] = [{} for _ in texts]

        def held(i: int, k: int) -> None:
            if texts[i] is not None and (self.sure[k] or self._try(k, texts[i])):
                out[i][self.labels[k]] = out[i].get(self.labels[k], 0) + 1

        def scan(at: int, coded: list[bytes]) -> None:
            data = np.frombuffer(b"\xff".join([*coded, b""]), np.uint8)
            text, word = self.automaton.find(data, np.cumsum([len(x) + 1 for x in coded]) - 1)
            sizes = self.settled_ends[word + 1] - self.settled_ends[word]
            where = np.repeat(self.settled_ends[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pairs, counts = np.unique(np.repeat(text, sizes) * len(self.names) + self.settled[where], return_counts=True)
            for i, x, n in zip((pairs // len(self.names)).tolist(), (pairs % len(self.names)).tolist(), counts.tolist()):
                out[at + i][self.names[x]] = n
            open_ = self.is_tried[word]
            for i, w in zip(text[open_].tolist(), word[open_].tolist()):
                for k in self.tried[w]:
                    held(at + i, k)

        if self.automaton:
            at, size, coded = 0, 0, []
            for x in texts:
                raw = (x or "").encode()
                if coded and size + len(raw) >= SLICE:
                    scan(at, coded)
                    at, size, coded = at + len(coded), 0, []
                coded.append(raw)
                size += len(raw)
            if coded:
                scan(at, coded)
        for k in self.always:
            for i in range(len(texts)):
                held(i, k)
        return out


def _parts(vocabulary: DataFrame, label: str, pattern: str) -> list[list[tuple[str, str]]]:
    """The pairs, in parts whose automata are no larger than TABLE, at 256 classes."""
    rows = vocabulary.where(F.col(label).isNotNull() & F.col(pattern).isNotNull()).select(label, pattern).distinct()
    out, size = [[]], 0
    for x, p in sorted(map(tuple, rows.toLocalIterator())):
        more = 4 * 256 * min(LITERAL, len(p.encode()))
        if out[-1] and size + more > TABLE:
            out.append([])
            size = 0
        out[-1].append((x, p))
        size += more
    return out


def labelled(rows: DataFrame, text: Column, vocabulary: DataFrame, label: str, pattern: str, plain: bool = False, out: str = "found") -> DataFrame:
    """Adds `out`: (label, n) for the labels of a vocabulary of which a text holds n > 0
    patterns, by label. Texts are taken as they are given; patterns are Python's, those with
    a null field are left out, and a null text holds none."""
    importable(rows.sparkSession)
    small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c != out]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField(out, FOUND)])
    rows = rows.select(*names, F.lit(None).cast(FOUND).alias(out), text.alias("__text"))
    for part in _parts(vocabulary, label, pattern):
        shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(part, plain))

        def run(batches, shared=shared):
            for batch in (x for whole in batches for x in slices(whole, whole.num_columns - 1, most=SLICE)):
                *kept, before, texts = batch.columns
                got = shared.value.count(texts.to_pylist())
                for have, more in zip(before.to_pylist(), got):
                    for x in have or ():
                        more[x["label"]] = more.get(x["label"], 0) + x["n"]
                found = pa.array([[{"label": k, "n": v} for k, v in sorted(x.items())] for x in got], before.type)
                yield pa.RecordBatch.from_arrays([*kept, found, texts], names=[*names, out, "__text"])

        rows = rows.mapInArrow(run, T.StructType([*schema, T.StructField("__text", T.StringType())]))
    return rows.drop("__text")


def route(found: Column, other: str) -> Column:
    """The label with the one highest number, or `other`."""
    top = F.array_max(F.transform(found, lambda x: x["n"]))
    best = F.filter(found, lambda x: x["n"] == top)
    return F.when(F.size(best) == 1, best[0]["label"]).otherwise(other)
