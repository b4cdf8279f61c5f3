"""Cutting text where the byte-level pre-tokenizer cuts it in any case, so that pieces can
be looked up instead of encoded again.

PATTERN joins a space to what stands before it only if that is white space, and then
only if white space or the end of the text comes after it. Text can be cut before all
other spaces: its encoding is the sequence of its pieces', each with its space in front,
whatever the vocabulary is. In the same way a piece can be cut between letters, digits,
marks and line ends, and of line ends before something else the last stands alone. Other
patterns may join more, so their texts aren't cut."""

from __future__ import annotations

import re
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the public byte-level pattern that the rules of this module are about.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Python's \s holds all that is white space to other libraries, so what is \S to it is
# none to them.
_SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_JOINED_RE2, _CUT = rf"{_SPACES} (?:{_SPACES}|\z)", re.compile(r"(?<!\s) | (?=\S)")
# Latin letters, digits and marks that every version of Unicode knows; an apostrophe may
# belong to what follows it
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_PURE = re.compile(rf"(?!\n)[{_LETTERS}0-9{_MARKS}\n]+")
_USUAL = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"  # for RE2
_RUN = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n+")


def runs(piece: str) -> list[str] | None:
    """Parts that are always apart in a piece with a space in front; None if it may not
    be cut."""
    if not _PURE.fullmatch(piece):
        return None
    out = _RUN.findall(piece)
    if "\n\n" in piece:
        out = [y for i, x in enumerate(out) for y in ((x[1:], "\n") if x[:2] == "\n\n" and i + 1 < len(out) else (x,))]
    return out


class Memo:
    """Ids of texts as 32-bit integers, by pieces that are kept.

    Texts are taken a slice at a time. Arrow cuts them and lists the distinct pieces; what
    the tables don't hold of those is encoded in one go. Tables that are full become the
    older ones, and what is asked for again comes back from there; so at most 2 * most
    pieces are kept in each, besides those of the slice at hand."""

    def __init__(self, encode_many, most: int = 300_000, pieces: bool = True, whole=()):
        """encode_many(strings, pure): packed ids of each; pure strings are one pre-token
        each, without white space but for one space in front. pieces: whether PATTERN cuts
        the texts. whole: texts that hold one of these aren't cut."""
        self.encode_many, self.most, self.pieces, self.whole = encode_many, most, pieces, whole
        self.spaced, self.bare = ({}, {}), ({}, {})  # the table and the older one, of parts with a space in front and without

    def _known(self, tables: tuple[dict, dict], space: str, parts: list[str]) -> list[bytes]:
        """Packed ids of distinct parts, each one pre-token after `space`."""
        table, older = tables
        wanted = list(filterfalse(table.__contains__, parts))
        for p in filter(older.__contains__, wanted):
            table[p] = older[p]
        new = list(filterfalse(table.__contains__, wanted))
        if lines := [p for p in new if p[:1] == "\n"]:
            new = [p for p in new if p[0] != "\n"]
            table.update(zip(lines, self.encode_many(lines, False)))
        if new:
            table.update(zip(new, self.encode_many([space + p for p in new] if space else new, True)))
        return list(map(table.__getitem__, parts))

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces that are not a word and marks."""
        cuts = list(map(runs, pieces))
        firsts, rests = list({c[0] for c in cuts if c}), list({x for c in cuts if c for x in c[1:]})
        first, rest = dict(zip(firsts, self._known(self.spaced, " ", firsts))), dict(zip(rests, self._known(self.bare, "", rests)))
        whole = [p for p, c in zip(pieces, cuts) if not c]
        coded = iter(self.encode_many([" " + p for p in whole], False) if whole else ())
        return [first[c[0]] + b"".join([rest[x] for x in c[1:]]) if c else next(coded) for c in cuts]

    def _pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of distinct pieces with a space in front. Usually they are a word and marks:
        Arrow takes them apart, so that only distinct words are looked up here."""
        parts = pc.extract_regex(pieces, _USUAL)
        usual = parts.is_valid().to_numpy(zero_copy_only=False)
        words, marks = (parts.field(k).filter(pa.array(usual)).dictionary_encode() for k in (0, 1))
        values = [b"", *self._known(self.spaced, " ", words.dictionary.to_pylist())]
        first, second = np.zeros((2, len(pieces)), np.int64)
        first[usual] = 1 + words.indices.to_numpy()
        second[usual] = len(values) + marks.indices.to_numpy()
        listed = marks.dictionary.to_pylist()
        found = dict(zip(given := [m for m in listed if m], self._known(self.bare, "", given)))
        values += [found.get(m, b"") for m in listed]
        first[~usual] = len(values) + np.arange(len(pieces) - usual.sum())
        values += self._others(pieces.filter(pa.array(~usual)).to_pylist())
        lists = _lists(values).take(pa.array(np.stack([first, second], 1).ravel()))
        return pa.ListArray.from_arrays(lists.offsets.take(pa.array(np.arange(0, len(lists.offsets), 2))), lists.values)

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """Of each text its ids, list<int32>; null and empty texts have none."""
        self.spaced, self.bare = (({}, x[0]) if len(x[0]) > self.most else x for x in (self.spaced, self.bare))
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole, joined = np.full(len(texts), not self.pieces), np.zeros(len(texts), bool)
        if self.pieces:
            joined = pc.match_substring_regex(texts, _JOINED_RE2).to_numpy(zero_copy_only=False)
            for x in self.whole:
                whole = whole | pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(whole | joined)
        cuts = pc.split_pattern(pc.if_else(pa.array(whole | joined), "", texts), " ")
        ends = cuts.offsets.to_numpy().astype(np.int64)
        coded = cuts.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text's first piece has no space in front
        body = np.ones(len(at), bool)
        body[ends[:-1]] = False
        used = np.bincount(at[body], minlength=len(coded.dictionary)) > 0
        known = self._pieces(coded.dictionary.filter(pa.array(used)))
        heads = coded.dictionary.take(pa.array(at[ends[:-1]])).to_pylist()
        tails: dict[int, list[str]] = {}
        for i, t in zip(apart.tolist(), texts.take(pa.array(apart)).to_pylist()):
            heads[i], *tails[i] = [t] if whole[i] else _CUT.split(t)
        given = iter(self.encode_many([h for h in heads if h], False) if any(heads) else ())
        heads = [next(given) if h else b"" for h in heads]
        for i, pieces in tails.items():
            names = list(set(pieces))
            found = dict(zip(names, self._others(names)))
            heads[i] += b"".join([found[x] for x in pieces])
        place = (np.cumsum(used) - 1)[at]
        place[ends[:-1]] = len(known) + np.arange(len(heads))
        lists = pa.concat_arrays([known, _lists(heads)]).take(pa.array(place))
        return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends]), lists.values)

    def ids(self, text: str | None) -> list[int]:
        return self.lists(pa.array([text], pa.string()))[0].as_py()


def _lists(values: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32)))


def pack(ids) -> bytes:
    return array("I", ids).tobytes()
