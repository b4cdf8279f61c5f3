"""Documents linked by the Jaccard similarity of their word shingles, by signature trees.

A document's set is its distinct five-word shingles, as 64-bit hashes. Equal sets are one
node. A node's tokens are dealt by hash into BANDS parts, and the up to three smallest of
each part make a key; nodes that share a key meet. In a large pair with similarity 0.8
each part agrees with a chance of at least 0.8^3, so that all differ with a chance below
0.488^40 < 4e-13. In a small pair a part without a difference has an equal key; all the
common tokens would have to share parts with the few others, the likeliest being four
common tokens and one other: 40^-4, and with the second dealing that sets of at most
SMALL tokens get, (40 * 24)^-4 < 2e-12. Nothing that meets is dropped. Sharing a passage or a common line is rarely enough for a key, so that
frequent shingles don't gather documents.

Where nodes meet, a signature tree is built: nodes sorted by size are the leaves, and
each inner node holds the OR of the bitmaps below and their range of sizes. Two of its
nodes can hold a link only if the sizes allow it and the common bits, with the tokens
that share bits, are as many as the overlap must be; a dual traversal skips all others,
and those that are already in one component. What is left is measured exactly. The result
is a star for each component found, so that a group of n copies gives n links.

First the keys of a few bands are done, in chunks of about CHUNK nodes. Then the others,
but only where a group still has nodes of different components: large groups of near
copies are one component by then. There the nodes outside the group's largest component
meet each chunk. Where these are more than a chunk (a passage that many differing texts
share), the group isn't crossed with itself: its nodes are dealt again, under pairs of such
keys. A linked pair shares only one key with a chance below 2e-11 if it is large; if it
shares others that gather fewer nodes, it meets there. Joins by key are salted, so that a
popular key isn't one task, and are of a kind whose skewed partitions Spark splits further.

Sets are not stored for all documents, but each has a signature of two to four bits a
token. Where a group is one chunk, its nodes first meet by signatures and sizes alone, which
bound the overlap from above: a node that can't be linked with any other of a group leaves
it. The sets of the nodes that stay are made again from the texts; a bitmap of fixed size
tells which texts to read, an exact join follows. So sets are shuffled only where a link is
possible.

Defined results: null and empty texts, and those without words, have 0 shingles and are
linked with nothing; with one to four words the sequence is the only shingle. Rows that
agree in text are linked. Rows with a null id take part; the component's id is the least
id that is not null. Texts of any length are read whole; a similarity of just 0.8 links.
Only the id and the text are read, whatever other columns are named, and keep_one() passes
all through. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace, words_of
from quillmill.llm.components import components

SIZE, BANDS, SMALLEST, CHUNK = 5, 40, 3, 2000
#: Tokens of a chunk, so that it is bounded in bytes too (a set of more is one alone).
TOKENS = 1 << 22
#: A key's nodes are dealt into so many parts where keys are joined.
SALTS = 8
#: Sets of no more tokens get keys of two dealings.
SMALL = 24
EARLY = 6
BITS = 1 << 26
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    get = _words.get
    h = np.array([get(w) or _words.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    n = len(h) - SIZE + 1
    total = h[:n] * _FACTORS[0]
    for k in range(1, SIZE):
        total += h[k : k + n] * _FACTORS[k]
    return np.unique(mix(total))


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """One for each part that has tokens: of its number and its smallest tokens. Small
    sets, whose few tokens may share a part, are dealt a second time."""
    keys = _dealt(tokens, 1, 0, BANDS)
    return np.concatenate([keys, _dealt(tokens, 3, BANDS, 64 - BANDS)]) if len(tokens) <= SMALL else keys


def _dealt(tokens: np.ndarray, factor: int, start: int, parts: int) -> np.ndarray:
    part = (mix(tokens * _FACTORS[factor]) % np.uint64(parts)).astype(np.int64) + start
    order = np.argsort(part, kind="stable")  # tokens are sorted, so each part's are
    part, tokens = part[order], tokens[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends, key = np.r_[first[1:], len(part)], part[first].astype(np.uint64) + np.uint64(1)
    for k in range(SMALLEST):
        some = first + k < ends
        key[some] = mix(key[some] * _FACTORS[2] + tokens[np.minimum(first + k, len(tokens) - 1)[some]])
    return (key & ~np.uint64(63)) | part[first].astype(np.uint64)  # the band stays readable


def node_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of two to four bits a token, a power of 2 long, in words of 64."""
    bits = np.zeros(max(64, 1 << (2 * len(tokens) - 1).bit_length()), bool)
    bits[((tokens >> np.uint64(20)) % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(sizes: list[int], signatures: list[bytes]) -> np.ndarray:
    """Of sets in order of size, which may be linked with another one: nothing else is said
    of a set than that sizes and signatures rule out all others. The longer of two
    signatures is folded to the length of the other."""
    size, words = np.array(sizes), np.array([len(x) // 8 for x in signatures])
    found = np.zeros(len(size), bool)
    for w in np.unique(words).tolist():
        start, stop, end = np.searchsorted(words, [w, w + 1, 2 * w + 1]).tolist()
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, w), axis=0) for x in signatures[start:end]])
        shared = size[start:end] - np.bitwise_count(bits).sum(1, dtype=np.int64)
        last = np.searchsorted(size, size[start:stop] * 100 // 80, side="right")
        for x in range(start, stop):
            y = np.arange(x + 1, last[x - start])
            if found[x]:
                y = y[~found[y]]
            if len(y):
                most = np.bitwise_count(bits[y - start] & bits[x - start]).sum(1, dtype=np.int64) + np.minimum(shared[y - start], shared[x - start])
                y = y[180 * most >= 80 * (size[x] + size[y])]
                found[y] = True
                found[x] |= len(y) > 0
    return found


class Tree:
    """A signature tree over sets; join() unites all linked ones."""

    LEAF, FAN, WORDS = 24, 6, 32

    def __init__(self, sets: list[np.ndarray], roots: np.ndarray):
        self.sets, self.root = sets, roots
        n = len(sets)
        self.size = np.array([len(s) for s in sets])
        self.bits = np.zeros((n, self.WORDS), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(20)) % np.uint64(64 * self.WORDS)
            np.bitwise_or.at(self.bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.shared = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        edges = np.arange(0, n, self.LEAF)
        level = (np.bitwise_or.reduceat(self.bits, edges), np.minimum.reduceat(self.size, edges), np.maximum.reduceat(self.size, edges), np.maximum.reduceat(self.shared, edges))
        self.levels = [level]
        while len(level[1]) > 1:
            edges = np.arange(0, len(level[1]), self.FAN)
            level = (np.bitwise_or.reduceat(level[0], edges), np.minimum.reduceat(level[1], edges), np.maximum.reduceat(level[2], edges), np.maximum.reduceat(level[3], edges))
            self.levels.append(level)

    def possible(self, h: int, a: int, b: int) -> bool:
        bits, low, high, shared = self.levels[h]
        if 100 * high[a] < 80 * low[b] or 100 * high[b] < 80 * low[a]:
            return False
        most = int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(shared[a], shared[b])
        return 180 * most >= 80 * (low[a] + low[b])

    def join(self) -> None:
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            h, a, b = stack.pop()
            if a != b and not self.possible(h, a, b):
                continue
            if h == 0:
                self.leaves(a, b)
                continue
            span = self.LEAF * self.FAN**h
            here = np.r_[self.root[a * span : (a + 1) * span], self.root[b * span : (b + 1) * span]]
            if (here == here[0]).all():
                continue
            below = len(self.levels[h - 1][1])
            left, right = (range(x * self.FAN, min((x + 1) * self.FAN, below)) for x in (a, b))
            stack += [(h - 1, x, y) for x in left for y in right if a != b or x <= y]

    def leaves(self, a: int, b: int) -> None:
        i = np.arange(a * self.LEAF, min((a + 1) * self.LEAF, len(self.sets)))
        j = np.arange(b * self.LEAF, min((b + 1) * self.LEAF, len(self.sets)))
        if self.root[i[0]] == self.root[j[0]] and (self.root[i] == self.root[i[0]]).all() and (self.root[j] == self.root[i[0]]).all():
            return
        most = np.bitwise_count(self.bits[i][:, None] & self.bits[j][None]).sum(2, dtype=np.int64) + np.minimum(self.shared[i][:, None], self.shared[j][None])
        both = self.size[i][:, None] + self.size[j][None]
        maybe = (180 * most >= 80 * both) & (self.root[i][:, None] != self.root[j][None]) & (i[:, None] < j[None])
        for x, y in zip(*np.nonzero(maybe)):
            self.meet(i[x], j[y])

    def meet(self, x: int, y: int) -> None:
        if self.root[x] != self.root[y] and linked(self.sets[x], self.sets[y]):
            self.root[self.root == max(self.root[x], self.root[y])] = min(self.root[x], self.root[y])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(both) - common)


def _verify(batches):
    """Rows (group, part, node, root, tokens) in order of group and part to links."""
    links: list[tuple[bytes, bytes]] = []
    rows: list[tuple[bytes, bytes, bytes]] = []
    now = None

    def close():
        if len(rows) > 1:
            rows.sort(key=lambda r: (len(r[2]), r[2]))
            names = [r[1] for r in rows]
            ids = {x: i for i, x in enumerate(dict.fromkeys(names))}
            before = np.array([ids[x] for x in names])
            tree = Tree([np.frombuffer(r[2], np.uint64) for r in rows], before.copy())
            tree.join()
            start: dict[int, bytes] = {}
            for x, r in zip(tree.root.tolist(), rows):
                if (to := start.setdefault(x, r[1])) != r[1]:
                    links.append((r[1], to))
        rows.clear()

    def out():
        pairs = list(dict.fromkeys(links))
        links.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in range(2)], names=["a", "b"])

    for batch in batches:
        for group, part, node, root, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, part) != now:
                close()
                now = (group, part)
            rows.append((node, root, tokens))
        yield out()
    close()
    yield out()


def _possible(batches):
    """Rows (key, node, size, signature and others) in order of key to those, less the
    signature, whose node may be linked with another of its key."""
    rows: list[tuple] = []

    def closed():
        rows.sort(key=lambda r: r[2])
        stay = may_link([r[2] for r in rows], [r[3] for r in rows]).tolist() if len(rows) > 1 else []
        out = [(*r[:3], *r[4:]) for r, x in zip(rows, stay) if x]
        rows.clear()
        return out

    def batch_of(out, schema):
        fields = [f for k, f in enumerate(schema) if k != 3]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], names=[f.name for f in fields])

    schema = None
    for batch in batches:
        out, schema = [], batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[0][0]:
                out += closed()
            rows.append(row)
        yield batch_of(out, schema)
    if rows:
        yield batch_of(closed(), schema)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row (a hash of id and text) and root (the node
    that names the component, null without shingles) for each row."""
    ws = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def describe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(t) for t in batch.column(2).to_pylist()]
                keys = [band_keys(s).astype(np.int64) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ], names=["doc_id", "row", "n_shingles", "node", "keys", "signature"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    described = ws.write(texts.mapInArrow(describe, f"doc_id {kind}, row long, n_shingles long, node binary, keys array<long>, signature binary"), "described")
    nodes = described.where("n_shingles > 0").groupBy("node").agg(F.first("keys").alias("keys"), F.first("n_shingles").cast("int").alias("size"))
    met = ws.write(nodes.select("node", "size", F.explode("keys").alias("key")), "keys")
    # groups of the same nodes are one: their keys agree in number and sum of hashes
    groups = met.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("g")).where("n > 1")
    band = F.col("key").bitwiseAND(F.lit(63))
    groups = groups.groupBy("n", "g").agg(F.min_by(F.struct("key", "tokens"), band).alias("x")).select("x.key", "n", "x.tokens")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    met_there = ws.write(met.select("*", salt).join(groups.select("*", salts), ["key", "salt"]), "met")
    ws.drop("keys")

    # what one chunk holds meets by signatures first
    whole = (F.col("n") <= CHUNK) & (F.col("tokens") <= TOKENS)
    signed = described.where("n_shingles > 0").groupBy("node").agg(F.first("signature").alias("signature"))
    signed = met_there.where(whole).join(signed, "node").select("key", "node", "size", "signature", "salt", "n", "tokens").repartition("key").sortWithinPartitions("key")
    stay = signed.mapInArrow(_possible, "key long, node binary, size int, salt int, n long, tokens long")
    members = ws.write(stay.unionByName(met_there.where(~whole).select(*stay.columns)), "members")
    ws.drop("met")

    # texts to read again, by a bitmap of fixed size
    bit = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long") % BITS + 1  # Spark numbers bits from 1
    found = members.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for k, bits in found:
        bitmap[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(bits), np.uint8)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)

    def tokens(batches):
        wanted, given = bitmap.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                out = {}
                for t in whole.column(0).slice(at, 1000).to_pylist():
                    if len(s := shingles(t)) and (node := node_of(s)) not in given:
                        b = int.from_bytes(node[:4], "big") % BITS
                        if wanted[b >> 3] >> (b & 7) & 1:
                            out[node] = s.tobytes()
                            given.add(node)
                if len(given) > 200_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["node", "tokens"])

    sets = texts.select("text").mapInArrow(tokens, "node binary, tokens binary")
    sets = ws.write(sets.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")

    chunks = lambda n, tokens: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(tokens) / TOKENS)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("key", "node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def links(rows: DataFrame, name: str) -> DataFrame:
        """rows(key, part, node, root): all nodes of a part meet."""
        rows = rows.join(sets, "node").select("key", "part", "node", "root", "tokens").repartition("key", "part").sortWithinPartitions("key", "part")
        return ws.write(rows.mapInArrow(_verify, "a binary, b binary"), name)

    first = members.where(band < EARLY).withColumn("chunks", chunks("n", "tokens"))
    early = links(first.select("key", own("chunks").cast("long").alias("part"), "node", F.col("node").alias("root")), "early")
    roots = components(ws, early, "first")
    labelled = ws.write(members.select("key", "salt", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    def opened(rows: DataFrame) -> DataFrame:
        """Keys whose nodes are of several components: the largest of these, and chunks of
        all nodes and of those outside it."""
        counted = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
        most = F.max_by(F.struct("root", "n", "tokens"), F.struct("n", "root"))
        out = counted.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), most.alias("most")).where("roots > 1")
        out = out.select("key", F.col("most.root").alias("main"), chunks("n", "tokens").alias("all"), (F.col("n") - F.col("most.n")).alias("n"), (F.col("tokens") - F.col("most.tokens")).alias("tokens"))
        return out.select("key", "main", "all", chunks("n", "tokens").alias("few"))

    def crossed(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        """part (i, j): chunk i of all nodes, and chunk j of those outside the largest component."""
        at = lambda i, j: (i.cast("long") * F.col("few") + j).alias("part")
        in_all = F.transform(upto("few"), lambda j: at(own("all"), j))
        in_few = F.transform(upto("all"), lambda i: at(i, own("few")))
        parts = F.when(F.col("root") == F.col("main"), in_all).otherwise(F.array_union(in_few, in_all))
        return links(rows.join(keys.select("*", salts), ["key", "salt"]).select("key", F.explode(parts).alias("part"), "node", "root"), name)

    open_ = ws.write(opened(labelled), "open")
    late = crossed(labelled, open_.where("few = 1"), "late")
    wide = open_.where("few > 1").select("key")
    if not wide.isEmpty():
        # nodes that meet under such a key meet again under it and another of them
        several = labelled.join(wide.select("*", salts), ["key", "salt"]).groupBy("node").agg(F.first("size").alias("size"), F.first("root").alias("root"), F.array_sort(F.collect_list("key")).alias("keys"))
        pairs = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
        finer = ws.write(several.select("node", "size", "root", salt, F.explode(pairs).alias("key")), "finer")
        alike = finer.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("g"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 1 AND low < high")
        finer = finer.join(alike.groupBy("n", "g").agg(F.min("key").alias("key")).select("key", salts), ["key", "salt"])
        late = late.unionByName(crossed(finer, opened(finer), "later"))
    all_links = late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    final = components(ws, all_links, "last")

    lows = described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    lows = lows.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = lows.join(lows.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id", "root")
    some = described.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id", "row", "root")
    none = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("binary").alias("root"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` less all but one of each component: the row with the least id,
    null last, stays. Rows without shingles stay. Rows that agree in id and text stay or
    go together."""
    linked_rows = Workspace(docs.sparkSession).write(jaccard_components(docs, id_col, text_col), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    first = linked_rows.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.row").alias("__row"))
    stay = first.unionByName(linked_rows.where("n_shingles = 0").select(F.col("row").alias("__row")))
    return docs.withColumn("__row", F.xxhash64(id_col, text_col)).join(stay, "__row", "left_semi").select(*docs.columns)


def op7_signature_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
