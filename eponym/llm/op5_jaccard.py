"""N-gram Jaccard join by T-occurrence search (DivideSkip), with connected components.

Two documents link when the Jaccard similarity of their sets of word shingles reaches
``percent``. Linked sets of sizes a and b share at least T = ceil(percent * (a + b) /
(100 + percent)) shingles: a partner of a document occurs in T of the inverted lists of its
shingles. The search is DivideSkip, laid out over the cluster. It is exact up to 64-bit
hashes of shingles, and never lists the pairs of a group of copies:

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. Lists are divided into short and long ones by one order of all shingles: those that a
   count sketch over the whole corpus calls frequent come last, the others by hash. A
   document's short lists are those of its first n - T + 1 + ``extra`` shingles (T here for
   its smallest partner), so T - 1 - ``extra`` long ones are left, and a partner occurs in
   at least ``extra`` + 1 of the short lists, or in T where that is fewer. Any order gives
   the same result; this one keeps the short lists short.
3. The short lists of a document are brought together (only entries with a larger doc_id
   and a fitting size) and merged with a heap, skipping entries that cannot reach that
   number any more. What remains is proposed.
4. The long lists are probed: whether a proposed partner is in the list of a shingle is
   whether the shingle is in the partner's sorted set, which binary search tells. A
   document's set meets its partners' sets one after another, so nothing large is held.
5. Links give components (min-label propagation with shortcuts, checkpointed each round).
   Shingles of step 2 held by more than ``short_list`` documents (groups of copies,
   boilerplate) propose only pairs with their smallest document. Those whose documents are
   not all of one component after that are searched again: documents outside the list's
   largest component are queries against all of its documents of fitting size, in blocks
   of about ``block`` shingles, by the same heap merge and binary probes within a block. A
   group of copies already linked is not compared with itself, yet no link that could
   join components is lost.

Shuffled data: digests of sets, short lists (a tenth of the sets), and whole sets of
documents in a proposed pair only. Those are chosen by a bitmap, which like the sketch is
sized by a count of documents up to a bound (more only costs speed). Every step reads
checkpointed tables, so lost executors cost a task each. A step's shuffle files go when it
ends, a checkpoint's when the last step that reads it has ended, so the disk in use is that
of the largest step.

Defined cases: a text with fewer words than a shingle is one shingle of all its words;
null text or a text without words has an empty set, links with nothing and is its own
component; rows with equal doc_id are one node, which has the links of all their texts; a
null doc_id keeps a null component; texts of any length count whole; an empty table gives
an empty result; other columns are ignored. ``keep_one`` keeps the smallest doc_id of a
component; of rows with that doc_id any one.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, merged, released, shuffles_released, slices, small_batches, table, task_memory, utf8

SCANNED = "kind int, doc_id long, n long, k1 long, k2 long, part int, counts binary"
PARTS = 64


class Shingles:
    """Sets of shingle hashes of texts; words are hashed once per worker while the table has room."""

    def __init__(self, words: int = 3, most_words: int = 150_000):
        self.words, self.most_words = words, most_words
        self.known: dict[bytes, bytes] = {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = utf8(text).lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > self.most_words:
                known.clear()
            for k, h in enumerate(found):
                if h is None:
                    w = words[k]
                    found[k] = h = xxhash.xxh3_64_digest(w)
                    if len(w) <= 24:
                        known[w] = h
        h = np.frombuffer(b"".join(found), dtype="<u8")
        w = min(self.words, len(h))
        out = np.full(len(h) - w + 1, w, dtype=np.uint64)
        for j in range(w):
            out ^= h[j : len(h) - w + 1 + j]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        out.sort()
        return out if len(out) == 1 else out[np.concatenate([[True], out[1:] != out[:-1]])]


@functools.lru_cache(maxsize=4)
def shingler(words: int) -> Shingles:
    return Shingles(words)


def _docs(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan(docs: DataFrame, words: int, sketch_bits: int) -> DataFrame:
    """Per document the size and digest of its set (kind 0); per task the counts of all shingles, hashed to counters (kind 1)."""

    def run(batches):
        import xxhash

        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        make, counts, seen = shingler(words), np.zeros(1 << sketch_bits, dtype=np.uint16), False
        with task_memory(make.known):
            for batch in slices(batches):
                ns, k1, k2 = [], [], []
                for text in batch.column(1).to_pylist():
                    s = make.of(text)
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    a, b = np.frombuffer(d, dtype="<i8").tolist()
                    ns.append(len(s)), k1.append(a), k2.append(b)
                    at = s >> np.uint64(64 - sketch_bits)
                    counts[at] += (counts[at] < 60_000).astype(np.uint16)
                    seen = True
                m = len(ns)
                none = pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), batch.column(0), pa.array(ns, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), none, pa.nulls(m, pa.binary())], schema=schema)
            if seen:
                small = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
                packed = [zlib.compress(p.tobytes(), 1) for p in small]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(PARTS, np.int32)), *(pa.nulls(PARTS, pa.int64()) for _ in range(4)), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(packed, pa.binary())], schema=schema
                )

    return _docs(docs).mapInArrow(run, SCANNED)


def frequent_bits(scanned: DataFrame, sketch_bits: int, least: int = 64) -> bytes:
    """A bitmap of the counters over a bound: ``least``, or four times the mean if that is more."""
    total = scanned.where("kind = 0").agg(F.sum("n")).head()[0] or 0
    bound = max(least, math.ceil(4 * total / (1 << sketch_bits)))
    size = (1 << sketch_bits) // PARTS

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(size, dtype=np.int64)
        for raw in frame["counts"]:
            raw = zlib.decompress(raw)
            whole += np.frombuffer(raw, dtype=np.uint8 if len(raw) == size else "<i8")
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "counts": [zlib.compress(whole.astype("<i8").tobytes(), 1)]})

    rows = scanned.where("kind = 1").select("part", "counts")
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("counts"), F.lit(16))).groupBy("part", "lot").applyInPandas(add, "part int, counts binary")
    got = rows.groupBy("part").applyInPandas(lambda f: add(f).assign(counts=lambda x: [zlib.compress(np.packbits(np.frombuffer(zlib.decompress(c), dtype="<i8") > bound).tobytes(), 1) for c in x["counts"]]), "part int, counts binary").collect()
    bits = {r["part"]: zlib.decompress(r["counts"]) for r in got}
    return b"".join(bits.get(p, bytes(size // 8)) for p in range(PARTS))


def least_shared(a: int, b: int, percent: int) -> int:
    """T: the fewest common shingles of linked sets."""
    return -(-percent * (a + b) // (100 + percent))


def prefixes(docs: DataFrame, words: int, bits: bytes, sketch_bits: int, percent: int, extra: int) -> DataFrame:
    """Per document the prefix of its set in the common order."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])
        make, often = shingler(words), np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        with task_memory(make.known):
            for batch in slices(batches):
                ns, tokens = [], []
                for text in batch.column(1).to_pylist():
                    s = make.of(text)
                    n = len(s)
                    ns.append(n)
                    size = min(n, n - -(-percent * n // 100) + 1 + extra)
                    common = often[s >> np.uint64(64 - sketch_bits)]
                    rare = s[~common][:size]
                    tokens.append((np.concatenate([rare, s[common][: size - len(rare)]]) if len(rare) < size else rare).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=schema)

    return _docs(docs).mapInArrow(run, "doc_id long, n long, prefix array<long>")


def doc_bits(ids: DataFrame, bits: int) -> bytes:
    """A bitmap that holds all ids of ``ids`` (column ``doc_id``)."""
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    rows = ids.select((at / 64).cast("long").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out.tobytes()


def whole_sets(docs: DataFrame, words: int, ids: DataFrame, most_bits: int = 27) -> DataFrame:
    """Whole sets of the documents of ``ids``; ``doc_id`` and ``set`` (sorted, little-endian), each once.

    A bitmap built from ``ids``, of some bits for each of them, drops nearly all others
    before the join with them.
    """
    bits = min(most_bits, max(12, (16 * max(1, ids.count())).bit_length()))
    mask = doc_bits(ids, bits)

    def run(batches):
        make, words_of_mask = shingler(words), np.frombuffer(mask, dtype="<i8")
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("set", pa.binary())])
        import xxhash

        with task_memory(make.known):
            for batch in slices(batches):
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array(((words_of_mask[at // 64] >> (at % 64)) & 1).astype(bool)))
                sets = [make.of(t).tobytes() for t in batch.column(1).to_pylist()]
                keys = np.array([xxhash.xxh3_64_intdigest(x) for x in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sets, pa.binary())], schema=schema)

    some = _docs(docs).where(F.col("doc_id").isNotNull()).withColumn("at", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits))
    return some.mapInArrow(run, "doc_id long, key long, set binary").dropDuplicates(["doc_id", "key"]).select("doc_id", "set")


def merge_skip(lists: list[list[int]], need: int):
    """(place, lists holding it) for places in at least ``need`` of the sorted lists.

    A heap over the lists' heads pops equal places together and, when they are too few,
    skips every popped list to the next place that can still reach ``need``.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        place, popped = heap[0][0], []
        while heap and heap[0][0] == place:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield place, len(popped)
            target = place + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = max(place + 1, heap[0][0])
        for _, k, at in popped:
            nxt = bisect_left(lists[k], target, at)
            if nxt < len(lists[k]):
                heapq.heappush(heap, (lists[k][nxt], k, nxt))


def groups(batches, keys: int):
    """Rows of sorted batches by their first ``keys`` columns: (key, batch slices of the group so far, whether it ends).

    A group longer than a batch comes in parts.
    """
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.zeros(n, dtype=bool)
        changed[0] = True
        for c in cols:
            changed[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(changed)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
            own = tuple(int(c[a]) for c in cols)
            yield own, own != key, batch.slice(a, b - a)
            key = own


class Block:
    """An inverted index of whole sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.of = flat[order], of[order]
        self.keys, self.at = np.unique(flat, return_index=True)
        self.at = np.append(self.at, len(flat))
        # list and place in one sorted array, which binary search probes for many lists at once
        self.entries = np.repeat(np.arange(len(self.keys)), np.diff(self.at)) * max(1, len(sets)) + self.of

    def search(self, query: np.ndarray, percent: int, extra: int = 2) -> list[int]:
        """Places of the sets linked with ``query``."""
        q = len(query)
        fits = (100 * np.minimum(self.sizes, q) >= percent * np.maximum(self.sizes, q)) & (self.sizes > 0)
        if not q or not fits.any():
            return []
        t = least_shared(q, int(self.sizes[fits].min()), percent)
        k = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        k = k[self.keys[k] == query]
        if len(k) < t:
            return []
        k = k[np.argsort(self.at[k + 1] - self.at[k], kind="stable")]
        long = max(0, t - 1 - extra)  # the longest lists, only probed; a partner is in t - long of the others
        short, probed = k[: len(k) - long], k[len(k) - long :]
        lists = [self.of[self.at[i] : self.at[i + 1]].tolist() for i in short.tolist()]
        found = []
        for place, count in merge_skip(lists, t - long):
            if fits[place]:
                want = probed * len(self.sizes) + place
                at = np.minimum(np.searchsorted(self.entries, want), len(self.entries) - 1)
                if count + int((self.entries[at] == want).sum()) >= least_shared(q, int(self.sizes[place]), percent):
                    found.append(place)
        return found


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def propose(short: DataFrame, percent: int, extra: int) -> DataFrame:
    """Pairs (a, b, bn), a < b, that the merge of a's short lists (token, d: doc_id and n of its documents) leaves."""
    fit = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    own = f"transform(d, (x, i) -> named_struct('a', x.doc_id, 'an', x.n, 'rest', filter(slice(d, i + 2, size(d)), y -> y.doc_id > x.doc_id and {fit})))"
    rows = short.select(F.expr(f"inline({own})")).where("size(rest) > 0")
    rows = rows.select("a", "an", F.col("rest.doc_id").alias("b"), F.col("rest.n").alias("bn")).repartition(F.col("a")).sortWithinPartitions("a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bn", pa.int64())])

    def run(batches):
        out, lists, sizes, least, at = [], [], {}, 0, None

        def merge():
            # a smaller partner may have to be in fewer of the lists
            need = min(extra + 1, -(-percent * least // 100))
            if len(lists) >= need:
                for b, _ in merge_skip(lists, max(1, need)):
                    out.append((at, b, sizes[b]))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

        for (a,), new, rows in groups(batches, 1):
            if new:
                merge()
                lists, sizes, at = [], {}, a
                least = -(-percent * rows.column(1)[0].as_py() // 100)
                if len(out) > 20_000:
                    yield batch()
                    out = []
            for b, n, an in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), rows.column(1).to_pylist()):
                lists.append(b)
                sizes.update(zip(b, n))
                least = min(least, -(-percent * an // 100))
        merge()
        if out:
            yield batch()

    return rows.mapInArrow(run, "a long, b long, bn long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, block: int, broadcast_rows: int = 200_000) -> DataFrame:
    """Those of the pairs (a, b, bn), a < b, that link, by binary probes of b's shingles in a's set.

    The set of a is held and those of its partners pass by. A document whose partners
    have many shingles (``bn`` are those of b) is dealt to several tasks, by ``block``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        asked: list[np.ndarray] = []
        for (a, _), new, rows in groups(batches, 2):
            if new:
                asked = []
            b, sets = rows.column(2), rows.column(3).to_pylist()
            asks = int(b.null_count)  # these come first
            asked += [_as_set(x) for x in sets[:asks]]
            held = [_as_set(x) for x in sets[asks:]]
            if not held or not asked:
                continue
            size = np.array(list(map(len, held)))
            flat, linked = np.concatenate(held), np.zeros(len(held), dtype=bool)
            some = size > 0
            for q in asked:
                if len(q):
                    hit = q[np.minimum(np.searchsorted(q, flat), len(q) - 1)] == flat
                    both = np.bincount(np.repeat(np.arange(len(held)), size), hit, len(held))
                    linked |= some & (100 * both >= percent * (len(q) + size - both))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(linked.sum()), a)), b.slice(asks).filter(pa.array(linked))], schema=schema)

    # only documents with more partners than a block are told of; they are few against the pairs
    large = checkpointed(pairs.groupBy("a").agg(F.ceil(F.sum("bn") / block).alias("blocks")).where("blocks > 1"))
    side = F.broadcast(large) if large.count() <= broadcast_rows else large
    lots = pairs.join(side, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("lot"))
    held = lots.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "lot", "b", "set")
    asks = lots.select("a", "lot").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), "set")
    sorted_rows = held.union(asks).repartition(F.col("a"), F.col("lot")).sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return sorted_rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) for every end of a link, checkpointed; the label is the smallest doc_id reachable."""
    both = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u != v").distinct())
    held = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "doc_id"))
    while True:
        labels = held.select("doc_id", "label")
        near = both.join(labels.select(F.col("doc_id").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("doc_id")).agg(F.min("l").alias("l"))
        new = labels.join(near, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = new.select(F.col("doc_id").alias("label"), F.col("label").alias("further"))
        new = checkpointed(new.join(jump, "label", "left").select("doc_id", "old", F.coalesce("further", "label").alias("label")))
        released(held)
        if new.where("old != label").isEmpty():
            released(both)
            return new
        held = new


def search_long(lists: DataFrame, labels: DataFrame, docs: DataFrame, words: int, percent: int, block: int) -> DataFrame | None:
    """Links inside long lists (token, doc_id, n) between documents of different components.

    Documents of a list are dealt to blocks by size, in steps of the ratio that linked sizes
    may have, and by hash within a step. A query goes to the blocks of its step and of those
    beside it only; a document of the index goes to one block.
    """
    known = lists.join(labels.select("doc_id", "label"), "doc_id", "left").select("token", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    sizes = known.groupBy("token", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).where("top.m < all")
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) if percent < 100 else 1e-9) + 1e-9).cast("long")
    rows = known.join(largest, "token").select("token", "doc_id", "n", "label", step.alias("step"), (F.col("label") != F.col("top.label")).alias("query"))
    rows = checkpointed(rows)
    if rows.isEmpty():
        released(rows)
        return None
    sets = checkpointed(whole_sets(docs, words, rows.select("doc_id").distinct()))
    blocks = rows.groupBy("token", "step").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    index = rows.join(blocks, ["token", "step"]).select("token", "step", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("lot"), F.lit(0).alias("asks"), "doc_id", "label")
    asks = rows.where("query").select("token", F.explode(F.expr("sequence(step - 1, step + 1)")).alias("step"), "doc_id", "label").join(blocks, ["token", "step"])
    asks = asks.select("token", "step", F.explode(F.expr("sequence(0, blocks - 1)")).alias("lot"), F.lit(1).alias("asks"), "doc_id", "label")
    dealt = index.unionByName(asks).join(sets, "doc_id").select("token", "step", "lot", "asks", "doc_id", "label", "set")
    dealt = dealt.repartition(F.col("token"), F.col("step"), F.col("lot")).sortWithinPartitions("token", "step", "lot", "asks")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held, index, up = [], None, {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for _, new, rows in groups(batches, 3):
            if new:
                held, index, up = [], None, {}
            out = []
            for ask, doc, own, raw in zip(*(rows.column(k).to_pylist() for k in (3, 4, 5, 6))):
                if not ask:
                    held.append((doc, own, _as_set(raw)))
                    continue
                if index is None:
                    index = Block([x[2] for x in held])
                for place in index.search(_as_set(raw), percent):
                    if (x := root(held[place][1])) != (y := root(own)):
                        up[max(x, y)] = min(x, y)
                        out.append((min(doc, held[place][0]), max(doc, held[place][0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    found = checkpointed(dealt.mapInArrow(run, "a long, b long").distinct())
    released(rows, sets)
    return found


def join(docs: DataFrame, percent: int = 90, words: int = 3, extra: int = 2, short_list: int = 96, block: int = 250_000, sketch_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    with shuffles_released(docs.sparkSession):
        return _join(docs, percent, words, extra, short_list, block, sketch_bits)


def _join(docs: DataFrame, percent: int, words: int, extra: int, short_list: int, block: int, sketch_bits: int | None) -> DataFrame:
    sketch_bits = sketch_bits or min(25, max(12, (32 * max(1, docs.count())).bit_length()))
    scanned = checkpointed(scan(docs, words, sketch_bits))
    bits = frequent_bits(scanned, sketch_bits)
    every = checkpointed(scanned.where("kind = 0").select("doc_id", "n", "k1", "k2"))
    released(scanned)
    real = every.where("n > 0 and doc_id is not null")
    classes = checkpointed(real.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("head")))
    some = checkpointed(prefixes(docs, words, bits, sketch_bits, percent, extra).join(classes.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    postings = some.select(F.explode("prefix").alias("token"), "doc_id", "n")
    # written, so that the join reads both sides from exchanges of its own and a hot shingle's postings can be split
    lists = checkpointed(postings.groupBy("token").agg(F.count("*").alias("m"), F.min("doc_id").alias("least")).where("m > 1"))
    shared = checkpointed(postings.join(lists, "token"))
    released(some, lists)
    short = shared.where(F.col("m") <= short_list).groupBy("token").agg(F.sort_array(F.collect_set(F.struct("doc_id", "n"))).alias("d")).where("size(d) > 1")
    stars = shared.where((F.col("m") > short_list) & (F.col("doc_id") != F.col("least"))).select(F.col("least").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("bn"))
    proposed = checkpointed(propose(short, percent, extra).union(stars.distinct()).groupBy("a", "b").agg(F.max("bn").alias("bn")))
    ends = proposed.select(F.col("a").alias("doc_id")).union(proposed.select("b")).distinct()
    # rows with one doc_id and different sets tie the classes of these sets together
    several = real.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.min("k2").alias("low2"), F.max("k2").alias("high2")).where("low != high or low2 != high2").select("doc_id")
    tied = real.join(several, "doc_id").join(classes, ["k1", "k2", "n"]).select("doc_id", F.col("head").alias("b")).distinct()
    ties = tied.join(tied.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b")
    sets = checkpointed(whole_sets(docs, words, ends))
    links = checkpointed(verify(proposed, sets, percent, block).union(ties.where("a != b")))
    released(sets, proposed)
    labels = components(links)
    long = shared.where(F.col("m") > short_list).select("token", "doc_id", "n").distinct()
    more = None if long.isEmpty() else search_long(long, labels, docs, words, percent, block)
    released(shared, links)
    if more is not None and not more.isEmpty():
        first, labels = labels, components(labels.select(F.col("label").alias("a"), F.col("doc_id").alias("b")).union(more))
        released(first, more)
    heads = classes.join(labels.select(F.col("doc_id").alias("head"), "label"), "head", "left").select("k1", "k2", F.col("n").alias("__n"), F.coalesce("label", "head").alias("__c"))
    named = every.join(heads, (every.k1 == heads.k1) & (every.k2 == heads.k2) & (every.n == heads["__n"]), "left")
    return merged(named).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("__c", "doc_id")).alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each component; rows with a repeated doc_id count as one."""
    found = join(docs.select("doc_id", "text"), percent, words)
    rest = checkpointed(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("m")).where((F.col("c") != F.col("doc_id")) | (F.col("m") > 1)))
    gone, again = (rest.where(w).select("doc_id") for w in (F.col("c") != F.col("doc_id"), F.col("c") == F.col("doc_id")))
    small = rest.count() <= broadcast_rows
    side = F.broadcast if small else (lambda x: x)
    kept = docs.join(side(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    return kept.join(side(again), "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(side(again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
