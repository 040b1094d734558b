"""Document fingerprints by a randomised edit embedding.

Every text takes the same random walk: reading a character at output position j, a shared
random bit of (j, character) decides whether the walk moves on to the next character or
writes this one again, so a character that is read stays for a geometric number of
positions. Texts that differ by a few edits fall into step again soon after each, so edit
distance becomes Hamming distance between outputs. The output is never written out: only
the position at which each character arrives is followed, and each (position, character)
adds +1 or -1 to one of ``BINS`` sums chosen by a shared hash, a random sample of the
output's bits. The signs of the sums are the fingerprint (two bit masks in hexadecimal,
positive then negative), over the whole text. The likeness of two fingerprints is the
cosine of their signs, set straight by the arc-sine law, 0 to 1.

Near documents are found by banding: keys, each of the bits of a fixed random sample of
bins, as many as a pair of the least likeness needs to share one with a chance of 0.9. Equal fingerprints are one class, so a group of copies costs one row per band, and
all classes under a key are compared with each other, in blocks of at most ``block`` rows
a side; a pair that shares several keys counts under the first. ``near_counts`` adds the
number of near documents and the smallest doc_id among them and the document itself.

``with_edited`` pairs each document with the next in descending doc_id (after the last:
the first). Rows are dealt to shards by ranges of doc_id and a hash of the text, whose
bounds come from a sample of these alone; the first row of a shard is also sent to the
shard before it, so every shard finds all its neighbours. Texts cross the network once.

Defined cases: null text counts as empty, its fingerprint is all zeros and like only to
itself; a single document is its own next one; rows with equal doc_id follow one another
in the order of a hash of their texts; a null doc_id counts as the smallest; texts of any
length are walked whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, RangeShards, checkpointed, mix64, small_batches, table, utf8

BINS, CLASSES, PERIOD = 256, 64, 1 << 16
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _steps() -> np.ndarray:
    """Positions that a character of each class takes up at each position: 1 plus the zeros that follow among shared random bits."""
    bits = (mix64(np.arange(CLASSES * PERIOD, dtype=np.uint64) + np.uint64(0x5DEECE66D)) >> np.uint64(63)).reshape(CLASSES, PERIOD).astype(bool)
    steps = np.ones((CLASSES, PERIOD), dtype=np.uint8)
    run = np.zeros(CLASSES, dtype=np.uint8)
    for turn in range(2):  # twice round, as a run may cross the end of the period
        for j in range(PERIOD - 1, -1, -1):
            run = np.where(bits[:, j], 0, np.minimum(run + 1, 60)).astype(np.uint8)
            if turn:
                steps[:, j] = 1 + run
    return steps


class Embedding:
    """The shared walk and hash."""

    def __init__(self):
        self.steps = _steps()
        self.flat = self.steps.reshape(-1)
        self.lists: list[bytes] = [s.tobytes() for s in self.steps]

    @staticmethod
    def classes(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return (((points * np.uint32(0x9E3779B1)) >> np.uint32(26)) & np.uint32(CLASSES - 1)).astype(np.uint8)

    def walk(self, codes: np.ndarray, lengths: np.ndarray, start: np.ndarray, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Arrival positions of all characters of texts laid end to end, and the position after each text's last."""
        offsets = np.cumsum(lengths) - lengths
        arrival = np.empty(len(codes), dtype=np.int32)
        j = start.astype(np.int64).copy()
        order = np.argsort(-lengths, kind="stable")
        by_length, at, now = lengths[order], offsets[order], j[order]
        longest = int(by_length[few - 1]) if len(order) >= few else 0
        alive = np.searchsorted(-by_length, -np.arange(longest), side="left") if longest else []
        for i in range(longest):
            k = alive[i]
            here = at[:k] + i
            p = now[:k]
            arrival[here] = p
            p += self.flat[codes[here].astype(np.int64) * PERIOD + (p & (PERIOD - 1))]
        j[order] = now
        for d in order[: np.searchsorted(-by_length, -longest, side="left")].tolist():  # the few longer ones
            o, n, p, steps, mask = int(offsets[d]), int(lengths[d]), int(j[d]), self.lists, PERIOD - 1
            seen = []
            put = seen.append
            for c in codes[o + longest : o + n].tobytes():
                put(p)
                p += steps[c][p & mask]
            arrival[o + longest : o + n] = seen
            j[d] = p
        return arrival, j

    @staticmethod
    def sums(codes: np.ndarray, arrival: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        h = arrival.astype(np.uint32) * np.uint32(CLASSES) + codes
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        sign = 1.0 - 2.0 * ((h >> np.uint32(8)) & np.uint32(1))
        return np.bincount(of * BINS + (h & np.uint32(BINS - 1)), sign, minlength=n * BINS).reshape(n, BINS)

    def fingerprints(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Signs of every text and of its edited text; the last text only serves as the next of the one before."""
        n = len(texts) - 1
        coded = [self.classes(t) for t in texts]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        codes = np.concatenate(coded) if len(coded) else np.zeros(0, np.uint8)
        half = lengths // 2
        keep = lengths - half
        of = np.repeat(np.arange(n + 1), lengths)
        arrival, _ = self.walk(codes, lengths, np.zeros(n + 1, dtype=np.int64))
        in_first = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(keep, lengths)
        first = self.sums(codes[in_first], arrival[in_first], of[in_first], n + 1)
        whole = first + self.sums(codes[~in_first], arrival[~in_first], of[~in_first], n + 1)
        # the edited text walks on from where the kept part ends
        offsets = np.cumsum(lengths) - lengths
        resume = np.zeros(n, dtype=np.int64)
        for d in np.flatnonzero(keep[:n] > 0):
            last = offsets[d] + keep[d] - 1
            p = int(arrival[last])
            resume[d] = p + self.lists[codes[last]][p & (PERIOD - 1)]
        taken = np.minimum(half[:n], lengths[1:])
        tails = [coded[d + 1][:k] for d, k in enumerate(taken.tolist())]
        tail_codes = np.concatenate(tails) if n else np.zeros(0, np.uint8)
        tail_arrival, _ = self.walk(tail_codes, taken, resume)
        edited = first[:n] + self.sums(tail_codes, tail_arrival, np.repeat(np.arange(n), taken), n)
        return np.sign(whole).astype(np.int8), np.sign(edited).astype(np.int8)


def text_of(signs: np.ndarray) -> list[str]:
    """Fingerprints as text."""
    positive, negative = np.packbits(signs > 0, axis=1), np.packbits(signs < 0, axis=1)
    return [p.tobytes().hex() + m.tobytes().hex() for p, m in zip(positive, negative)]


def signs_of(fingerprints) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(-1, 2, BINS // 8)
    bits = np.unpackbits(raw, axis=2).astype(np.int8)
    return bits[:, 0] - bits[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot, na, nb = ((x.astype(np.float64) * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b)))
    cosine = np.where((na == 0) & (nb == 0), 1.0, dot / np.maximum(np.sqrt(na * nb), 1e-12))
    return np.round(np.sin(np.pi / 2 * np.clip(cosine, 0.0, 1.0)), 9)


_SHARED: list[Embedding] = []


def embedding() -> Embedding:
    if not _SHARED:
        _SHARED.append(Embedding())
    return _SHARED[0]


def with_edited(docs: DataFrame, shard_docs: int = 8192, batch_chars: int = 5_000_000) -> DataFrame:
    """One row per document with its fingerprint, its edited text's, and their likeness."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), text.alias("text"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("spread"))
    ids = rows.select("id", "spread")
    bounds = RangeShards(ids, shard_docs)

    @F.pandas_udf("int")
    def shard_of(id: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series(bounds.of(id.to_numpy(), spread.to_numpy()))

    found = ids.select("id", "spread", shard_of("id", "spread").alias("shard")).groupBy("shard").agg(F.max(F.struct("id", "spread")).alias("top")).collect()
    tops = sorted((r["shard"], tuple(r["top"])) for r in found)
    also = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}  # a shard's first row follows the last of the next higher shard

    @F.pandas_udf("array<int>")
    def places(id: pd.Series, spread: pd.Series) -> pd.Series:
        own = bounds.of(id.to_numpy(), spread.to_numpy()).tolist()
        return pd.Series([[s, also[at]] if at in also else [s] for s, at in zip(own, zip(id.tolist(), spread.tolist()))])

    dealt = rows.select("id", "spread", "text", "no_id", F.posexplode(places("id", "spread")).alias("ghost", "shard"))
    dealt = dealt.repartitionById(bounds.shards, F.col("shard")).sortWithinPartitions("ghost", F.desc("id"), F.desc("spread"), "text").select("id", "text", "no_id", "ghost")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        walk = embedding()

        def result(held, following):
            texts = [t for _, t, _ in held] + [following]
            whole, edited = walk.fingerprints(texts)
            shas = []
            for a, b in zip(texts, texts[1:]):
                h = len(a) // 2
                shas.append(hashlib.sha256(utf8(a[: len(a) - h] + b[:h])).hexdigest())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if no else i for i, _, no in held], pa.int64()), pa.array([len(t) for _, t, _ in held], pa.int64()), pa.array(shas, pa.string()),
                    pa.array(text_of(whole[:-1]), pa.string()), pa.array(text_of(edited), pa.string()), pa.array(likeness(whole[:-1], edited)), pa.array(likeness(whole[:-1], whole[1:])),
                ],
                schema=schema,
            )

        held, chars, done = [], 0, False
        for batch in batches:
            for i, text, no, ghost in zip(*(c.to_pylist() for c in batch.columns)):
                if done:
                    continue
                if held and (ghost or chars >= batch_chars):
                    yield result(held, text)
                    held, chars = [], 0
                if ghost:
                    done = True
                    continue
                held.append((i, text, no))
                chars += len(text)
        if held:  # only a shard that got no ghost row: never, as every shard has a next one
            yield result(held, held[0][1])

    return dealt.mapInArrow(run, RESULT)


MOST_BANDS = 200
SAMPLES = np.argsort(mix64(np.arange(MOST_BANDS * BINS, dtype=np.uint64).reshape(MOST_BANDS, BINS) + np.uint64(77)), axis=1)


def banding(classes: int, least: float, recall: float = 0.9) -> tuple[int, int]:
    """Bands and bins: keys grow by a bin for each doubling beyond some million classes, so buckets stay as they are, and bands with them, so that a pair of just the least likeness is found with the given chance."""
    agree = (1 + math.asin(least) * 2 / math.pi) / 2
    bins = min(20, max(12, math.ceil(math.log2(max(2, classes))) - 8))
    return min(MOST_BANDS, math.ceil(math.log(1 - recall) / math.log(1 - agree**bins))), bins


def band_keys(signs: np.ndarray, bands: int, bins: int) -> np.ndarray:
    """One key a band for every fingerprint: the bits of its bins, a sum of zero counting as positive."""
    out = np.empty((len(signs), bands), dtype=np.int64)
    bits = (signs >= 0).astype(np.uint64)
    for k in range(bands):
        h = np.full(len(signs), k + 1, dtype=np.uint64)
        for b in SAMPLES[k, :bins]:
            h = h * np.uint64(2) + bits[:, b]
        out[:, k] = (mix64(h) >> np.uint64(1)).astype(np.int64)
    return out


def bucket_links(signs: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, bins: int, least: float, rows: int = 512):
    """Index arrays (i, j, likeness) of the near pairs of one bucket, ``left`` against ``right``, without those that share an earlier band's key."""
    floor = math.asin(min(1.0, max(0.0, least))) * 2 / math.pi - 1e-6
    f = signs.astype(np.float32)
    f /= np.maximum(np.sqrt((f * f).sum(axis=1)), 1e-6)[:, None]
    same = left is right
    keys = band_keys(signs, band, bins) if band else None
    for at in range(0, len(left), rows):
        i, j = np.nonzero(f[left[at : at + rows]] @ f[right].T >= floor)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        for part in range(0, len(i), 100_000):
            x, y = i[part : part + 100_000], j[part : part + 100_000]
            if band:
                new = ~(keys[x] == keys[y]).any(axis=1)
                x, y = x[new], y[new]
            score = likeness(signs[x], signs[y])
            near = score >= least
            if near.any():
                yield x[near], y[near], score[near]


def small_links(words: np.ndarray, end: np.ndarray, band: np.ndarray, bands: int, bins: int, least: float):
    """As ``bucket_links``, for many small buckets at once: row i meets rows i + 1 to ``end[i]`` - 1. ``words`` are the two masks in 64-bit words."""
    floor = math.asin(min(1.0, max(0.0, least))) * 2 / math.pi - 1e-6
    half = words.shape[1] // 2
    plus, minus = words[:, :half], words[:, half:]
    norm = np.sqrt(np.bitwise_count(words).sum(axis=1, dtype=np.int64))
    pairs, i, step = [], np.arange(len(words)), 1
    while len(i := i[i + step < end[i]]):
        p, m, q, o = plus[i], minus[i], plus[i + step], minus[i + step]
        dot = np.bitwise_count((p & q) | (m & o)).sum(axis=1, dtype=np.int64) - np.bitwise_count((p & o) | (m & q)).sum(axis=1, dtype=np.int64)
        x = i[dot >= floor * norm[i] * norm[i + step]]
        pairs.append((x, x + step))
        step += 1
    if not pairs:
        return
    i, j = (np.concatenate(c) for c in zip(*pairs))
    rows = np.unique(np.concatenate([i, j]))
    bits = np.unpackbits(words[rows].view(np.uint8).reshape(-1, 2, BINS // 8), axis=2).astype(np.int8)
    signs = bits[:, 0] - bits[:, 1]
    keys = band_keys(signs, bands, bins)
    for part in range(0, len(i), 100_000):
        x, y = i[part : part + 100_000], j[part : part + 100_000]
        a, b = np.searchsorted(rows, x), np.searchsorted(rows, y)
        score = likeness(signs[a], signs[b])
        near = (score >= least) & ~((keys[a] == keys[b]) & (np.arange(bands) < band[x][:, None])).any(axis=1)
        yield x[near], y[near], score[near]


def _written(rows: DataFrame, digests: list[str]) -> DataFrame:
    """``rows``, written once, with hexadecimal columns as half as many bytes."""
    held = checkpointed(rows.withColumns({c: F.unhex(c) for c in digests}))
    return held.withColumns({c: F.lower(F.hex(c)) for c in digests})


def _classes(fingerprints: DataFrame) -> DataFrame:
    """One row per fingerprint: smallest id, number of documents."""
    return _written(fingerprints.groupBy("fingerprint").agg(F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("id"), F.count(F.lit(1)).alias("n")), ["fingerprint"])


def _compared(classes: DataFrame, bands: int, bins: int, least: float, block: int, counts: bool, broadcast_rows: int = 200_000, few: int = 64, held_rows: int = 16_000) -> DataFrame:
    """Near pairs of classes (id, near_id, likeness), or with ``counts`` partial sums (id, n, near_id) of them."""

    @F.pandas_udf("array<long>")
    def keys(fp: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(signs_of(fp.tolist()), bands, bins)) if len(fp) else [], dtype=object)

    keyed = small_batches(classes).select("id", "n", F.unhex("fingerprint").alias("fp"), F.posexplode(keys("fingerprint")).alias("band", "key"))
    # buckets of more than about a block, estimated from one class in ``rate``; the estimate only sets the size of tasks
    rate = 1 if block < 1024 else 16
    some = classes.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(rate)) == 0).select(F.explode(keys("fingerprint")).alias("key"))
    large = checkpointed(some.groupBy("key").count().where(F.col("count") * rate > block).select("key", F.ceil(F.col("count") * rate / block).cast("int").alias("blocks")))
    large = F.broadcast(large) if large.count() <= broadcast_rows else large
    keyed = keyed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a block of a large bucket meets every other one, and itself; a row is kept small, as there is one for every band
    dealt = keyed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    flags = F.when(low == high, 0).when(F.col("own") == low, 2).otherwise(3)
    dealt = dealt.select(F.xxhash64("key", low, high).alias("unit"), F.expr("shiftleft(n, 10) + shiftleft(band, 2)").alias("tag"), flags.cast("long").alias("flags"), "id", "fp")
    dealt = dealt.select("unit", (F.col("tag") + F.col("flags")).alias("tag"), "id", "fp").repartition(F.col("unit")).sortWithinPartitions("unit")

    fields = [("id", pa.int64()), ("n", pa.int64()), ("near_id", pa.int64())] if counts else [("id", pa.int64()), ("near_id", pa.int64()), ("likeness", pa.float64())]
    schema = pa.schema(fields)

    def run(batches):
        def result(held):
            unit, tag, ids, fp = (np.concatenate(c) for c in zip(*held))
            sizes, band, crossed, upper = tag >> 10, (tag >> 2) & 255, (tag & 2) > 0, (tag & 1) > 0
            cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            total, nearest, found = np.zeros(len(ids), np.int64), ids.copy(), []

            def take(x, y, score):
                if counts:
                    for p, q in ((x, y), (y, x)):
                        np.add.at(total, p, sizes[q])
                        np.minimum.at(nearest, p, ids[q])
                else:
                    found.append((np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), score))

            length = np.diff(cuts)
            small = (length <= few) & ~crossed[cuts[:-1]]
            end = np.repeat(np.where(small, cuts[1:], 0), length)
            for near in small_links(fp.view(np.uint64), end, band, bands, bins, least):
                take(*near)
            for a, z in zip(cuts[:-1][~small], cuts[1:][~small]):
                bits = np.unpackbits(fp[a:z].reshape(-1, 2, BINS // 8), axis=2).astype(np.int8)
                left = np.flatnonzero(~upper[a:z])
                right = np.flatnonzero(upper[a:z]) if crossed[a] else left
                for x, y, score in bucket_links(bits[:, 0] - bits[:, 1], left, right, int(band[a]), bins, least):
                    take(x + a, y + a, score)
            if counts:
                some = total > 0
                return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some]), pa.array(nearest[some])], schema=schema)
            cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            part = [c[n].to_numpy(zero_copy_only=False) for n in ("unit", "tag", "id")]
            part.append(np.frombuffer(b"".join(c["fp"].to_pylist()), np.uint8).reshape(-1, BINS // 4))
            changed = np.flatnonzero(part[0] != part[0][-1])
            last = int(changed[-1]) + 1 if len(changed) else 0  # where the batch's last unit begins
            rows += batch.num_rows
            if rows >= held_rows and not last and held and held[-1][0][-1] != part[0][0]:
                yield result(held)
                held, rows, last = [], batch.num_rows, 0
            elif rows >= held_rows and last:
                yield result([*held, [x[:last] for x in part]])
                held, rows = [], batch.num_rows - last
            else:
                last = 0
            held.append([x[last:] for x in part])
        if held:
            yield result(held)

    return dealt.mapInArrow(run, "id long, n long, near_id long" if counts else "id long, near_id long, likeness double")


def near_links(fingerprints: DataFrame, least: float = 0.8, block: int = 4096) -> DataFrame:
    """Links (doc_id, near_id, likeness): from documents to the smallest doc_id with their fingerprint, and between those of all near fingerprints that share a band key."""
    classes = _classes(fingerprints)
    real = F.when(F.col("near_id") != LOWEST, F.col("near_id")).alias("near_id")
    between = _compared(classes, *banding(classes.count(), least), least, block, False).select(F.col("id").alias("doc_id"), real, "likeness")
    within = fingerprints.select("doc_id", "fingerprint").join(classes.where("n > 1"), "fingerprint").where(F.col("doc_id") > F.col("id"))
    return between.unionByName(within.select("doc_id", F.col("id").alias("near_id")).select("doc_id", real).distinct().withColumn("likeness", F.lit(1.0)))


def near_counts(fingerprints: DataFrame, least: float = 0.8, block: int = 4096) -> DataFrame:
    """``fingerprints`` with ``n_near``, the number of other documents with an equal fingerprint or a near one that shares a band key, and ``near_id``, the smallest doc_id among them and the document's own."""
    classes = _classes(fingerprints)
    linked = _compared(classes, *banding(classes.count(), least), least, block, True).groupBy("id").agg(F.sum("n").alias("more"), F.min("near_id").alias("near_id"))
    some = classes.join(linked, "id", "left").where("n > 1 or more is not null").select("fingerprint", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), F.coalesce(F.least("id", "near_id"), "id").alias("__near"))
    out = fingerprints.join(checkpointed(some), "fingerprint", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    near = F.when(F.col("__near").isNull(), F.col("doc_id")).when(F.col("__near") != LOWEST, F.col("__near"))
    return out.select(*fingerprints.columns, "n_near", near.alias("near_id"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_counts(_written(with_edited(table(spark, sf_dir, "documents")), ["edited_sha256", "fingerprint", "edited_fingerprint"]))
