"""Nearest-neighbour and text similarity joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import levenshtein_similarity
from ..functions.vectors import dot, norm
from .clusters import _kept


def _blocks(df: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Vectors gathered into blocks of about ``rows`` rows, dealt by a hash of the name; floats stay floats, which halves them."""
    n = max(1, -(-df.count() // rows))
    kind = "array<float>" if dict(df.dtypes)["vector"] == "array<float>" else "array<double>"
    keyed = df.select("name", F.col("vector").cast(kind).alias("vector")).withColumn(f"{prefix}_block", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int"))
    return keyed.groupBy(f"{prefix}_block").agg(F.collect_list("name").alias(f"{prefix}_names"), F.flatten(F.collect_list("vector")).alias(f"{prefix}_cells"))


def _held_bytes(df: DataFrame) -> int:
    """About the bytes that rows of arrays take in Spark's memory."""
    each = {"array<float>": 4, "array<int>": 4, "array<string>": 24}
    return df.select(F.sum(sum((F.size(c).cast("long") * each.get(t, 8) for c, t in df.dtypes if t.startswith("array")), F.lit(0)))).first()[0] or 0


def _meetings(inputs: DataFrame, candidates: DataFrame, most: int = 16 << 20) -> DataFrame:
    """Every block of inputs with every block of candidates, one block of inputs after another in a task.

    Blocks are read back from the checkpoints where they meet, not shuffled. A task holds its
    candidates on the heap (Spark spills them by number of rows only, here never), so they
    are dealt by their size, about ``most`` bytes to a task, or one block.
    """
    conf, key = inputs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "67108864", "64MB"):
        conf.set(key, "16m")  # of a default of 64, as a row is two blocks
    left, right = _kept(inputs), _kept(candidates)
    tasks = max(1, min(left.count(), 4 * inputs.sparkSession.sparkContext.defaultParallelism))
    left, right = _kept(left.repartition(tasks)), _kept(right.repartition(max(1, min(right.count(), -(-_held_bytes(right) // most)))))
    return left.hint("shuffle_replicate_nl").join(right, F.lit(True))


class Best:
    """The ``k`` best candidates of every place of a block of inputs, ties to the smaller name, over blocks that come one after another."""

    def __init__(self, n: int, k: int, slack: float = 1e-9):
        self.n, self.k, self.slack, self.edge, self.held, self.rows = n, k, slack, np.full(n, -np.inf), [], 0

    def add(self, scores: np.ndarray, take) -> None:
        """``scores`` has a row for each input; ``take`` gives the names of columns."""
        if not self.held and scores.shape[1] > self.k:
            self.edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1] - self.slack
        i, j = np.nonzero((scores >= self.edge[:, None]) & (scores > -np.inf))
        if len(i):
            self.held.append((i, scores[i, j], take(j)))
            self.rows += len(i)
        if self.rows > 4 * self.n * self.k:
            self.prune()

    def extend(self, i: np.ndarray, scores: np.ndarray, names: pa.Array) -> None:
        """Adds single candidates of the places ``i``."""
        self.held.append((i, scores, names))
        self.prune()

    def prune(self) -> None:
        if not self.held:
            return
        i, s = (np.concatenate([h[c] for h in self.held]) for c in (0, 1))
        names = pa.concat_arrays([h[2] for h in self.held])
        s9, place = np.round(s, 9), np.empty(len(s), dtype=np.int64)
        place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(s))
        order = np.lexsort((place, -s9, i))
        i = i[order]
        first = np.searchsorted(i, np.arange(self.n))
        order = order[np.arange(len(i)) - first[i] < self.k]
        i, s, s9 = (np.concatenate([h[0] for h in self.held])[order], s[order], s9[order])
        at = np.searchsorted(i, np.arange(self.n)) + self.k - 1
        full = (at < len(i)) & (i[np.minimum(at, len(i) - 1)] == np.arange(self.n))
        self.edge[full] = np.maximum(self.edge[full], s9[at[full]] - self.slack)
        self.held = [(i, s, names.take(pa.array(order)))]
        self.rows = len(i)

    def batch(self, names: pa.Array, least: float | None, columns: list[str]):
        self.prune()
        if self.held:
            i, s, others = self.held[0]
            good = np.flatnonzero(s > least) if least is not None else np.arange(len(s))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i[good])), others.take(pa.array(good)), pa.array(s[good])], names=columns)


def _same(names: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal names in both."""
    at = pc.index_in(names, value_set=others)
    i = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return i, at.take(pa.array(i)).to_numpy()


def nearest(inputs: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine", least: float | None = None, with_self: bool = True, block: int = 2048) -> DataFrame:
    """input_name, candidate_name, score, rank: the ``k`` best candidates of every input.

    Exact: blocks of inputs meet blocks of candidates, each meeting is one matrix product; a
    task keeps the best ``k`` of a block of inputs over all blocks it meets, and a window
    picks from those of all tasks. No side is broadcast whole. ``least`` keeps only scores
    strictly above it. Ties go to the smaller name.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")

    kind, columns = dict(candidates.dtypes)["name"], ["input_name", "candidate_name", "score"]

    def matrix(column, row, n):
        m = column[row].values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" else m

    def meet(batches):
        at = names = a = best = None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() != at:
                    if best is not None:
                        yield from best.batch(names, least if metric == "cosine" else None, columns)
                    at, names = batch.column(0)[row].as_py(), batch.column(1)[row].values
                    a, best = matrix(batch.column(2), row, len(names)), Best(len(names), k)
                others = batch.column(4)[row].values
                b = matrix(batch.column(5), row, len(others))
                s = a @ b.T if metric == "cosine" else -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
                if not with_self:
                    s[_same(names, others)] = -np.inf
                best.add(s, lambda j, others=others: others.take(pa.array(j)))
        if best is not None:
            yield from best.batch(names, least if metric == "cosine" else None, columns)

    met = _meetings(_blocks(inputs, block, "i"), _blocks(candidates, block, "c")).mapInArrow(meet, f"input_name {dict(inputs.dtypes)['name']}, candidate_name {kind}, score double")
    if least is not None:
        met = met.where(F.col("score") > least)
    order = W.partitionBy("input_name").orderBy(F.desc(F.round("score", 9)), "candidate_name")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("score", F.when(F.lit(metric == "euclidean"), -F.col("score")).otherwise(F.col("score")))


def tfidf(names: DataFrame, grams: Column, min_df: int = 1) -> DataFrame:
    """name, gram, weight: counts times idf (1 + ln((1 + n) / (1 + df))), each name's weights of length one."""
    counted = names.select("name", F.explode(grams).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("c"))
    n = names.select("name").distinct().count()
    df = counted.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    raw = counted.join(df, "gram").withColumn("x", F.col("c") * (F.log((1.0 + n) / (1 + F.col("df"))) + 1))
    return raw.select("name", "gram", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("name")))).alias("weight"))


class _Grams:
    """Names of a block with their n-grams (as numbers) and weights; ``cut`` has where each name's cells begin."""

    def __init__(self, batch: pa.RecordBatch, row: int, first: int):
        self.names, sizes, self.grams, self.weights = (batch.column(first + c)[row].values for c in range(4))
        self.grams, self.weights = self.grams.to_numpy(), self.weights.to_numpy()
        self.cut = np.concatenate([[0], np.cumsum(sizes.to_numpy())])

    def index(self) -> None:
        """Lists of places and weights under each n-gram; ``level`` of an n-gram is higher the longer its list, ``left`` has the length of what each name has over each level."""
        self.known, self.at = np.unique(self.grams, return_inverse=True)
        order = np.argsort(self.at, kind="stable")
        self.places, self.values = np.repeat(np.arange(len(self.names)), np.diff(self.cut))[order], self.weights[order]
        start = np.searchsorted(self.at[order], np.arange(len(self.known) + 1))
        self.start, self.listed = start.tolist(), np.diff(start)
        self.level = np.searchsorted(len(self.names) / 2.0 ** np.arange(10, 0, -0.5), self.listed)
        self.left = self.over(self.cut, self.level[self.at], self.weights)
        self.usual = np.quantile(self.left, 0.99, axis=1)

    @staticmethod
    def over(cut: np.ndarray, level: np.ndarray, weights: np.ndarray, levels: int = 21) -> np.ndarray:
        """For each level, the length of each name's weights of higher levels."""
        n = len(cut) - 1
        mass = np.bincount(level * n + np.repeat(np.arange(n), np.diff(cut)), weights**2, levels * n).reshape(levels, n)
        return np.sqrt(np.maximum(mass[::-1].cumsum(axis=0)[::-1] - mass, 0)) + 1e-7

    def scores(self, own: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whole scores of some places with a name given by its weight under each known n-gram."""
        sizes = self.cut[places + 1] - self.cut[places]
        ends = np.cumsum(sizes)
        cells = np.arange(ends[-1]) + np.repeat(self.cut[places] - ends + sizes, sizes)
        return np.add.reduceat(own[self.at[cells]] * self.weights[cells], ends - sizes)


def _best_by_grams(a: _Grams, b: _Grams, edge: np.ndarray, k: int, least: float):
    """Place in ``a``, places in ``b`` and scores that can be among the best ``k`` of a name; ``edge`` has what its k-th best reaches as known so far.

    The lists of a name's rarer n-grams (up to a level) are added up. What frequent ones can
    add to that is at most the product of the lengths that both names have in them; only where the sum
    reaches the edge is a name scored whole. The level is the lowest at which that product is under
    the edge for nearly all. A name without an edge gets one from the best under its rarest n-grams.
    """
    n, own = len(b.names), np.zeros(len(b.known))
    at = np.searchsorted(b.known, a.grams)
    at[at == len(b.known)] = 0
    there = b.known[at] == a.grams
    at, weights, cut = at[there], a.weights[there], np.concatenate([[0], np.cumsum(there)])[a.cut]
    order = np.lexsort((b.listed[at], np.repeat(np.arange(len(a.names)), np.diff(cut))))
    at, weights = at[order], weights[order]
    left = b.over(cut, b.level[at], weights)
    itself = dict(zip(*(x.tolist() for x in _same(a.names, b.names))))

    def met(cells, weights):
        if not len(cells):
            return np.zeros(n)
        spans = [(b.start[g], b.start[g + 1]) for g in cells.tolist()]
        where = np.concatenate([b.places[s:e] for s, e in spans])
        return np.bincount(where, np.concatenate([b.values[s:e] * w for (s, e), w in zip(spans, weights.tolist())]), n)

    for i in range(len(a.names)):
        s, e = cut[i], cut[i + 1]
        if s == e:
            continue
        cells, own[at[s:e]] = at[s:e], weights[s:e]
        floor = max(least - 1e-9, edge[i])
        if edge[i] == -np.inf:
            some = met(cells[:6], weights[s : s + 6])
            if i in itself:
                some[itself[i]] = 0
            some = np.argpartition(-some, 4 * k)[: 4 * k] if n > 4 * k else np.arange(n)
            some = some[some != itself.get(i, -1)]
            if len(some) >= k:
                floor = max(floor, -np.partition(-b.scores(own, some), k - 1)[k - 1] - 1e-9)
        under = left[:, i] * b.usual < floor
        level = int(under.argmax()) if under.any() else len(under) - 1
        m = int(np.searchsorted(b.level[cells], level, side="right"))
        got = met(cells[:m], weights[s : s + m]) + left[level, i] * b.left[level]
        if i in itself:
            got[itself[i]] = -np.inf
        places = np.flatnonzero(got >= floor - 1e-9)
        if len(places):
            score = b.scores(own, places)
            good = (score >= floor) & (score > 0)
            if good.any():
                yield i, places[good], score[good]
        own[cells] = 0.0


def tfidf_nearest(inputs: DataFrame, candidates: DataFrame, k: int, least: float = 0.0, block: int = 16_000) -> DataFrame:
    """name, alt_name, score, rank by sparse dot products of ``tfidf`` rows, without equal names.

    Exact, and no join on n-grams, of which a few are in most names: blocks of inputs meet
    blocks of candidates, a meeting adds up lists of a name's rarer n-grams (see
    ``_best_by_grams``) and keeps the best ``k`` (with ties) of every input, and a window
    picks from those. Weights must not be negative, nor ``least``. N-grams of up to three
    characters become numbers, longer ones 63 bits of a hash.
    """
    if least < 0:
        raise ValueError("least must not be negative")
    letter = [F.ascii(F.substring("gram", i, 1)).cast("long") for i in (1, 2, 3)]
    number = F.when(F.length("gram") <= 3, (letter[0] * (1 << 21) + letter[1]) * (1 << 21) + letter[2]).otherwise(F.xxhash64("gram").bitwiseOR(F.lit(-(1 << 63))))

    def rows(df, side, block):
        n = max(1, -(-df.select("name").distinct().count() // block))
        held = df.withColumn("gram", number).groupBy("name").agg(F.collect_list(F.struct("gram", "weight")).alias("cells"))
        r = held.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias(f"{side}_block")).agg(F.sort_array(F.collect_list(F.struct("name", "cells"))).alias("r"))
        flat = {"names": "r.name", "sizes": "transform(r, x -> size(x.cells))", "grams": "flatten(transform(r, x -> x.cells.gram))", "weights": "flatten(transform(r, x -> x.cells.weight))"}
        return r.select(f"{side}_block", *[F.expr(e).alias(f"{side}_{c}") for c, e in flat.items()])

    def meet(batches):
        at = a = best = None
        columns = ["name", "alt_name", "score"]
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() != at:
                    if best is not None:
                        yield from best.batch(a.names, least, columns)
                    at, a = batch.column(0)[row].as_py(), _Grams(batch, row, 1)
                    best = Best(len(a.names), k)
                b = _Grams(batch, row, 6)
                b.index()
                found = list(_best_by_grams(a, b, best.edge, k, least))
                if found:
                    best.extend(np.repeat([i for i, _, _ in found], [len(p) for _, p, _ in found]), np.concatenate([s for _, _, s in found]), b.names.take(pa.array(np.concatenate([p for _, p, _ in found]))))
        if best is not None:
            yield from best.batch(a.names, least, columns)

    met = _meetings(rows(inputs, "i", max(1, block // 4)), rows(candidates, "c", block), 24 << 20).mapInArrow(meet, "name string, alt_name string, score double")
    order = W.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "alt_name")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_by_edits(blocked: DataFrame, k: int) -> DataFrame:
    """The ``k`` of each name's blocked candidates with the highest edit similarity."""
    s = blocked.select("name", "alt_name", levenshtein_similarity(F.col("name"), F.col("alt_name")).alias("score"))
    order = W.partitionBy("name").orderBy(F.desc("score"), "alt_name")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote_for_cluster(near: DataFrame, clusters: DataFrame, limit: int = 3) -> DataFrame:
    """input_name, label, votes, mean_score, rank: clusters of the nearest names by votes, then mean score."""
    v = near.join(clusters.select(F.col("name").alias("candidate_name"), "label"), "candidate_name").groupBy("input_name", "label").agg(F.count("*").alias("votes"), F.avg("score").alias("mean_score"))
    order = W.partitionBy("input_name").orderBy(F.desc("votes"), F.desc(F.round("mean_score", 9)), "label")
    return v.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def cluster_pair_scores(members: DataFrame) -> DataFrame:
    """label, other_label (label < other_label) and the mean cosine over all pairs of their members.

    The mean of all cosines is the product of the clusters' mean unit vectors, so members
    are aggregated before clusters meet.
    """
    from ..functions.vectors import normalized

    unit = members.select("label", F.posexplode(normalized(F.col("vector"))).alias("i", "x"))
    mean = unit.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("u"))
    other = mean.select(F.col("label").alias("other_label"), F.col("u").alias("v"))
    return mean.join(other, F.col("label") < F.col("other_label")).select("label", "other_label", dot(F.col("u"), F.col("v")).alias("score"))


def unit_length(c: Column) -> Column:
    return norm(c)
