"""Clusters, codes and packing."""

from __future__ import annotations

import bisect
import heapq
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def centroids(members: DataFrame) -> DataFrame:
    """label, size and the mean vector of (label, vector), by one aggregation over (label, place)."""
    cells = members.select("label", F.posexplode("vector").alias("i", "x"))
    return cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("m")).groupBy("label").agg(F.max("m").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroid(members: DataFrame, centers: DataFrame) -> DataFrame:
    """name, label, nearest, score: the centroid (few, one per cluster) with the highest cosine; ties to the smaller label."""
    pairs = members.join(centers.select(F.col("label").alias("nearest"), "centroid"), F.lit(True)).select("name", "label", "nearest", cosine(F.col("vector"), F.col("centroid")).alias("score"))
    order = W.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "nearest")
    return pairs.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def own_centroid_scores(members: DataFrame, centers: DataFrame) -> DataFrame:
    return members.join(centers.select("label", "centroid"), "label").select("name", "label", cosine(F.col("vector"), F.col("centroid")).alias("score"))


def drifted(old: DataFrame, new: DataFrame, below: float = 0.8) -> DataFrame:
    both = old.select("label", F.col("centroid").alias("a")).join(new.select("label", F.col("centroid").alias("b")), "label")
    return both.select("label", cosine(F.col("a"), F.col("b")).alias("score")).where(F.col("score") < below)


def misplaced(near: DataFrame, labels: DataFrame, very_near: float = 0.9) -> DataFrame:
    """Per name, from its nearest others: whether one of another cluster is very near, is nearest, or most of the top three are of others."""
    own = labels.select(F.col("name").alias("input_name"), F.col("label").alias("own"))
    n = near.join(own, "input_name").join(labels.select(F.col("name").alias("candidate_name"), F.col("label").alias("other")), "candidate_name")
    foreign = F.col("own") != F.col("other")
    return n.groupBy(F.col("input_name").alias("name")).agg(
        F.max(F.when(foreign & (F.col("score") > very_near), 1).otherwise(0)).alias("very_near_foreign"),
        F.max(F.when(foreign & (F.col("rank") == 1), 1).otherwise(0)).alias("nearest_foreign"),
        F.when(F.sum(F.when(foreign & (F.col("rank") <= 3), 1).otherwise(0)) >= 2, 1).otherwise(0).alias("majority_foreign"),
    )


def cluster_labels(members: DataFrame) -> DataFrame:
    """cluster, upper-cased most frequent member (ties to the smaller name), members, total frequency."""
    best = F.min(F.struct((-F.col("frequency")).alias("f"), "name"))
    return members.groupBy("cluster").agg(best.alias("b"), F.count("*").alias("members"), F.sum("frequency").alias("total_frequency")).select("cluster", F.upper(F.col("b")["name"]).alias("label"), "members", "total_frequency")


def super_clusters(clusters: DataFrame) -> DataFrame:
    """bucket and its cluster labels, where there are several."""
    return clusters.select("bucket", "label").distinct().groupBy("bucket").agg(F.array_sort(F.collect_list("label")).alias("labels")).where(F.size("labels") > 1)


def coverage(preferred: DataFrame, clusters: DataFrame) -> DataFrame:
    """Share of all frequency, and of names, that clusters cover."""
    f = preferred.join(clusters.select("name", F.lit(1).alias("hit")).distinct(), "name", "left")
    return f.agg((F.sum(F.when(F.col("hit").isNotNull(), F.col("frequency")).otherwise(0)) / F.sum("frequency")).alias("frequency_share"), F.avg(F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0)).alias("name_share"))


def take_clusters(scores: DataFrame, threshold: float, most: int) -> DataFrame:
    """name, cluster, score, rank: a name's best score per cluster, descending, down to the threshold and at most ``most``; the first is always kept."""
    best = scores.groupBy("name", "cluster").agg(F.max("score").alias("score"))
    order = W.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "cluster")
    return best.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & ((F.col("rank") == 1) | (F.col("score") >= threshold)))


def assign_by_table(names: DataFrame, table: DataFrame) -> DataFrame:
    return names.join(table, "name", "left").select("name", F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("CLUSTER_"), "name")).alias("cluster"))


def own_cluster_for_noise(labels: DataFrame, buckets: int = 64) -> DataFrame:
    """Names with a negative label get a new label of their own, above all others, in the order of names.

    Names are numbered within ranges of themselves and shifted by the sizes of the ranges
    before, so no task orders them all.
    """
    top = labels.agg(F.greatest(F.max("label"), F.lit(-1)).alias("top"))
    alone = _kept(labels.where("label < 0").select("name").repartitionByRange(buckets, "name").withColumn("p", F.spark_partition_id()))
    before = alone.groupBy("p").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    numbered = alone.withColumn("i", F.row_number().over(W.partitionBy("p").orderBy("name"))).join(F.broadcast(before), "p").select("name", (F.col("before") + F.col("i")).alias("k"))
    return labels.join(numbered, "name", "left").join(F.broadcast(top), F.lit(True)).select("name", F.when(F.col("k").isNotNull(), F.col("top") + F.col("k")).otherwise(F.col("label")).cast("long").alias("label"))


def code_tables(coded: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Query side (name, code) with all codes, index side (code, name) under the first code, from (name, codes array).

    Nickname heads add their codes to the query side and put themselves in the index.
    """
    query = coded.select("name", F.explode("codes").alias("code"))
    index = coded.select("name", F.element_at("codes", 1).alias("code"))
    if heads is not None:
        first = index.select(F.col("name").alias("head"), "code")
        more = heads.join(first, "head")
        query = query.union(more.select("name", "code"))
        index = index.union(more.select(F.col("head"), "code"))
    return query.distinct(), index.select("code", "name").distinct()


def code_join(query: DataFrame, index: DataFrame, block: int = 1024) -> DataFrame:
    """name, candidate: index names under any code of a query name, each pair once.

    Both sides of a code are cut into blocks of up to ``block`` names, and every block meets
    every block of its code; blocks are dealt out, not codes, so no task has all pairs of a
    frequent code. A pair with several common codes is kept under the smallest, which only
    names with several codes need to look at, so these have blocks of their own.
    """
    def side(df, name, codes):
        each = df.groupBy(F.col("name").alias(name)).agg(F.collect_set("code").alias(codes)).select(F.explode(codes).alias("code"), name, F.when(F.size(codes) > 1, F.col(codes)).alias(codes))
        more = F.col(codes).isNotNull()
        cut = F.floor((F.row_number().over(W.partitionBy("code", more).orderBy(name)) - 1) / block)
        blocks = each.withColumns({f"{name}_more": more, "block": cut}).groupBy("code", f"{name}_more", "block")
        return blocks.agg(F.collect_list(F.struct(name, codes)).alias(f"{name}s")).drop("block")

    spark = query.sparkSession
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b = side(query, "name", "own"), side(index, "candidate", "other")
    met = a.join(b, "code").where(~(F.col("name_more") & F.col("candidate_more"))).select(F.col("names.name").alias("names"), F.col("candidates.candidate").alias("candidates")).repartition(tasks)
    plain = met.select(F.explode("names").alias("name"), "candidates").select("name", F.explode("candidates").alias("candidate"))
    both = a.where("name_more").join(b.where("candidate_more"), "code").repartition(tasks)
    pair = both.select("code", F.explode("names").alias("n"), "candidates").select("code", "n", F.explode("candidates").alias("c"))
    return plain.union(pair.where(F.col("code") == F.array_min(F.array_intersect("n.own", "c.other"))).select("n.name", "c.candidate"))


def expand_super(codes: DataFrame, supers: DataFrame) -> DataFrame:
    """(name, cluster) with all sibling clusters of the same super-cluster added; supers is (super_label, cluster)."""
    siblings = codes.join(supers, "cluster").select("name", "super_label").distinct().join(supers, "super_label").select("name", "cluster")
    return codes.select("name", "cluster").union(siblings).distinct()


def basename_redirect(names: DataFrame, basenames: DataFrame, clusters: DataFrame) -> DataFrame:
    """A name's cluster, or its base name's when that one is clustered."""
    b = names.join(basenames, "name", "left")
    own = clusters.select("name", F.col("cluster").alias("own"))
    base = clusters.select(F.col("name").alias("basename"), F.col("cluster").alias("base"))
    return b.join(base, "basename", "left").join(own, "name", "left").select("name", F.coalesce("base", "own").alias("cluster"))


def linkage(distance: np.ndarray, method: str = "average", weights: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size) of agglomerative clustering; ties to the smallest places."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weights is None else weights.astype(float).copy()
    ids, merges = list(range(n)), []
    nearest = d.min(axis=1) if n else np.zeros(0)  # of each place, so a step looks at one row, not at all
    for step in range(n - 1):
        i = int(nearest.argmin())
        height = float(nearest[i])
        if not np.isfinite(height):
            break
        j = int(d[i].argmin())
        i, j = sorted((i, j))
        if method == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "complete":
            row = np.maximum(d[i], d[j])
        elif method == "single":
            row = np.minimum(d[i], d[j])
        else:
            raise ValueError(f"unknown linkage {method}")
        row[[i, j]] = np.inf
        lost = np.flatnonzero((nearest == d[i]) | (nearest == d[j]))  # places whose nearest may have gone
        d[i, :], d[:, i] = row, row
        d[j, :], d[:, j] = np.inf, np.inf
        nearest = np.minimum(nearest, row)
        nearest[lost] = d[lost].min(axis=1)
        nearest[i], nearest[j] = row.min(), np.inf
        size[i] += size[j]
        merges.append((ids[i], ids[j], height, int(size[i])))
        ids[i] = n + step
    return merges


def cut(n: int, merges: list[tuple[int, int, float, int]], most: float) -> list[int]:
    """Cluster places of n leaves after the merges up to a distance, numbered by first leaf."""
    up = list(range(n + len(merges)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (i, j, height, _) in enumerate(merges):
        if height <= most:
            up[root(i)] = n + k
            up[root(j)] = n + k
    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(x), len(numbers)) for x in range(n)]


def agglomerative(members: DataFrame, scores: DataFrame, least: float, method: str = "average", missing: float = 2.0) -> DataFrame:
    """bucket, name, cluster (from 0): agglomerative clusters of each bucket's names.

    ``members`` (bucket, name, optional weight); ``scores`` (bucket, name, alt_name, score)
    of known pairs. The distance is 1 - score, ``missing`` for unknown pairs; clusters merge
    up to 1 - ``least``. Buckets are independent, so each is one task's group.
    """
    weighted = "weight" in members.columns
    kinds = dict(members.dtypes)
    several = members.groupBy("bucket").agg(F.count("*").alias("m"))
    alone = members.join(several.where("m = 1"), "bucket", "left_semi").select("bucket", "name", F.lit(0).alias("cluster"))
    several = several.where("m > 1").select("bucket")
    rows = members.select("bucket", "name", (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("weight"), F.lit(None).cast("string").alias("alt_name"), F.lit(None).cast("double").alias("score"))
    rows = rows.unionByName(scores.select("bucket", "name", F.lit(None).cast("double").alias("weight"), F.col("alt_name").cast("string").alias("alt_name"), F.col("score").cast("double").alias("score")))
    # a number of its own, as the rows are few bytes for what a group costs
    rows = rows.join(several, "bucket", "left_semi").repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "bucket")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pair = frame["alt_name"].notna().to_numpy()
        own = frame[~pair].sort_values("name")
        names = own["name"].tolist()
        place = {str(x): k for k, x in enumerate(names)}
        d = np.full((len(names), len(names)), missing)
        if pair.any():
            known = frame[pair]
            i, j = (np.array([place.get(str(x), -1) for x in known[c].tolist()]) for c in ("name", "alt_name"))
            ok = (i >= 0) & (j >= 0)
            d[i[ok], j[ok]] = d[j[ok], i[ok]] = 1 - known["score"].to_numpy()[ok]
        merges = linkage(d, method, own["weight"].to_numpy() if weighted else None)
        return pd.DataFrame({"bucket": [frame["bucket"].iloc[0]] * len(names), "name": names, "cluster": cut(len(names), merges, 1 - least)})

    grouped = rows.groupBy("bucket").applyInPandas(run, f"bucket {kinds['bucket']}, name {kinds['name']}, cluster int")
    return grouped.unionByName(alone)


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the edges (u, v)."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        differ = x != y
        if not differ.any():
            return label
        u, v, x, y = u[differ], v[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _stars(edges: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Edges (u, l) that connect within each partition what its edges (u, l) connect: every name with the smallest it reaches."""
    kind = dict(edges.dtypes)["u"]

    def run(batches):
        held, m = [], 0

        def reduced():
            both = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held]).dictionary_encode()
            order = pc.array_sort_indices(both.dictionary).to_numpy()
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            at = place[both.indices.to_numpy()]
            label = _roots(at[: len(at) // 2], at[len(at) // 2 :], len(order))
            some = np.flatnonzero(label != np.arange(len(order)))
            return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(order[x])) for x in (some, label[some])], names=["u", "l"])

        for batch in batches:
            held.append(batch)
            m += batch.num_rows
            if m > rows + 2 * held[0].num_rows:
                held = [reduced()]
                m = held[0].num_rows
        if held:
            yield reduced()

    return edges.mapInArrow(run, f"u {kind}, l {kind}")


def components(edges: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """name, component (its smallest name) of undirected edges (a, b).

    Partitions are reduced to stars, a few of them together each time while they hold up to
    ``rows``; if several are left, labels fall and jump until nothing changes.
    """
    stars = _kept(_stars(edges.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("l"))))
    parts = stars.rdd.getNumPartitions()
    while parts > 1:
        fewer = max(1, -(-stars.count() // rows))
        if 2 * fewer > parts:
            break
        stars = _kept(_stars(stars.coalesce(fewer)))
        parts = fewer
    if parts <= 1:
        return stars.select(F.col("u").alias("name"), F.col("l").alias("component")).union(stars.select("l", "l").distinct())
    return _labels(stars.select(F.col("u").alias("a"), F.col("l").alias("b")))


def _labels(edges: DataFrame) -> DataFrame:
    """``components`` by labels that fall and jump until nothing changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u != v").distinct()
    both = _kept(both)
    labels = _kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        new = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        new = _kept(new.join(new.select(F.col("u").alias("l"), F.col("l").alias("further")), "l", "left").select("u", "old", F.coalesce("further", "l").alias("l")))
        if new.where("old != l").isEmpty():
            return new.select(F.col("u").alias("name"), F.col("l").alias("component"))
        labels = new.select("u", "l")


def _written(df: DataFrame) -> DataFrame:
    """Like ``_kept``, for many rows: as compressed columns beside the checkpoints."""
    folder = f"{_kept_folder(df)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _kept_folder(df: DataFrame) -> str:
    """The session's checkpoint folder; one of its own where a session on one machine has none."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eponym-"))
    return sc.getCheckpointDir()


def _kept(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder."""
    _kept_folder(df)
    return df.checkpoint(eager=True)


def capped_closures(scored: DataFrame, most: int = 10_000) -> DataFrame:
    """name, closure: closures grown over pairs in ascending distance, joined only while their sizes sum to ``most`` or less.

    The order of pairs decides, but only among pairs of one connected component, and the
    cap binds only in components over ``most``. Smaller ones are closures as they are;
    each larger one is folded in order by one task (one entry per name, pairs pass by).
    """
    kind = dict(scored.dtypes)["a"]
    scored = _written(scored.select("a", "b", "distance"))
    whole = _kept(components(scored))
    sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > most).select("component")
    small = whole.join(sizes.where(F.col("n") <= most).select("component"), "component", "left_semi").select("name", F.col("component").alias("closure"))
    if over.isEmpty():
        return small

    def fold(batches):
        """Rows come by component and in order; only the names' places and sizes are held."""
        up: dict = {}
        size: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = None
        for batch in batches:
            out = out or pa.schema([("name", batch.schema.field("a").type), ("closure", batch.schema.field("a").type)])
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in (a, b):
                    if x not in up:
                        up[x] = x
                        size[x] = 1
                a, b = root(a), root(b)
                if a != b and size[a] + size[b] <= most:
                    i, j = (a, b) if a < b else (b, a)
                    up[j] = i
                    size[i] += size[j]
        if up:
            names = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(c, out.field(0).type) for c in (names, [root(x) for x in names])], schema=out)

    # components are independent, so those of one task may be folded together
    held = whole.join(over, "component", "left_semi").select(F.col("name").alias("a"), F.xxhash64("component").alias("c"))
    pairs = scored.join(held, "a").repartition("c").sortWithinPartitions("distance", "a", "b").select("a", "b")
    return small.unionByName(pairs.mapInArrow(fold, f"name {kind}, closure {kind}"))


def greedy(ranked: DataFrame, threshold: float) -> DataFrame:
    """name, cluster: names in order of frequency join the clusters of their nearest clustered name when its cosine reaches the threshold.

    ``ranked`` is (name, rank, vector) and may have ``heads``, a list of the heads of a
    nickname: such a name joins the clusters of its heads instead, and a head without
    clusters starts its own. Each step depends on all before, so it runs over one ordered
    group in a single task with a growing matrix (one row per name).
    """
    kind, with_heads = dict(ranked.dtypes)["name"], "heads" in ranked.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        m = np.array(frame["vector"].tolist(), dtype=float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        names = frame["name"].tolist()
        heads = frame["heads"].tolist() if with_heads else [None] * len(names)
        of: dict = {}
        for i, name in enumerate(names):
            own = of.setdefault(name, [])
            if heads[i] is not None and len(heads[i]):
                for h in heads[i]:
                    own += [c for c in (of.get(h) or of.setdefault(h, [h])) if c not in own]
                if not own:
                    own.append(name)
            elif i:
                s = m[:i] @ m[i]
                j = int(s.argmax())
                own += [c for c in (of[names[j]] if s[j] >= threshold else [name]) if c not in own]
            elif not own:
                own.append(name)
        rows = [(n, c) for n, cs in of.items() for c in cs]
        return pd.DataFrame(rows, columns=["name", "cluster"])

    return ranked.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, f"name {kind}, cluster {kind}")


def augment_clusters(known: DataFrame, unseen: DataFrame, threshold: float) -> DataFrame:
    """name, cluster of ``unseen`` (name, rank, vector, optional basename), one after another.

    A name goes to the cluster of its base name if that has one; else to the cluster of the
    nearest name, known or seen before, whose cosine reaches ``threshold``; else it starts
    its own. ``known`` is (name, vector, cluster). Each name is a candidate for later ones,
    so this is a fold in one task, like ``greedy``.
    """
    kind = dict(unseen.dtypes)["name"]
    base = F.col("basename").cast("string") if "basename" in unseen.columns else F.lit(None).cast("string")
    rows = known.select(F.col("name"), F.lit(-1).cast("long").alias("rank"), "vector", F.col("cluster").cast("string").alias("cluster"), F.lit(None).cast("string").alias("basename"))
    rows = rows.unionByName(unseen.select("name", F.col("rank").cast("long").alias("rank"), "vector", F.lit(None).cast("string").alias("cluster"), base.alias("basename")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "name"])
        m = np.array(frame["vector"].tolist(), dtype=float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        names, cluster = frame["name"].tolist(), frame["cluster"].tolist()
        of = {str(n): c for n, c, r in zip(names, cluster, frame["rank"]) if r < 0}
        first = len(cluster) - int((frame["rank"] >= 0).sum())
        # which names are compared does not hang on clusters, so all nearest ones before are found first, by blocks
        bases, there = frame["basename"].tolist(), set(of)
        by_base = np.zeros(len(names), dtype=bool)
        for i in range(first, len(names)):
            by_base[i] = bases[i] is not None and bases[i] in there
            there.add(str(names[i]))
        compared = np.flatnonzero(~by_base)
        m, nearest, score = m[compared], np.full(len(names), -1), np.full(len(names), -np.inf)
        for low in range(first, len(compared), 128):
            high = min(len(compared), low + 128)
            s = m[low:high] @ m[:high].T
            s[:, low:][np.triu_indices(high - low)] = -np.inf
            at = s.argmax(axis=1)
            nearest[compared[low:high]], score[compared[low:high]] = compared[at], s[np.arange(high - low), at]
        for i in range(first, len(names)):
            if by_base[i]:
                cluster[i] = of[bases[i]]
            else:
                cluster[i] = cluster[nearest[i]] if score[i] >= threshold and np.isfinite(score[i]) else str(names[i])
            of[str(names[i])] = cluster[i]
        seen = (frame["rank"] >= 0).to_numpy()
        return pd.DataFrame({"name": frame["name"][seen], "cluster": np.array(cluster, dtype=object)[seen]})

    return rows.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, f"name {kind}, cluster string")


def phonebook(sizes: list[tuple], neighbours: list[tuple], supers: dict, n_partitions: int, most: float) -> dict:
    """cluster -> list of partitions.

    Clusters over ``most`` are split evenly over several partitions. The rest merge: within
    a super-cluster, then along neighbour pairs in falling similarity until few enough
    partitions are left, then the smallest into the largest it fits in. Two partitions
    merge only when one is whole and together they stay within ``most``. Partitions are
    numbered densely by first use. A fold over one row per cluster, on the driver.
    """
    parts: dict[int, float] = {}
    holds: dict = {}
    many = set()
    for cluster, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        k = max(1, math.ceil(size / most))
        ids = list(range(len(parts), len(parts) + k))
        parts.update({i: size / k for i in ids})
        holds[cluster] = ids
        many.update(ids if k > 1 else ())
    where = {i: i for i in parts}

    def at(i):
        while where[i] != i:
            where[i] = where[where[i]]
            i = where[i]
        return i

    def merge(a, b) -> bool:
        many_a, many_b = ({at(i) for i in holds[x]} for x in (a, b))
        if (len(many_a) > 1 and len(many_b) > 1) or many_a & many_b:
            return False
        i, j = (min(x, key=lambda k: (parts[k], k)) for x in (many_a, many_b))
        if parts[i] + parts[j] > most:
            return False
        where[j] = i
        parts[i] += parts.pop(j)
        return True

    groups: dict = {}
    for cluster in holds:
        groups.setdefault(supers.get(cluster, ("", cluster)), []).append(cluster)
    for members in groups.values():
        for a, b in zip(members, members[1:]):
            merge(a, b)
    for a, b, _ in sorted(neighbours, key=lambda x: (-x[2], str(x[0]), str(x[1]))):
        if len(parts) <= n_partitions:
            break
        merge(a, b)
    while len(parts) > n_partitions:
        whole = sorted((s, i) for i, s in parts.items() if i not in many)
        if len(whole) < 2:
            break
        small, i = whole[0]
        fit = [(s, j) for s, j in whole[1:] if s + small <= most]
        if not fit:
            break
        s, j = max(fit)
        where[i] = j
        parts[j] += parts.pop(i)
    numbers: dict[int, int] = {}
    return {c: [numbers.setdefault(at(i), len(numbers)) for i in ids] for c, ids in holds.items()}


def place_single_letters(sizes: dict, singles: list[tuple]) -> dict:
    """name -> partition: names of one letter, most frequent first, each to the partition that is smallest by then."""
    heap = [(s, p) for p, s in sizes.items()]
    heapq.heapify(heap)
    out = {}
    for name, frequency in sorted(singles, key=lambda x: (-x[1], x[0])):
        size, p = heapq.heappop(heap)
        out[name] = p
        heapq.heappush(heap, (size + frequency, p))
    return out


def split_hierarchy(children: dict, sizes: dict, root, most: float, least: float, n_partitions: int) -> list[tuple[float, list, int]]:
    """(size of each part, nodes, number of parts) of a hierarchy cut into partitions.

    The largest partition is split while it is over ``most``: a merged one into its nodes, a
    node into its children, a leaf into equal parts. Then small partitions merge, the
    largest below ``least`` first, each into the largest that it fits in, until there are
    ``n_partitions`` or none fits. Over nodes of a hierarchy, on the driver.
    """
    parts: list[tuple[float, list, int]] = [(sizes[root], [root], 1)]
    while parts[-1][0] > most:
        _, nodes, k = parts.pop()
        if len(nodes) > 1:
            new = [(sizes[x], [x], 1) for x in nodes]
        elif nodes[0] in children:
            new = [(sizes[x], [x], 1) for x in children[nodes[0]]]
        else:
            new = [(sizes[nodes[0]] / (k + 1), nodes, k + 1)]
        for x in new:
            bisect.insort(parts, x, key=lambda y: y[0])
    below = len(parts)
    while sum(k for _, _, k in parts) > n_partitions and below > 0:
        below -= 1
        size, nodes, k = parts[below]
        if k > 1 or size >= least:
            continue
        fits = [j for j in range(below + 1, len(parts)) if parts[j][2] == 1 and size + parts[j][0] <= most]
        if fits:
            other = parts.pop(fits[-1])
            parts.pop(below)
            bisect.insort(parts, (size + other[0], nodes + other[1], 1), key=lambda y: y[0])
            below = len(parts)
    return parts


def partition_lookups(clusters: DataFrame, partitions: DataFrame) -> DataFrame:
    """name, lookups: the partitions that a name's clusters (name, cluster) lie in, by (cluster, start, n); each start counts its n once."""
    each = clusters.join(partitions, "cluster").groupBy("name", "start").agg(F.max("n").alias("n"))
    return clusters.select("name").distinct().join(each, "name", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("lookups"))


def standard_clusters(variants: DataFrame, scored: DataFrame, digits: int = 3) -> DataFrame:
    """name, cluster, score: the best score of a cluster over all variants (name, variant) of a name, from (name, cluster, score)."""
    best = variants.join(scored.withColumnRenamed("name", "variant"), "variant").groupBy("name", "cluster").agg(F.max("score").alias("score"))
    return best.select("name", "cluster", F.round("score", digits).alias("score"))


def bucket_closure(codes: DataFrame, buckets: DataFrame) -> DataFrame:
    """cluster, other: clusters reached over a cluster's names (name, cluster), their buckets (head, name) and the names of these."""
    held = codes.join(buckets, "name").select("cluster", "head").distinct()
    reached = held.join(buckets, "head").select("cluster", "name").distinct()
    return reached.join(codes.withColumnRenamed("cluster", "other"), "name").select("cluster", "other").distinct()


def round_robin(partitions: DataFrame, machines: int = 40) -> DataFrame:
    """machine and its summed size when partitions are dealt in order of size."""
    rank = F.row_number().over(W.orderBy(F.desc("size"), "partition"))
    return partitions.withColumn("machine", (rank - 1) % machines).groupBy("machine").agg(F.sum("size").alias("size"))
