"""Pair augmentation, triplets and sampling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import levenshtein_at_least, levenshtein_similarity
from ..functions.vectors import smoothed_score
from . import deletions
from .clusters import _kept
from .pair_statistics import hash_unit, two_sided_counts


def weighted_edges(attached: DataFrame) -> DataFrame:
    """Attached names with the two-sided counts of both names."""
    n = two_sided_counts(attached)
    return attached.join(n.select(F.col("name").alias("tree_name"), F.col("frequency").alias("tree_count")), "tree_name").join(n.select(F.col("name").alias("record_name"), F.col("frequency").alias("record_count")), "record_name")


def _paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths name -> middle -> alt_name, counted; first and second have (name|alt_name, middle)."""
    return first.join(second, "middle").where("name != alt_name").groupBy("name", "alt_name").agg(F.count("*").alias("score"))


def tree_record_pairs(attached: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Names that share a tree name, with the number of shared ones; each hop needs its weight.

    The hop to a tree name weighs its frequency by the name's count, the hop from it by
    the tree name's count.
    """
    e = weighted_edges(attached)
    into = e.where(F.col("frequency") / F.col("record_count") >= threshold).select(F.col("record_name").alias("name"), F.col("tree_name").alias("middle"))
    out = e.where(F.col("frequency") / F.col("tree_count") >= threshold).select(F.col("tree_name").alias("middle"), F.col("record_name").alias("alt_name"))
    return _paths(into, out)


def record_tree_pairs(attached: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Names that share a record name, with the number of shared ones."""
    e = weighted_edges(attached)
    into = e.where(F.col("frequency") / F.col("tree_count") >= threshold).select(F.col("tree_name").alias("name"), F.col("record_name").alias("middle"))
    out = e.where(F.col("frequency") / F.col("record_count") >= threshold).select(F.col("record_name").alias("middle"), F.col("tree_name").alias("alt_name"))
    return _paths(into, out)


def chained_pairs(attached: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Names two hops down (record names of record names) or two hops up, counts added."""
    e = weighted_edges(attached)
    down = e.where(F.col("frequency") / F.col("tree_count") >= threshold)
    up = e.where(F.col("frequency") / F.col("record_count") >= threshold)
    a = _paths(down.select(F.col("tree_name").alias("name"), F.col("record_name").alias("middle")), down.select(F.col("tree_name").alias("middle"), F.col("record_name").alias("alt_name")))
    b = _paths(up.select(F.col("record_name").alias("name"), F.col("tree_name").alias("middle")), up.select(F.col("record_name").alias("middle"), F.col("tree_name").alias("alt_name")))
    return a.unionByName(b).groupBy("name", "alt_name").agg(F.sum("score").alias("score"))


def neighbour_pairs(attached: DataFrame) -> DataFrame:
    """Names one hop away in either direction, frequencies added."""
    both = attached.select(F.col("tree_name").alias("name"), F.col("record_name").alias("alt_name"), "frequency").union(attached.select("record_name", "tree_name", "frequency"))
    return both.groupBy("name", "alt_name").agg(F.sum("frequency").alias("score"))


def same_code_pairs(names: DataFrame, code) -> DataFrame:
    """Ordered pairs of names with a common non-empty code; ``code`` may be an array of codes."""
    codes = names.select("name", code.alias("code"))
    if dict(codes.dtypes)["code"].startswith("array"):
        codes = codes.select("name", F.explode("code").alias("code"))
    codes = codes.where("code != ''").distinct()
    return codes.join(codes.withColumnRenamed("name", "alt_name"), "code").where("name != alt_name").select("name", "alt_name").distinct()


def segments(least: float, longest: int, lengths: set[int] | None = None) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (shorter, longer, segment, place, size, first, last) of names that may be alike.

    At most k = floor((1 - least) * longer) edits leave one of k + 1 segments of the shorter
    name whole; in the longer one it starts between ``first`` and ``last`` (places from 1).
    Only for names of ``lengths``, where these are given.
    """
    out = []
    held = sorted(lengths) if lengths else range(1, longest + 1)
    for short in held:
        for long in held:
            if not short <= long <= math.floor(short / least + 1e-9):
                continue
            k = math.floor((1 - least) * long + 1e-9)
            more = long - short
            for i in range(k + 1):
                at, past = 1 + short * i // (k + 1), 1 + short * (i + 1) // (k + 1)
                low, high = max(1, at - (k - more) // 2), min(long - (past - at) + 1, at + (k + more) // 2)
                if low <= high:
                    out.append((short, long, i, at, past - at, low, high))
    return out


def similar_name_pairs(names: DataFrame, least: float) -> DataFrame:
    """Unordered pairs (name < alt_name) with edit similarity of at least ``least``, each once.

    Short names of the letters a to z meet by what deletions leave of them (see
    ``deletions``), all others by segments.
    """
    own, plain, odd = _plain_and_odd(names)
    if own.isEmpty():
        return own.select("name", F.col("name").alias("alt_name"), F.lit(0.0).alias("similarity")).limit(0)
    out = _by_rests(plain.where(F.length("name") <= deletions.LONGEST), least).unionByName(_by_all_pairs(plain, least))
    return out if odd.isEmpty() else out.unionByName(_odd_pairs(plain, odd, least))


def _plain_and_odd(names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All names, those of a to z that ``deletions`` takes, and the others."""
    own = _kept(names.select("name").where(F.length("name") > 0).distinct())
    marked = own.withColumn("plain", F.col("name").rlike(f"^[a-z]{{1,{deletions.WIDEST}}}$"))
    return own, marked.where("plain").select("name"), marked.where("not plain").select("name")


def _odd_pairs(plain: DataFrame, odd: DataFrame, least: float) -> DataFrame:
    lengths = {r[0]: r[1] for r in plain.select(F.length("name"), F.lit(False)).union(odd.select(F.length("name"), F.lit(True))).distinct().collect()}
    rows = segments(least, max(lengths), set(lengths))
    some = _by_segments(odd, plain, rows, least).unionByName(_by_segments(plain, odd, rows, least)).unionByName(_by_segments(odd, odd, rows, least))
    return some.distinct()


FOUND = pa.schema([("name", pa.string()), ("alt_name", pa.string()), ("similarity", pa.float64())])


def _listed(pairs):
    """Batches of (name, alt_name, similarity), name < alt_name, of pairs in words (see ``deletions.words``)."""
    for a, a_more, b, b_more, similarity in pairs:
        swap = (a > b) | ((a == b) & (a_more > b_more))
        low, low_more, high, high_more = np.where(swap, b, a), np.where(swap, b_more, a_more), np.where(swap, a, b), np.where(swap, a_more, b_more)
        yield pa.RecordBatch.from_arrays([deletions.text(low, low_more), deletions.text(high, high_more), pa.array(similarity, pa.float64())], schema=FOUND)


def _first_ones(k: int, without: np.ndarray):
    """Batches of (name, alt_name, similarity), both ways, of the ``k`` first partners that each name has among a task's pairs."""

    def out(pairs):
        chosen = deletions.Chosen(k, without)
        for pair in pairs:
            chosen.add(*pair)
        for columns in chosen.rows():
            yield pa.RecordBatch.from_arrays(list(columns), schema=FOUND)

    return out


def _by_all_pairs(plain: DataFrame, least: float, block: int = 2_000, upper: float = 1.0, out=_listed, tasks: int | None = None) -> DataFrame:
    """Pairs alike of names of a to z whose longer one is too long for ``_by_rests``.

    Blocks of names of one length meet without a shuffle, each as one row of bytes.
    """
    rest = [n for n in range(1, deletions.WIDEST + 1) if n not in deletions.lengths(least) and deletions.edits(least, n)]

    def pack(batches):
        schema = pa.schema([("size", pa.int32()), ("cells", pa.binary())])
        by: dict[int, list[str]] = {}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                by.setdefault(len(x), []).append(x)
        for n, names in by.items():
            for at in range(0, len(names), block):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([deletions.cells_of(names[at : at + block]).tobytes()], pa.binary())], schema=schema)

    def pairs(batches):
        for batch in batches:
            for n, long, m, short in zip(*(batch.column(c) for c in range(4))):
                n, m = n.as_py(), m.as_py()
                (p, own), (q, other) = (deletions.read(x.as_py()) for x in (long, short))
                for a, b, d in deletions.all_pairs(p, q, n, m, least, upper, known=(own, other)):
                    four = [*deletions.words(a), *deletions.words(b)]
                    # all names of one length meet both ways
                    once = np.full(len(d), True) if m < n else (four[0] < four[2]) | ((four[0] == four[2]) & (four[1] < four[3]))
                    if once.any():
                        yield *(x[once] for x in four), 1 - d[once] / n

    n = plain.count()
    blocks = _kept(plain.repartition(max(1, -(-n // (16 * block))), F.length("name"), F.pmod(F.xxhash64("name"), F.lit(max(1, n // block)))).mapInArrow(pack, "size int, cells binary"))
    k = max(1, min(blocks.count(), 6 + n // 1_000_000))
    long = _kept(blocks.where(F.col("size").isin(rest)).repartition(k))
    short = _kept(blocks.select(F.col("size").alias("short_size"), F.col("cells").alias("short_cells")).repartition(k))
    met = long.hint("shuffle_replicate_nl").join(short, (F.col("short_size") <= F.col("size")) & (F.col("short_size") >= F.lit(least) * F.col("size") - 1e-9))
    met = met.coalesce(max(tasks, k)) if tasks else met
    return met.mapInArrow(lambda batches: out(pairs(batches)), "name string, alt_name string, similarity double")


def _by_rests(plain: DataFrame, least: float, rows: int = 1_000_000, upper: float = 1.0, out=_listed) -> DataFrame:
    """Pairs alike of names of a to z whose longer one has one of the lengths of ``deletions``.

    Rests are dealt by a hash, as blocks of bytes; a task lists all pairs that meet under its
    rests and keeps those under their largest common one, so no pairs are shuffled.
    """
    sizes = {r["n"]: r["m"] for r in plain.groupBy(F.length("name").alias("n")).agg(F.count("*").alias("m")).collect()}
    parts = max(1, -(-sum(m * deletions.rests_of(n, least) for n, m in sizes.items()) // rows))
    parts = max(parts, min(2 * plain.sparkSession.sparkContext.defaultParallelism, sum(sizes.values()) // 1000 + 1))
    dealt = pa.schema([("part", pa.int32()), ("rests", pa.binary())])

    def deal(batches):
        for batch in batches:
            some = [r for r in deletions.rests(deletions.packed(batch.column(0).to_pylist()), least)]
            if not some:
                continue
            keys, names = (np.concatenate(x) for x in zip(*some))
            part = deletions.dealt(keys, parts)
            order = np.argsort(part, kind="stable")
            both = np.stack([keys[order], names[order]], axis=1)
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            own = np.flatnonzero(cut[1:] > cut[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([both[cut[p] : cut[p + 1]].tobytes() for p in own.tolist()], pa.binary())], schema=dealt)

    def pairs(batches):
        blocks = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for batch in batches for x in batch.column(1).to_pylist()]
        if not blocks:
            return
        both = np.concatenate(blocks)
        del blocks
        for a, b, d, n in deletions.meet(both[:, 0], both[:, 1], least, upper=upper):
            if len(a):
                none = np.zeros(len(a), dtype=np.uint64)
                yield a, none, b, none, 1 - d / n

    dealt_rows = plain.mapInArrow(deal, "part int, rests binary").repartition(parts, "part")
    return dealt_rows.mapInArrow(lambda batches: out(pairs(batches)), "name string, alt_name string, similarity double")


def _by_segments(left: DataFrame, right: DataFrame, rows: list[tuple], least: float) -> DataFrame:
    """Pairs alike of a shorter name of ``left`` and a longer one of ``right``, with lengths of ``rows`` (see ``segments``).

    Candidates come from an equi-join on a segment of the shorter name that the edits must
    leave whole, its number, and both lengths; the longer name offers its letters at the few
    places where that segment can be. The edit distance decides.
    """
    parts = left.sparkSession.createDataFrame(rows, "shorter int, longer int, segment int, place int, size int, first int, last int")
    piece = F.expr("substring(name, place, size)").alias("piece")
    held = left.join(F.broadcast(parts), F.length("name") == F.col("shorter")).select("shorter", "longer", "segment", piece, F.col("name").alias("a"))
    spread = right.join(F.broadcast(parts), F.length("name") == F.col("longer")).select("shorter", "longer", "segment", "size", "name", F.explode(F.sequence("first", "last")).alias("place"))
    offered = spread.select("shorter", "longer", "segment", piece, F.col("name").alias("b")).distinct()
    met = held.join(offered, ["shorter", "longer", "segment", "piece"]).where((F.col("a") != F.col("b")) & ((F.col("shorter") < F.col("longer")) | (F.col("a") < F.col("b"))))
    near = met.where(levenshtein_at_least(F.col("a"), F.col("b"), least)).select(F.least("a", "b").alias("name"), F.greatest("a", "b").alias("alt_name")).distinct()
    return near.select("name", "alt_name", levenshtein_similarity(F.col("name"), F.col("alt_name")).alias("similarity"))


def near_negatives(names: DataFrame, positives: DataFrame, lower: float, upper: float, k: int, most: int = 1_000_000) -> DataFrame:
    """Per name up to ``k`` names alike within a band and attached in neither order, chosen by hash.

    Attached pairs are few once they must be alike too. Up to ``most`` of them, all tasks know
    them, so each task of the search leaves the first ``k`` of a name only; beyond that,
    all pairs found are joined with them.
    """
    alike = positives.where(levenshtein_at_least(F.col("tree_name"), F.col("record_name"), lower)).select("tree_name", "record_name")
    both = alike.select(F.inline(F.array(F.struct(F.col("tree_name").alias("name"), F.col("record_name").alias("alt_name")), F.struct(F.col("record_name").alias("name"), F.col("tree_name").alias("alt_name")))))
    both = _kept(both.distinct())
    own, plain, odd = _plain_and_odd(names)
    short, few = plain.where(F.length("name") <= deletions.LONGEST), both.count() <= most
    out = _first_ones(k, _words_of_pairs(both)) if few else _listed
    # the more pairs a task sees, the fewer it leaves
    tasks = 2 * names.sparkSession.sparkContext.defaultParallelism if few else None
    found = _by_rests(short, lower, 2_500_000, upper, out).unionByName(_by_all_pairs(plain, lower, upper=upper, out=out, tasks=tasks))
    rest = None if few else found
    if not odd.isEmpty():
        more = _odd_pairs(plain, odd, lower).where(F.col("similarity") <= upper + 1e-12)
        rest = more if rest is None else rest.unionByName(more)
    if rest is not None:
        ways = rest.select(F.inline(F.array(F.struct("name", "alt_name", "similarity"), F.struct(F.col("alt_name").alias("name"), F.col("name").alias("alt_name"), "similarity"))))
        rest = ways.join(both, ["name", "alt_name"], "left_anti")
        found = found.unionByName(rest) if few else rest
    order = W.partitionBy("name").orderBy(F.md5(F.concat_ws(",", "name", "alt_name")), "alt_name")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("name", "alt_name", "similarity")


def _words_of_pairs(pairs: DataFrame) -> np.ndarray:
    """Four words a row of the pairs of names of a to z that ``deletions`` takes."""
    plain = f"^[a-z]{{1,{deletions.WIDEST}}}$"
    rows = pairs.where(F.col("name").rlike(plain) & F.col("alt_name").rlike(plain)).toArrow()
    sides = [deletions.words(deletions.cells_of(rows.column(c).to_pylist())) for c in range(2)]
    return deletions.Chosen.table(np.stack([*sides[0], *sides[1]], axis=1))


def learner_votes(learners: list[DataFrame], least: int = 3) -> DataFrame:
    """Pairs that at least ``least`` learners propose, with their votes less one."""
    every = None
    for k, one in enumerate(learners):
        rows = one.select("name", "alt_name").distinct()
        every = rows if every is None else every.union(rows)
    return every.groupBy("name", "alt_name").agg(F.count("*").alias("votes")).where(F.col("votes") >= least).select("name", "alt_name", (F.col("votes") - 1).alias("votes"))


def merge_augmented(attached: DataFrame, votes: DataFrame, times: int = 8) -> DataFrame:
    """Original frequencies times ``times`` plus votes."""
    original = attached.select("tree_name", "record_name", (F.col("frequency") * times).alias("frequency"))
    return original.unionByName(votes.select(F.col("name").alias("tree_name"), F.col("alt_name").alias("record_name"), F.col("votes").alias("frequency"))).groupBy("tree_name", "record_name").agg(F.sum("frequency").alias("frequency"))


def cooccurrence_scores(attached: DataFrame, smooth: float = 20.0, lift: float = 0.38) -> DataFrame:
    """Totals of either side, raw ratios and the smoothed score of attached names."""
    t = F.sum("frequency").over(W.partitionBy("tree_name"))
    r = F.sum("frequency").over(W.partitionBy("record_name"))
    out = attached.withColumns({"tree_total": t, "record_total": r})
    f = F.col("frequency")
    return out.withColumns({"tree_ratio": f / F.col("tree_total"), "record_ratio": f / F.col("record_total"), "score": smoothed_score(f, F.col("tree_total"), F.col("record_total"), smooth, lift)})


def triplets(scored: DataFrame, least: float = 0.5, per_anchor: int = 2000) -> DataFrame:
    """anchor, positive, negative with scores, from unordered pairs of an anchor's names.

    The larger score must reach ``least``; of equal scores the smaller name is positive.
    At most ``per_anchor`` rows of an anchor are kept, by score, then names.
    """
    s = scored.select(F.col("tree_name").alias("anchor"), F.col("record_name").alias("n"), "score")
    o = s.select("anchor", F.col("n").alias("m"), F.col("score").alias("m_score"))
    both = s.join(o, "anchor").where((F.col("n") < F.col("m")) & (F.greatest("score", "m_score") >= least))
    first = F.col("score") >= F.col("m_score")
    out = both.select(
        "anchor", F.when(first, F.col("n")).otherwise(F.col("m")).alias("positive"), F.greatest("score", "m_score").alias("positive_score"),
        F.when(first, F.col("m")).otherwise(F.col("n")).alias("negative"), F.least("score", "m_score").alias("negative_score"),
    )
    order = W.partitionBy("anchor").orderBy(F.desc(F.round("positive_score", 9)), "positive", "negative")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_anchor).drop("r")


def stratified_sample(scored: DataFrame, per_bucket: int = 40) -> DataFrame:
    """Up to ``per_bucket`` rows of each tenth of the score, by a hash of the pair."""
    tenth = F.floor(F.col("score") * 10 + 1e-9)
    order = W.partitionBy("tenth").orderBy(F.md5(F.concat_ws(",", "tree_name", "record_name")), "tree_name", "record_name")
    return scored.withColumn("tenth", tenth).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_bucket).select("tree_name", "record_name", "score", "tenth")


def bucket_pairs(buckets: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of distinct names of one bucket (head, name), once each."""
    b = buckets if allowed is None else buckets.join(allowed, "name", "left_semi")
    return b.join(b.select("head", F.col("name").alias("name2")), "head").where("name != name2").select(F.col("name").alias("name1"), "name2").distinct()


def cross_except(left: DataFrame, right: DataFrame, exclude: DataFrame) -> DataFrame:
    """All pairs of two bounded lists of names (each a top-k) without equal names and excluded pairs in either order."""
    both = exclude.select("name1", "name2").union(exclude.select("name2", "name1")).distinct()
    pairs = left.select(F.col("name").alias("name1")).join(right.select(F.col("name").alias("name2")), F.col("name1") != F.col("name2"))
    return pairs.join(both, ["name1", "name2"], "left_anti")


def easy_negatives(triples: DataFrame, common: DataFrame, per_pair: int = 5) -> DataFrame:
    """For every (anchor, positive) ``per_pair`` names picked by hash from a ranked list (name, rank from 1), score 0, none of them the anchor or the positive."""
    n = common.count()
    pairs = triples.select("anchor", "positive").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_pair))))
    pick = (F.conv(F.substring(F.md5(F.concat_ws(",", "anchor", "positive", F.col("k").cast("string"))), 1, 6), 16, 10).cast("long") % n) + 1
    return pairs.withColumn("rank", pick).join(common.select(F.col("name").alias("negative"), "rank"), "rank").where("negative != anchor and negative != positive").select("anchor", "positive", "negative", F.lit(0.0).alias("negative_score")).distinct()


def replicate(counted: DataFrame, divide: int = 2) -> DataFrame:
    """Each name floor(frequency / ``divide``) times, numbered."""
    times = F.floor(F.col("frequency") / divide).cast("int")
    return counted.where(times > 0).select("name", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def margin_rows(triples: DataFrame) -> DataFrame:
    return triples.select("anchor", "positive", "negative", (F.col("positive_score") - F.col("negative_score")).alias("target"))


def symmetric_examples(triples: DataFrame) -> DataFrame:
    """name1, name2, score: positives and negatives both ways, and every name with itself at 1."""
    p = triples.select(F.col("anchor").alias("name1"), F.col("positive").alias("name2"), F.col("positive_score").alias("score")).union(triples.select("anchor", "negative", "negative_score"))
    names = p.select(F.explode(F.array("name1", "name2")).alias("name1")).distinct()
    return p.union(p.select("name2", "name1", "score")).union(names.select("name1", F.col("name1").alias("name2"), F.lit(1.0))).distinct()


def weighted_draw(ranked: DataFrame, draws: int, width: int = 1024) -> DataFrame:
    """``draws`` names drawn with odds log10(frequency), at hash-uniform places of the running total.

    Totals run over buckets of ``width`` ranks first, so no task orders all names; a draw
    finds its bucket among these few, then its name in the bucket.
    """
    w = F.log10("frequency")
    weighted = ranked.withColumn("w", w).where("w > 0").withColumn("bucket", F.floor((F.col("rank") - 1) / width))
    order = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = weighted.groupBy("bucket").agg(F.sum("w").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(order), F.lit(0.0)))
    total = buckets.agg(F.sum("s").alias("total"))
    at = ranked.sparkSession.range(1, draws + 1).join(F.broadcast(total), F.lit(True)).select(F.col("id").alias("draw"), (hash_unit(F.col("id").cast("string")) * F.col("total")).alias("u"))
    placed = buckets.join(F.broadcast(at), (F.col("u") >= F.col("before")) & (F.col("u") < F.col("before") + F.col("s"))).select("draw", "bucket", (F.col("u") - F.col("before")).alias("u"))
    inner = weighted.withColumn("high", F.sum("w").over(W.partitionBy("bucket").orderBy("rank"))).withColumn("low", F.col("high") - F.col("w"))
    return placed.join(inner, "bucket").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("draw", "name")


def every_nth(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where((F.col("rank") - 1) % n == 0)


def down_sample(labelled: DataFrame, multiplier: float = 2.0, key: str = "key") -> DataFrame:
    """All positives (label 1) and negatives by hash, about ``multiplier`` times as many."""
    c = labelled.agg(F.sum("label").alias("p"), F.count("*").alias("n")).head()
    rate = multiplier * (c["p"] or 0) / max(1, (c["n"] or 0) - (c["p"] or 0))
    return labelled.where((F.col("label") == 1) | (hash_unit(F.col(key).cast("string")) <= rate))
