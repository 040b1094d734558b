"""Evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def precision_recall_at_k(actuals: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """k, precision, recall, averaged over all names with actuals.

    ``actuals`` (name, candidate) each once; ``ranked`` (name, candidate, rank). Hits are
    counted per (name, rank) once and accumulated over k.
    """
    a = actuals.groupBy("name").agg(F.count("*").alias("n_actual"))
    c = ranked.groupBy("name").agg(F.count("*").alias("n_candidates"))
    hits = ranked.join(actuals, ["name", "candidate"], "left_semi").select("name", F.col("rank").alias("hit_rank"))
    ks = actuals.sparkSession.range(1, most + 1).withColumnRenamed("id", "k")
    base = a.join(c, "name", "left").join(F.broadcast(ks), F.lit(True))
    found = base.join(hits, "name", "left").groupBy("name", "k", "n_actual", "n_candidates").agg(F.sum(F.when(F.col("hit_rank") <= F.col("k"), 1).otherwise(0)).alias("h"))
    size = F.least(F.col("k"), F.coalesce("n_candidates", F.lit(0)))
    return found.groupBy("k").agg(F.avg(F.when(size == 0, F.lit(0.0)).otherwise(F.col("h") / size)).alias("precision"), F.avg(F.col("h") / F.col("n_actual")).alias("recall"))


def threshold_curve(actuals: DataFrame, scored: DataFrame, thresholds: list[float], distances: bool = False) -> DataFrame:
    """threshold, precision, recall: macro means of precision and frequency-weighted recall.

    ``actuals`` (name, candidate, frequency); ``scored`` (name, candidate, score). Without
    a match precision is 1; without anything to recall, recall is 1. Thresholds are a
    small table; candidates meet them only in conditional sums.
    """
    total = actuals.groupBy("name").agg(F.sum("frequency").alias("total"))
    best = F.min("score") if distances else F.max("score")
    s = scored.groupBy("name", "candidate").agg(best.alias("score")).join(actuals, ["name", "candidate"], "left")
    return judged_curve(total, s, thresholds, distances)


def judged_curve(total: DataFrame, judged: DataFrame, thresholds: list[float], distances: bool = False) -> DataFrame:
    """``threshold_curve`` where actuals are too many to list: ``total`` (name, total) of their frequencies,
    ``judged`` (name, candidate, score, frequency), each once, with the frequency null where a candidate is none of them."""
    t = total.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    s = total.select("name", "total").join(judged, "name", "left").join(F.broadcast(t), F.lit(True))
    over = (F.col("score") <= F.col("threshold")) if distances else (F.col("score") >= F.col("threshold"))
    per = s.groupBy("threshold", "name", "total").agg(
        F.sum(F.when(over, 1).otherwise(0)).alias("n"), F.sum(F.when(over & F.col("frequency").isNotNull(), 1).otherwise(0)).alias("hit"), F.sum(F.when(over, F.coalesce("frequency", F.lit(0))).otherwise(0)).alias("got")
    )
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("hit") / F.col("n"))
    r = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("got") / F.col("total"))
    return per.groupBy("threshold").agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"))


def validation_sweep(actuals: DataFrame, scored: DataFrame, sizes: list[int], thresholds: list[float], frequency: DataFrame, clusters: DataFrame | None = None, partitions: DataFrame | None = None) -> DataFrame:
    """size, threshold, precision, recall, f1, f2, partitions: the threshold curve over the ``size`` most frequent names (0: all).

    ``frequency`` is (name, frequency). With ``clusters`` (name, cluster, score) and
    ``partitions`` (cluster, start, n), also how many partitions a name looks up on average,
    each start once. Sizes and thresholds are parameters, one small plan for each size.
    """
    total = actuals.groupBy("name").agg(F.sum("frequency").alias("total"))
    judged = scored.groupBy("name", "candidate").agg(F.max("score").alias("score")).join(actuals, ["name", "candidate"], "left")
    return judged_sweep(total, judged, sizes, thresholds, frequency, clusters, partitions)


def judged_sweep(total: DataFrame, judged: DataFrame, sizes: list[int], thresholds: list[float], frequency: DataFrame, clusters: DataFrame | None = None, partitions: DataFrame | None = None) -> DataFrame:
    """``validation_sweep`` over totals and judged candidates (see ``judged_curve``)."""
    out = None
    for size in sizes:
        names = frequency.select("name") if not size else frequency.orderBy(F.desc("frequency"), "name").limit(size).select("name")
        own = total.join(names, "name", "left_semi")
        curve = judged_curve(own, judged.join(names, "name", "left_semi"), thresholds)
        if clusters is not None:
            t = total.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
            met = clusters.join(own.select("name"), "name", "left_semi").join(F.broadcast(t), F.col("score") >= F.col("threshold")).join(partitions, "cluster")
            looked = met.groupBy("threshold", "name", "start").agg(F.max("n").alias("n")).groupBy("threshold").agg(F.sum("n").alias("s"))
            curve = curve.join(F.broadcast(looked), "threshold", "left").withColumn("partitions", F.coalesce("s", F.lit(0)) / F.lit(float(max(1, own.count())))).drop("s")
        p, r = F.col("precision"), F.col("recall")
        curve = curve.withColumns({"f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), "f2": F.when(4 * p + r == 0, F.lit(0.0)).otherwise(5 * p * r / (4 * p + r)), "size": F.lit(size).cast("long")})
        out = curve if out is None else out.unionByName(curve)
    return out


def curve_area(precisions: list[float], recalls: list[float], distances: bool = False) -> float:
    """Area under a precision-recall curve given by ascending thresholds.

    Recall must grow along the curve: points that do not grow by more than 1e-4 are
    dropped. A point at recall 0 is put in front; fewer than two points have no area.
    """
    points = list(zip(precisions, recalls))
    if not distances:
        points.reverse()
    if len(points) < 2:
        return 0.0
    kept = [(points[0][0], 0.0)]
    for p, r in points:
        if r > kept[-1][1] + 1e-4:
            kept.append((p, r))
    area = sum((r2 - r1) * (p1 + p2) / 2 for (p1, r1), (p2, r2) in zip(kept, kept[1:]))
    if not -1e-9 <= area <= 1.0001:
        raise ValueError(f"area {area} is outside [0, 1]")
    return area


def area_of_curve(curve: DataFrame, distances: bool = False) -> DataFrame:
    """One row: the area of a threshold curve (one row per threshold)."""
    rows = curve.orderBy("threshold").collect()
    return curve.sparkSession.createDataFrame([(curve_area([r["precision"] for r in rows], [r["recall"] for r in rows], distances),)], "auc double")


def ndcg(relevant: DataFrame, predicted: DataFrame, k: int | None = None) -> DataFrame:
    """name, ndcg at ``k`` of ranked predictions against relevance scores.

    ``relevant`` (name, candidate, relevance), ``predicted`` (name, candidate, rank). The
    ideal order takes all relevance scores. k of 0, or more than a name's predictions,
    is an error.
    """
    if k is not None:
        short = predicted.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") < k).limit(1).count() if k > 0 else 1
        if short:
            raise ValueError(f"k={k} must be between 1 and the number of predictions")
    cap = F.lit(k) if k is not None else F.count("*").over(W.partitionBy("name"))
    p = predicted.withColumn("cap", cap)
    gain = p.where(F.col("rank") <= F.col("cap")).join(relevant, ["name", "candidate"], "left").groupBy("name").agg(F.sum(F.coalesce("relevance", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.max("cap").alias("cap"))
    order = W.partitionBy("name").orderBy(F.desc("relevance"), "candidate")
    ideal = relevant.withColumn("r", F.row_number().over(order)).join(gain.select("name", "cap"), "name").where(F.col("r") <= F.col("cap")).groupBy("name").agg(F.sum(F.col("relevance") / F.log2(F.col("r") + 1.0)).alias("idcg"))
    return gain.join(ideal, "name", "left").select("name", F.when(F.coalesce("idcg", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def index_query(attached: DataFrame, query: DataFrame, index: DataFrame, everywhere: DataFrame | None = None) -> DataFrame:
    """name, precision, recall of an index, without listing the names found.

    ``query`` (name, code) with all codes of a name, ``index`` (code, name) with one code
    per name. Precision is the name's own frequency over that of everything under its
    codes (over all names they were attached to, ``everywhere``); recall is its own
    frequency found over its own frequency. Both are 1 when there is nothing. As a
    candidate stands under one code, what a code holds is summed once per code, and own
    names meet on (name, code); the join never grows with the square of a code's names.
    """
    all_of = (attached if everywhere is None else everywhere).groupBy(F.col("record_name").alias("candidate")).agg(F.sum("frequency").alias("e"))
    place = index.select("code", F.col("name").alias("candidate"))
    held = place.join(all_of, "candidate").groupBy("code").agg(F.sum("e").alias("e"))
    got = query.distinct().join(held, "code").groupBy("name").agg(F.sum("e").alias("g"))
    own = attached.select(F.col("tree_name").alias("name"), F.col("record_name").alias("candidate"), "frequency")
    hit = own.join(place, "candidate").join(query.distinct(), ["name", "code"], "left_semi").groupBy("name").agg(F.sum("frequency").alias("h"))
    total = own.groupBy("name").agg(F.sum("frequency").alias("total"))
    j = total.join(got, "name", "left").join(hit, "name", "left")
    h = F.coalesce("h", F.lit(0))
    return j.select("name", F.when(F.coalesce("g", F.lit(0)) == 0, F.lit(1.0)).otherwise(h / F.col("g")).alias("precision"), F.when(F.col("total") == 0, F.lit(1.0)).otherwise(h / F.col("total")).alias("recall"))


def macro_scores(per_name: DataFrame) -> DataFrame:
    """precision, recall, f1, f2 of the averages."""
    a = per_name.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return a.select(p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"), F.when(4 * p + r == 0, F.lit(0.0)).otherwise(5 * p * r / (4 * p + r)).alias("f2"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """auc of (label, score): the share of positive-negative pairs in the right order, ties half.

    Scores are counted first, so the running sum is over distinct scores.
    """
    c = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    w = c.select("p", "n", below.alias("below"))
    total = F.sum("p") * F.sum("n")
    return w.agg(F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / total).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    c = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    w = W.orderBy(F.desc("score"))
    c = c.select("p", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("seen"))
    return c.agg(F.when(F.sum("p") == 0, F.lit(0.0)).otherwise(F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("average_precision"))


def rank_means(ranked: DataFrame, width: int) -> DataFrame:
    b = F.floor((F.col("rank") - 1) / width)
    return ranked.groupBy(b.alias("bin")).agg(F.avg("frequency").alias("mean_frequency"), F.count("*").alias("names"))


def cumulative_share(ranked: DataFrame, ranks: list[int]) -> DataFrame:
    """rank, share of all frequency held by names up to it, by conditional sums in one pass."""
    sums = [F.sum(F.when(F.col("rank") <= r, F.col("frequency")).otherwise(0)).alias(f"s{r}") for r in ranks]
    one = ranked.agg(F.sum("frequency").alias("total"), *sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).cast("long").alias("rank"), (F.col(f"s{r}") / F.col("total")).alias("share")) for r in ranks])))


def width_bins(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width histogram; the highest value belongs to the last bin."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins))).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(values: DataFrame) -> DataFrame:
    """Counts over floor(log10 frequency) and tenths of similarity."""
    x = F.floor(F.log10(F.col("frequency")) + 1e-9).cast("int")
    y = F.least(F.lit(9), F.floor(F.col("similarity") * 10 + 1e-9)).cast("int")
    return values.groupBy(x.alias("frequency_bin"), y.alias("similarity_bin")).agg(F.count("*").alias("n"))


def welch(values: DataFrame) -> DataFrame:
    """t statistic and degrees of freedom between groups 0 and 1 of (group, value), from moments."""
    m = values.groupBy().agg(*[f(F.when(F.col("group") == g, F.col("value"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return m.select(((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).alias("df"))


def mann_whitney(values: DataFrame) -> DataFrame:
    """u statistic of group 1 over group 0, ties half."""
    c = values.groupBy("value").agg(F.sum(F.when(F.col("group") == 1, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("group") == 0, 1.0).otherwise(0.0)).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return c.select("p", "n", below.alias("below")).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))


def distinct_codes(ranked: DataFrame, coders: dict, tops: list[int]) -> DataFrame:
    """coder, top, codes: distinct codes among the most frequent names; each name is coded once."""
    coded = ranked.select("rank", F.explode(F.array(*[F.struct(F.lit(n).alias("coder"), c.alias("code")) for n, c in coders.items()])).alias("x")).select("rank", "x.*")
    first = coded.groupBy("coder", "code").agg(F.min("rank").alias("first"))
    sums = first.groupBy("coder").agg(*[F.sum(F.when(F.col("first") <= t, 1).otherwise(0)).alias(f"t{t}") for t in tops])
    return sums.select("coder", F.inline(F.array(*[F.struct(F.lit(t).cast("long").alias("top"), F.col(f"t{t}").alias("codes")) for t in tops])))


def cooccurrence_cells(attached: DataFrame, symmetric: bool = True) -> DataFrame:
    """i, j, x: every pair adds its frequency at (tree, record) and (tree, tree), and when symmetric at (record, tree) and (record, record)."""
    t, r, f = F.col("tree_name"), F.col("record_name"), F.col("frequency").alias("x")
    cells = [F.struct(t.alias("i"), r.alias("j"), f), F.struct(t.alias("i"), t.alias("j"), f)]
    if symmetric:
        cells += [F.struct(r.alias("i"), t.alias("j"), f), F.struct(r.alias("i"), r.alias("j"), f)]
    return attached.select(F.inline(F.array(*cells))).groupBy("i", "j").agg(F.sum("x").alias("x"))


def marginals(cells: DataFrame) -> DataFrame:
    """i, log(1 + row sum)."""
    return cells.groupBy("i").agg(F.log(F.sum("x") + 1.0).alias("log_sum"))


def softmax(rows: DataFrame, key: str, value: str) -> DataFrame:
    w = W.partitionBy(key)
    z = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("z", z).withColumn("p", F.col("z") / F.sum("z").over(w)).drop("z")
