"""Pair statistics, filters and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import levenshtein_similarity


def count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("name", "alt_name").agg(F.count("*").alias("frequency"))


def name_totals(counted: DataFrame) -> DataFrame:
    """name, total: frequency as either side of a pair, by one aggregation over both sides."""
    sides = counted.select(F.explode(F.array("name", "alt_name")).alias("name"), "frequency")
    return sides.groupBy("name").agg(F.sum("frequency").alias("total"))


def pair_statistics(counted: DataFrame) -> DataFrame:
    """Frequencies both ways, totals, probabilities and edit similarity of counted pairs.

    The reverse frequency comes from one aggregation over unordered pairs instead of a
    self-join: both orders of a pair meet in one group and are told apart afterwards.
    """
    low, high = F.least("name", "alt_name"), F.greatest("name", "alt_name")
    meet = counted.groupBy(low.alias("low"), high.alias("high")).agg(
        F.sum(F.when(F.col("name") == low, F.col("frequency")).otherwise(0)).alias("forth"), F.sum(F.when(F.col("name") != low, F.col("frequency")).otherwise(0)).alias("back")
    )
    both = meet.select(F.inline(F.array(F.struct(F.col("low").alias("name"), F.col("high").alias("alt_name"), F.col("forth").alias("frequency"), F.col("back").alias("reverse_frequency")), F.struct(F.col("high").alias("name"), F.col("low").alias("alt_name"), F.col("back").alias("frequency"), F.col("forth").alias("reverse_frequency")))))
    both = both.where("frequency > 0")
    as_name = counted.groupBy("name").agg(F.sum("frequency").alias("s"))
    as_alt = counted.groupBy(F.col("alt_name").alias("name")).agg(F.sum("frequency").alias("t"))
    totals = as_name.join(as_alt, "name", "full_outer").select("name", F.coalesce("s", F.lit(0)).alias("sum_name_frequency"), (F.coalesce("s", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("total"))
    out = both.join(totals.withColumnRenamed("total", "total_name_frequency"), "name")
    out = out.join(totals.select(F.col("name").alias("alt_name"), F.col("total").alias("total_alt_name_frequency")), "alt_name")
    together = F.col("frequency") + F.col("reverse_frequency")
    return out.select(
        "name", "alt_name", "frequency", "reverse_frequency", "sum_name_frequency", "total_name_frequency", "total_alt_name_frequency",
        (F.col("frequency") / F.col("sum_name_frequency")).alias("ordered_prob"),
        (together / (F.col("total_name_frequency") + F.col("total_alt_name_frequency") - together)).alias("unordered_prob"),
        levenshtein_similarity(F.col("name"), F.col("alt_name")).alias("similarity"),
    )


def similar_pairs(stats: DataFrame, least: float = 0.4, more_than: int = 1) -> DataFrame:
    return stats.where((F.col("similarity") > least) & (F.col("frequency") > more_than))


def drop_noisy(stats: DataFrame, min_frequency: int = 5, similarity: float = 0.55, ordered_prob: float = 0.08) -> DataFrame:
    return stats.where(~((F.col("similarity") < similarity) & ((F.col("frequency") < min_frequency) | (F.col("ordered_prob") < ordered_prob))))


def dissimilar_pairs(stats: DataFrame, most: float = 0.4, least_frequency: int = 1000) -> DataFrame:
    return stats.where((F.col("similarity") <= most) & (F.col("frequency") + F.col("reverse_frequency") >= least_frequency))


def drop_bad_pairs(pairs: DataFrame, bad: DataFrame, left: str = "tree_name", right: str = "record_name") -> DataFrame:
    """Pairs whose names are no bad pair in either order."""
    both = bad.select(F.col("name1").alias(left), F.col("name2").alias(right)).union(bad.select("name2", "name1")).distinct()
    return pairs.join(both, [left, right], "left_anti")


def two_sided_counts(attached: DataFrame) -> DataFrame:
    """name, frequency summed over both sides of attached names."""
    return attached.select(F.explode(F.array("tree_name", "record_name")).alias("name"), "frequency").groupBy("name").agg(F.sum("frequency").alias("frequency"))


def most_frequent(counted: DataFrame, k: int | float) -> DataFrame:
    """The k most frequent names, or that share of all names, ties by name."""
    order = [F.desc("frequency"), F.col("name")]
    if isinstance(k, float):  # a share may be most of the names: ranked in parts, not sorted in one place
        from ..sources.tables import ranked

        r = ranked(counted)
        return r.join(F.broadcast(r.agg(F.floor(F.max("rank") * k).alias("k"))), F.col("rank") <= F.col("k")).select("name", "frequency")
    return counted.orderBy(*order).limit(k)


def frequency_split(attached: DataFrame, preferred: DataFrame, train_share: float = 0.45) -> DataFrame:
    """Pairs with ``side``: train where both names are among the most frequent, test otherwise.

    Names of the pairs are ranked by preferred frequency (0 where unknown), then name.
    """
    names = attached.select(F.explode(F.array("tree_name", "record_name")).alias("name")).distinct()
    known = names.join(preferred.select("name", "frequency"), "name", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    frequent = most_frequent(known, float(train_share)).select("name")
    flags = attached.join(frequent.select(F.col("name").alias("tree_name"), F.lit(1).alias("a")), "tree_name", "left").join(frequent.select(F.col("name").alias("record_name"), F.lit(1).alias("b")), "record_name", "left")
    return flags.select("tree_name", "record_name", "frequency", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "train").otherwise("test").alias("side"))


def attached_lists(attached: DataFrame, with_self: bool = False) -> DataFrame:
    """tree_name with its record names, most frequent first; with_self adds a missing own name with frequency 0."""
    rows = attached.select("tree_name", "record_name", "frequency")
    if with_self:
        own = rows.groupBy("tree_name").agg(F.max(F.col("tree_name") == F.col("record_name")).alias("has")).where("not has")
        rows = rows.unionByName(own.select("tree_name", F.col("tree_name").alias("record_name"), F.lit(0).cast("long").alias("frequency")))
    item = F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "record_name")))
    return rows.groupBy("tree_name").agg(item.alias("l")).select("tree_name", F.transform("l", lambda x: F.struct(x["record_name"].alias("record_name"), (-x["f"]).alias("frequency"))).alias("attached"))


def filter_dataset(attached: DataFrame, names: DataFrame, both: bool = True) -> DataFrame:
    out = attached.join(names.select(F.col("name").alias("tree_name")), "tree_name", "left_semi")
    return out.join(names.select(F.col("name").alias("record_name")), "record_name", "left_semi") if both else out


def hash_unit(c, salt: str = "") -> F.Column:
    """A number in [0, 1) from the first six hexadecimal digits of an md5 sum, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(c, F.lit(salt)).cast("binary")), 1, 6), 16, 10).cast("double") / 16777216.0


def name_disjoint_split(attached: DataFrame, train_share: float = 0.7) -> DataFrame:
    """Pairs with ``side``, by a hash of each name; pairs across the sides are dropped."""
    a, b = hash_unit(F.col("tree_name")) < train_share, hash_unit(F.col("record_name")) < train_share
    return attached.where(a == b).select("tree_name", "record_name", "frequency", F.when(a, "train").otherwise("test").alias("side"))


def row_split(attached: DataFrame, train_share: float = 0.9) -> DataFrame:
    """Rows split by a hash of the pair; test rows whose record name is also in train move to train."""
    drawn = attached.withColumn("t", hash_unit(F.concat_ws(",", "tree_name", "record_name")) < train_share)
    seen = drawn.groupBy("record_name").agg(F.max("t").alias("in_train"))
    return drawn.join(seen, "record_name").select("tree_name", "record_name", "frequency", F.when(F.col("in_train"), "train").otherwise("test").alias("side"))


def drop_frequent_dissimilar(attached: DataFrame, frequent: DataFrame, most: float = 0.65) -> DataFrame:
    """Drops pairs of two frequent names that are not alike."""
    a = frequent.select(F.col("name").alias("tree_name"), F.lit(1).alias("fa"))
    b = frequent.select(F.col("name").alias("record_name"), F.lit(1).alias("fb"))
    flagged = attached.join(a, "tree_name", "left").join(b, "record_name", "left")
    bad = F.col("fa").isNotNull() & F.col("fb").isNotNull() & (levenshtein_similarity(F.col("tree_name"), F.col("record_name")) <= most)
    return flagged.where(~bad).select("tree_name", "record_name", "frequency")


def orient(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """Swaps a pair when only its record name is a known tree name (set-based: the known names do not grow on the way)."""
    known = trees.select("tree_name").distinct()
    f = pairs.join(known.select("tree_name", F.lit(1).alias("kt")), "tree_name", "left").join(known.select(F.col("tree_name").alias("record_name"), F.lit(1).alias("kr")), "record_name", "left")
    swap = F.col("kt").isNull() & F.col("kr").isNotNull()
    return f.select(F.when(swap, F.col("record_name")).otherwise(F.col("tree_name")).alias("tree_name"), F.when(swap, F.col("tree_name")).otherwise(F.col("record_name")).alias("record_name"), "frequency")


def self_frequent(attached: DataFrame) -> DataFrame:
    """Tree names that are at least as often themselves as anything else."""
    top = F.max("frequency").over(W.partitionBy("tree_name"))
    return attached.withColumn("top", top).where((F.col("tree_name") == F.col("record_name")) & (F.col("frequency") >= F.col("top"))).select("tree_name", "frequency")


def unknown_share(attached: DataFrame, known: DataFrame) -> DataFrame:
    """Attached names outside a vocabulary, with weights that sum to one per tree name."""
    rest = attached.join(known.select(F.col("name").alias("record_name")), "record_name", "left_anti")
    return rest.select("tree_name", "record_name", (F.col("frequency") / F.sum("frequency").over(W.partitionBy("tree_name"))).alias("weight"))


def frequency_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of two frequency maps with both frequencies, their total and the first one's ratio."""
    both = a.select("name", F.col("frequency").alias("given_freq")).join(b.select("name", F.col("frequency").alias("surname_freq")), "name", "full_outer")
    both = both.select("name", F.coalesce("given_freq", F.lit(0)).alias("given_freq"), F.coalesce("surname_freq", F.lit(0)).alias("surname_freq"))
    return both.withColumn("total_freq", F.col("given_freq") + F.col("surname_freq")).withColumn("given_ratio", F.col("given_freq") / F.col("total_freq"))
