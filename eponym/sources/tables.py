"""Relations that the queries start from, read from a folder of parquet tables.

``tokens``: latin words of documents with their places. ``pairs``: neighbouring tokens
that differ, which stand for matched name pairs. ``preferred``: token frequencies above
one with their rank. ``attached``: pairs with their frequency. ``co_purchase``: brands and
part types bought together, a dense co-occurrence table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: F.length(x) > 1)


def word_lists(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, folder, name).select(F.col(key), words_of(F.col("text")).alias("words"))


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, pos (from 1), token."""
    return word_lists(spark, folder).select("doc_id", F.posexplode("words").alias("p", "token")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "token")


def neighbours(words) -> F.Column:
    """Neighbouring words that differ, as structs of name and alt_name."""
    n = F.size(words)
    both = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("name"), b.alias("alt_name"))))
    return F.filter(both, lambda p: p["name"] != p["alt_name"])


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """name, alt_name: one row per occurrence."""
    return word_lists(spark, folder).select(F.inline(neighbours(F.col("words"))))


def bad_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring words of benchmark texts, in both orders, each once."""
    found = word_lists(spark, folder, "benchmark", "item_id").select(F.inline(neighbours(F.col("words"))))
    return found.union(found.select("alt_name", "name")).distinct().toDF("name1", "name2")


def preferred(spark: SparkSession, folder: str) -> DataFrame:
    """name, frequency (above one), rank by frequency, then name.

    The rank needs one order over all names: frequencies are counted first, so it sorts
    distinct names only.
    """
    return ranked(frequent(spark, folder))


def frequent(spark: SparkSession, folder: str) -> DataFrame:
    """name, frequency of ``preferred``, for what needs no rank."""
    return tokens(spark, folder).groupBy(F.col("token").alias("name")).agg(F.count("*").alias("frequency")).where("frequency > 1")


def ranked(counted: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds ``rank`` by (frequency desc, name) without sorting all names in one task.

    Names are ranked within each frequency and shifted by the number of names with a
    higher one, which only needs the table of frequencies in one place; within one
    frequency the first two letters split the names further.
    """
    part = F.substring("name", 1, 2)
    keyed = counted.withColumn("__p", part)
    sizes = keyed.groupBy("frequency", "__p").agg(F.count("*").alias("__m"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__m").over(W.orderBy(F.desc("frequency"), "__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    inner = F.row_number().over(W.partitionBy("frequency", "__p").orderBy("name"))
    return keyed.withColumn("__i", inner).join(before, ["frequency", "__p"]).select("name", "frequency", (F.col("__before") + F.col("__i")).cast("long").alias("rank"))


def attached(spark: SparkSession, folder: str) -> DataFrame:
    """tree_name, record_name, frequency."""
    return pairs(spark, folder).groupBy(F.col("name").alias("tree_name"), F.col("alt_name").alias("record_name")).agg(F.count("*").alias("frequency"))


def co_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """tree_name (brand), record_name (part type), frequency of joint order lines."""
    items, part = table(spark, folder, "lineitem").select("l_partkey"), table(spark, folder, "part")
    bought = items.groupBy("l_partkey").agg(F.count("*").alias("c"))
    return bought.join(part, bought.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("tree_name"), F.col("p_type").alias("record_name")).agg(F.sum("c").alias("frequency"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """name (vec_id), label, vector."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("name"), "label", F.col("embedding").alias("vector"))


def vec_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("name", "label")
