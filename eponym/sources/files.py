"""Readers and writers of the name files (inventory S1 to S5, S10 to S29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW_PAIRS = "name string, alt_name string"


def read_raw_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated pairs without header or quoting; empty fields stay empty strings."""
    return spark.read.schema(RAW_PAIRS).option("sep", "|").option("quote", "").option("nullValue", "\u0000").option("emptyValue", "").csv(path).fillna("")


def read_raw_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; malformed lines are dropped."""
    return spark.read.schema("name string").option("sep", "|").option("quote", "").option("mode", "DROPMALFORMED").option("nullValue", "\u0000").csv(path).fillna("")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; ``null``, ``na`` and the like stay strings, empty fields are empty."""
    return spark.read.option("header", True).option("nullValue", "\u0000").csv(path).fillna("")


def read_tsv(spark: SparkSession, path: str, schema: str = "name1 string, name2 string") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\u0000").csv(path).fillna("")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, frequency long").csv(path)


def read_parquet(spark: SparkSession, path: str, *columns: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def buckets_of_lines(lines: DataFrame) -> DataFrame:
    """head, name of lines ``head names : tail names``: every name of a line, under its first name."""
    parts = F.filter(F.split(F.regexp_replace("value", ":", " "), "\\s+"), lambda x: x != "")
    return lines.select(parts.alias("names")).where(F.size("names") > 0).select(F.col("names")[0].alias("head"), F.explode(F.array_distinct("names")).alias("name"))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return buckets_of_lines(spark.read.text(path))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.filter(F.transform(F.split("value", ","), F.trim), lambda x: x != "").alias("names")).where(F.size("names") > 0)


def nicknames_symmetric(lines: DataFrame, with_self: bool = True) -> DataFrame:
    """name, nickname: every name of a line with every name of it."""
    both = _fields(lines).select(F.explode("names").alias("name"), "names").select("name", F.explode("names").alias("nickname")).distinct()
    return both if with_self else both.where("name != nickname")


def nicknames_directed(lines: DataFrame, with_head: bool = True) -> DataFrame:
    """name, head: every name of a line with its first."""
    found = _fields(lines).select(F.explode("names").alias("name"), F.col("names")[0].alias("head")).distinct()
    return found if with_head else found.where("name != head")


def read_basenames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, basename string").option("sep", "|").csv(path)


def variants_of_rows(rows: DataFrame, separator: str = " ") -> DataFrame:
    """name, variant of rows (name, confirmed, computed), both lists of variants."""
    every = F.array_union(F.split("confirmed", separator), F.split("computed", separator))
    return rows.select("name", F.explode(F.filter(every, lambda x: x != "")).alias("variant")).distinct()


def query_terms(urls: DataFrame, column: str = "url") -> DataFrame:
    """key, value of the query part of urls; a plus sign is not decoded."""
    from ..functions.strings import unquote

    query = F.regexp_extract(F.replace(F.col(column), F.lit('"'), F.lit("")), "\\?([^#]*)", 1)
    term = urls.select("*", F.explode(F.split(query, "&")).alias("__t")).where(F.col("__t").contains("="))
    return term.select(*[c for c in urls.columns if c != column], F.regexp_extract("__t", "^([^=]*)=", 1).alias("key"), unquote(F.regexp_extract("__t", "^[^=]*=(.*)$", 1)).alias("value"))


def clusters_of_json(spark: SparkSession, path: str) -> DataFrame:
    """label, names, centroid of a JSON map of clusters."""
    text = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<names: array<string>, centroid: array<double>>>"
    return text.select(F.explode(F.from_json("value", kind)).alias("label", "c")).select("label", "c.names", "c.centroid")


def super_clusters_of_json(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("super_label", "clusters"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, embedding array<float>").json(path)


def read_cluster_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, clusters array<struct<id: string, score: double>>").json(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True, compression="gzip")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def weighted_actuals_lines(attached: DataFrame) -> DataFrame:
    """``name,alt|weight,...``: one line per name, weights as shares of its frequency."""
    total = F.sum("frequency").over(W.partitionBy("tree_name"))
    item = F.concat_ws("|", "record_name", F.round(F.col("frequency") / total, 6).cast("string"))
    items = attached.withColumn("item", F.struct(-F.col("frequency"), "record_name", item.alias("text")))
    return items.groupBy("tree_name").agg(F.sort_array(F.collect_list("item")).alias("l")).select(F.concat_ws(",", "tree_name", F.transform("l", lambda x: x["text"])).alias("value"))


def cluster_lines(clusters: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``label<tab>names``: the members of each cluster and their nicknames."""
    more = clusters.join(nicknames, "name").select("label", F.col("nickname").alias("name"))
    return clusters.select("label", "name").union(more).groupBy("label").agg(F.array_sort(F.collect_set("name")).alias("n")).select(F.concat_ws("\t", F.col("label").cast("string"), F.array_join("n", " ")).alias("value"))


def corpus_lines(attached: DataFrame) -> DataFrame:
    """``name alt alt ...`` per tree name, most frequent first."""
    item = F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "record_name")))
    return attached.groupBy("tree_name").agg(item.alias("l")).select(F.concat_ws(" ", "tree_name", F.transform("l", lambda x: x["record_name"])).alias("value"), (F.size("l") + 1).alias("n"))


def rounded_centroids(clusters: DataFrame, digits: int = 8) -> DataFrame:
    return clusters.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, digits)))


def report_lines(clusters: DataFrame, every: int = 25) -> DataFrame:
    """Every ``every``-th bucket with its sub-clusters, members by frequency, then name, both descending."""
    members = clusters.groupBy("bucket", "cluster").agg(F.sort_array(F.collect_list(F.struct("frequency", "name")), asc=False).alias("m"))
    lines = members.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(F.col("m")[0]["frequency"].alias("f"), F.array_join(F.transform("m", lambda x: x["name"]), " ").alias("t"))), asc=False).alias("s"))
    return lines.where(F.crc32(F.col("bucket").cast("string").cast("binary")) % every == 0).select(F.concat_ws(" | ", F.col("bucket").cast("string"), F.array_join(F.transform("s", lambda x: x["t"]), " ; ")).alias("value"))
