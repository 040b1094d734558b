"""Further registered queries: lookups, validation, services, partitions, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import coders, normalize, strings
from ..operators import augment, clusters, metrics
from ..sources import files, tables
from .catalogue import _CURVE, _KNN_EVAL, _judged, _near, _totals, query, r6, rounded
from .sql import caverphone_sql, refined_soundex_sql, soundex_sql, sql

_PIECES = "list_filter(regexp_split_to_array(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    sql(
        "",
        "select raw, array_to_string(list_filter(list_transform(p, lambda x: regexp_replace(x, '[0-9]', '', 'g')), lambda x: x <> ''), ' ') as given from (select raw, " + _PIECES + " as p from raw)",
        raw="select distinct p_name as raw from part union select distinct s_name from supplier union select distinct p_type from part",
    )
)
def normalize_plain_names(spark, d):
    """[F1, F3, F6-F8, F13-F15] names without abbreviations, prefixes, noise words or marks, whose pieces SQL can state"""
    raw = tables.table(spark, d, "part").select(F.col("p_name").alias("raw")).union(tables.table(spark, d, "supplier").select("s_name")).union(tables.table(spark, d, "part").select("p_type")).distinct()
    return raw.select("raw", normalize.normalize_and_join(F.col("raw"), False).alias("given"))


@query(
    sql(
        "pref",
        "select name, frequency from pref where name not in (select k from abbreviation) and name not in (select v from abbreviation) union all select v, min_by(frequency, rank) from (select v, frequency, rank from pref join abbreviation on k = name union all select name, frequency, rank from pref where name in (select v from abbreviation)) group by v",
        abbreviation="select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in normalize.L.GIVEN_ABBREVIATIONS.items()) + ") t(k, v)",
    )
)
def frequent_names(spark, d):
    """the first of raw names with one and the same latin piece; raw ones come in three spellings"""
    p = tables.preferred(spark, d)
    raw = p.select("frequency", "rank", F.explode(F.array("name", F.upper("name"), F.concat(F.lit(" "), "name", F.lit("'s")))).alias("name")).withColumn("place", F.col("rank"))
    return normalize.frequent_names(raw.select("name", "frequency", "place"), False)


@query(sql("pref", "select name, " + caverphone_sql("name") + " as code from pref"))
def caverphone_codes(spark, d):
    """[F33]"""
    return tables.preferred(spark, d).select("name", coders.caverphone(F.col("name")).alias("code"))


@query(sql("pref", "select name, length(name) as letters, list_aggregate(list_transform(range(1, least(length(name), 30) + 1), lambda i: (i - 1) * 27 + ascii(name[i]) - 96), 'sum')::bigint as hot_places from pref"))
def one_hot_letters(spark, d):
    """30 rows of 27 places each, one of them hot; the sum of the hot places of letters"""
    hot = F.transform(strings.char_ids(F.col("name")), lambda x: F.transform(F.sequence(F.lit(0), F.lit(26)), lambda v: (v == x).cast("int")))
    flat = F.flatten(hot)
    at = F.filter(F.transform(flat, lambda x, i: F.when((x == 1) & (i % 27 > 0), i)), lambda i: i.isNotNull())
    return tables.preferred(spark, d).select("name", hot.alias("h"), at.alias("at")).select("name", F.size("at").cast("long").alias("letters"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("hot_places"))


# lookups


_CODES = "select name, " + soundex_sql("name") + " as cluster from pref"


@query(sql("pref brandtype", "select distinct h.cluster, c.cluster as other from (select distinct cluster, head from codes join part_words using (name)) h join part_words w using (head) join codes c on c.name = w.name", words="select distinct w as name from (select unnest(string_split(p_name, ' ')) as w from part)", codes="select name, " + soundex_sql("name") + " as cluster from words", part_words="select distinct p_brand as head, unnest(string_split(p_name, ' ')) as name from part"))
def cluster_bucket_closure(spark, d):
    """[J30] clusters are codes of the words of part names, buckets are brands"""
    w = tables.table(spark, d, "part").select(F.col("p_brand").alias("head"), F.explode(F.split("p_name", " ")).alias("name")).distinct()
    codes = w.select("name").distinct().select("name", coders.soundex(F.col("name")).alias("cluster"))
    return clusters.bucket_closure(codes, w)


@query(sql("pref", "select distinct a.name, b.cluster from c a join (select distinct cluster, substring(cluster, 1, 3) as s from c) b on substring(a.cluster, 1, 3) = b.s", c=_CODES))
def super_cluster_expansion(spark, d):
    """[J31] codes with the same first three characters are one super-cluster"""
    c = tables.preferred(spark, d).select("name", coders.soundex(F.col("name")).alias("cluster"))
    supers = c.select("cluster").distinct().select(F.substring("cluster", 1, 3).alias("super_label"), "cluster")
    return clusters.expand_super(c, supers)


@query(sql("pref", "select p.name, coalesce(b.cluster, c.cluster) as cluster from pref p join c on c.name = p.name left join c b on starts_with(p.name, 'th') and b.name = substring(p.name, 3)", c=_CODES))
def basename_clusters(spark, d):
    """[J32] a name that begins with th goes where the rest of it is clustered"""
    p = tables.preferred(spark, d)
    c = p.select("name", coders.soundex(F.col("name")).alias("cluster"))
    base = p.where(F.col("name").startswith("th")).select("name", F.expr("substring(name, 3)").alias("basename"))
    return clusters.basename_redirect(p.select("name"), base, c)


_TAKEN = "select name, cluster, score from (select *, row_number() over (partition by name order by round(score, 9) desc, cluster) as rank from (select name, cast(other_label as bigint) as cluster, max(score) as score from near where rank <= 10 group by all)) where rank <= 3"


def _taken(spark, d):
    n = _near(spark, d).join(tables.vec_clusters(spark, d).withColumnRenamed("name", "candidate_name"), "candidate_name")
    return clusters.take_clusters(n.select(F.col("input_name").alias("name"), F.col("label").cast("long").alias("cluster"), "score"), -2.0, 3).select("name", "cluster", "score")


def _partitions(spark, d):
    return tables.vec_clusters(spark, d).select(F.col("label").cast("long").alias("cluster")).distinct().select("cluster", (F.col("cluster") % 4).alias("start"), (1 + F.col("cluster") % 4).alias("n"))


@query(sql("near", "select name, cast(sum(n) as bigint) as lookups from (select distinct name, cluster % 4 as start, 1 + cluster % 4 as n from taken) group by name", taken=_TAKEN))
def partition_lookup(spark, d):
    """[J33]"""
    return clusters.partition_lookups(_taken(spark, d).select("name", "cluster"), _partitions(spark, d))


_SWEEP = "select s.size, t.threshold, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1, round(5 * p * r / (4 * p + r), 6) as f2, round(coalesce(l, 0) / s.names, 6) as partitions"


@query(
    sql(
        "near vec",
        _SWEEP + " from (select size, count(distinct act.name) as names from sized join act using (name) group by size) s join (select size, threshold, avg(case when n = 0 then 1.0 else h / n end) as p, avg(g / total) as r from perc group by all) t using (size) left join (select size, threshold, sum(n) as l from (select distinct size, threshold, name, cluster % 4 as start, 1 + cluster % 4 as n from taken join sized using (name) join th on score >= threshold where name in (select name from act)) group by all) k on k.size = s.size and k.threshold = t.threshold",
        taken=_TAKEN,
        **_KNN_EVAL,
        **_CURVE,
        sized="select 0::bigint as size, name from vec union all select 100, name from (select name from vec order by name % 7 desc, name limit 100)",
        perc="select size, per.* from per join sized using (name)",
    )
)
def validation_sweep(spark, d):
    """[M13] over two sizes and all thresholds"""
    from .catalogue import _THRESHOLDS

    frequency = tables.vectors(spark, d).select("name", (F.col("name") % 7).alias("frequency"))
    return rounded(metrics.judged_sweep(_totals(spark, d), _judged(spark, d), [0, 100], _THRESHOLDS, frequency, _taken(spark, d), _partitions(spark, d)))


# services: normalise a name, its vector, its standard clusters


@query(sql("pref", "select name, name as normalized from pref where name not in (" + ", ".join(f"'{w}'" for w in {*normalize.L.GIVEN_ABBREVIATIONS, *normalize.L.GIVEN_PREFIXES, *normalize.L.NOISE_WORDS}) + ")"))
def normalize_service(spark, d):
    """[2.15 normalize] given names, patronymics off; names that the word lists change are left out here (see normalize_names)"""
    out = {*normalize.L.GIVEN_ABBREVIATIONS, *normalize.L.GIVEN_PREFIXES, *normalize.L.NOISE_WORDS}
    p = tables.preferred(spark, d).where(~F.col("name").isin(*out))
    return p.select("name", F.array_join(normalize.normalize(F.col("name"), False, handle_patronymics=False), " ").alias("normalized"))


@query(sql("vec", "select name, round(v[1] / n, 6) as first, round(v[64] / n, 6) as last from (select name, v, sqrt(list_aggregate(list_transform(v, lambda x: x * x), 'sum')) as n from vec)"))
def vector_service(spark, d):
    """[2.15 vector] the unit vector of every known name"""
    from ..functions.vectors import normalized

    v = tables.vectors(spark, d).select("name", normalized(F.col("vector")).alias("u"))
    return v.select("name", r6(F.col("u")[0]).alias("first"), r6(F.col("u")[63]).alias("last"))


@query(sql("near", "select v.name, cluster, round(max(score), 3) as score from (select name, name as variant from vec union all select name, other from near where rank <= 2) v join taken on taken.name = v.variant group by all", taken=_TAKEN))
def standard_service(spark, d):
    """[2.15 standard] a name's two nearest stand for its nickname variants; their clusters by the best score"""
    n = _near(spark, d)
    variants = tables.vectors(spark, d).select("name", F.col("name").alias("variant")).union(n.where("rank <= 2").select("input_name", "candidate_name"))
    return clusters.standard_clusters(variants, _taken(spark, d))


# clusters and partitions


@query()
def closure_clusters(spark, d):
    """[C8] clusters inside closures of near names, unknown pairs ten apart, all other names alone"""
    p = tables.preferred(spark, d)
    near = clusters._kept(augment.similar_name_pairs(p, 0.85))
    closed = clusters.capped_closures(near.select(F.col("name").alias("a"), F.col("alt_name").alias("b"), F.round(1 - F.col("similarity"), 9).alias("distance")), 500)
    closed = clusters._kept(closed.withColumnRenamed("closure", "bucket"))
    pairs = near.join(closed, "name").join(closed.select(F.col("name").alias("alt_name"), F.col("bucket").alias("b2")), "alt_name").where("bucket = b2").select("bucket", "name", "alt_name", F.col("similarity").alias("score"))
    got = clusters.agglomerative(closed, pairs, 0.85, missing=10.0).select("name", F.concat_ws("/", "bucket", "cluster").alias("cluster"))
    alone = p.join(closed, "name", "left_anti").select("name", F.col("name").alias("cluster"))
    return got.unionByName(alone)


@query()
def cluster_augmentation(spark, d):
    """[C11] names of even number are clustered by label, the others join them one after another"""
    v = tables.vectors(spark, d)
    known = v.where("name % 2 = 0").select("name", "vector", F.col("label").alias("cluster"))
    return clusters.augment_clusters(known, v.where("name % 2 = 1").select("name", F.col("name").alias("rank"), "vector"), 0.6)


@query()
def greedy_sweep(spark, d):
    """[C23] greedy clustering over a grid of thresholds"""
    v = tables.vectors(spark, d).withColumn("rank", F.col("name"))
    out = None
    for t in (0.5, 0.7, 0.9):
        one = clusters.greedy(v.select("name", "rank", "vector"), t).agg(F.count_distinct("cluster").alias("clusters")).withColumn("threshold", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("threshold", "clusters")


@query(sql("", "with recursive e as (select distinct 'all' as node, p_brand as child, count(*) over (partition by p_brand) as n from part) select count(*) as children, cast(sum(n) as bigint) as parts from e"))
def hierarchy_sizes(spark, d):
    """[C4, C5] the first level of the hierarchy that ``split_hierarchy`` cuts (see the tests for the cut)"""
    p = tables.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("children"), F.sum("n").alias("parts"))


@query()
def hierarchy_partitions(spark, d):
    """[C4] brands and types of parts, cut into partitions of like size; the hierarchy's few nodes are on the driver"""
    p = tables.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).collect()
    children, sizes = {"all": sorted({r["p_brand"] for r in p})}, {"all": float(sum(r["n"] for r in p))}
    for r in p:
        leaf = f"{r['p_brand']}/{r['p_type']}"
        children.setdefault(r["p_brand"], []).append(leaf)
        sizes[leaf] = float(r["n"])
        sizes[r["p_brand"]] = sizes.get(r["p_brand"], 0.0) + r["n"]
    cut = clusters.split_hierarchy(children, sizes, "all", sizes["all"] / 20, sizes["all"] / 30, 25)
    return spark.createDataFrame([(k, float(s), n, sorted(nodes)) for k, (s, nodes, n) in enumerate(cut)], "partition int, size double, parts int, nodes array<string>")


#: Triplets that are taught many times over: (anchor, positive, negative).
PUSHED_APART = [("maria", "mary", "mario"), ("john", "jon", "joan"), ("louise", "luisa", "louis")]


@query("select a as anchor, p as positive, n as negative, cast(unnest(range(1, 11)) as bigint) as copy from (values " + ", ".join(f"('{a}', '{p}', '{n}')" for a, p, n in PUSHED_APART) + ") t(a, p, n)")
def push_apart(spark, d):
    """[D7]"""
    t = spark.createDataFrame(PUSHED_APART, "anchor string, positive string, negative string")
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))


@query(sql("pref", "select code, name from (select " + refined_soundex_sql("name") + " as code, name, count(*) over (partition by " + refined_soundex_sql("name") + ") as m, row_number() over (partition by " + refined_soundex_sql("name") + " order by name) as r from pref) where m > 1 and r <= 3"))
def code_heads(spark, d):
    """[T6, A9] the first three names of codes that several names have"""
    c = tables.preferred(spark, d).groupBy(coders.refined_soundex(F.col("name")).alias("code")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return c.where("size(names) > 1").select("code", F.explode(F.slice("names", 1, 3)).alias("name"))


@query(sql("attached", "select tree_name, record_name, frequency, cast(1 as bigint) as kept from attached where tree_name <> record_name and length(tree_name) > 0 and not (ends_with(tree_name, 'ing') or ends_with(record_name, 'ing'))"))
def shuffled_pairs(spark, d):
    """[P3, P5, P6, T9] pairs without suffix or exact matches, in an order by hash"""
    t, r = F.col("tree_name"), F.col("record_name")
    a = tables.attached(spark, d).where((t != r) & (F.length(t) > 0) & ~(t.endswith("ing") | r.endswith("ing")))
    return a.repartitionByRange(F.xxhash64(t, r)).sortWithinPartitions(F.xxhash64(t, r)).withColumn("kept", F.lit(1).cast("long"))


@query(sql("pref attached", "select (select cast(sum(frequency) as bigint) from pref) - (select coalesce(cast(sum(frequency) as bigint), 0) from attached where tree_name in (select name from pref where rank <= 10)) as total"))
def corrected_total(spark, d):
    """[A24] all frequency less that of pairs under the ten most frequent names"""
    p = tables.preferred(spark, d)
    less = tables.attached(spark, d).join(F.broadcast(p.where("rank <= 10").select(F.col("name").alias("tree_name"))), "tree_name", "left_semi").agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("x"))
    return p.agg(F.sum("frequency").alias("s")).join(less, F.lit(True)).select((F.col("s") - F.col("x")).alias("total"))


# files: written to the session's checkpoint folder and read back


def _folder(spark) -> str:
    clusters._kept(spark.range(1))  # the folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query(sql("pref", "select name, cast(frequency as varchar) as frequency from pref"))
def csv_files(spark, d):
    """[S2, S3, S21] written with gzip, read as strings"""
    path = _folder(spark)
    files.write_csv(tables.preferred(spark, d).select("name", "frequency"), path)
    return files.read_csv(spark, path)


@query(sql("attached", "select tree_name as name, record_name as alt_name from attached"))
def raw_pair_files(spark, d):
    """[S1, P1] pipe-separated lines"""
    path = _folder(spark)
    files.write_text(tables.attached(spark, d).select(F.concat_ws("|", "tree_name", "record_name").alias("value")), path)
    return files.read_raw_pairs(spark, path)


@query(sql("attached", "select tree_name as name1, record_name as name2 from attached"))
def tsv_files(spark, d):
    """[S4]"""
    path = _folder(spark)
    files.write_text(tables.attached(spark, d).select(F.concat_ws("\t", "tree_name", "record_name").alias("value")), path)
    return files.read_tsv(spark, path)


@query(sql("pref", "select name, frequency from pref"))
def frequency_files(spark, d):
    """[S5, S22] two appends"""
    path = _folder(spark)
    p = tables.preferred(spark, d)
    for some in (p.where("rank % 2 = 0"), p.where("rank % 2 = 1")):
        some.select("name", "frequency").write.mode("append").csv(path)
    return files.read_frequencies(spark, path)


@query(sql("attached", "select tree_name, frequency from attached"))
def parquet_files(spark, d):
    """[S6-S8, S20] column subset of many files"""
    path = _folder(spark)
    files.write_parquet(tables.attached(spark, d), path)
    return files.read_parquet(spark, path, "tree_name", "frequency", pattern="*.parquet")


@query(sql("vec", "select cast(name as varchar) as name, round(v[1]::float, 5) as first, cast(len(v) as bigint) as n from vec"))
def embedding_files(spark, d):
    """[S18, V18] JSON lines"""
    path = _folder(spark)
    files.write_json_lines(tables.vectors(spark, d).select(F.col("name").cast("string").alias("name"), F.col("vector").alias("embedding")), path)
    return files.read_embeddings(spark, path).select("name", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").cast("long").alias("n"))


@query(sql("near", "select cast(name as varchar) as name, cast(cluster as varchar) as id, round(score, 6) as score from taken", taken=_TAKEN))
def cluster_score_files(spark, d):
    """[S17] JSON lines"""
    path = _folder(spark)
    rows = _taken(spark, d).groupBy(F.col("name").cast("string").alias("name")).agg(F.collect_list(F.struct(F.col("cluster").cast("string").alias("id"), "score")).alias("clusters"))
    files.write_json_lines(rows, path)
    return files.read_cluster_scores(spark, path).select("name", F.inline("clusters")).select("name", "id", r6(F.col("score")).alias("score"))


@query(sql("brandtype", "select head || chr(9) || string_agg(name, ' ' order by name) as value from brandtype group by head"))
def cluster_text(spark, d):
    """[S25]"""
    b = tables.table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_brand").alias("name")).distinct()
    return files.cluster_lines(b, b.select("name", F.col("name").alias("nickname")))
