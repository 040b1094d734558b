import numpy as np
import pytest

from eponym.operators import clusters, metrics, pair_statistics, similarity
from eponym.sources import files


def _ndcg(spark, relevant, scores, predicted, k=None):
    rel = spark.createDataFrame([("q", c, float(s)) for c, s in zip(relevant, scores)], "name string, candidate int, relevance double")
    pred = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(predicted)], "name string, candidate int, rank int")
    return metrics.ndcg(rel, pred, k).head()["ndcg"]


@pytest.mark.parametrize("k,want", [(10, 0.602227), (3, 0.258148), (1, 0.14285)])
def test_ndcg_reals(spark, k, want):
    assert _ndcg(spark, [4, 2, 1], [0.7, 0.2, 0.1], list(range(1, 11)), k) == pytest.approx(want, abs=1e-4)


def test_ndcg_known(spark):
    assert _ndcg(spark, [1, 2, 3, 5, 6], [3, 2, 3, 1, 2], list(range(1, 7)), 6) == pytest.approx(0.9607, abs=1e-3)
    assert _ndcg(spark, [1, 2], [1, 1], [1, 2]) == pytest.approx(1)
    assert _ndcg(spark, [9], [1], [1, 2]) == 0


@pytest.mark.parametrize("k", [0, 3])
def test_ndcg_errors(spark, k):
    with pytest.raises(ValueError):
        _ndcg(spark, [1], [1], [1, 2], k)


def test_curve_area():
    assert metrics.curve_area([1.0], [0.5]) == 0
    assert metrics.curve_area([0.5, 1.0], [1.0, 0.5]) == pytest.approx(0.5 + 0.375)
    assert metrics.curve_area([0.5, 0.5], [0.5, 0.5]) == pytest.approx(0.25)


def test_linkage_and_cut():
    d = np.array([[0, 0.1, 0.8, 0.9], [0.1, 0, 0.7, 0.9], [0.8, 0.7, 0, 0.2], [0.9, 0.9, 0.2, 0]])
    for method in ("average", "complete", "single"):
        assert clusters.cut(4, clusters.linkage(d, method), 0.3) == [0, 0, 1, 1]
    assert clusters.cut(4, clusters.linkage(d), 5.0) == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        clusters.linkage(d, "other")


def test_phonebook():
    sizes = [("a", 25.0), ("b", 4.0), ("c", 4.0), ("d", 3.0), ("e", 2.0)]
    got = clusters.phonebook(sizes, [("b", "c", 0.9)], {}, 4, 10.0)
    assert len(got["a"]) == 3
    used = sorted({p for ps in got.values() for p in ps})
    assert used == list(range(len(used)))
    load = {}
    for (c, s) in sizes:
        for p in got[c]:
            load[p] = load.get(p, 0) + s / len(got[c])
    assert max(load.values()) <= 10


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a int, b int")
    got = dict(clusters.components(e).collect())
    assert set(got.values()) == {1, 100} and len(got) == 42


def test_rank_is_total(spark):
    from eponym.sources.tables import ranked

    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("ab", 3)], "name string, frequency int")
    assert {r["name"]: r["rank"] for r in ranked(df).collect()} == {"c": 1, "a": 2, "ab": 3, "b": 4}


def test_probabilities_sum_to_one(spark, sf_dir):
    from pyspark.sql import functions as F

    from eponym.sources import tables

    s = pair_statistics.pair_statistics(pair_statistics.count_pairs(tables.pairs(spark, sf_dir)))
    assert s.groupBy("name").agg(F.sum("ordered_prob").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    assert s.where("similarity < 0 or similarity > 1 or unordered_prob > 1").count() == 0


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "name int, vector array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    got = similarity.nearest(df, df, 3, block=7).toPandas()
    for i, g in got.groupby("input_name"):
        assert g.sort_values("rank")["candidate_name"].tolist() == np.argsort(-s[i])[:3].tolist()
    with pytest.raises(ValueError):
        similarity.nearest(df, df, 3, metric="other")


def test_files(spark, tmp_path):
    raw = tmp_path / "raw.txt"
    raw.write_text("a^b~Latn|c^d~Latn\nnull|\n")
    assert [tuple(r) for r in files.read_raw_pairs(spark, str(raw)).collect()] == [("a^b~Latn", "c^d~Latn"), ("null", "")]
    bucket = tmp_path / "b.txt"
    bucket.write_text("john : jon jack\nmary : \n")
    assert {tuple(r) for r in files.read_buckets(spark, str(bucket)).collect()} == {("john", "john"), ("john", "jon"), ("john", "jack"), ("mary", "mary")}
    nick = spark.createDataFrame([("bill,will,william",)], "value string")
    assert files.nicknames_symmetric(nick).count() == 9 and files.nicknames_directed(nick, False).count() == 2
    js = tmp_path / "c.json"
    js.write_text('{"A": {"names": ["a", "b"], "centroid": [0.123456789, 1]}}')
    r = files.rounded_centroids(files.clusters_of_json(spark, str(js))).head()
    assert (r["label"], r["names"], r["centroid"][0]) == ("A", ["a", "b"], 0.12345679)
    e = spark.createDataFrame([("x", [1.0, 2.0])], "name string, embedding array<float>")
    files.write_json_lines(e, str(tmp_path / "e"))
    assert files.read_embeddings(spark, str(tmp_path / "e")).collect() == e.collect()
    files.write_csv(e.select("name"), str(tmp_path / "csv"))
    files.write_csv(e.select("name"), str(tmp_path / "csv"), append=True)
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 2


def test_streaming_counts(spark, tmp_path):
    from eponym.streaming.pair_counts import count_pairs

    spark.createDataFrame([("alpha beta alpha beta",), ("beta alpha",)], "text string").write.parquet(str(tmp_path / "in"))
    q = count_pairs(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("pair_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("pair_counts").collect()} == {("alpha", "beta", 2), ("beta", "alpha", 2)}
