import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eponym.functions import strings
from eponym.operators import augment, clusters, similarity


def names_of(seed, n=160):
    rng = random.Random(seed)
    parts = ["an", "er", "th", "o", "ell", "mar", "a", "in", "st", "ro", "zz", "é"]
    return sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n)} | {"a", "x" * 70, "x" * 68 + "yy"})


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    return 1 - lev(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("least", [0.5, 0.65, 0.75, 0.9])
def test_similar_pairs_equal_all_pairs(spark, least):
    names = names_of(3)
    got = [(r["name"], r["alt_name"], round(r["similarity"], 9)) for r in augment.similar_name_pairs(spark.createDataFrame([(x,) for x in names], "name string"), least).collect()]
    want = {(a, b, round(alike(a, b), 9)) for k, a in enumerate(names) for b in names[k + 1 :] if alike(a, b) >= least - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want
    assert augment.similar_name_pairs(spark.createDataFrame([], "name string"), least).count() == 0


@pytest.mark.parametrize("block", [7, 2000])
def test_tfidf_neighbours_equal_all_pairs(spark, block):
    names = names_of(4, 60)
    t = similarity.tfidf(spark.createDataFrame([(x,) for x in names], "name string"), strings.char_ngrams(F.col("name")))
    of = {}
    for r in t.collect():
        of.setdefault(r["name"], {})[r["gram"]] = r["weight"]
    want = {}
    for a in of:
        scored = [(-round(sum(w * of[b].get(g, 0) for g, w in of[a].items()), 9), b) for b in of if b != a]
        want[a] = [(b, k + 1) for k, (s, b) in enumerate(sorted(x for x in scored if x[0] < 0)[:4])]
    got = {a: [] for a in of}
    for r in similarity.tfidf_nearest(t, t, 4, block=block).orderBy("name", "rank").collect():
        got[r["name"]].append((r["alt_name"], r["rank"]))
    assert got == want


def test_tfidf_search_scores_few_pairs_whole():
    """The search finds the best of all pairs and scores few of them whole (before: every pair)."""
    import numpy as np
    import pyarrow as pa

    rng, parts = random.Random(7), ["er", "an", "the", "und", "schpf", "tion", "lo", "ga", "bo", "eux", "ing", "ha", "ver", "que", "ad", "ri"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(1500)})
    grams = [sorted({x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}) for x in names]
    known = {g: i for i, g in enumerate(sorted({g for x in grams for g in x}))}
    m = np.zeros((len(names), len(known)))
    for i, x in enumerate(grams):
        m[i, [known[g] for g in x]] = 1
    m *= np.log(len(names) / m.sum(0)) + 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cells = [np.flatnonzero(row) for row in m]
    row = [[names], [[len(c) for c in cells]], [np.concatenate(cells).tolist()], [np.concatenate([m[i, c] for i, c in enumerate(cells)]).tolist()]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=list("nsgw"))
    a, b, looked = similarity._Grams(batch, 0, 0), similarity._Grams(batch, 0, 0), []
    b.index()
    b.scores = lambda own, places: looked.append(len(places)) or similarity._Grams.scores(b, own, places)
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -1)
    tenth = -np.sort(-s, axis=1)[:, 9]
    for edge in (np.full(len(names), -np.inf), tenth - 1e-9):
        looked.clear()
        found = {i: dict(zip(p.tolist(), x.tolist())) for i, p, x in similarity._best_by_grams(a, b, edge, 10, 0.0)}
        for i in range(len(names)):
            want = set(np.flatnonzero((s[i] >= tenth[i]) & (s[i] > 0)).tolist())
            assert want <= set(found[i]) and all(abs(found[i][j] - s[i, j]) < 1e-8 for j in want)
        assert sum(looked) < 0.2 * len(names) ** 2


def test_similar_pairs_of_mixed_names_meet_once(spark):
    rng = random.Random(11)
    names = names_of(12, 120) + ["".join(rng.choice("aab") for _ in range(rng.randint(2, 9))) for _ in range(120)] + ["Ann", "an n", "bäab", "aab1", "aabb1", "aaaaaaaaaaaab", "aaaaaaaaaaaaab"]
    names = sorted(set(names))
    df = spark.createDataFrame([(x,) for x in names], "name string")
    for least in (0.65, 0.75, 0.85):
        got = [(r["name"], r["alt_name"], round(r["similarity"], 9)) for r in augment.similar_name_pairs(df, least).collect()]
        want = {(a, b, round(alike(a, b), 9)) for k, a in enumerate(names) for b in names[k + 1 :] if alike(a, b) >= least - 1e-12}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [0, 1000])
def test_near_negatives_equal_all_pairs(spark, most):
    import hashlib

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(2, 15))) for _ in range(160)} | {"Ann", "an n", "aab1", "a" * 25, "a" * 18 + "b" * 7})
    attached = [(a, b) for a in names for b in rng.sample(names, 12) if a != b]
    known = {*attached, *((b, a) for a, b in attached)}
    want = set()
    for a in names:
        near = [(hashlib.md5(f"{a},{b}".encode()).hexdigest(), b, round(alike(a, b), 9)) for b in names if a != b and 0.65 - 1e-12 <= alike(a, b) <= 0.75 + 1e-12 and (a, b) not in known]
        want |= {(a, b, s) for _, b, s in sorted(near)[:5]}
    got = augment.near_negatives(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(attached, "tree_name string, record_name string"), 0.65, 0.75, 5, most)
    rows = [(r["name"], r["alt_name"], round(r["similarity"], 9)) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_all_pairs_reads_bags_once_for_a_block():
    """Blocks meet a few bags at a time, with bags read once for a block (before: made anew whenever two blocks met)."""
    import numpy as np

    from eponym.operators import deletions

    rng = random.Random(2)
    a, b = (sorted({"".join(rng.choice("abc") for _ in range(n)) for _ in range(90)}) for n in (14, 13))
    (p, own), (q, other) = (deletions.read(deletions.cells_of(x).tobytes()) for x in (a, b))
    assert deletions.read(p.tobytes())[1] is own
    want = sorted((x, y, lev(y, x)) for x in a for y in b if lev(y, x) <= 3)
    for rows in (1, 64, 1 << 16):
        found = deletions.all_pairs(p, q, 14, 13, 0.75, rows=rows, known=(own, other))
        assert sorted((x, y, int(z)) for c, e, d in found for x, y, z in zip(deletions.text_of(c), deletions.text_of(e), d)) == want
    some = [z for _, _, d in deletions.all_pairs(p, q, 14, 13, 0.75, 0.8) for z in d.tolist()]
    assert len(some) == sum(z == 3 for _, _, z in want) and len(want) > len(some) > 0
    assert np.array_equal(deletions.bags(q), other)


def test_near_negatives_search_once(spark):
    """Pairs are sought once and a task leaves the first of a name only (before: twice, and all pairs sorted)."""
    import numpy as np

    from eponym.operators import deletions

    names = spark.createDataFrame([(x,) for x in names_of(6, 80)], "name string").where("name rlike '^[a-z]{1,24}$'")
    got = augment.near_negatives(names, spark.createDataFrame([], "tree_name string, record_name string"), 0.65, 0.75, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    chosen = deletions.Chosen(5, np.zeros((0, 4), np.uint64), room=50)
    for x in range(1, 90):
        a, b, none = np.full(1, 7 << 55, np.uint64), np.full(1, (8 + x % 18 << 55) | (1 + x // 18 << 50), np.uint64), np.zeros(1, np.uint64)
        chosen.add(a, none, b, none, np.full(1, 0.7))
    chosen.cut()
    assert int((chosen.held[0] == np.uint64(7 << 55)).sum()) == 5


def test_similar_pairs_meet_by_rests_of_names(spark):
    """Names that share a common segment only are not compared (before: 3.4e9 candidates for 296,000 names)."""
    import numpy as np

    from eponym.operators import deletions

    names = ["er" + x + y for x in "abcdfghjkl" for y in ("mnopqr", "stuvwx", "zyxwvu")]
    keys, rows = (np.concatenate(x) for x in zip(*deletions.rests(deletions.packed(names), 0.75)))
    assert len(np.unique(keys >> np.uint64(1))) > 0.5 * len(keys)
    pairs = [p for a, b, d, n in deletions.meet(keys, rows, 0.75) for p in zip(deletions.text(a).to_pylist(), deletions.text(b).to_pylist(), (1 - d / n).tolist())]
    want = [(a, b, alike(a, b)) for k, a in enumerate(sorted(names)) for b in sorted(names)[k + 1 :] if alike(a, b) >= 0.75]
    assert sorted(pairs) == sorted(want)


def test_blocks_meet_without_a_shuffle(spark):
    """Blocks are not shuffled to their meetings, and a task keeps only the best of all it met (before: an exchange of all pairs of blocks)."""
    names = names_of(5, 80)
    t = similarity.tfidf(spark.createDataFrame([(x,) for x in names], "name string"), strings.char_ngrams(F.col("name")))
    plan = similarity.tfidf_nearest(t, t, 4, block=9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") <= 1


def test_a_meeting_holds_few_bytes_of_candidates(spark):
    """Spark holds a task's candidates on the heap, so tasks get them by size (before: up to 64 blocks of any size, here all 40 of 105 MB)."""
    df = spark.range(400).select(F.col("id").alias("name"), F.expr("transform(sequence(1, 32768), x -> cast(x + id as float))").alias("vector"))
    met = similarity._meetings(similarity._blocks(df.where("name < 10"), 10, "i"), similarity._blocks(df, 10, "c"))
    held = met.groupBy(F.spark_partition_id().alias("task"), "c_block").agg(F.max(F.size("c_cells")).alias("n")).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in held) == 400 * 32768 and max(r["n"] for r in held) * 4 <= 1.6 * (16 << 20)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_equals_all_pairs(spark, metric):
    import numpy as np

    v = np.round(np.random.default_rng(3).normal(size=(70, 5)), 1)
    v[10:20] = v[:10]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "name long, vector array<float>")
    for with_self, least in ((True, None), (False, 0.2)):
        got = {}
        for r in similarity.nearest(df, df, 6, metric, least=least, with_self=with_self, block=8).orderBy("input_name", "rank").collect():
            got.setdefault(r["input_name"], []).append(r["candidate_name"])
        plan = similarity.nearest(df, df, 6, metric, block=8)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan
        if metric == "cosine":
            f = v.astype("f4").astype(float)
            u = f / np.linalg.norm(f, axis=1, keepdims=True)
            want = {i: [j for _, j in sorted((-round(s, 9), j) for j, s in enumerate(u @ u[i]) if (with_self or j != i) and (least is None or s > least))[:6]] for i in range(70)}
            assert got == {i: x for i, x in want.items() if x}


def test_code_join_gives_each_pair_once(spark):
    q = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "x")], "name string, code string")
    i = spark.createDataFrame([("m", "x"), ("m", "y"), ("n", "y"), ("n", "z"), ("o", "q")], "name string, code string").select("code", "name")
    got = clusters.code_join(q, i)
    assert sorted(map(tuple, got.collect())) == [("a", "m"), ("a", "n"), ("b", "m"), ("b", "n"), ("c", "m")]
    assert "keys=[name#" not in got._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]  # no pass over all pairs


def test_pairs_of_a_frequent_code_are_shared_by_tasks(spark):
    """Blocks of one code go to many tasks (before: a single task had all its pairs); pairs with several common codes come once."""
    names = spark.range(600).select(F.concat(F.lit("n"), "id").alias("name"), F.explode(F.when(F.col("id") < 10, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).alias("code"))
    got = clusters.code_join(names, names, block=50)
    rows = got.groupBy("name", "candidate").count()
    assert rows.count() == 600 * 600 and rows.where("count > 1").isEmpty()
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 600 * 600 and max(tasks) < 0.3 * 600 * 600


def brute_closures(pairs, most):
    up, size = {}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        for x in (a, b):
            up.setdefault(x, x)
            size.setdefault(x, 1)
        i, j = sorted((root(a), root(b)))
        if i != j and size[i] + size[j] <= most:
            up[j] = i
            size[i] += size[j]
    return {x: root(x) for x in up}


@pytest.mark.parametrize("most", [3, 8, 1000])
def test_capped_closures_equal_one_fold(spark, most):
    rng = random.Random(most)
    pairs = [(a, b, round(rng.random(), 3)) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}]
    got = clusters.capped_closures(spark.createDataFrame(pairs, "a int, b int, distance double"), most).collect()
    assert {r["name"]: r["closure"] for r in got} == brute_closures(pairs, most)


@pytest.mark.parametrize("rows", [5, 1_000_000])
def test_components_by_stars(spark, rows):
    """Stars of partitions join to whole components, with few rows in a task and with many (before: only rounds over all edges)."""
    rng = random.Random(rows)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220))] + [("é", "z"), ("z", "n000"), ("q", "q")]
    df = spark.createDataFrame(edges, "a string, b string").repartition(9)
    got = {r["name"]: r["component"] for r in clusters.components(df, rows).collect()}
    assert got == brute_closures([(a, b, 0.0) for a, b in edges if a != b], 10**9)
    stars = clusters._stars(df.where("a != b").toDF("u", "l").coalesce(1), rows).collect()
    assert {r["u"]: r["l"] for r in stars} == {a: b for a, b in got.items() if a != b}


def test_linkage_equals_whole_searches():
    rng = np.random.default_rng(5)
    for method in ("average", "complete", "single"):
        for _ in range(20):
            n = int(rng.integers(2, 15))
            d = np.round(rng.random((n, n)), 2)
            d = np.triu(d, 1) + np.triu(d, 1).T
            w = rng.integers(1, 5, n).astype(float)
            own, size, ids, alive, want = d.copy(), w.copy(), list(range(n)), list(range(n)), []
            np.fill_diagonal(own, np.inf)
            for step in range(n - 1):
                sub = own[np.ix_(alive, alive)]
                a, b = sorted(divmod(int(sub.argmin()), len(alive)))
                i, j = alive[a], alive[b]
                row = {"average": (size[i] * own[i] + size[j] * own[j]) / (size[i] + size[j]), "complete": np.maximum(own[i], own[j]), "single": np.minimum(own[i], own[j])}[method]
                want.append((ids[i], ids[j], float(own[i, j]), int(size[i] + size[j])))
                own[i, :], own[:, i], own[i, i] = row, row, np.inf
                size[i] += size[j]
                alive.remove(j)
                ids[i] = n + step
            assert [m[:2] + m[3:] for m in clusters.linkage(d, method, w)] == [m[:2] + m[3:] for m in want]


def test_greedy_with_nicknames(spark):
    rows = [("ann", 1, [1.0, 0.0], None), ("nan", 2, [0.0, 1.0], ["ann", "nancy"]), ("anne", 3, [0.99, 0.1], None), ("bob", 4, [-1.0, 0.0], None), ("nanny", 5, [0.0, 0.9], None)]
    got = sorted(tuple(r) for r in clusters.greedy(spark.createDataFrame(rows, "name string, rank int, vector array<double>, heads array<string>"), 0.8).collect())
    assert got == [("ann", "ann"), ("anne", "ann"), ("bob", "bob"), ("nan", "ann"), ("nan", "nancy"), ("nancy", "nancy"), ("nanny", "ann"), ("nanny", "nancy")]


def test_cluster_augmentation(spark):
    known = spark.createDataFrame([("ann", [1.0, 0.0], "A"), ("bob", [0.0, 1.0], "B")], "name string, vector array<double>, cluster string")
    new = [("anne", 1, [0.9, 0.1], None), ("zed", 2, [-1.0, 0.0], None), ("zeda", 3, [-0.95, 0.1], None), ("debob", 4, [-1.0, 0.0], "bob"), ("dezed", 5, [0.0, 0.2], "zed"), ("deq", 6, [0.9, 0.05], "q")]
    got = {r["name"]: r["cluster"] for r in clusters.augment_clusters(known, spark.createDataFrame(new, "name string, rank int, vector array<double>, basename string"), 0.8).collect()}
    assert got == {"anne": "A", "zed": "zed", "zeda": "zed", "debob": "B", "dezed": "zed", "deq": "A"}


def test_cluster_augmentation_in_blocks_equals_one_after_another(spark):
    """Several blocks of 128 new names (before: a copy of all vectors for every name)."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 4))
    known = {f"k{i}": (v[i], f"C{i}") for i in range(60)}
    new = [(f"n{i}", i, v[i], f"n{rng.integers(60, 400)}" if i % 7 == 0 else None) for i in range(60, 400)]
    seen, of, want = [(v[i], f"C{i}") for i in range(60)], {k: c for k, (_, c) in known.items()}, {}
    for name, _, x, base in new:
        if base in of:
            c = of[base]
        else:
            s = [float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for y, _ in seen]
            c = seen[int(np.argmax(s))][1] if max(s) >= 0.9 else name
            seen.append((x, c))
        of[name] = want[name] = c
    a = spark.createDataFrame([(k, x.tolist(), c) for k, (x, c) in known.items()], "name string, vector array<double>, cluster string")
    b = spark.createDataFrame([(n, r, x.tolist(), y) for n, r, x, y in new], "name string, rank int, vector array<double>, basename string")
    assert {r["name"]: r["cluster"] for r in clusters.augment_clusters(a, b, 0.9).collect()} == want


def test_split_hierarchy():
    children, sizes = {"r": ["a", "b"], "a": ["c", "d"]}, {"r": 100.0, "a": 40.0, "b": 60.0, "c": 30.0, "d": 10.0}
    cut = clusters.split_hierarchy(children, sizes, "r", 35.0, 20.0, 2)
    assert sorted(x for _, nodes, _ in cut for x in nodes) == ["a", "b"] or sorted(x for _, nodes, _ in cut for x in nodes) == ["b", "c", "d"]
    assert all(s <= 35 for s, _, _ in cut) and sum(s * k for s, _, k in cut) == 100
    cut = clusters.split_hierarchy({"r": ["a", "b", "c", "d"]}, {"r": 100.0, "a": 40.0, "b": 30.0, "c": 20.0, "d": 10.0}, "r", 50.0, 45.0, 3)
    assert sorted(sorted(nodes) for _, nodes, _ in cut) == [["a", "d"], ["b"], ["c"]] or sum(k for _, _, k in cut) == 3


def test_single_letters_and_partitions():
    assert clusters.place_single_letters({0: 10.0, 1: 4.0, 2: 5.0}, [("b", 3.0), ("a", 3.0), ("c", 1.0)]) == {"a": 1, "b": 2, "c": 1}
    got = clusters.phonebook([("a", 25.0), ("b", 1.0), ("c", 9.0)], [("a", "b", 0.9)], {}, 3, 10.0)
    assert len(got["a"]) == 3 and got["b"][0] in got["a"]


def test_pieces_and_scripts(spark):
    rng = random.Random(7)
    words = ["john", "jon", "smith", "smyth", "brown", "lee", "joan", "li"]
    for _ in range(60):
        a, b = ([rng.choice(words) for _ in range(rng.randint(0, 3))] for _ in range(2))
        got = strings.match_pieces_one(a, b)
        assert all(x in " ".join(a) or x in "".join(a) for x, _ in got) and len(got) <= max(len(a), len(b))
    names = names_of(9, 40)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 : k + 4] if len(a) < 40]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strings.edit_script("a", "b").alias("e"), strings.jaro_winkler("a", "b").alias("j")).collect()
    assert len(rows) == len(pairs) and all(r["e"]["cost"] >= 0 and 0 <= r["j"] <= 1 for r in rows)
    assert strings.jaro("aanhaingnt", "erthing") == pytest.approx((4 / 10 + 4 / 7 + 3 / 4) / 3)  # three letters out of place are one transposition


def test_totals_and_judged_equal_listed_actuals(spark, sf_dir):
    """The curve needs no list of all pairs of a label (before: the square of a label's names)."""
    from eponym.operators import metrics
    from eponym.plans import catalogue as c

    want = {r["name"]: r["total"] for r in c._actuals(spark, sf_dir).groupBy("name").agg(F.sum("frequency").alias("total")).collect()}
    assert {r["name"]: r["total"] for r in c._totals(spark, sf_dir).collect()} == want
    listed = metrics.threshold_curve(c._actuals(spark, sf_dir), c._candidates(spark, sf_dir), [0.2, 0.5]).orderBy("threshold").collect()
    judged = metrics.judged_curve(c._totals(spark, sf_dir), c._judged(spark, sf_dir), [0.2, 0.5]).orderBy("threshold").collect()
    assert [[round(x, 9) for x in r] for r in listed] == [[round(x, 9) for x in r] for r in judged]
