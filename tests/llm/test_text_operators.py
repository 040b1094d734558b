import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from eponym.llm import op3_toxicity, op5_jaccard, op6_quality_rules, op7_quality, op8_licenses, op9_urls, op10_fingerprints
from eponym.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same


def test_queries_equal_sql(spark, sf_dir):
    for name, sql in ORACLE_SQL.items():
        same(QUERIES[name](spark, sf_dir), sf_dir, sql)


# 3, 7: classifiers


@pytest.mark.parametrize("name,label,folds,fold,least", [("op3_toxicity", "toxic", 4, 2, 0.85), ("op7_quality", "quality", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    d = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least


def test_quality_is_the_size_difference():
    import zstandard

    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    bad = lambda: " ".join(rng.choice("BUY!! NOW!! CLICK!! FREE!! WIN!! HERE!!".split()) for _ in range(60))
    model = op7_quality.fit([(good() if y else bad(), y) for y in [0, 1] * 150])
    texts = [good(), bad(), good()[:30], "", None]
    sizes = []
    for t in texts:
        raw = (t or "").encode()
        a, b = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw)) for d in (model.good, model.bad))
        sizes.append((b - a) / len(raw) ** 0.5 if raw else 0.0)
    assert np.allclose(model.differences(texts), sizes)
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(model.final[0] * np.array(sizes) + model.final[1]))))
    s = model.scores(texts)
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] > 0.5 and s[3] == s[4]


@pytest.mark.parametrize("module", [op3_toxicity, op7_quality])
def test_classifier_edges(spark, make, texts, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = module.train(make(texts), labels)
    got = module.score(make(texts), model).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[6]["score"]
    assert module.score(make([]), model).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in module.score(make(texts), module.train(make(texts), none)).collect()} == {0.5}
    assert [r["doc_id"] for r in module.score(make(["a"], [None]), model).collect()] == [None]


def test_bounded_sample(spark, make):
    from eponym.llm.learning import labelled_sample

    docs = make([f"text {k}" for k in range(3000)] + ["another text of the first"] * 500, [*range(3000), *[0] * 500])
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(3000)] + [(4, 0)] * 300, "doc_id long, toxic int").repartition(7)
    got = labelled_sample(docs, labels, "toxic", 4, 2, 50, 1000)
    usable = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 4 != 2]
    hashed = {r["id"]: r["h"] for r in spark.range(3000).selectExpr("id", "xxhash64(id, 'toxic') as h").collect()}
    want = [k for y in (0, 1) for k in sorted((k for k in usable if (k % 10 == 0) == y), key=lambda k: hashed[k])[:50]]
    assert sorted(got) == sorted((("another text of the first" if k == 0 else f"text {k}"), int(k % 10 == 0)) for k in want)


def invented(rng, n):
    syllable = "ba de fi lo mu ra se ti vo na ke".split()
    return ["".join(rng.choice(syllable) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def insulted(rng, phrases, n=240):
    sample = []
    for k in range(n):
        words = invented(rng, 30)
        if k % 2:
            words.insert(rng.randint(0, 29), rng.choice(phrases))
        sample.append((" ".join(words[:15]) + ". " + " ".join(words[15:]), k % 2))
    return sample


def test_gapped_insults():
    rng = random.Random(5)
    model = op3_toxicity.fit(insulted(rng, ["idiot", "moron", "pathetic", "worthless"]))
    clean = " ".join(invented(rng, 20))
    s = model.scores([clean, clean + " idiot", clean + " i.d.i-o.t", clean + " i d i o t", clean + " idxiot", clean + " worthlesss", clean + " pathhetic", ""])
    assert s[0] < 0.3 and s[7] < 0.3 and (s[1:7] >= 0.3).all()


def test_insults_of_several_words():
    rng = random.Random(6)
    phrases = ["waste of skin", "dumber than rocks"]
    sample = insulted(rng, phrases, 600)
    parts = " ".join(phrases).split()
    sample = [(t if y else t + " " + " ".join(rng.sample(parts, 2)[:1] + invented(rng, 2) + rng.sample(parts, 1)), y) for t, y in sample]  # the words alone say nothing
    model = op3_toxicity.fit(sample)
    toxic = model.scores([" ".join(invented(rng, 8) + [rng.choice(phrases)] + invented(rng, 8)) for _ in range(60)])
    clean = model.scores([" ".join(invented(rng, 8) + [rng.choice(parts)] + invented(rng, 8)) for _ in range(60)])
    assert np.mean(toxic >= 0.3) >= 0.9 and np.mean(clean >= 0.3) <= 0.1


@pytest.mark.parametrize("d,inserted", [("sf0.01", 0.8), ("sf0.1", 0.8)])
def test_insults_in_held_out_documents(d, inserted):
    """Held-out documents with insults: as they are, with marks or spaces, and with a letter put into every insult."""
    import duckdb

    rows = duckdb.sql(f"select d.doc_id, d.text, l.toxic from '/root/testdata/{d}/documents.parquet' d join '/root/testdata/{d}/labels.parquet' l using (doc_id) where text is not null order by 1").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = op3_toxicity.fit([(t, y) for i, t, y in rows if not held(i) and len(t) <= 20_000])
    insult = re.compile(r"\b(idiot|moron|pathetic|worthless|scum|trash|loser|clown|stupid|disgusting)\b", re.I)
    toxic, clean = [t for i, t, y in rows if held(i) and y and insult.search(t)], [t for i, t, y in rows if held(i) and not y and not insult.search(t)]
    rng = random.Random(3)

    def put_in(w):
        at = rng.randint(1, len(w) - 1)
        return w[:at] + rng.choice("bcdfghjklmnpqrstvwxz") + w[at:]

    for form, least in ((str, 0.95), (".".join, 0.95), (" ".join, 0.95), (put_in, inserted)):
        assert np.mean(model.scores([insult.sub(lambda m: form(m.group()), t) for t in toxic]) >= 0.3) >= least
    assert np.mean(model.scores(clean) >= 0.3) <= 0.05


def test_sentences_and_windows():
    s = op3_toxicity.Sentences(["One two. Three-four a b", None, "", "x1y! z"])
    assert s.words() == ["one", "two", "threefour", "ab", "xy", "z"] and s.doc.tolist() == [0, 0, 0, 0, 3, 3]
    assert s.together.tolist() == [True, False, True, False, False]
    weight = np.random.default_rng(1).normal(size=1 << op3_toxicity.SPACE_BITS).astype(np.float32)
    got = s.values(weight)
    for k, w in enumerate(s.words()):  # a word's value is the weighted sum of its own subsequences
        if len(w) > 2:
            _, f, v = op3_toxicity.subsequences([w])
            assert abs(got[k, 0] - (weight[f] * v).sum() / np.sqrt((v * v).sum())) < 1e-4
    assert np.isinf(got[1, 1]) and np.isfinite(got[2, 1]) and np.isinf(got[3, 1])


def test_drop_toxic_keeps_columns(spark, make, texts):
    kept = op3_toxicity.drop_toxic(make(texts), op3_toxicity.Model(prior=0.1))
    assert kept.columns == make(texts).columns and kept.count() == len(texts)
    assert op3_toxicity.drop_toxic(make(texts), op3_toxicity.Model(prior=0.9)).count() == 0


# 5: Jaccard join


def shingles(text, w):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + w]) for k in range(max(1, len(words) - w + 1))) if words else frozenset()


def brute_components(docs, percent=90, w=3):
    sets = {i: shingles(t, w) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                c = c + passage
            out.append(" ".join(c))
    return out


@pytest.mark.parametrize("options", [{}, {"short_list": 2, "block": 300}, {"percent": 80, "words": 5, "short_list": 3, "block": 200}, {"extra": 0, "sketch_bits": 12}])
def test_join_equals_brute_force(make, texts, options):
    some = texts[:7] + near_texts() + ["two words", "TWO words", "one"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.join(make(some), **options).collect()}
    assert got == brute_components(list(enumerate(some)), options.get("percent", 90), options.get("words", 3))


def test_repeated_ids_have_all_links(make):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    near = [t + " and one more" for t in base]
    rows = op5_jaccard.join(make([*base, *near, base[1], "far away from all"], [1, 1, 2, 3, 0, 9])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    rows = op5_jaccard.join(make([base[0], base[1], near[0], near[1]], [1, 1, 2, 3]), short_list=1).collect()
    assert {r["component_id"] for r in rows} == {1}


def test_merge_skip_equals_counting():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(rng.choice([8, 60])), rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        for need in (1, 2, 3, 5):
            counts = __import__("collections").Counter(x for y in lists for x in y)
            assert list(op5_jaccard.merge_skip(lists, need)) == sorted((x, c) for x, c in counts.items() if c >= need)


def test_join_gives_disk_back(spark, make):
    """Of all checkpoints and shuffles only what the result reads is left (before: all of them, until the driver collected its garbage)."""
    import pathlib
    import time

    from eponym.llm.common import shared_dir

    shared_dir(spark)
    top = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if f.getName().startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, written, before = set(top.iterdir()), shuffles(), spark.conf.get(key)
    found = op5_jaccard.join(make(near_texts()), short_list=2, block=300)
    assert spark.conf.get(key) == before
    assert len(set(top.iterdir()) - held) <= 4
    for _ in range(50):
        if not shuffles() - written:
            break
        time.sleep(0.1)
    assert not shuffles() - written
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == brute_components(list(enumerate(near_texts())))


def test_hot_shingles_of_many_sizes(make):
    """A passage in every document, so all lists of it are long, and groups of near copies besides."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(rng.choice([2, 4, 30, 300]))]
        for _ in range(3):
            texts.append(" ".join(passage + own + [f"r{rng.randint(0, 9)}"] * rng.randint(0, 1)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_jaccard.join(make(texts), short_list=6, block=400).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_join_edges(make):
    assert op5_jaccard.join(make([])).count() == 0
    assert [tuple(r) for r in op5_jaccard.join(make([None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]
    rows = op5_jaccard.join(make(["a b c d", "a b c d", "a b c d"], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (4, 4), (4, 4)]


def test_search_equals_counting():
    rng = np.random.default_rng(4)
    for spread in (60, 400):
        sets = [np.unique(rng.integers(0, spread, rng.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
        sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], [np.uint64(999)]])) for s in sets[:20]]
        block = op5_jaccard.Block(sets)
        for percent in (50, 80, 90):
            for q in sets[::7]:
                want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))]
                assert sorted(block.search(q, percent)) == want


def test_keep_one(make):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make([text, "other words here for once", text, text, None, ""], [7, 1, 3, 3, 9, None])
    kept = op5_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 3, 9]


# 6: quality rules


def brute_stats(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, c in __import__("collections").Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules_equal_brute_force(make, texts):
    rng = random.Random(1)
    some = texts + ["\n".join(rng.choice(["a b c d e", "f g # h", "", " ", "x | y"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    for r in op6_quality_rules.judge(make(some)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_stats(some[r["doc_id"]])


def brute_kept(docs, max_docs=20, min_words=10):
    """Verdicts from sets of documents, for (doc_id, source, text) rows."""
    lines = {i: [" ".join(re.sub("[0-9]", "0", x.lower()).split()) for x in (t or "").split("\n") if x.strip()] for i, _, t in docs}
    holders = {}
    for i, host, t in docs:
        for x in lines[i]:
            holders.setdefault((host, x), set()).add(t)
    out = {}
    for i, host, t in docs:
        left = sum(len(x.split()) for x in lines[i] if len(holders[host, x]) <= max_docs)
        out[i] = not brute_stats(t)[5] and left >= min_words
    return out


def test_line_frequency(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    menu = [" ".join(word() for _ in range(n)) for n in (4, 4, 3, 40, 5, 4)]
    docs = []
    for k in range(240):
        own = [" ".join(word() for _ in range(rng.choice([2, 4, 12]))) for _ in range(rng.randint(0, 2))]
        picked = menu[: rng.randint(1, 6)] if rng.random() < 0.7 else rng.sample(menu, 2)
        docs.append((k, ["a", "b", "c", None][rng.choice([0, 0, 0, 1, 2, 3])], "\n".join(own[:1] + picked + own[1:])))
    docs += [(1000 + k, "copies", "\n".join(menu)) for k in range(60)]  # copies of one document count once
    docs += [(2000 + k, "over", f"{menu[0].upper()} {k}\n{menu[3]}\n{word()}") for k in range(21)] + [(3000 + k, "at", f"{menu[3]}\n{word()}") for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    got = {r["doc_id"]: r["kept"] for r in op6_quality_rules.judge(frame).collect()}
    want = brute_kept(docs)
    assert got == want
    rejected = {r["doc_id"] for r in op6_quality_rules.judge(frame).where("not kept and not base_failed").collect()}
    assert len(rejected) > 30 and sum(want.values()) > 60 and all(want[1000 + k] for k in range(60))


def letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def test_lines_count_by_document(make):
    header = "welcome to the garden pages of our town\nread about roses tulips and all other flowers\nback to the top"
    assert not any(r["kept"] for r in op6_quality_rules.judge(make([f"{header}\ntitle {letters(k)}" for k in range(60)])).collect())  # inner lines always have the same neighbours
    refrain = "and so the song goes on and on for ever and ever"
    song = "\n".join(f"verse {letters(k)} about {letters(7 * k + 1)}\n{refrain}" for k in range(40))
    rows = {r["doc_id"]: r for r in op6_quality_rules.judge(make([song] + [f"{refrain}\n{letters(k)}" for k in range(5)])).collect()}
    assert all(rows[k]["kept"] for k in range(1, 6))  # six documents hold the line, however often one repeats it


def test_long_lines_are_removed(make):
    notice = " ".join(f"notice{letters(k)}" for k in range(30))
    rows = op6_quality_rules.judge(make([f"{notice}\npage {letters(k)}" for k in range(30)])).collect()
    assert not any(r["kept"] or r["base_failed"] for r in rows)


def test_rules_edges(make, texts):
    assert op6_quality_rules.judge(make([])).count() == 0
    kept = op6_quality_rules.keep_good(make(texts))
    assert kept.columns == make(texts).columns and kept.count() > 0
    assert op6_quality_rules.judge(make(["a b"], [None])).head()["kept"] is False


# 8: licenses


def test_license_rules():
    rules = op8_licenses.rules()
    assert len(rules) > 400 and [r[1] for r in rules] == sorted((r[1] for r in rules), reverse=True)
    for text, label in [
        ("Licensed under the\nApache  License, Version 2.0 (the", "apache-2.0"), ("GNU General Public License version 3", "gpl-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("see https://www.mozilla.org/en-US/MPL/2.0/ for", "mpl-2.0"), ("under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("All rights reserved.", "all-rights-reserved"),
    ]:
        assert [d[0] for d in op8_licenses.detect(text)] == [label], text


def samples(pattern, rng, n=6):
    """Texts that a pattern matches, made from its parts."""
    import re._parser as sre

    def of(parsed):
        out = ""
        for kind, value in parsed:
            if kind is sre.LITERAL:
                out += chr(value)
            elif kind is sre.IN:
                kinds = [k for k in value if k[0] is not sre.NEGATE]
                k, v = rng.choice(kinds)
                if len(kinds) < len(value):
                    out += "q"
                elif k is sre.LITERAL:
                    out += chr(v)
                elif k is sre.RANGE:
                    out += chr(rng.randint(*v))
                else:
                    out += {sre.CATEGORY_SPACE: rng.choice([" ", "\n", "\t"]), sre.CATEGORY_DIGIT: "7"}.get(v, "w")
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                least, most, inner = value
                out += "".join(of(inner) for _ in range(rng.randint(least, min(most, least + 3))))
            elif kind is sre.SUBPATTERN:
                out += of(value[3])
            elif kind is sre.BRANCH:
                out += of(rng.choice(value[1]))
            elif kind is sre.NOT_LITERAL:
                out += "q"
        return out

    return [of(sre.parse(pattern)) for _ in range(n)]


def brute_detect(text):
    """Every rule without gates; a detection inside one of a higher rank goes, looked up among all."""
    low = re.sub("[A-Z]", lambda c: c.group().lower(), text)
    hits = sorted((-r[1], m.start() - m.end(), m.start(), k, m.end(), r[0], r[2]) for k, r in enumerate(op8_licenses.rules()) for m in r[4].finditer(low))
    kept = []
    for _, _, start, _, end, label, doubt in hits:
        if not any(a <= start and end <= b for a, b, _, _ in kept):
            kept.append((start, end, label, doubt))
    return [(label, a, b, d) for a, b, label, d in sorted(kept)]


def test_every_rule_opens_its_gate():
    rng = random.Random(11)
    missed, made = [], 0
    for label, priority, _, keys, pattern in op8_licenses.rules():
        assert keys and min(map(len, keys)) > 0
        for text in samples(pattern.pattern, rng):
            low = text.lower()
            if pattern.search(low):  # a look-ahead may reject the sample
                made += 1
                if not any(k in " ".join(low.split()) for k in keys) or op8_licenses.detect(text) != brute_detect(text):
                    missed.append((label, priority, text))
    assert made > 2000 and not missed


def test_detections_equal_brute_force(spark):
    rng = random.Random(12)
    patterns = [r[4].pattern for r in op8_licenses.rules()]
    texts = [" ".join(rng.choice([w, w.upper()]) for w in ("see", *samples(rng.choice(patterns), rng, 1), "İ and", *samples(rng.choice(patterns), rng, 2), "rest of it")) for _ in range(150)]
    some = 0
    for r in op8_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        want = brute_detect(texts[r["doc_id"]])
        some += len(want) > 1
        assert [tuple(d) for d in r["detections"]] == want
        assert set(r["labels"].split(",")) - {""} == {d[0] for d in want} | set(r["base_labels"].split(",")) - {""}
        assert abs(r["score"] - ((1 - np.prod([d[3] for d in want])) if want else 0.5 * bool(r["base_labels"]))) < 1e-12
    assert some > 60
    long = "licensed under the mit license. " * 4000
    assert len(op8_licenses.detect(long)) == 4000


def test_short_grants():
    for text, label in [("This is licensed under MIT.", "mit"), ("used under Apache-2.0 terms", "apache-2.0"), ("BSD 3-Clause", "bsd-3-clause"), ("released under Artistic 2.0", "artistic-2.0"),
                        ("https://www.perlfoundation.org/artistic", "artistic-2.0"), ("see licence for details", "license-file"), ("see http://www.mozilla.org/MPL/MPL-1.1.html", "mpl-1.1")]:
        assert [d[0] for d in op8_licenses.detect(text)] == [label], text


def test_license_base(make, texts):
    some = texts + ["The MIT License, the mit-license; MITlicense. Apache license General public LICENSE", "mit mit license license"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in op8_licenses.scan(make(some)).collect():
        t = re.sub("[A-Z]", lambda c: c.group().lower(), some[r["doc_id"]] or "")
        words = word.findall(t)
        places, labels = [], set()
        for phrase, label in op8_licenses.PHRASES.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert op8_licenses.scan(make([])).count() == 0


# 9: urls


def test_url_rules(spark):
    urls = ["https://Blog.Example.COM/en/7?x=1", "http://example.com/en/8", "http://a.example.net/de/81", "http://example.net/de/9", "http://x.org/es/1#t", "http://notexample.com/en/7", "no scheme", None, "x://", "http://com/en/"]
    want = [("blog.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("a.example.net", "/de/81", "example.net/de/8", "allow"), ("example.net", "/de/9", "net/de/", "block"),
            ("x.org", "/es/1", "org/es/", "block"), ("notexample.com", "/en/7", "com/en/", "block"), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("com", "/en/", "com/en/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    model = op9_urls.train(pages)
    for r in op9_urls.judge(pages, model).collect():
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert op9_urls.judge(pages.limit(0), model).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    """Each rule gives the word, allow or block, of the contract's list (before: net/de/ blocked and example.net/de/8 allowed)."""
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    words = dict(x.split()[::-1] for x in listed.split(", "))
    assert {host + path: kind for kind, host, path in op9_urls.RULES} == words
    fits = [("com/en/", "http://a.com/en/1"), ("example.com/en/7", "http://b.Example.com/en/71"), ("net/de/", "http://example.net/de/9"), ("net/de/", "http://other.NET/de/8"), ("example.net/de/8", "http://c.example.net/de/8?x"), ("org/es/", "http://org/es/")]
    pages = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(fits)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op9_urls.judge(pages, op9_urls.train(pages)).collect()}
    assert got == {i: (rule, words[rule]) for i, (rule, _) in enumerate(fits)}


def brute_trees(trees, x):
    """Sums of the leaves that each row reaches, one row and one tree at a time."""
    out = []
    for row in x:
        total = trees.start
        for t in trees.trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_url_model(spark):
    """Held-out pages: the trees rank those that rules block above the others, and beat the share of the larger class."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = pages.where("page_id % 5 = 0")
    model = op9_urls.train(pages.where("page_id % 5 <> 0"))
    rows = op9_urls.labelled_urls(held, most=100_000)
    assert len(rows) == held.where("url like '%://%'").count()
    s, y = model.scores([u for u, _ in rows]), np.array([v for _, v in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5
    assert auc >= 0.6 and np.mean((s >= 0.5) == y) >= max(y.mean(), 1 - y.mean()) - 0.01, (auc, np.mean((s >= 0.5) == y))
    x = model.features.matrix([u for u, _ in rows[:200]])
    assert np.allclose(model.trees.score(x), brute_trees(model.trees, x))
    got = {r["page_id"]: r for r in op9_urls.judge(held, model).collect()}
    urls = {r["page_id"]: r["url"] for r in held.select("page_id", "url").collect()}
    some = [i for i, r in got.items() if r["rule"] is None][:300]
    assert [got[i]["verdict"] for i in some] == ["block" if v >= 0.5 else "allow" for v in model.scores([urls[i] for i in some])]


def test_url_model_learns_lexical_features():
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    made = [(f"http://{word(8)}.{'top' if y else 'org'}/{word(4)}?{'&'.join(f'{word(2)}={rng.randint(1, 10**6)}' for _ in range(4 if y else 1))}", y) for y in [0, 1] * 1500]
    model = op9_urls.Model(made[:2400])
    s = model.scores([u for u, _ in made[2400:]])
    assert np.mean((s >= 0.5) == np.array([y for _, y in made[2400:]])) > 0.95
    assert op9_urls.Model([]).scores(["http://a.b/", None, ""]).tolist() == [0, 0, 0]
    assert op9_urls.Model([("http://a.b/", 1)]).scores(["x"]).tolist() == [0.99]


def test_url_edges(spark):
    pages = spark.createDataFrame([(None, "http://x.com/en/1"), (1, None), (1, None), (2, "h" * 100_000)], "page_id long, url string")
    rows = op9_urls.judge(pages, op9_urls.train(pages)).collect()
    assert len(rows) == 4 and {r["verdict"] for r in rows if r["page_id"] is None} == {"block"}
    assert len({r["verdict"] for r in rows if r["page_id"] == 1}) == 1


# 10: fingerprints


def brute_fingerprint(text):
    e = op10_fingerprints.embedding()
    sums, j = np.zeros(op10_fingerprints.BINS), 0
    for c in e.classes(text):
        sums += e.sums(np.array([c], np.uint8), np.array([j]), np.array([0]), 1)[0]
        j += int(e.steps[c, j & (op10_fingerprints.PERIOD - 1)])
    return op10_fingerprints.text_of(np.sign(sums).astype(np.int8)[None])[0]


@pytest.mark.parametrize("shard_docs", [3, 8192])
def test_fingerprints(make, texts, shard_docs):
    some = [t if t is None else t[:3000] for t in texts]
    ids = [9 * i % 31 for i in range(len(some))]
    got = {r["doc_id"]: r for r in op10_fingerprints.with_edited(make(some, ids), shard_docs=shard_docs, batch_chars=2000).collect()}
    order = sorted(zip(ids, some), reverse=True, key=lambda x: x[0])
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute_fingerprint(a), brute_fingerprint(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_long_texts_and_ties(spark):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    long = word(150_000)  # its walk goes round the shared bits several times
    docs = [(3, long), (2, long[:70_000] + "X" + long[70_001:]), (1, word(150_000))] + [(0, word(50)) for _ in range(30)] + [(None, "n")]
    rows = op10_fingerprints.with_edited(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs=5).collect()
    assert len(rows) == len(docs)
    of = {r["n_chars"] * 10 + (r["doc_id"] or 0): r for r in rows if r["doc_id"]}
    assert of[1_500_003]["fingerprint"] == brute_fingerprint(long) and of[1_500_003]["near_next"] > 0.9 and of[1_500_002]["near_next"] < 0.3
    edited = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in (t for _, t in docs) for b in (t for _, t in docs)}
    assert all(r["edited_sha256"] in edited for r in rows)


def test_fingerprint_likeness(make):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    near, far = base[:700] + "X" + base[700:1500] + base[1503:], "".join(rng.choice("abcdefgh ") for _ in range(2000))
    f = op10_fingerprints.with_edited(make([base, near, far, base]))
    links = {(r["doc_id"], r["near_id"]) for r in op10_fingerprints.near_links(f).collect()}
    assert links == {(1, 0), (3, 0)}
    rows = {r["doc_id"]: r for r in f.collect()}
    assert rows[0]["fingerprint"] == rows[3]["fingerprint"] and rows[1]["near_next"] > 0.9 and rows[2]["near_next"] < 0.4


def test_fingerprint_edges(make):
    assert op10_fingerprints.with_edited(make([])).count() == 0
    one = op10_fingerprints.with_edited(make(["abc"])).head()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()
    rows = op10_fingerprints.with_edited(make(["b", "a", None], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == [(-1, 0), (4, 1), (4, 1)]


def brute_likeness(signs):
    f = signs.astype(float)
    norm = np.sqrt((f * f).sum(axis=1))
    return np.sin(np.pi / 2 * np.clip(f @ f.T / np.maximum(np.outer(norm, norm), 1e-12), 0, 1))


@pytest.mark.parametrize("block", [4096, 3])
def test_near_links_beyond_bucket_heads(spark, block):
    rng = np.random.default_rng(8)
    n, twins = 6000, 300
    signs = rng.choice(np.array([-1, 1], np.int8), (n, op10_fingerprints.BINS))
    near = signs[-twins:].copy()
    for row in near:
        row[rng.choice(op10_fingerprints.BINS, 8, replace=False)] *= -1
    signs = np.concatenate([signs, near, near[:5]])
    frame = spark.createDataFrame(list(enumerate(op10_fingerprints.text_of(signs))), "doc_id long, fingerprint string").repartition(4)
    like = brute_likeness(signs)
    want = {(int(j), int(i)) for i, j in np.argwhere(np.triu(like >= 0.8, 1))}
    links = [(r["doc_id"], r["near_id"]) for r in op10_fingerprints.near_links(frame, block=block).collect()]
    copies = {(n + twins + k, n - twins + k) for k in range(5)}  # a copy's links are those of the first of its class
    assert len(want) == twins + 10 and len(links) == len(set(links)) and set(links) == want - copies
    got = {r["doc_id"]: (r["n_near"], r["near_id"]) for r in op10_fingerprints.near_counts(frame, block=block).collect()}
    assert got == {i: (int((row >= 0.8).sum()) - 1, int(np.flatnonzero(row >= 0.8)[0])) for i, row in enumerate(like)}


def test_banding_recall(spark):
    """Near pairs of fingerprints of the tables' texts, against all pairs."""
    f = op10_fingerprints.with_edited(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("doc_id", "fingerprint").checkpoint()
    links = {(r["doc_id"], r["near_id"]) for r in op10_fingerprints.near_links(f).collect()}
    frame = f.toPandas().groupby("fingerprint")["doc_id"].min().reset_index()
    signs, ids = op10_fingerprints.signs_of(frame["fingerprint"].tolist()), frame["doc_id"].to_numpy()
    near = {(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in np.argwhere(np.triu(brute_likeness(signs) >= 0.8, 1))}
    assert len(near) > 100 and len(near & links) >= 0.9 * len(near)
    assert {x for x in links if x[0] in set(ids) and x[1] in set(ids)} <= near
    for n in (1000, 10**6, 10**8):
        bands, bins = op10_fingerprints.banding(n, 0.8)
        assert n >> bins < 2000 and 1 - (1 - ((1 + np.arcsin(0.8) * 2 / np.pi) / 2) ** bins) ** bands >= 0.9


def test_bucket_links():
    rng = np.random.default_rng(9)
    signs = rng.choice(np.array([-1, 0, 1], np.int8), (90, op10_fingerprints.BINS))
    signs = np.concatenate([signs, np.where(rng.random(signs.shape) < 0.05, 0, signs), np.where(rng.random(signs.shape) < 0.2, -signs, signs)]).astype(np.int8)
    every, keys = np.arange(len(signs)), op10_fingerprints.band_keys(signs, 5, 4)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(brute_likeness(signs) >= 0.8, 1)) if not (keys[i, :3] == keys[j, :3]).any()}
    words = np.frombuffer(bytes.fromhex("".join(op10_fingerprints.text_of(signs))), np.uint64).reshape(len(signs), -1)
    few = op10_fingerprints.small_links(words, np.full(len(signs), len(signs)), np.full(len(signs), 3), 5, 4, 0.8)
    for found in (few, op10_fingerprints.bucket_links(signs, every, every, 3, 4, 0.8, rows=50)):
        links = [(int(i), int(j)) for x, y, _ in found for i, j in zip(x, y)]
        assert want and len(links) == len(want) and set(links) == want
