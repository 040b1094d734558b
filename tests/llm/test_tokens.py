import hashlib
import random
import zlib

import numpy as np
import pytest

from eponym.llm import op1_packing, op2_simple8b, op4_bpe
from eponym.llm.tokens import BYTE_TOKENIZER, WORD_TOKENIZER, WordEncoder, tokenizer, tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = tokenizer_path(WORD_TOKENIZER), tokenizer_path(BYTE_TOKENIZER)
PARTS = ["a", "b", "Hello", "world,", " ", "  ", "\n", "\t", "'s", "'ll", "é", "É", "\u00a0", "\u3000", "你", "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", "!!", "\u0301", "\x1c", "\x85", "😀", "ab cd ef", "\u200b", "İ", "ª", "ΑΣ", "ς"]


def plain(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def noise(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_words_once_equal_library():
    e = WordEncoder(WORD, most_words=50, longest_word=6)
    for some in (noise(1), noise(2)):
        assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(some)] == [plain(WORD, t) for t in some]
        e.clear()


def test_words_with_marks_equal_library():
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha()]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    some = [" ".join("".join(rng.choices(letters, k=rng.randint(0, 9)) + rng.choices(marks, k=rng.randint(0, 4))) for _ in range(200)) for _ in range(100)]
    some += [" ".join(c * k + m for c in letters for k in (1, 2)) for m in ("", *marks, "<|", "|>", "'s", "'s#", "#'s", "\u0301#", "<|endoftext|>", "#<|endoftext|>")]
    assert [np.frombuffer(i, "<u4").tolist() for i in WordEncoder(WORD).encode(some)] == [plain(WORD, t) for t in some]


def test_marked_words_do_not_go_one_by_one():
    e, alone = WordEncoder(WORD), []
    assert e.bare and {*".,!?;:|#*$%&_"} <= {*e.marks}
    each = e._each
    e._each = lambda words: alone.extend(words) or each(words)
    some = [" ".join(f"{a}{b}ß{m}" for a in "abcdefgh" for b in "xyzéà" for m in (",", "###", ".$$$", "%%%", ")&"))]
    assert [np.frombuffer(i, "<u4").tolist() for i in e.encode(some)] == [plain(WORD, t) for t in some]
    assert sorted(alone) == sorted([",", "###", ".$$$", "%%%", ")&"])


@pytest.mark.parametrize("bits,most", [(2, 2_000), (4, 10**6), (8, 10**6)])
def test_chunks_equal_library(bits, most):
    e = op4_bpe.ChunkEncoder(BYTE, chunk_bits=bits, most_chars=most)
    for some in (noise(3, 250), noise(3, 250), [" ".join(noise(4, 30))]):
        got = e.encode(some)
        assert [np.frombuffer(i, "<u4").tolist() for i in got] == [plain(BYTE, t) for t in some]
        assert [e.decode(i) for i in got] == [tokenizer(BYTE).decode(plain(BYTE, t), skip_special_tokens=False) for t in some]


def test_chunks_are_shared():
    e = op4_bpe.ChunkEncoder(BYTE, chunk_bits=4)
    passage = " ".join(f"shared{i} passage" for i in range(300))
    e.encode(["start one " + passage + " end"])
    before = len(e.known)
    e.encode(["another beginning, longer " + passage + " and another end"])
    assert len(e.known) - before < 12


def test_windows_grow_until_chunks_agree():
    text = " ".join(f"word{i} and some more, number {i * i};" for i in range(400))
    e = op4_bpe.ChunkEncoder(BYTE, chunk_bits=5)
    e.encode([text])
    assert len(e.joins) > 50 and not e.grown
    chunks = [c for c in e.known.values() if c.places]
    for c in chunks[3::4]:  # ids at the ends of some chunks are made wrong: no window agrees with them
        c.head, c.tail = b"\xff" * len(c.head), b"\xff" * len(c.tail)
    e.joins.clear()
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == plain(BYTE, text) and e.grown > 0
    for c in chunks:
        c.head = c.tail = b"\xff\xff\xff\xff"
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == plain(BYTE, text)
    long = "x" * 300_000 + " " + "ab cd " * 60_000
    assert np.frombuffer(op4_bpe.ChunkEncoder(BYTE).encode([long])[0], "<u4").tolist() == plain(BYTE, long)


def test_op4_query(make, texts):
    got = {r["doc_id"]: r for r in op4_bpe.round_trip(make(texts), BYTE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = plain(BYTE, t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer(BYTE).decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = op4_bpe.decode(op4_bpe.encode(make(texts), BYTE), BYTE)
    assert {r["doc_id"]: r["text"] for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert op4_bpe.round_trip(make([]), BYTE).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_simple8b_words():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lengths = rng.integers(1, 200, rng.integers(1, 20))
        ids = rng.integers(0, 2**60, int(lengths.sum()), dtype=np.uint64) >> rng.integers(0, 60, int(lengths.sum())).astype(np.uint64)
        words, sizes = op2_simple8b.encode_ids(ids, lengths)
        assert (op2_simple8b.decode_words(words) == ids).all() and sizes.sum() == len(words)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        assert [len(op2_simple8b.decode_words(words[a:b])) for a, b in zip(cut, cut[1:])] == lengths.tolist()
    ones, _ = op2_simple8b.encode_ids(np.ones(600, np.uint64), np.array([600]))
    assert len(ones) == 10
    escape, _ = op2_simple8b.encode_ids(np.array([2**40, 3], np.uint64), np.array([2]))
    assert (escape >> np.uint64(60)).tolist() == [13, 13] and op2_simple8b.decode_words(escape).tolist() == [2**40, 3]


@pytest.mark.parametrize("shard_docs", [3, 8192])
def test_op2_query(make, texts, shard_docs):
    ids = [50 - 3 * i for i in range(len(texts))]
    rows = sorted(zip(ids, texts))
    got = {r["doc_id"]: r for r in op2_simple8b.write_and_read(make(texts, ids), WORD, shard_docs=shard_docs).collect()}
    start = 0
    for i, t in rows:
        want = plain(WORD, t) + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), crc(want))
        start += len(want)


def test_op2_edges(make):
    assert op2_simple8b.write_and_read(make([]), WORD).count() == 0
    same = op2_simple8b.write_and_read(make(["a", "b", "a"], [5, 5, None]), WORD, shard_docs=1).orderBy("start").collect()
    assert [r["doc_id"] for r in same] == [None, 5, 5] and [r["start"] for r in same] == [0, 2, 4]


def test_file_format(tmp_path, spark, make, texts):
    made = op2_simple8b.write(make(texts), WORD, 2, str(tmp_path / "t"), shard_docs=4, block_ids=50).collect()
    assert sum(r["n_docs"] for r in made) == len(texts)
    back = [(int(d), ids[a:b].tolist()) for r in sorted(made, key=lambda r: r["shard"]) for docs, _, n, ids in op2_simple8b.read_file(r["path"]) for d, a, b in zip(docs, np.cumsum(n) - n, np.cumsum(n))]
    assert back == [(i, plain(WORD, t) + [2]) for i, t in enumerate(texts)]


def test_shards_split_repeated_ids(spark):
    from pyspark.sql import functions as F

    from eponym.llm.common import RangeShards

    rows = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"), F.xxhash64("id").alias("spread"))
    shards = RangeShards(rows, 1000)
    held = rows.toPandas()
    of = shards.of(held["id"].to_numpy(), held["spread"].to_numpy())
    assert shards.shards == 20 and np.bincount(of, minlength=20).max() < 2500 and len(set(of[held["id"] == 7])) >= 8
    order = np.lexsort((held["spread"], held["id"]))
    assert (np.diff(of[order]) >= 0).all()


def test_null_lowest_and_repeated_ids(spark, tmp_path):
    texts = [(None, "a b"), (-(2**63), "c"), (5, "d e f"), (5, "g"), (None, None), (5, "d e f"), (0, "zero")] + [(9, f"many {k}") for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = op2_simple8b.write_and_read(frame, WORD, shard_docs=6).collect()
    assert len({r["start"] for r in rows}) == len(texts) and sum(r["n_tokens"] for r in rows) == sum(len(plain(WORD, t)) + 1 for _, t in texts)
    by_place = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_place] == [None, None, -(2**63), 0, 5, 5, 5] + [9] * 40
    assert sorted(r["ids_crc32"] for r in rows) == sorted(crc(plain(WORD, t) + [2]) for _, t in texts)


def test_packing_small():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.integers(1, 100, rng.integers(1, 60))
        bins = op1_packing.pack_lengths(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 100 for b in bins)
        assert len(bins) <= len(op1_packing.best_fit(lengths, 100))


def test_local_search_empties_bins():
    lengths = np.array([60, 60, 40, 40])
    assert len(op1_packing.local_search([[0, 2], [1], [3]], lengths, 100)) == 2  # a move
    lengths = np.array([70, 50, 50, 30])
    assert len(op1_packing.local_search([[0], [1, 3], [2]], lengths, 100)) == 2  # one for one
    lengths = np.array([50, 50, 60, 30, 10])
    before = [[0, 3, 4], [1], [2]]
    assert len(op1_packing.local_search(before, lengths, 100)) == 2  # one for two


def test_exchanges_of_many_small_pieces():
    """The best exchange of bins with hundreds of pieces, against all of them."""
    rng = np.random.default_rng(12)
    for _ in range(30):
        lengths = np.concatenate([rng.integers(21, 40, 150), rng.integers(15, 60, 130)])
        capacity = int(lengths[150:].sum()) + int(rng.integers(1, 14))
        bins, fill = [list(range(150)), list(range(150, 280))], [int(lengths[:150].sum()), int(lengths[150:].sum())]
        gap, x, y = capacity - fill[1], lengths[:150], lengths[150:]
        two = lambda a: (a[:, None] + a[None, :])[np.triu_indices(len(a), 1)]
        gains = np.concatenate([np.subtract.outer(p, q).ravel() for p, q in ((x, y), (x, two(y)), (two(x), y))])
        want = gains[(gains <= gap) & (gains > 0)].max(initial=0)
        other, give, take = op1_packing._best_step(0, [1], bins, fill, lengths, capacity)
        assert other == 1 and int(lengths[give].sum() - lengths[take].sum()) == want and set(give) <= set(bins[0]) and set(take) <= set(bins[1])


def test_repeated_rows_are_spread_over_blocks(spark):
    rows = spark.createDataFrame([(7 if k % 2 else None, 0, 0, 5, 1) for k in range(6000)], op1_packing.PIECES).repartition(3).checkpoint()
    packed = op1_packing._pack_round(rows, 0, 10, 100)
    held = [r["count"] for r in packed.selectExpr("shiftright(sequence_id, 24) as block").groupBy("block").count().collect()]
    assert len(held) == 10 and max(held) < 800


@pytest.mark.parametrize("block,above", [(20, 5), (8000, 1)])
def test_op1_query(make, texts, block, above):
    texts = texts + ["filler " * k for k in range(1, 60)]
    rows = op1_packing.pack(make(texts), WORD, block_pieces=block).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        want, mine = plain(WORD, t) + [1], sorted(of[i], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(want), 4096))
        assert all(r["ids_crc32"] == crc(want[r["start"] : r["start"] + r["length"]]) for r in mine) and sum(r["length"] for r in mine) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 4096) + above
    assert op1_packing.pack(make([]), WORD).count() == 0
    assert op1_packing.pack(make(["a", "a"], [1, 1]), WORD).count() == 2
