"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut).
Pieces are dealt by their place into blocks of about ``block_pieces``; each block is packed by
best fit in descending order, then improved by local search over its underfull bins:
moving a piece, exchanging one for one, one for two, or two for one, whenever that raises
the sum of squared fills, until the emptiest bins run empty. Bins that stay clearly
underfull are taken apart and packed again with those of other blocks, round after round,
until what is left is one block, so the waste is about one bin for all blocks together. A block has a fixed size whatever the input,
so no task grows with the corpus, and a lost one is redone from the checkpointed pieces.

Defined cases: null text counts as empty; an empty document is one piece holding only
the end id; repeated rows are packed as often as they occur; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table, task_memory
from .tokens import WORD_TOKENIZER, tokenizer_path, word_encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document."""

    def cut(batches):
        encoder, end = word_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        with task_memory(encoder):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    rows = []
                    for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                        ids += end
                        n = len(ids) // 4
                        for k, s in enumerate(range(0, n, capacity)):
                            rows.append((doc, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit in descending order: bins as lists of indices."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gap = np.zeros(capacity + 1, dtype=bool)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        gap = n + int(open_gap[n:].argmax())
        if open_gap[gap]:
            b = by_gap[gap].pop()
            open_gap[gap] = bool(by_gap[gap])
        else:
            b, gap = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_gap[gap - n].append(b)
        open_gap[gap - n] = True
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties underfull bins by exchanges that raise the sum of squared fills.

    The emptiest bin gives tokens to a fuller one by a move (x for nothing), an exchange
    of x for a shorter y, of x for two shorter pieces, or of two pieces for one longer
    one. Each step takes from a bin no fuller than the one that gains, so the sum of
    squares grows and the search ends. It stops early at the fewest bins possible.
    """
    fewest = math.ceil(int(lengths.sum()) / capacity)
    fill = [int(lengths[b].sum()) for b in bins]
    alive = len(bins)
    rest = {b for b in range(len(bins)) if fill[b] < capacity}
    stuck: set[int] = set()
    while alive > fewest and len(rest) > 1:
        open_bins = [b for b in rest if b not in stuck]
        if not open_bins:
            break
        target = min(open_bins, key=lambda b: (fill[b], b))
        step = _best_step(target, [b for b in rest if b != target and fill[b] >= fill[target]], bins, fill, lengths, capacity)
        if step is None:
            stuck.add(target)
            continue
        other, give, take = step
        gain = int(lengths[give].sum()) - (int(lengths[take].sum()) if take else 0)
        bins[target] = [i for i in bins[target] if i not in give] + take
        bins[other] = [i for i in bins[other] if i not in take] + give
        fill[target] -= gain
        fill[other] += gain
        if fill[other] == capacity:
            rest.discard(other)
        stuck.clear() if gain > capacity // 64 else stuck.discard(other)
        if not bins[target]:
            rest.discard(target)
            alive -= 1
    return [b for b in bins if b]


def _by_length(members: list[int], lengths: np.ndarray):
    """Distinct lengths of a bin's pieces, a piece of each, and the sums of two pieces with such a pair.

    A bin has few distinct lengths (a sum of k of them is at least k * (k + 1) / 2), however
    many pieces it holds, and pieces of equal length can stand in for one another.
    """
    of: dict[int, list[int]] = {}
    for i in members:
        of.setdefault(int(lengths[i]), []).append(i)
    x = np.array(sorted(of), dtype=np.int64)
    p, q = np.triu_indices(len(x))
    again = np.array([len(of[n]) > 1 for n in x.tolist()])
    some = (p != q) | again[p]
    p, q = p[some], q[some]
    return of, x, x[p] + x[q], p, q


def _best_step(target, others, bins, fill, lengths, capacity):
    """The exchange that moves most tokens out of ``target``: (bin, given, taken)."""
    if not others:
        return None
    of, x, sums, p, q = _by_length(bins[target], lengths)
    gaps = np.array([capacity - fill[b] for b in others])
    for n in x[::-1].tolist():  # a move: the longest piece that fits, where it fits best
        fit = np.where(gaps >= n, gaps, capacity + 1)
        if fit[j := int(fit.argmin())] <= capacity:
            return others[j], [of[n][0]], []
    best, found = 0, None
    for j, b in enumerate(others):
        gap = int(gaps[j])
        if gap <= best:
            continue
        y_of, y, y_sums, r, s = _by_length(bins[b], lengths)
        for give, take in ((x, y), (x, y_sums), (sums, y)):  # one for one, one for two, two for one
            if not len(give) or not len(take):
                continue
            # the best partner of each given length is the shortest taken one that still fits
            at = np.searchsorted(take_sorted := np.sort(take), give - gap)
            ok = at < len(take)
            gain = np.where(ok, give - take_sorted[np.minimum(at, len(take) - 1)], -1)
            if gain.max() > best:
                best, k = int(gain.max()), int(gain.argmax())
                m = int(np.flatnonzero(take == take_sorted[at[k]])[0])
                given = [of[int(x[k])][0]] if give is x else _two(of, x, p[k], q[k])
                taken = [y_of[int(y[m])][0]] if take is y else _two(y_of, y, r[m], s[m])
                found = (b, given, taken)
    return found


def _two(of, x, p, q) -> list[int]:
    """Two pieces of the lengths at places ``p`` and ``q``."""
    return of[int(x[p])][:2] if p == q else [of[int(x[p])][0], of[int(x[q])][0]]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    lengths = np.asarray(lengths, dtype=np.int64)
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_round(rows: DataFrame, turn: int, blocks: int, capacity: int) -> DataFrame:
    """Packs every block; ``waste`` is the room left in a row's bin.

    ``rows`` is a written table, so places in it are the same in every attempt. Blocks are
    dealt by place and not by any column, so repeated rows and null doc_ids are spread.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        sequence, offset, waste = (np.zeros(len(frame), dtype=np.int64) for _ in range(3))
        base = (turn << 58) | (int(frame["block"].iloc[0]) << 24)
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            ends = np.cumsum(lengths[members])
            sequence[members], offset[members], waste[members] = base | k, ends - lengths[members], capacity - ends[-1]
        return frame.drop(columns="block").assign(sequence_id=sequence, offset=offset, waste=waste)

    salted = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(blocks)))
    return salted.groupBy("block").applyInPandas(pack, PACKED + ", waste long")


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block_pieces: int = 8000, loose: float = 0.02) -> DataFrame:
    """Packs all documents; one row per piece with its sequence and its place there.

    ``block_pieces``: pieces per block. ``loose``: bins with more than this share of room
    left are taken apart after each round and packed again together, until they fit into
    one block or a repacking round no longer halves them.
    """
    rows = checkpointed(pieces(docs, path, end_id, capacity))
    names = [c.split()[0] for c in PACKED.split(", ")]
    n, turn, done = rows.count(), 0, []
    while True:
        packed = _pack_round(rows, turn, max(1, math.ceil(n / block_pieces)), capacity)
        if n <= block_pieces:
            break
        packed = checkpointed(packed)
        is_loose = F.col("waste") > int(loose * capacity)
        again = packed.where(is_loose).select(*[c.split()[0] for c in PIECES.split(", ")])
        left = again.count()
        if turn and 2 * left > n:
            break
        done.append(packed.where(~is_loose).select(*names))
        rows, n, turn = checkpointed(again), left, turn + 1
    return functools.reduce(DataFrame.unionByName, [*done, packed.select(*names)])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
