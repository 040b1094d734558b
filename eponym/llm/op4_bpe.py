"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 code points cuts every text where its low bits are zero, so equal
passages of different documents fall into equal chunks. Every distinct chunk is encoded
once, as a text of its own; its ids are wrong only near its ends, where a token or a
pre-token of the whole text may cross the cut. The join of two chunks is therefore encoded
again, over a window that reaches from the last but one settled place of the left chunk to
the second of the right one (a settled place is a space after a visible character; the
tokenizer's split puts a boundary there whatever stands around). Window and chunks agree
where they overlap if the window's first ids are the left chunk's ids between its last two
settled places, and its last ids the right chunk's between its first two. If they do not,
or a chunk has no two such places with token boundaries at them, the window grows over
that chunk to the next one and is encoded again, until both sides agree exactly or the
window has reached the ends of the text.

Chunks and windows are kept in a table of the worker's task, bounded by the characters it
holds: when full it keeps only what the current texts need, which costs time and changes
no result. Nothing is shuffled, so a lost task is just run again; a passage is encoded once
by every task that meets it.

Defined cases: null text counts as empty, with no ids and an empty decoded text; a text
without cuts is one chunk; texts of any length are encoded whole; repeated rows give
repeated results; a null doc_id stays null; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are ignored. The end-of-text string inside a text
becomes its special id, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, task_memory, utf8
from .tokens import BYTE_TOKENIZER, no_collector, tokenizer, tokenizer_path

#: Code points that the tokenizer's \s matches (fixed values).
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
SPACE_SET = frozenset(SPACES.tolist())
ENCODED = "doc_id long, n_tokens long, ids binary"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunk:
    """Ids of a chunk as a text of its own, and its first and last two settled places.

    ``ids`` are those between the first and the last settled place; ``head`` and ``tail``
    those between the first two and the last two. ``places`` (in code points) is None where
    the chunk has no two settled places at token boundaries.
    """

    __slots__ = ("places", "ids", "head", "tail", "whole")

    def __init__(self, whole: bytes):
        self.whole, self.places = whole, None


def outer_settled(text: str) -> tuple[int, int, int, int] | None:
    """The first two and the last two places of spaces after visible characters."""

    def found(at):
        c = text[at - 1]
        return c > " " and (c < "\x7f" or ord(c) not in SPACE_SET)

    outer = []
    for step, at, end in ((text.find, 0, None), (text.rfind, None, 0)):
        for _ in range(2):
            while True:
                at = step(" ", at + 1) if end is None else step(" ", 0, at)
                if at <= 0:
                    return None
                if found(at):
                    break
            outer.append(at)
    first, second, last, before = outer
    return (first, second, before, last) if first < last else None


class ChunkEncoder:
    """Encodes whole texts, each distinct chunk and window once."""

    def __init__(self, path: str, chunk_bits: int = 10, most_chars: int = 12_000_000):
        self.library = tokenizer(path)
        self.mask, self.most_chars = np.uint32((1 << chunk_bits) - 1), most_chars
        self.known: dict[str, Chunk] = {}
        self.joins: dict[str, bytes] = {}
        self.held = 0
        self.met = self.encoded = self.grown = 0  # characters met and encoded, windows that had to grow
        chars = byte_of_char()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bytes_of: list[bytes] = []
        for i in range(size):
            token = self.library.id_to_token(i) or ""
            self.bytes_of.append(bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode())
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def cuts(self, text: str) -> list[int]:
        """Where chunks begin and end."""
        if len(text) < 32:
            return [0, len(text)]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = points * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        for step, power in ((1, 31), (2, 961), (4, 923521), (8, 2498845121 % 2**32)):
            h = h[:-step] * np.uint32(power) + h[step:]
        at = np.flatnonzero((h >> np.uint32(13)) & self.mask == 0) + 16
        return [0, *at[at < len(text)].tolist(), len(text)]

    def encode(self, texts) -> list[bytes]:
        with no_collector():
            return self._encode([t or "" for t in texts])

    def _library(self, texts: list[str]) -> list[list[int]]:
        self.encoded += sum(map(len, texts))
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts) -> list[bytes]:
        split = []
        for t in texts:
            edges = self.cuts(t)
            split.append((edges, [t[a:b] for a, b in zip(edges, edges[1:])]))
            self.met += len(t)
        new = {c for _, chunks in split for c in chunks if c and c not in self.known}
        self._make_room(new, split)
        self._learn(list(new))
        # every text as a list of its chunks that have settled places; the windows between them come next
        plans = [[(a, c) for a, text in zip(edges, chunks) if text and (c := self.known[text]).places] for edges, chunks in split]
        out: list[bytes | None] = [None] * len(texts)
        waiting = []
        for k, (text, (edges, chunks)) in enumerate(zip(texts, split)):
            if len(chunks) == 1:
                out[k] = self.known[text].whole if text else b""
            else:
                waiting.append(k)
        while waiting:
            windows = {k: self._windows(texts[k], plans[k]) for k in waiting}
            fresh = list({w for ws in windows.values() for w in ws if w not in self.joins})
            for w, ids in zip(fresh, self._library(fresh)):
                self.joins[w] = np.array(ids, dtype="<u4").tobytes()
                self.held += len(w)
            again = []
            for k in waiting:
                plan = plans[k]
                joined, rejected = self._join(plan, windows[k])
                if rejected:
                    self.grown += len(rejected)
                    plans[k] = [x for n, x in enumerate(plan) if n not in rejected]
                    again.append(k)
                else:
                    out[k] = joined
            waiting = again
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks and finds the ids at their outermost settled places, for all at once."""
        got = self._library(chunks)
        counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), dtype="<u4", count=int(counts.sum()))
        ends = np.cumsum(self.sizes[flat])
        past = np.cumsum(counts)
        total = np.concatenate([[0], ends])[past]  # bytes up to the end of each chunk
        raw, start, from_byte = flat.tobytes(), (4 * (past - counts)).tolist(), 0
        outer, where, made = [], [], []
        for text, a, b, to_byte in zip(chunks, start, (4 * past).tolist(), total.tolist()):
            self.known[text] = chunk = Chunk(raw[a:b])
            places = outer_settled(text)
            if places:
                outer.append(places)
                made.append((chunk, text))
                if to_byte - from_byte == len(text):
                    where.append([from_byte + i for i in places])
                else:
                    where.append([from_byte + len(text[:i].encode("utf-8", "surrogatepass")) for i in places])
            from_byte = to_byte
        if not made:
            return
        want = np.array(where, dtype=np.int64)
        at = np.searchsorted(ends, want.ravel()).reshape(want.shape)
        sound = ((at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] == want)).all(axis=1).tolist()
        for (chunk, _), places, cut, ok in zip(made, outer, (4 * (at + 1)).tolist(), sound):
            if ok:
                first, second, before, last = cut
                chunk.places, chunk.ids, chunk.head, chunk.tail = places, raw[first:last], raw[first:second], raw[before:last]

    def _make_room(self, new: set[str], split) -> None:
        size = sum(map(len, new))
        if self.held + size > self.most_chars:
            needed = {c for _, chunks in split for c in chunks}
            self.known = {c: x for c, x in self.known.items() if c in needed}
            self.joins.clear()
            self.held = sum(map(len, self.known))
        self.held += size

    @staticmethod
    def _windows(text: str, plan) -> list[str]:
        """The text's parts between its chunks, overlapping each by its outermost two settled places."""
        starts = [0, *(a + c.places[2] for a, c in plan)]
        ends = [*(a + c.places[1] for a, c in plan), len(text)]
        return [text[a:b] for a, b in zip(starts, ends)]

    def _join(self, plan, windows: list[str]) -> tuple[bytes, set[int]]:
        """Ids of the text, or the chunks of ``plan`` with which a window does not agree."""
        parts, rejected = [], set()
        for n, window in enumerate(windows):
            ids = self.joins[window]
            tail = plan[n - 1][1].tail if n else b""
            head = plan[n][1].head if n < len(plan) else b""
            if tail and not ids.startswith(tail):
                rejected.add(n - 1)
            if head and not ids.endswith(head):
                rejected.add(n)
            if len(ids) < len(tail) + len(head):
                rejected.update(m for m in (n - 1, n) if 0 <= m < len(plan))
            parts.append(ids[len(tail) : len(ids) - len(head)])
            if n < len(plan):
                parts.append(plan[n][1].ids)
        return b"".join(parts), rejected

    def clear(self) -> None:
        self.known.clear()
        self.joins.clear()
        self.held = 0

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document with its ids as little-endian uint32 bytes."""

    def run(batches):
        encoder = chunk_encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        with task_memory(encoder):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    ids = encoder.encode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of ``encode`` with the decoded text."""

    def run(batches):
        encoder = chunk_encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encoder.decode(i) for i in part.column(2).to_pylist()], pa.string())], schema=schema)

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every document in one pass; digests of ids and decoded text."""

    def run(batches):
        encoder = chunk_encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        with task_memory(encoder):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    ids = encoder.encode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array([len(i) // 4 for i in ids], pa.int64()),
                            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                            pa.array([hashlib.sha256(utf8(encoder.decode(i))).hexdigest() for i in ids]),
                        ],
                        schema=schema,
                    )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))
