"""Token ids in files, by Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload: the selector
names how many ids of how many bits the payload packs (lowest bits first). An id that no
packed width of a run suits stands alone in an escape word (selector 13, up to 60 bits).
Encoding picks the greedy longest run at each place from sliding maxima of the ids' bit
lengths; a run never crosses a document. Decoding handles all words of a block at once.

File: blocks one after another, then an index, then a footer. A block is the words of
whole documents, about ``block_ids`` ids. The index holds, as little-endian arrays, per
document its doc_id (int64), its number of ids (int64) and whether its doc_id is known or
null (a byte), and per block its byte offset, words, first document, documents and ids
(int64 each), so any block can be decoded alone. The footer
is documents, blocks, ids, the index's byte offset (int64 each) and the magic ``EPS8B001``.

Documents are encoded where they are read; the coded documents (not the texts) are dealt
to shards by ranges of doc_id and place, whose bounds come from a sample of these alone, so
rows of one doc_id can fill many shards, and sorted. A shard has about ``shard_docs``
documents however many there are; the driver holds a few sampled ids and one row a shard. A shard is written to the session's shared folder under a name of its own and
moved into place, so a second attempt of a lost task leaves the same file. The files stay
there, as the result reads them; whoever ends the session's folder removes them.

Defined cases: null text counts as empty; an empty document holds just the end id; rows
with equal doc_id are kept, in the order of the table; a null doc_id sorts first and comes
back null; texts of any length are coded whole; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, RangeShards, shared_dir, small_batches, table, task_memory
from .tokens import WORD_TOKENIZER, tokenizer_path, word_encoder

MAGIC = b"EPS8B001"
#: Fixed by the format: ids and bits of selectors 0 to 12; 13 is the escape.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 13
SELECTORS = np.full(61, ESCAPE, dtype=np.uint8)
SELECTORS[COUNTS] = np.arange(len(COUNTS))
#: Bit lengths of small ids.
WIDTHS = np.frexp(np.arange(65_536, dtype=np.float64))[1].astype(np.uint8)
CODED = "doc_id long, spread long, n_tokens long, words binary, shard int"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def encode_ids(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of documents laid end to end, and the number of words of each."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(len(lengths), dtype=np.int64)
    ends = np.cumsum(lengths)
    width = WIDTHS[ids] if ids.max() < len(WIDTHS) else np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    ids = ids.astype(np.uint64)
    most = {1: np.concatenate([width, np.zeros(60, dtype=np.uint8)])}
    for k, half in ((2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 8), (12, 8), (15, 8), (20, 15), (30, 15), (60, 30)):
        most[k] = np.maximum(most[half][: half - k], most[half][k - half :])
    step = np.ones(n, dtype=np.uint8)
    for count, bits in zip(COUNTS[-2::-1], BITS[-2::-1]):
        np.putmask(step, most[count][:n] <= bits, count)
    near = ends[:, None] - np.arange(1, 60)[None, :]  # near a document's end only shorter runs fit
    room = np.broadcast_to(np.arange(1, 60, dtype=np.uint8), near.shape)
    inside = near >= (ends - lengths)[:, None]
    near, room = near[inside], room[inside]
    fits = np.ones(len(near), dtype=np.uint8)
    for count, bits in zip(COUNTS[-2::-1], BITS[-2::-1]):
        np.putmask(fits, (most[count][near] <= bits) & (room >= count), count)
    step[near] = fits
    jumps = step.tolist()
    starts, i = [], 0
    put = starts.append
    while i < n:
        put(i)
        i += jumps[i]
    selector = SELECTORS[step]
    at = np.array(starts, dtype=np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == s)
        packed = words[here]
        for j in range(COUNTS[s]):
            packed |= ids[at[here] + j] << np.uint64(BITS[s] * j)
        words[here] = packed
    return words.astype("<u8"), np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def decode_words(words: np.ndarray) -> np.ndarray:
    """All ids of a run of words."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, dtype=np.int64)[selector]
    at = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(selector).tolist():
        here = np.flatnonzero(selector == s)
        mask = np.uint64((1 << BITS[s]) - 1)
        for j in range(COUNTS[s]):
            ids[at[here] + j] = (words[here] >> np.uint64(BITS[s] * j)) & mask
    return ids


def _open(uri: str):
    """File system and path of a shared folder's address."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _rows(docs: DataFrame) -> DataFrame:
    """Texts with ``id`` and ``spread``, by which rows are sorted: nulls first, then by doc_id, rows of one doc_id by their place in ``docs``."""
    null, doc_id = F.col("doc_id").isNull(), F.col("doc_id").cast("long").alias("doc_id")
    spread = F.monotonically_increasing_id() - F.when(null, F.lit(1 << 62)).otherwise(F.lit(0))
    return docs.select(doc_id, F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), spread.alias("spread"))


def encode(docs: DataFrame, path: str, end_id: int, shards: RangeShards) -> DataFrame:
    """Coded documents with the shard of their doc_id."""

    def run(batches):
        encoder, end = word_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("spread", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("shard", pa.int32())])
        with task_memory(encoder):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    coded = [i + end for i in encoder.encode(part.column(1).to_pylist())]
                    lengths = np.array([len(i) // 4 for i in coded], dtype=np.int64)
                    words, sizes = encode_ids(np.frombuffer(b"".join(coded), dtype="<u4"), lengths)
                    raw, cut = words.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 8
                    ids, spreads = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(3),
                            pa.array(lengths),
                            pa.array([raw[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary()),
                            pa.array(shards.of(ids, spreads)),
                        ],
                        schema=schema,
                    )

    return _rows(small_batches(docs)).mapInArrow(run, CODED)


def write(docs: DataFrame, path: str, end_id: int, folder: str, shard_docs: int = 8192, block_ids: int = 65_536) -> DataFrame:
    """Writes all documents; one row per shard file. The result's rows are few: one a shard."""
    shards = RangeShards(_rows(docs).select("id", "spread"), shard_docs)
    coded = encode(docs, path, end_id, shards).repartitionById(shards.shards, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "spread")

    def run(batches):
        out = None
        doc_ids, known, n_ids, blocks, pending, pending_ids, offset = [], [], [], [], [], 0, 0

        def flush():
            nonlocal pending, pending_ids, offset
            raw = b"".join(pending)
            out.write(raw)
            blocks.append((offset, len(raw) // 8, len(doc_ids) - len(pending), len(pending), pending_ids))
            offset += len(raw)
            pending, pending_ids = [], 0

        shard = fs = final = temp = None
        for batch in batches:
            for doc, n_tokens, words, of in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if out is None:
                    shard = of
                    fs, root = _open(folder)
                    final, temp = f"{root}/shard-{shard:06d}.s8b", f"{root}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    fs.create_dir(root)
                    out = fs.open_output_stream(temp)
                doc_ids.append(0 if doc is None else doc)
                known.append(doc is not None)
                n_ids.append(n_tokens)
                pending.append(words)
                pending_ids += n_tokens
                if pending_ids >= block_ids:
                    flush()
        if out is None:
            return
        if pending:
            flush()
        out.write(np.array(doc_ids, dtype="<i8").tobytes())
        out.write(np.array(n_ids, dtype="<i8").tobytes())
        out.write(np.array(known, dtype="u1").tobytes())
        out.write(np.array(blocks, dtype="<i8").tobytes())
        out.write(np.array([len(doc_ids), len(blocks), sum(n_ids), offset], dtype="<i8").tobytes() + MAGIC)
        size = out.tell()
        out.close()
        fs.move(temp, final)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/shard-{shard:06d}.s8b", "n_docs": len(doc_ids), "n_tokens": sum(n_ids), "n_bytes": size}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return coded.mapInArrow(run, MANIFEST)


def read_file(uri: str):
    """Yields per block of a file: doc_ids, whether each is known (else it is null), ids per document, and all its ids."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 40)
        tail = f.read(40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        n_docs, n_blocks, _, index = np.frombuffer(tail[:32], dtype="<i8").tolist()
        f.seek(index)
        doc_ids = np.frombuffer(f.read(8 * n_docs), dtype="<i8")
        n_ids = np.frombuffer(f.read(8 * n_docs), dtype="<i8")
        known = np.frombuffer(f.read(n_docs), dtype="u1").astype(bool)
        blocks = np.frombuffer(f.read(40 * n_blocks), dtype="<i8").reshape(-1, 5)
        for offset, words, first, docs, ids in blocks.tolist():
            f.seek(offset)
            got = decode_words(np.frombuffer(f.read(8 * words), dtype="<u8"))
            if len(got) != ids:
                raise ValueError(f"{uri}: a block of {ids} ids has {len(got)}")
            yield doc_ids[first : first + docs], known[first : first + docs], n_ids[first : first + docs], got


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """One row per document of the files, in ascending doc_id order across them."""
    manifest = sorted(manifest, key=lambda r: r["shard"])
    starts, total = [], 0
    for r in manifest:
        starts.append(total)
        total += r["n_tokens"]
    files = spark.createDataFrame([(k, r["path"], s) for k, (r, s) in enumerate(zip(manifest, starts))], "k int, path string, start long")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for doc_ids, known, n_ids, ids in read_file(path):
                    raw, cut = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(n_ids)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, mask=~known),
                            pa.array(start + cut[:-1]),
                            pa.array(n_ids),
                            pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.int64()),
                        ],
                        schema=schema,
                    )
                    start += int(cut[-1])

    return files.repartitionById(max(1, len(manifest)), F.col("k")).mapInArrow(run, RESULT)


def write_and_read(docs: DataFrame, path: str, end_id: int = 2, shard_docs: int = 8192) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(spark, write(docs, path, end_id, folder, shard_docs).collect())


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
