"""What several operators of this folder share: reading, checkpoints, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests) a temporary folder is set; on a
    cluster executors could not see it, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="eponym-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def merged(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` in at most ``per_core`` partitions a core, or a quarter of the session's shuffle partitions if that is more.

    Sessions set those in proportion to their data, so no task grows with it. Partitions are read one after another, without a shuffle and without holding more of
    them at once. More files than that only cost: creating one through Hadoop's local file
    system starts a ``chmod`` process, which for a moment counts the JVM's memory twice.
    """
    spark = df.sparkSession
    return df.coalesce(max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so later stages and retries read it back."""
    shared_dir(df.sparkSession)
    return merged(df).checkpoint(eager=True)


def released(*frames: DataFrame) -> None:
    """Deletes the files of checkpoints that no plan still to run reads.

    What was made of them must be checkpointed itself; otherwise they stay until the driver collects its garbage.
    """
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of each action go when it ends, not when the driver happens to collect its garbage.

    For code that checkpoints what it reads again; a lost stage is run anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lowest_hashes(rows: DataFrame, hashed, n: int, most: int) -> DataFrame:
    """Of ``n`` rows, those with the lowest values of a 64-bit hash, about twice ``most``; all if there are few more.

    An ordered limit after it has that many rows to sort, however many partitions there are.
    """
    if n <= 4 * most:
        return rows
    return rows.where(hashed < F.lit(int(2 * most / n * 2.0**64) - (1 << 63)))


def crc_mod(col, n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def crc_mod_py(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit integers (the SplitMix64 output step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


LOWEST = -(2**63)


class RangeShards:
    """Shards of rows by ranges of (id, spread), with about ``shard_rows`` rows each, however many rows an id has.

    ``rows`` has the long columns ``id`` and ``spread``, which tells rows of one id apart.
    The bounds are quantiles of a sample that a hash of the pair chooses, about
    ``per_shard`` pairs for every shard; only these reach the driver. Range shards of a
    sample differ in size by a fraction of themselves, whatever the number of shards.
    """

    def __init__(self, rows: DataFrame, shard_rows: int, per_shard: int = 32):
        n = rows.count()
        self.shards, self.ids, self.spreads = max(1, -(-n // shard_rows)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.shards > 1:
            share = min(1.0, per_shard * self.shards / n)
            chosen = rows.where(F.pmod(F.xxhash64("id", "spread", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "spread").toArrow()
            ids, spreads = (chosen.column(c).to_numpy() for c in ("id", "spread"))
            order = np.lexsort((spreads, ids))
            at = order[(np.arange(1, self.shards) * len(order)) // self.shards] if len(order) else order
            self.ids, self.spreads = ids[at], spreads[at]

    def of(self, ids: np.ndarray, spreads: np.ndarray) -> np.ndarray:
        """The shard of each (id, spread)."""
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        out = low.astype(np.int32)
        for k in np.flatnonzero(low < high).tolist():  # ids on a bound, which the spread decides
            a, b = int(low[k]), int(high[k])
            out[k] = a + int(np.searchsorted(self.spreads[a:b], spreads[k], side="right"))
        return out


def small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, with fewer rows to an Arrow batch where the session still has the default.

    A batch of the default 10,000 texts is held by the JVM and by the worker at once; long
    documents make that the largest part of a task's memory.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(rows))
    return docs


def slices(batches, rows: int = 1000):
    """Arrow batches cut to at most ``rows`` rows, so few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextlib.contextmanager
def task_memory(*tables):
    """Empties a worker's tables when its task ends and hands freed memory back to the system.

    Workers stay alive between tasks, also those of other stages, and share an executor's
    memory with the JVM.
    """
    try:
        yield
    finally:
        for t in tables:
            t.clear()
        with contextlib.suppress(OSError, AttributeError):
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            ctypes.CDLL("libc.so.6").malloc_trim(0)
