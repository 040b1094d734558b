"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from a bounded sample of labelled documents (``per_class``
each). A text is compressed with either; the difference of the two sizes says which kind
it resembles. It is a sum over the text's parts, so chance moves it by about the root of
the text's size, and divided by that it means the same for short and long texts. A logistic function of that difference
alone, fitted on labelled documents that no dictionary was built from, makes the score.

Scoring needs no shuffle; the dictionaries are a closure of fixed size.

Defined cases: null text counts as empty; an empty text has difference 0 and scores as
such; without labelled rows of both kinds every score is the share of good rows (0.5
without any); repeated rows score alike; texts of any length are compressed whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod_py, small_batches, table, utf8
from .learning import labelled_sample, logistic, sigmoid

RESULT = "doc_id long, held_out boolean, score double, predicted int"


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or plain sample content where there is too little to train on."""
    import zstandard

    pieces = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    try:
        return zstandard.train_dictionary(size, pieces, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class Model:
    def __init__(self, good: bytes = b"", bad: bytes = b"", final=None, prior: float = 0.5, level: int = 3):
        self.good, self.bad, self.final, self.prior, self.level = good, bad, final, prior, level
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def _compressors(self):
        import zstandard

        if self.ready is None:
            self.ready = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=self.level)
                self.ready.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self.ready

    def differences(self, texts) -> np.ndarray:
        """Size with the bad dictionary less size with the good one, over the root of the text's size."""
        good, bad = self._compressors()
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            if raw := utf8(t):
                a, b = len(good.compress(raw)), len(bad.compress(raw))
                out[k] = (b - a) / math.sqrt(len(raw))
        return out

    def scores(self, texts) -> np.ndarray:
        if self.final is None:
            return np.full(len(texts), self.prior)
        slope, constant = self.final
        return sigmoid(slope * SCALE * self.differences(texts) + constant)


#: Brings the difference to a range of about one before the ridge.
SCALE = 1.0


def fit(sample: list[tuple[str, int]], size: int = 112_640) -> Model:
    y = np.array([v for _, v in sample])
    if len(sample) == 0 or y.min() == y.max():
        return Model(prior=0.5 if len(sample) == 0 else float(np.clip(y.mean(), 0.01, 0.99)))
    calibrates = np.zeros(len(y), dtype=bool)
    for v in (0, 1):
        calibrates[np.flatnonzero(y == v)[1::2]] = True
    built = [[utf8(t) for (t, v), c in zip(sample, calibrates) if v == side and not c] for side in (1, 0)]
    if not all(any(b) for b in built) or len(set(y[calibrates].tolist())) < 2:
        return Model(prior=float(np.clip(y.mean(), 0.01, 0.99)))
    model = Model(dictionary(built[0], size), dictionary(built[1], size))
    x = model.differences([t for (t, _), c in zip(sample, calibrates) if c])
    model.final = logistic(SCALE * x[:, None], y[calibrates], ridge=0.05)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0).to_pylist()
                s = model.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([i is not None and crc_mod_py(i, folds) == held_out for i in ids]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 20_000) -> Model:
    return fit(labelled_sample(docs, labels, "quality", 5, 0, per_class, most_chars))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
