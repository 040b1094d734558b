"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks.

Sentences are the units. A sentence is a sequence of letters and word gaps, after
lower-casing; marks inside words are dropped (``i.d.i-o.t``) and runs of single letters are
joined (``i d i o t``). The kernel compares windows of one to ``WINDOW`` consecutive words
of sentences by the subsequences of three and four characters they share, word gaps being
characters too; a subsequence weighs ``DECAY`` for every character it spans beyond the
first, with up to ``GAPS`` skipped ones, and values are divided by the windows' norms, so an
inserted or dropped character costs little. A sentence is as toxic as its worst window.

Training takes a bounded sample of labelled documents (``per_class`` each), whose
sentences carry their document's label. All windows of clean sentences are clean; of a
toxic document at least one window is toxic, and which one is found by turns: first the
windows that toxic documents hold far more often than clean ones are taken, then each fit
chooses the worst windows of every toxic document anew and adds the clean windows that
come nearest to them. Toxic windows are also taught with letters put in. Each window
becomes its kernel values with the landmarks (toxic and clean windows) times the inverse
root of the landmarks' kernel matrix, and a linear SVM is fitted on these. As the kernel
is a product of sparse feature vectors, the fitted function folds into one weight per
subsequence, which is what workers apply: sums over words and over the gaps between them
give the value of every window. A document's score is a logistic function, fitted on other
documents of the sample, of its worst and its second worst sentence.

Scoring needs no shuffle; the model is a closure of fixed size.

Defined cases: null or empty text scores as a text without any word; without labelled
rows of both kinds every score is the share of toxic rows (0.5 without any); texts of any
length are scored whole; repeated rows score alike; an empty table gives an empty result;
other columns are ignored. ``drop_toxic`` keeps or drops repeated rows together.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod_py, small_batches, table, task_memory
from .learning import labelled_sample, linear_svm, logistic, sigmoid

DECAY, GAPS, SPACE_BITS, WINDOW = 0.85, 2, 19, 3
PAIRS = [(a, b) for a, b in itertools.combinations(range(1, 3 + GAPS), 2)]
PAD = 3 + GAPS
RESULT = "doc_id long, held_out boolean, score double, predicted int"
NONE = -1.5
M1, M2, M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _slot(h):
    h = (h ^ (h >> np.uint32(15))) * M3
    return h >> np.uint32(32 - SPACE_BITS)


def _subsequences(codes: np.ndarray, n: int):
    """(last offset, slots) of all shapes at the places 0 to n - 1, for 32-bit codes."""
    first = codes[:n] * M1
    for a, b in PAIRS:
        h = ((first ^ codes[a : a + n]) * M2 ^ codes[b : b + n]) * M1
        yield b, _slot(h)
        for c in range(b + 1, PAD + 1):
            yield c, _slot((h ^ codes[c : c + n]) * M2)


#: Subsequences by last offset.
SHAPES = Counter(last for last, _ in _subsequences(np.zeros(PAD + 1, np.uint32), 1))


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For every code point: 3 letter, 2 white space, 1 end mark, 0 other."""
    out = np.zeros(0x110000, dtype=np.int8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 3
        elif c.isspace():
            out[i] = 2
    out[[ord(c) for c in ".!?"]] = 1
    return out


class Sentences:
    """All sentences of some texts as one array of codes, with the places of their words.

    Code 1 is a gap between words or an end of a sentence, 0 keeps sentences apart.
    ``start`` and ``stop`` are the gaps before and after each word.
    """

    def __init__(self, texts):
        joined = "\0".join((t or "").lower().replace("\0", " ") for t in texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _kinds()[points]
        gap = np.concatenate([kind[1:] == 2, [False]]) | np.concatenate([points[1:] == 0, [True]])
        ends = (points == 0) | (points == 10) | ((kind == 1) & gap)
        keep = (kind >= 2) | ends
        points, ends, doc = points[keep], ends[keep], np.cumsum(points == 0, dtype=np.int32)[keep]
        letter = kind[keep] == 3
        doc = doc - (points == 0)
        # a run of white space and ends becomes one gap, which ends the sentence if any of it does
        first = ~letter & np.concatenate([[True], letter[:-1]])
        run = np.flatnonzero(first)
        closes = np.zeros(len(points), dtype=bool)
        if len(run):
            total = np.concatenate([[0], np.cumsum(ends, dtype=np.int32)])
            past = np.append(run[1:], len(points))
            closes[run] = total[past] > total[run]
        keep = letter | first
        points, closes, letter, doc = points[keep], closes[keep], letter[keep], doc[keep]
        # gaps between single letters go
        at = np.flatnonzero(~letter)
        size = np.diff(np.concatenate([[-1], at])) - 1
        single = np.zeros(len(at), dtype=bool)
        if len(at) > 1:
            single[:-1] = (size[:-1] == 1) & (size[1:] == 1) & ~closes[at[:-1]]
        keep = np.ones(len(points), dtype=bool)
        keep[at[single]] = False
        points, closes, letter, doc = points[keep], closes[keep], letter[keep], doc[keep]
        # ends of sentences become a gap, zeros, and a gap
        times = np.where(closes, np.int32(PAD + 2), np.int32(1))
        place = np.cumsum(times, dtype=np.int64) - times
        codes = np.zeros(int(times.sum()) + 2 + PAD, dtype=np.uint32)
        codes[1 + place] = np.where(letter, points + np.uint32(2), np.uint32(1))
        codes[1 + (place + PAD + 1)[closes]] = 1
        codes[0] = 1
        self.codes = codes
        gaps = np.flatnonzero(codes == 1)
        far = np.diff(gaps)
        word = (far > 1) & (codes[np.minimum(gaps[:-1] + 1, len(codes) - 1)] > 1)
        self.start, self.stop = gaps[:-1][word], gaps[1:][word]
        owner = np.zeros(len(codes), dtype=np.int32)
        owner[1 + place] = doc
        self.doc = owner[self.start + 1].astype(np.int64)
        self.together = self.stop[:-1] == self.start[1:]  # a word and the next one are of one sentence

    def words(self) -> list[str]:
        text = np.where(self.codes > 1, self.codes - 2, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a + 1 : b] for a, b in zip(self.start.tolist(), self.stop.tolist())]

    def values(self, weight: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The folded function, without its constant, of every window: one row per word, one column per size of window."""
        if not len(self.start):
            return np.zeros((0, WINDOW), dtype=np.float32)
        n, codes = len(self.codes) - PAD, self.codes
        inner, norm, cross, cross_norm = (np.zeros(len(codes), dtype=np.float32) for _ in range(4))
        gaps = np.append(np.flatnonzero(codes == 1), len(codes))
        for at in range(0, n, block):
            m = min(block, n - at)
            part, here = codes[at : at + m + PAD], np.arange(at, at + m)
            far = gaps[np.searchsorted(gaps, here, side="right")] - here
            sums = {}
            for last, slot in _subsequences(part, m):
                got = weight[slot]
                sums[last] = got if last not in sums else sums[last] + got
            for last, total in sums.items():
                there = (part[:m] > 0) & (part[last : last + m] > 0)
                within = there & (far >= last)
                over = there & ~within
                one, both = np.float32(DECAY**last), np.float32(SHAPES[last] * DECAY ** (2 * last))
                inner[at : at + m] += one * total * within
                cross[at : at + m] += one * total * over
                norm[at : at + m] += both * within
                cross_norm[at : at + m] += both * over
        cut = self.start
        edge = np.empty(2 * len(cut), dtype=np.int64)
        edge[::2], edge[1::2] = self.start, self.stop
        v0, n0, v1, n1 = (np.add.reduceat(np.append(x, np.float32(0)), edge)[::2] for x in (inner, norm, cross, cross_norm))
        out = np.full((len(cut), WINDOW), -np.inf, dtype=np.float32)
        value, size = v0.astype(np.float64), n0.astype(np.float64)
        out[:, 0] = value / np.maximum(np.sqrt(size), 1e-6)
        fits = np.ones(len(cut), dtype=bool)
        for k in range(1, WINDOW):
            fits[len(cut) - k :] = False
            fits[: len(cut) - k] &= self.together[k - 1 :] if k > 1 else self.together
            upto = len(cut) - k
            value[:upto] += v1[k - 1 : k - 1 + upto] + v0[k : k + upto]
            size[:upto] += n1[k - 1 : k - 1 + upto] + n0[k : k + upto]
            out[fits, k] = (value / np.maximum(np.sqrt(size), 1e-6))[fits]
        out[self.stop - self.start <= 3, 0] = -np.inf  # one or two letters alone say nothing
        return out


def subsequences(windows: list[str]):
    """Arrays (window, slot, weight) of all subsequences of the windows."""
    if not windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text = "".join("\x01" + w + "\x01" + "\0" * PAD for w in windows)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes == 32, np.uint32(1), np.where(codes > 1, codes + np.uint32(2), codes))
    of = np.repeat(np.arange(len(windows)), [len(w) + 2 + PAD for w in windows])
    n = len(codes) - PAD
    rows, slots, weights = [], [], []
    for last, slot in _subsequences(codes, n):
        at = np.flatnonzero((codes[:n] > 0) & (codes[last : last + n] > 0))
        rows.append(of[at])
        slots.append(slot[at].astype(np.int64))
        weights.append(np.full(len(at), DECAY**last))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(weights)


class Landmarks:
    """Kernel values with a few landmark windows, by the subsequences they share."""

    def __init__(self, windows: list[str]):
        w, f, v = subsequences(windows)
        order = np.argsort(f, kind="stable")
        norm = np.maximum(np.sqrt(np.bincount(w, v * v, minlength=len(windows))), 1e-12)
        self.size, self.feature, self.of, self.value = len(windows), f[order], w[order], (v / norm[w])[order]

    def kernel(self, windows: list[str]) -> np.ndarray:
        """One row per window, one column per landmark."""
        out = np.empty((len(windows), self.size), dtype=np.float32)
        for at in range(0, len(windows), 500):
            some = windows[at : at + 500]
            w, f, v = subsequences(some)
            norm = np.maximum(np.sqrt(np.bincount(w, v * v, minlength=len(some))), 1e-12)
            first, past = np.searchsorted(self.feature, f, side="left"), np.searchsorted(self.feature, f, side="right")
            shared = past - first
            place = np.repeat(first - np.cumsum(shared) + shared, shared) + np.arange(int(shared.sum()))
            cell = np.repeat(w, shared) * self.size + self.of[place]
            out[at : at + 500] = np.bincount(cell, np.repeat(v / norm[w], shared) * self.value[place], minlength=len(some) * self.size).reshape(len(some), self.size)
        return out

    def weights(self, alpha: np.ndarray) -> np.ndarray:
        """One weight per slot of the function with these coefficients of the landmarks."""
        return np.bincount(self.feature, self.value * alpha[self.of], minlength=1 << SPACE_BITS).astype(np.float32)


class Model:
    """Weights for subsequences and for documents; ``prior`` where there is no model."""

    def __init__(self, weight=None, constant=0.0, final=None, prior=0.5):
        self.weight, self.constant, self.final, self.prior = weight, constant, final, prior

    def clear(self) -> None:
        """Nothing is kept between texts."""

    def sentence_values(self, sentences: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Document and worst window of every sentence."""
        values = sentences.values(self.weight)
        if not len(values):
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.concatenate([[True], ~sentences.together]))
        return sentences.doc[first], np.maximum.reduceat(values.max(axis=1), first) + self.constant

    def document_features(self, texts, most_chars: int = 250_000) -> np.ndarray:
        """Values of the worst and the second worst sentence of each text; some texts at once, to hold few arrays."""
        parts, first, chars = [], 0, 0
        for k, t in enumerate(texts):
            if chars and chars + len(t or "") > most_chars:
                parts.append(self._features(texts[first:k]))
                first, chars = k, 0
            chars += len(t or "")
        return np.concatenate([*parts, self._features(texts[first:])])

    def _features(self, texts) -> np.ndarray:
        doc, value = self.sentence_values(Sentences(texts))
        out = np.full((len(texts), 2), NONE)
        value = np.clip(value, NONE, 3)
        order = np.lexsort((-value, doc))
        doc, value = doc[order], value[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]) if len(doc) else np.zeros(0, bool)
        doc, value = doc[new], value[new]  # distinct values, so a repeated sentence counts once
        head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        out[doc[head], 0] = value[head]
        second = np.concatenate([[False], head[:-1]]) & ~head if len(doc) else head
        out[doc[second], 1] = value[second]
        return out

    def scores(self, texts) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.prior)
        if not len(texts):
            return np.zeros(0)
        return sigmoid(np.column_stack([self.document_features(texts), np.ones(len(texts))]) @ self.final)


class Sample:
    """The words of the sample's sentences, with counts of the documents that hold a window."""

    def __init__(self, texts: list[str], toxic: np.ndarray, used: np.ndarray, at_once: int = 150):
        self.parts = [Sentences(texts[at : at + at_once]) for at in range(0, len(texts), at_once)]
        ids: dict[str, int] = {}
        self.ids = np.concatenate([np.array([ids.setdefault(w, len(ids)) for w in p.words()], dtype=np.int64) for p in self.parts])
        self.named = list(ids)
        self.doc = np.concatenate([p.doc + k * at_once for k, p in enumerate(self.parts)])
        self.together = np.concatenate([np.append(p.together, False)[: len(p.doc)] for p in self.parts])[:-1]
        self.label, self.used = toxic, used

    def values(self, weight: np.ndarray) -> np.ndarray:
        return np.concatenate([p.values(weight) for p in self.parts])

    def window(self, at: int, size: int) -> str:
        return " ".join(map(self.named.__getitem__, self.ids[at : at + size + 1].tolist()))

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows of ``size`` + 1 words, and a key of each."""
        n = len(self.ids)
        ok = np.ones(max(0, n - size), dtype=bool)
        for k in range(size):
            ok &= self.together[k : k + len(ok)]
        at = np.flatnonzero(ok)
        key = np.full(len(at), size, dtype=np.uint64)
        for k in range(size + 1):
            key = (key ^ self.ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return at, key

    def counted(self, size: int):
        """First places of distinct windows, with the toxic and the clean documents holding each (among the used ones)."""
        at, key = self.keys(size)
        some = self.used[self.doc[at]]
        at, key = at[some], key[some]
        unique, first, of = np.unique(key, return_index=True, return_inverse=True)
        held = np.unique(of.astype(np.int64) * len(self.label) + self.doc[at])
        window, toxic = held // len(self.label), self.label[held % len(self.label)] == 1
        return at[first], np.bincount(window, toxic, len(unique)), np.bincount(window, ~toxic, len(unique))


def _taught(window: str, times: int, rng) -> list[str]:
    """The window with one letter put in, at most ``times`` times."""
    inside = [k for k in range(1, len(window)) if window[k] != " " and window[k - 1] != " "] if len(window) >= 4 else []
    picks = [(inside[int(rng.integers(len(inside)))], int(rng.integers(26))) for _ in range(times)] if inside else []
    return [window[:at] + chr(97 + letter) + window[at:] for at, letter in dict.fromkeys(picks)]


def fit(sample: list[tuple[str, int]], landmarks: int = 700, negatives: int = 8000, rounds: int = 3) -> Model:
    """A model from labelled texts; a quarter of them calibrates the documents' score."""
    y_all = np.array([y for _, y in sample])
    if len(sample) == 0 or y_all.min() == y_all.max():
        return Model(prior=0.5 if len(sample) == 0 else float(np.clip(y_all.mean(), 0.01, 0.99)))
    plain = Model(prior=float(np.clip(y_all.mean(), 0.01, 0.99)))
    rng = np.random.default_rng(7)
    calibrates = np.zeros(len(sample), dtype=bool)
    for y in (0, 1):
        calibrates[np.flatnonzero(y_all == y)[3::4]] = True
    data = Sample([t for t, _ in sample], y_all, ~calibrates)
    n_toxic, n_clean = max(1, int(((y_all == 1) & ~calibrates).sum())), max(1, int(((y_all == 0) & ~calibrates).sum()))

    # windows that toxic documents hold far more often; longer ones only without any such word in them
    strong: dict[str, float] = {}
    evidence: dict[str, float] = {}  # toxic documents holding a window
    common, seen_clean = [], {}
    for size in range(WINDOW):
        at, toxic, clean = data.counted(size)
        lift = toxic / n_toxic - 2.0 * clean / n_clean
        least = max(2, 0.004 * n_toxic) if size == 0 else max(4, 0.02 * n_toxic)
        for k in np.flatnonzero((toxic >= least) & (lift > 0) & (clean <= 0.1 * toxic)).tolist():
            w = data.window(int(at[k]), size)
            if len(w) > 2 and not any(part in strong for part in (w.split() if size else ())):
                strong[w], evidence[w] = float(lift[k]), float(toxic[k])
        order = np.argsort(-clean, kind="stable")
        order = order[clean[order] > 0]
        share = negatives // (2 * WINDOW)
        picked = np.concatenate([order[:share], order[rng.permutation(len(order))[:share]]])
        for k in dict.fromkeys(picked.tolist()):
            w = data.window(int(at[k]), size)
            if len(w) > 2:
                common.append(w)
    if not strong:
        return plain
    strong_first = sorted(strong, key=lambda w: (-strong[w], w))
    common = [w for w in dict.fromkeys(common) if w not in strong]
    if not common:
        return plain
    spread = [common[i] for i in rng.permutation(len(common))]
    well_held = [w for w in strong_first if evidence[w] >= max(3, 0.02 * n_toxic)] or strong_first[:20]
    put_in = [t for w in well_held for t in _taught(w, max(1, landmarks // (4 * len(well_held))), rng)]
    toxic_marks = list(dict.fromkeys(strong_first[: landmarks // 4] + put_in[: landmarks // 4]))
    marks = list(dict.fromkeys(toxic_marks + spread[: landmarks - len(toxic_marks)]))
    landmark = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmark.kernel(marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    often = set(well_held)
    positives, clean_windows = strong_first[: negatives // 4], common[:negatives]
    model = plain
    for _ in range(rounds):
        known_clean = set(clean_windows)
        taught = {t: evidence[w] for w in positives for t in _taught(w, 24 if w in often else 4, rng) if t not in known_clean}
        windows = positives + list(taught) + clean_windows
        held = np.sqrt([evidence[w] for w in positives] + list(taught.values()))
        y = np.array([1] * len(held) + [0] * len(clean_windows))
        weight = np.concatenate([held / held.mean() * max(1.0, len(clean_windows) / (4 * len(held))), np.ones(len(clean_windows))])
        x = np.ones((len(windows), root.shape[1] + 1), dtype=np.float32)
        for at in range(0, len(windows), 2000):
            x[at : at + 2000, :-1] = landmark.kernel(windows[at : at + 2000]) @ root
        svm = linear_svm(x, y, cost=1.0, weight=weight)
        model = Model(landmark.weights(root @ svm[:-1]), float(svm[-1]))
        value = data.values(model.weight) + model.constant
        size = value.argmax(axis=1)
        top = value[np.arange(len(value)), size]
        order = np.lexsort((-top, data.doc))  # each document's words, worst first
        worst: Counter = Counter()
        rank = np.arange(len(order)) - np.repeat(*_runs(data.doc[order]))
        for at in order[(rank < 2) & (data.label[data.doc[order]] == 1) & data.used[data.doc[order]] & (top[order] > 0)].tolist():
            worst[data.window(at, int(size[at]))] += 1
        hard: dict[str, float] = {}
        clean_at = np.flatnonzero((data.label[data.doc] == 0) & data.used[data.doc])
        for at in clean_at[np.argsort(-top[clean_at], kind="stable")[: 4 * negatives]].tolist():
            hard.setdefault(data.window(at, int(size[at])), float(top[at]))
            if len(hard) >= negatives // 4:
                break
        holders = Counter()
        for at in clean_at[top[clean_at] > 0].tolist():
            holders[data.window(at, int(size[at]))] += 1
        found = [w for w, c in sorted(worst.items(), key=lambda x: (-x[1], x[0])) if holders[w] <= 0.1 * c]
        for w in found:
            evidence[w] = max(evidence.get(w, 0.0), float(worst[w]))
        positives = list(dict.fromkeys(well_held + found))[: negatives // 4] or positives
        taken = set(positives)
        clean_windows = [w for w in dict.fromkeys(clean_windows + list(hard)) if w not in taken and not (w in strong and holders[w] <= 0.1 * worst[w])]
    x = model.document_features([t for (t, _), c in zip(sample, calibrates) if c])
    model.final = logistic(x, y_all[calibrates], ridge=0.05)
    return model


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal ids starts, and its length."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ids)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document with its toxicity."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        with task_memory(model):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    ids = part.column(0).to_pylist()
                    s = model.scores(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([i is not None and crc_mod_py(i, folds) == held_out for i in ids]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema
                    )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""

    def values(batches):
        with task_memory(model):
            for texts in batches:
                parts = [model.scores(texts.iloc[at : at + 500].tolist()) for at in range(0, len(texts), 500)]
                yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    values.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    value = F.pandas_udf(values, "double")
    return small_batches(docs).where(value(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_chars: int = 20_000) -> Model:
    with task_memory():
        return fit(labelled_sample(docs, labels, "toxic", 4, 2, per_class, most_chars))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
