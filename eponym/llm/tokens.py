"""Token ids by public tokenizers, with words encoded once per worker.

The word tokenizer drops white space and never lets a token cross it, so a text's ids
are the ids of its white-space separated words, one after another. A worker keeps the
words it has met in a bounded table; only new ones go to the library, in batches.
"""

from __future__ import annotations

import codecs
import contextlib
import functools
import gc
import itertools
import os
import re

import numpy as np

from .common import utf8

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, one per process, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextlib.contextmanager
def no_collector():
    """Millions of small objects without cycles: the cycle collector would only walk them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: Marks that a tokenizer may split from the letters before them; an encoder takes those that its own does split.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Of each line, the letters it begins with whose lower case is one letter again, and the rest.
LETTERS = re.compile("^([A-Za-zÀ-ÖØ-öø-ÿ]*)(.*)$", re.MULTILINE).findall
#: The character that byte-level tokenizers write for each byte; a space stays one.
BYTE_CHARS = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)]
for _k, _b in enumerate([b for b in range(256) if BYTE_CHARS[b] is None]):
    BYTE_CHARS[_b] = chr(256 + _k) if _b != 32 else " "
BYTE_CHARS = "".join(BYTE_CHARS)


def byte_chars(text: str) -> str:
    return text if text.isascii() else codecs.charmap_decode(text.encode(), "strict", BYTE_CHARS)[0]


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes, for tokenizers that drop white space.

    New words are split into letters and end marks where that is the tokenizer's own split;
    the letters go to the library many at a time, and come apart again at the ids that end
    a word. A run of marks goes to it once for all words that end in it; all other words go one by one.
    """

    def __init__(self, path: str, most_words: int = 500_000, longest_word: int = 48, kept_words: int = 80_000):
        self.kept_words = kept_words
        self.library = tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        self.most_words, self.longest_word = most_words, longest_word
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bare = self._bare(path)
        letters, *marked = self._each(["ab", *(f"ab{m}" for m in MARKS)])
        self.marks = "".join(m for m, ids, alone in zip(MARKS, marked, self._each(list(MARKS))) if ids == letters + alone)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _bare(self, path: str):
        """The same vocabulary split at spaces only, for lower-case letters written by ``byte_chars``.

        None where its ids for a few words differ from the whole tokenizer's, which then takes the letters too.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_file(path)
        bare.no_truncation()
        bare.no_padding()
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        trial = "the quick brown fox jumps ébène größe señor a zzyzx thnttian à"
        return bare if bare.encode(byte_chars(trial), add_special_tokens=False).ids == self.library.encode(trial, add_special_tokens=False).ids else None

    def _each(self, words: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _letters(self, words: list[str], group: int = 256) -> list[bytes]:
        """Ids of words of letters only."""
        groups = [words[i : i + group] for i in range(0, len(words), group)]
        texts = [" ".join(g).lower() for g in groups]
        got = (self.bare or self.library).encode_batch_fast([byte_chars(t) for t in texts] if self.bare else texts, add_special_tokens=False)
        out: list[bytes] = []
        for some, e in zip(groups, got):
            ids = np.array(e.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some) or cut[-1] != len(ids):
                out += self._each(some)
                continue
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut], cut)]
        return out

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        split, stems, tails, others = [], {}, {}, []
        for some in itertools.batched(new, 10_000):
            for w, (stem, tail) in zip(some, LETTERS(b"\n".join(some).decode("utf-8", "surrogatepass"))):
                if stem and not tail:
                    stems[w] = stem
                elif stem and (tail in tails or not tail.strip(self.marks)):
                    stem_bytes = w[: -len(tail)]
                    tails[tail] = b""
                    split.append((w, stem_bytes, tail))
                    if stem_bytes not in known:
                        stems[stem_bytes] = stem
                else:
                    others.append((w, stem + tail))
        known.update(zip(stems, self._letters(list(stems.values()))))
        tails = dict(zip(tails, self._each(list(tails))))
        for w, s, t in split:
            known[w] = known[s] + tails[t]
        known.update(zip((w for w, _ in others), self._each([t for _, t in others])))

    def clear(self) -> None:
        """Leaves short words, which come back most, for the worker's next task."""
        short = (x for x in self.known.items() if len(x[0]) <= 8)
        self.known = dict(itertools.islice(short, self.kept_words))

    def encode(self, texts) -> list[bytes]:
        with no_collector():
            return self._encode(texts)

    def _encode(self, texts) -> list[bytes]:
        raw = [utf8(t) for t in texts]
        split = [(t if b"<|" in t else t.lower()).split() for t in raw]
        get = self.known.get
        found = [list(map(get, words)) for words in split]
        gaps = [[k for k, ids in enumerate(some) if ids is None] for some in found]
        new = {words[k] for words, ks in zip(split, gaps) for k in ks}
        if new:
            if len(self.known) + len(new) > self.most_words:
                self.known = {}
            self._learn(new)
            known = self.known
            for words, some, ks in zip(split, found, gaps):
                for k in ks:
                    some[k] = known[words[k]]
            for w in new:
                if len(w) > self.longest_word:
                    del known[w]
        return [b"".join(some) for some in found]


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
