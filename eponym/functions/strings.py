"""String similarity and encodings (inventory F20 to F26, F35 to F45)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "abcdefghijklmnopqrstuvwxyz<>"


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein_at_least(a: Column, b: Column, least: float) -> Column:
    """Whether the similarity reaches ``least``: a length band, then a bounded distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.abs(F.length(a) - F.length(b)) <= (1 - least) * longest + 1e-9) & (levenshtein_similarity(a, b) >= least - 1e-12)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, matched = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [c for c, f in zip(b, free) if not f]
    half = sum(x != y for x, y in zip(matched, other)) // 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_one(a: str, b: str, boost_from: float = 0.7) -> float:
    j = jaro(a, b)
    if j <= boost_from:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + 0.1 * same * (1 - j)


def damerau_one(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours, edits between them allowed."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        here = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), here
            if x == y:
                here = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_one(x, y) for x, y in zip(a, b)], dtype="Int32")


def damerau_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - damerau_levenshtein(a, b) / longest)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def edit_script_one(a: str, b: str) -> tuple[int, str]:
    """Least cost (insert 1, delete 1, substitute 2) and its operations, one letter each."""
    d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    d[:, 0], d[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (0 if x == y else 2))
    i, j, ops = len(a), len(b), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else 2):
            ops.append("=" if a[i - 1] == b[j - 1] else "s")
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            ops.append("d")
            i -= 1
        else:
            ops.append("i")
            j -= 1
    return int(d[-1, -1]), "".join(reversed(ops))


@F.pandas_udf(T.StructType([T.StructField("cost", T.IntegerType()), T.StructField("operations", T.StringType())]))
def edit_script(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_script_one(x or "", y or "") for x, y in zip(a, b)], columns=["cost", "operations"])


def match_pieces_one(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Greedy alignment: the most similar pair first (ties in row order), each piece once, while similarity is positive."""
    if len(left) == 1 and len(right) == 1:
        return [(left[0], right[0])]
    cells = []
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            longest = max(len(x), len(y))
            s = 1 - _distance(x, y) / longest if longest else 1.0
            if s > 0:
                cells.append((-s, i, j))
    out, rows, columns = [], set(), set()
    for _, i, j in sorted(cells):
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((left[i], right[j]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("alt_name", T.StringType())])))
def match_pieces(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b):
        if a is None or b is None or not len(a) or not len(b):
            return []
        return [{"name": x, "alt_name": y} for x, y in match_pieces_one(list(a), list(b))]

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=object)


def char_ids(c: Column, length: int = 30) -> Column:
    """Letters as 1 to 28 (0 for others), cut or padded with 0 to ``length``."""
    ids = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def chars_of(ids: Column) -> Column:
    return F.array_join(F.transform(F.filter(ids, lambda x: x > 0), lambda x: F.substring(F.lit(ALPHABET), x, F.lit(1))), "")


def char_ngrams(c: Column, least: int = 1, most: int = 3) -> Column:
    """All n-grams of a string, shorter ones first."""
    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(least, most + 1)])


def phoneme_bigrams(phonemes: Column) -> Column:
    ends = F.concat(F.array(F.lit("START")), phonemes, F.array(F.lit("END")))
    return F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.concat_ws(" ", a, b))


def unquote(c: Column) -> Column:
    """URL decoding that leaves a plus sign alone."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def wordpiece(vocabulary: list[str], length: int, unknown: str = "[UNK]", padding: str = "[PAD]"):
    """A function from names to token lists of fixed length: greedy longest match, later pieces marked ``##``."""
    pieces = frozenset(vocabulary)
    longest = max(map(len, pieces), default=1)

    def one(name: str | None) -> list[str]:
        out, at = [], 0
        while name and at < len(name):
            for end in range(min(len(name), at + longest), at, -1):
                piece = ("##" if at else "") + name[at:end]
                if piece in pieces:
                    out.append(piece)
                    at = end
                    break
            else:
                out = [unknown]
                break
        return (out + [padding] * length)[:length]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(name: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in name], dtype=object)

    return tokens
