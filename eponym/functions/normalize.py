"""Name normalisation as Column expressions (inventory F1 to F19, F42, P2 to P4).

All steps are built-in functions and stay in the JVM. ``normalize`` turns a raw name into
an array of latin lower-case pieces: transliterate, lower-case, strip a possessive, drop
apostrophes, blank out everything else, split, expand abbreviations (given names), glue
prefixes, drop noise words, strip digits, drop noise again, drop empties (and single
letters of surnames), fall back to the spaceless text when nothing is left, standardise
patronymics (surnames). A null name gives null.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_lists as L


def _latin_table() -> dict[str, str]:
    """Letters of the Latin blocks up to U+024F and U+1EFF that decompose to a plain letter."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            found[chr(code)] = base
    return found


#: One letter to one letter, by rule for Latin and listed for Cyrillic and Greek (fixed values).
SINGLE = _latin_table() | dict(
    zip("øØłŁđĐðÐıħĦŧŦ", "oOlLdDdDihHtT")
) | dict(zip("абвгдезийклмнопрстуфыэАБВГДЕЗИЙКЛМНОПРСТУФЫЭіІёЁ", "abvgdeziiklmnoprstufyeABVGDEZIIKLMNOPRSTUFYEiIeE")) | dict(
    zip("αβγδεζηικλμνξοπρσςτυωάέήίόύώΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩ", "abgdezeiklmnxoprsstuoaeeiouoABGDEZEIKLMNXOPRSTUO")
)
#: One letter to several (fixed values).
SEVERAL = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ж": "zh", "Ж": "Zh", "х": "kh", "Х": "Kh", "ц": "ts", "Ц": "Ts",
    "ч": "ch", "Ч": "Ch", "ш": "sh", "Ш": "Sh", "щ": "shch", "Щ": "Shch", "ю": "iu", "Ю": "Iu", "я": "ia", "Я": "Ia", "θ": "th", "Θ": "Th",
    "φ": "ph", "Φ": "Ph", "χ": "kh", "Χ": "Kh", "ψ": "ps", "Ψ": "Ps", "王": "Wang ", "李": "Li ", "张": "Zhang ", "刘": "Liu ", "陈": "Chen ", "杨": "Yang ", "黄": "Huang ", "ъ": "", "ь": "",
}


def transliterate(c: Column) -> Column:
    """Latin letters for those of other scripts that the tables hold; the rest stays."""
    plain = F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))
    for letter, text in SEVERAL.items():
        plain = F.replace(plain, F.lit(letter), F.lit(text))
    # most names are ASCII already: test once instead of replacing letter by letter
    return F.when(c.rlike("[^\\x00-\\x7F]"), plain).otherwise(c)


def _in(x: Column, words) -> Column:
    return x.isin(*words)


def expand_given_abbreviations(pieces: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in L.GIVEN_ABBREVIATIONS.items() for v in pair])
    return F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x))


def merge_prefixes(pieces: Column, anywhere, beginning=()) -> Column:
    """Glues every run of prefixes onto the next piece; a run at the end is a piece of its own.

    The ``beginning`` prefixes count as such only where no piece has ended yet.
    """
    start = F.struct(F.lit("").alias("run"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))

    def step(acc, x):
        is_prefix = _in(x, anywhere) if anywhere else F.lit(False)
        if beginning:
            is_prefix = is_prefix | ((acc["i"] == 0) & _in(x, beginning))
        return F.struct(
            F.when(is_prefix, F.concat(acc["run"], x)).otherwise(F.lit("")).alias("run"),
            F.when(is_prefix, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(acc["run"], x)))).alias("out"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["run"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["run"]))))


def merge_surname_prefixes(pieces: Column) -> Column:
    return merge_prefixes(pieces, L.SURNAME_PREFIXES, L.BEGINNING_SURNAME_PREFIXES)


def merge_given_prefixes(pieces: Column) -> Column:
    return merge_prefixes(pieces, L.GIVEN_PREFIXES)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remove_noise_words(pieces: Column, is_surname: bool) -> Column:
    """Drops noise words; of several pieces also possible noise, keeping the last if none is left."""
    possible = L.POSSIBLE_NOISE_WORDS + (L.POSSIBLE_SURNAME_NOISE_WORDS if is_surname else ())

    def second(kept):
        strict = F.filter(kept, lambda x: ~_in(x, possible))
        return F.when(F.size(kept) <= 1, kept).when(F.size(strict) > 0, strict).otherwise(F.slice(kept, -1, 1))

    return _let(F.filter(pieces, lambda x: ~_in(x, L.NOISE_WORDS)), second)


def standardize_patronymic(c: Column) -> Column:
    for pattern, replacement in L.PATRONYMICS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def latin_text(name: Column, preserve_wildcards: bool = False) -> tuple[Column, Column]:
    """The name after blanking non-letters, before and after blanking what is not latin."""
    keep = "*?" if preserve_wildcards else ""
    text = F.regexp_replace(F.lower(transliterate(name)), "'s$", "")
    text = F.regexp_replace(F.translate(text, "`'´‘’", ""), f"[^ \\p{{L}}0-9{keep}]", " ")
    return text, F.trim(F.regexp_replace(F.regexp_replace(text, f"[^a-z0-9{keep}]", " "), " +", " "))


def normalize(name: Column, is_surname: bool, preserve_wildcards: bool = False, handle_patronymics: bool = True, dont_return_empty: bool = True) -> Column:
    """Pieces of a raw name."""
    text, latin = latin_text(name, preserve_wildcards)
    pieces = F.split(latin, " ")
    pieces = merge_surname_prefixes(pieces) if is_surname else merge_given_prefixes(expand_given_abbreviations(pieces))
    pieces = remove_noise_words(pieces, is_surname)
    pieces = remove_noise_words(F.transform(pieces, lambda x: F.regexp_replace(x, "[0-9]", "")), is_surname)
    shortest = 2 if is_surname else 1
    pieces = F.filter(pieces, lambda x: F.length(x) >= shortest)
    if dont_return_empty:
        fallback = F.array(F.regexp_replace(F.when(F.length(text) > 0, text).otherwise(name), "\\s", ""))
        pieces = _let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback))
    if is_surname and handle_patronymics:
        pieces = F.transform(pieces, standardize_patronymic)
    return F.when(name.isNotNull(), pieces)


def normalize_and_join(name: Column, is_surname: bool) -> Column:
    """Pieces joined by spaces, empty when there is none."""
    return F.array_join(normalize(name, is_surname, dont_return_empty=False), " ")


def simple_normalize(name: Column) -> Column:
    return F.lower(F.trim(transliterate(name)))


def clean_for_coder(name: Column) -> Column:
    return F.regexp_replace(F.lower(transliterate(name)), "[^a-z]", "")


def given_part(raw: Column) -> Column:
    """Of ``given^surname``: what stands before the first mark."""
    return F.regexp_replace(raw, "\\^.*$", "")


def surname_part(raw: Column) -> Column:
    """Of ``given^surname``: what stands after the last mark."""
    return F.regexp_replace(raw, "^.*\\^", "")


def strip_script(raw: Column, script: str = "Latn") -> Column:
    return F.regexp_replace(raw, f"~{script}$", "")


def pad(name: Column) -> Column:
    return F.concat(F.lit("<"), name, F.lit(">"))


def unpad(name: Column) -> Column:
    return F.substring(name, F.lit(2), F.length(name) - 2)


def frequent_names(raw: DataFrame, is_surname: bool) -> DataFrame:
    """name, frequency of raw names (name, frequency, place) that are one latin piece of several letters.

    Of raw names that become the same, the first by ``place`` gives the frequency.
    """
    one = raw.select("frequency", "place", normalize(F.col("name"), is_surname).alias("p")).where(F.size("p") == 1).select(F.col("p")[0].alias("name"), "frequency", "place")
    first = one.where("length(name) > 1 and not name rlike '[^a-z]'").groupBy("name").agg(F.min_by("frequency", "place").alias("frequency"))
    return first
