"""Quality rules: cross-document line frequency, in SQL functions only.

Base rules look at one document: too few words, or too many words inside five-word
windows that come back. The method counts normalised lines over documents: every line,
however long, is lower-cased, its digits masked and its spaces collapsed, and hashed; per host (``source``) the documents holding it are counted, equal
texts of a host (by a 64-bit hash) as one document. Lines in more than
``max_docs`` documents of a host are removed; a document with fewer than ``min_words``
words left is depleted and rejected.

Plan: no shuffle carries texts. Line rows are hashes and counts; counting combines on
the map side, first by document and then by line, so no task takes all documents of a
common line; the join of line rows with frequent lines is left to adaptive execution,
which splits hot lines. Keys of depleted documents are written once; they are broadcast
when they are few (``broadcast_rows``) and joined by a shuffle otherwise.

Defined cases: null text has no words and fails; a null source is a host of its own;
repeated rows get the same verdict; a text of any length is judged whole; an empty table
gives an empty result. ``judge`` adds the columns ``STATS``, ``base_failed`` and ``kept``,
which replace columns of the caller with these names; ``keep_good`` leaves all as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

SPACE = r"[\\x20\\x09-\\x0D]+"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` is ``value``, computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _words(text: str) -> str:
    return f"filter(split({text}, '{SPACE}'), w -> w != '')"


def _repeat_words(words: str) -> str:
    """Words covered by five-word windows found at least twice."""
    windows = f"transform(sequence(0, size({words}) - 5), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2], {words}[i + 3], {words}[i + 4]))"
    twice = "filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h or x.h = get(s, k + 1).h, x.i, -1)), i -> i >= 0)"
    cover = "aggregate(transform(p, (v, k) -> least(5, coalesce(get(p, k + 1) - v, 5))), 0L, (a, v) -> a + v)"
    marked = _let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "s", _let(f"sort_array({twice})", "p", cover))
    return f"case when size({words}) < 6 then 0L else {_let(windows, 'h', f'case when size(array_distinct(h)) = size(h) then 0L else {marked} end')} end"


def _symbols(text: str) -> str:
    bare = text
    for c in "#*$%&|<>":
        bare = f"replace({bare}, '{c}', '')"
    return f"length({text}) - length({bare})"


def base_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the base figures of each text and the base verdict."""
    text = "coalesce(cast(text as string), '')"
    lines = f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    stats = _let(
        _words(text),
        "w",
        f"named_struct('n_words', cast(size(w) as long), 'word_chars', cast(length(array_join(w, '')) as long), 'n_repeat_words', cast({_repeat_words('w')} as long))",
    )
    dup = _let(lines, "l", "cast(size(l) - size(array_distinct(l)) as long)")
    out = docs.withColumns({"__s": F.expr(stats), "n_symbols": F.expr(f"cast({_symbols(text)} as long)"), "n_dup_lines": F.expr(dup)})
    out = out.withColumns({c: F.col(f"__s.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("__s")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))


def depleted(docs: DataFrame, max_docs: int = 20, min_words: int = 10) -> DataFrame:
    """Keys (hashes of doc_id, source and text) of documents with too little left."""
    text = "coalesce(cast(text as string), '')"
    norm = f"transform(filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'), l -> trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0'), '{SPACE}', ' ')))"
    lines = _let(
        norm,
        "l",
        "transform(l, (x, i) -> named_struct('pos', i, 'line', xxhash64(x), 'words', length(x) - length(replace(x, ' ', '')) + 1))",
    )
    rows = docs.select(_key().alias("key"), F.xxhash64(F.col("source").cast("string")).alias("host"), F.xxhash64(F.expr(text)).alias("copies"), F.expr(lines).alias("lines"))
    rows = rows.withColumn("all_words", F.expr("cast(aggregate(lines, 0, (a, x) -> a + x.words) as int)"))
    frequent = (
        rows.select("host", "copies", F.explode(F.expr("array_distinct(transform(lines, x -> x.line))")).alias("line"))
        .groupBy("host", "line").agg(F.count_distinct("copies").alias("n")).where(F.col("n") > max_docs).select("host", "line")
    )
    # a document with fewer words fails the base rules already
    hit = rows.where(F.col("all_words") >= min_words).select("key", "host", "all_words", F.inline("lines")).join(frequent, ["host", "line"])
    removed = hit.groupBy("key").agg(F.max("all_words").alias("all_words"), F.expr("aggregate(collect_set(named_struct('pos', pos, 'words', words)), 0L, (a, x) -> a + x.words)").alias("gone"))
    return removed.where(F.col("all_words") - F.col("gone") < min_words).select("key")


def judge(docs: DataFrame, max_docs: int = 20, min_words: int = 10, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with base figures, ``base_failed`` and ``kept``."""
    bad = checkpointed(depleted(docs, max_docs, min_words).withColumn("__bad", F.lit(True)).withColumnRenamed("key", "__key"))
    if bad.count() <= broadcast_rows:
        bad = F.broadcast(bad)
    out = base_stats(docs).withColumn("__key", _key()).join(bad, "__key", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__key", "__bad")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "source") else f"__own_{k}") for k, c in enumerate(names)])
    kept = judge(plain).where("kept")
    return kept.select(*[F.col(c if c in ("doc_id", "text", "source") else f"__own_{k}").alias(c) for k, c in enumerate(names)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *STATS, "base_failed", "kept")


#: DuckDB's form of the query.
ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) > 5)),
g2 as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rep as (select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from g2) group by doc_id),
base as (select w.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from w left join rep using (doc_id)),
nl as (select doc_id, source, list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), lambda x: trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) as l from d),
ln as (select doc_id, source, l[pos] as line, len(string_split(l[pos], ' ')) as words from (select doc_id, source, l, unnest(range(1, len(l) + 1)) as pos from nl)),
freq as (select ln.source, ln.line from ln join d using (doc_id) group by ln.source, ln.line having count(distinct d.t) > 20),
gone as (select ln.doc_id, sum(ln.words) as n from ln join freq on ln.line = freq.line and ln.source is not distinct from freq.source group by ln.doc_id),
tot as (select doc_id, sum(words) as n from ln group by doc_id)
select base.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
 n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(tot.n, 0) - coalesce(gone.n, 0) >= 10 as kept
from base left join gone on base.doc_id = gone.doc_id left join tot on base.doc_id = tot.doc_id
"""
