"""URL filters: explicit host and path rules, then gradient-boosted trees on lexical features.

Rules are matched in SQL functions: a rule fits its host and all subdomains when the
path starts with the rule's, and the longest fitting rule gives the verdict. Where none
fits, boosted regression trees (logistic loss, histogram splits, fitted here with numpy)
judge the url by its length, depth, digit ratio, entropy, parameter counts and suffix
statistics: the share of unwanted URLs under the host's last one, two and three names.

The trees learn from a bounded sample (``most``) of the pages' own URLs, labelled by the
rules: unwanted if a rule blocks them, else wanted, as nothing else says what is unwanted.
The model thus learns which kinds of hosts and URLs the block rules are aimed at.

Scoring needs no shuffle; the model is a closure of fixed size.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule
and is judged by the method; a null page_id stays null; where the sample has no URLs of
both kinds every score is the share of unwanted ones (0 without any); urls of any length
are judged whole; repeated rows get the same verdict; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest_hashes, table
from .learning import sigmoid

#: (verdict, host, path), fixed values.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest, as the rules see them."""
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S)
    return re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2), m.group(3)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    """The host's suffixes of one, two and three names: ``com``, ``example.com``, ``a.example.com``."""
    names = host.split(".") if host else []
    return [".".join(names[-k:]) for k in range(1, min(3, len(names)) + 1)]


class Features:
    """Lexical features of a url; the suffix statistics come from the training URLs."""

    def __init__(self, labelled: list[tuple[str, int]], most: int = 20_000, weight: float = 8.0):
        """``most`` suffixes are kept; a longer suffix leans on the next shorter one by ``weight`` URLs."""
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for url, y in labelled:
            for s in suffixes(split_url(url)[0]):
                counts[s][y] += 1
        rate = (sum(y for _, y in labelled) + 1) / (len(labelled) + 2)
        self.rate, self.share = rate, {}
        for s in sorted(sorted(counts, key=lambda s: (-sum(counts[s]), s))[:most], key=lambda s: (s.count("."), s)):
            above = self.share.get(s.partition(".")[2], rate)
            self.share[s] = (counts[s][1] + weight * above) / (sum(counts[s]) + weight)

    def of(self, url: str | None) -> list[float]:
        host, path, rest = split_url(url)
        text = url or ""
        query = rest[1:].split("#")[0] if rest[:1] == "?" else ""
        shares, last = [], self.rate
        for s in suffixes(host):
            shares.append(last := self.share.get(s, last))
        shares += [last] * (3 - len(shares))
        digits = sum(c.isdigit() for c in text)
        return [
            len(text), len(host), len(path), path.count("/"), host.count("."), host.count("-"), digits / max(1, len(text)), sum(c.isdigit() for c in host),
            entropy(host), entropy(path), query.count("="), len(query), "#" in rest, *shares,
        ]

    def matrix(self, urls) -> np.ndarray:
        return np.array([self.of(u) for u in urls], dtype=float).reshape(len(urls), -1)


class BoostedTrees:
    """Gradient-boosted regression trees for a logistic loss, with quantile histograms."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.trees_n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])
        p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = math.log(p0 / (1 - p0))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.trees_n):
            p = sigmoid(f)
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, b, g, h, rows, depth):
        leaf = self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
        if depth == 0:
            return leaf
        best, found = 1e-6, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
        for j, edges in enumerate(self.edges):
            k = len(edges) + 1
            if k < 2:
                continue
            gs, hs = (np.cumsum(np.bincount(b[rows, j], v[rows], minlength=k))[:-1] for v in (g, h))
            gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
            gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - whole
            gain[(hs < self.least / 4) | (hr < self.least / 4)] = -1
            if gain.max() > best:
                best, found = gain.max(), (j, int(gain.argmax()))
        if found is None:
            return leaf
        j, c = found
        left = b[rows, j] <= c
        return j, float(self.edges[j][c]), self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, edge, low, high = tree
        return np.where(x[:, j] <= edge, self._apply(low, x), self._apply(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.start + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x))))


class Model:
    """Trees on lexical features; ``prior`` where there is nothing to learn from."""

    def __init__(self, labelled: list[tuple[str, int]]):
        y = np.array([v for _, v in labelled], dtype=float)
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.0
        self.trees = None
        if len(y) and 0 < y.mean() < 1:
            # suffix statistics come from one half and the trees from the other, so these do not see their own labels in them
            half = np.random.default_rng(5).random(len(labelled)) < 0.5
            self.features = Features([x for x, h in zip(labelled, half) if h])
            self.trees = BoostedTrees(least=80.0).fit(self.features.matrix([u for (u, _), h in zip(labelled, half) if not h]), y[~half])

    def scores(self, urls) -> np.ndarray:
        if not len(urls):
            return np.zeros(0)
        return np.full(len(urls), self.prior) if self.trees is None else self.trees.score(self.features.matrix(urls))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, and the longest fitting rule with its verdict."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    out = pages.withColumn("__rest", rest)
    out = out.withColumn("host", F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), upper, lower))
    out = out.withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def labelled_urls(pages: DataFrame, rules=RULES, most: int = 20_000) -> list[tuple[str, int]]:
    """At most ``most`` URLs with labels from the explicit rules, chosen by a hash of page_id and url.

    1: a rule blocks it. 0: a rule allows it, or none fits, as only rules say what is unwanted.
    """
    urls = _urls(pages).where(F.col("url").contains("://"))
    hashed = F.xxhash64("page_id", "url")
    some = lowest_hashes(urls, hashed, urls.count(), most).select("page_id", "url", hashed.alias("h"))
    rows = with_rules(some, rules).select("page_id", "url", "h", (F.col("rule_verdict") == "block").alias("y"))
    return [(r["url"], int(bool(r["y"]))) for r in rows.orderBy("h", "url", "page_id").limit(most).collect()]


def train(pages: DataFrame, rules=RULES, most: int = 20_000) -> Model:
    return Model(labelled_urls(pages, rules, most))


def _urls(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))


def judge(pages: DataFrame, model: Model, rules=RULES, block_from: float = 0.5) -> DataFrame:
    """One row per page: host, path, rule, verdict and the method's score."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(model.scores(urls.tolist()))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = F.pandas_udf(score, "double")
    rows = with_rules(_urls(pages), rules).withColumn("score", scored("url"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"), "score")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, train(pages))
