"""URL verdicts: allow and block rules first, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small table of labelled URLs (an argument; `labelled_urls` makes the
default from word lists) and is applied to the n-grams of host and path, each with its own hash seed.  Rules are
looked up by the host's suffixes, so their number does not slow a verdict.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, read, ship

#: Buckets of the n-gram hash (a power of two), lengths of n-grams in bytes, and the most labelled URLs that training takes.
BITS, GRAMS, SAMPLE = 16, (3, 4, 5), 20_000
#: The log odds of label 1 without any known n-gram.
BIAS = -1.0

#: Words of unwanted and of wanted URLs, as hosts and paths have them.
UNWANTED = ["casino", "poker", "jackpot", "slots", "betting", "viagra", "cheap-pills", "porn", "xxx-videos", "escort", "hot-singles", "warez", "keygen",
            "cracked", "torrent", "payday-loans", "quick-cash", "replica-watches", "miracle-diet", "phishing", "malware", "adclick", "backlinks", "spam"]
WANTED = ["wiki", "docs", "library", "university", "museum", "news", "science", "history", "recipes", "weather", "travel", "research", "school", "forum",
          "blog", "project", "journal", "gardening", "music", "mathematics", "health", "archive", "books", "shop"]
_HOSTS, _PATHS = ["{}.example", "www.{}.example", "{}-online.example", "my{}.example"], ["/", "/{}", "/{}/index.html", "/en/{}", "/2019/{}", "/{}?id=7"]


def labelled_urls() -> list[tuple[str, int]]:
    """URLs with label 1 (unwanted) or 0: each word with its neighbours in the list, in hosts and paths."""
    out = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for j, host in enumerate(_HOSTS):
                for n in (1, 5):
                    path = _PATHS[(i + j + n) % len(_PATHS)].format(words[(i + n * (j + 1)) % len(words)])
                    out.append((f"http://{host.format(word)}{path}", label))
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ://."""
    known = F.coalesce(url, F.lit(""))
    part = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(known, part, 1), upper, upper.lower()), F.regexp_extract(known, part, 2)


def grams(texts: Sequence[bytes], seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and buckets of the n-grams of all texts, each taken with ^ before and $ behind, with repeats."""
    data = np.frombuffer(b"".join(b"^%s$" % t for t in texts), np.uint8).astype(U64)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    row, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    rows, found = [], []
    for k in GRAMS:
        n = max(0, len(data) - k + 1)
        h = np.full(n, seed * 0x9E3779B97F4A7C15 + k & 0xFFFFFFFFFFFFFFFF, U64)
        for i in range(k):
            h += data[i : n + i] + U64(1)
            mix64(h)
        inside = np.arange(n) + k <= end[:n]
        rows.append(row[:n][inside])
        found.append((h >> U64(64 - bits))[inside].astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def features(hosts: Sequence[str], paths: Sequence[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct buckets of the n-grams of hosts and paths."""
    parts = [grams([t.encode("utf-8", "surrogatepass") for t in texts], seed, bits) for seed, texts in enumerate((hosts, paths))]
    key = np.unique(np.concatenate([r << bits | b for r, b in parts]))
    return key >> bits, key & ((1 << bits) - 1)


def scores(weights: np.ndarray, hosts: Sequence[str], paths: Sequence[str], bits: int) -> np.ndarray:
    """Probabilities of label 1; a URL's features are scaled to unit length."""
    rows, found = features(hosts, paths, bits)
    sums, count = (np.bincount(rows, weights=w, minlength=len(hosts)) for w in (weights[found], np.ones(len(found))))
    return 1 / (1 + np.exp(-np.clip(sums / np.sqrt(np.maximum(count, 1)) + weights[-1], -35, 35)))


def train(hosts: Sequence[str], paths: Sequence[str], labels: Sequence[int], bits: int = BITS, epochs: int = 300, rate: float = 8.0,
          l2: float = 1e-3, bias: float = BIAS) -> np.ndarray:
    """Weights (the bias last) by full gradient descent.  The bias is given: a URL of unknown n-grams is let through."""
    w, y = np.zeros((1 << bits) + 1), np.asarray(labels, float)
    w[-1] = bias
    if not len(y):
        return w
    rows, found = features(hosts, paths, bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    for _ in range(epochs):
        margin = np.bincount(rows, weights=w[found], minlength=len(y)) * scale + w[-1]
        g = (y - 1 / (1 + np.exp(-margin))) / len(y)
        step = np.bincount(found, weights=(g * scale)[rows], minlength=len(w)) - l2 * w / len(y)
        w[:-1] += rate * step[:-1]
    return w


class Rules:
    """(verdict, host and path such as "example.com/en/"): a rule fits its host and all subdomains if the path starts
    with the rule's; the longest that fits decides, the later of two equally long ones."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[int, int, str, str, str]]] = {}
        for n, (say, text) in enumerate(rules):
            host, _, path = text.partition("/")
            self.by_host.setdefault(host, []).append((len(text), n, "/" + path, text, say))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = None, 0
        while at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[2]) and (best is None or rule > best):
                    best = rule
            at = host.find(".", at) + 1 or -1
        return (None, None) if best is None else best[3:]


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, least: float = 0.5, bits: int = BITS,
             sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of `pages` (page_id, url; others are ignored).

    `labelled` has url and label (1: unwanted; rows with other labels than 0 and 1 and null urls are left out); at most
    `sample` rows of it are taken, in the order of a hash of url.  The longest rule that fits decides (see `Rules`),
    else the model does: block from a score of `least` on.  Null, empty and malformed URLs have an empty host and path,
    fit no rule and are judged by the model; very long URLs are judged whole; repeated rows are judged alike; an empty
    table gives an empty result, and without labelled URLs all scores are that of BIAS.
    """
    spark = pages.sparkSession
    ship(spark)
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    host, path = host_path(F.col("url"))
    known = labelled.where("url is not null and label in (0, 1)").select("url", "label").distinct().orderBy(F.xxhash64("url"), "url", "label")
    taken = known.limit(sample).select(host, path, "label").collect()
    sent = spark.sparkContext.broadcast((train(*(zip(*taken, strict=True) if taken else ([], [], [])), bits), Rules(rules)))

    @F.arrow_udf("struct<rule: string, ruled: string, score: double>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        weights, fits = sent.value
        h, p = hosts.to_pylist(), paths.to_pylist()
        found = [fits(a, b) for a, b in zip(h, p, strict=True)]
        score = [scores(weights, h[a : a + 2048], p[a : a + 2048], bits) for a in range(0, len(h), 2048)]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()),
             pa.array(np.concatenate(score) if score else [], pa.float64())], ["rule", "ruled", "score"])

    out = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("j", judge("host", "path"))
    model = F.when(F.col("j.score") >= least, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "j.rule", F.coalesce("j.ruled", model).alias("verdict"), "j.score")


#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "pages"), RULES)
