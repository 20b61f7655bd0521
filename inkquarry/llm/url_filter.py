"""URL filters: rules, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (at most MAX_LABELLED rows, the bound is a parameter), in a fixed order, so it is the
same in every run. Scoring needs WIDTH floats per task and no shuffle. Null urls, and those without `://`, have empty host and path and fit no rule; an empty
labelled table gives a model that allows everything. Repeated rows get the same answer; further columns are ignored, and an empty table gives an empty result. URLs of any
length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import mix64

WIDTH, ORDERS, MAX_LABELLED, SLICE = 1 << 17, (3, 4, 5), 10_000, 1 << 19

#: Host, path prefix and verdict of each rule.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words that the hosts and paths of the labelled URLs are made of. A URL is labelled 1 (block) where its host or its path has one of BAD_WORDS.
BAD_WORDS = (
    "casino", "poker", "betting", "bets", "lottery", "jackpot", "bonus", "free-spins", "pills", "viagra", "replica-watches", "cheap", "free-money", "payday-loan", "win-prizes", "adult",
    "xxx", "porn", "cams", "escort", "phish", "malware", "keygen", "crack-download", "spam", "ads", "ad-tracker", "track-click", "clickbait", "popup",
)
GOOD_WORDS = (
    "library", "garden", "news", "weather", "university", "museum", "docs", "history", "travel", "cooking", "science", "health", "music", "theatre", "bicycles", "stories", "language",
    "north", "recipes", "blog", "forum", "articles", "research", "papers", "courses", "photos", "album", "contact", "help", "sports", "results", "concerts", "guide", "index", "about", "team",
    "school", "city", "archive", "letters",
)


SYLLABLES = ("th", "he", "in", "er", "an", "re", "on", "st", "tion", "ble", "mo", "la", "si", "ta", "ver", "de", "ro", "li", "ch", "ou")


def labelled_parts() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Hosts and paths with their labels: each word comes in several, alone, with a word of its own kind, and bad ones beside good ones. Names that mean nothing are good."""
    hosts = [(f"{x}example.{y}", 0) for x in ("", "www.", "m.", "files.", "shop.", "my.", "blog.") for y in ("org", "com", "net")]
    paths = [("/", 0), ("/en/12", 0), ("/fr/345.html", 0), ("/de/67/", 0), ("/index.html", 0), ("/en/7817/", 0), ("/es/4033.html", 0), ("/fr/9", 0)]
    for words, other, label in ((BAD_WORDS, BAD_WORDS, 1), (GOOD_WORDS, GOOD_WORDS, 0), (BAD_WORDS, GOOD_WORDS, 1), (GOOD_WORDS[::-1], GOOD_WORDS, 0)):
        for i, w in enumerate(words):
            v, top = other[(7 * i + 3) % len(other)], ("org", "com", "net")[i % 3]
            hosts += [(f"{w}.example.{top}", label), (f"www.{w}-{v}.example.{top}", label), (f"m.{v}{w}.example.{top}", label)] if words is other else [(f"{v}-{w}.example.{top}", label)]
            paths += [(f"/{w}/{i}", label), (f"/en/{v}-{w}.html", label), (f"/{w}-{v}", label)] if words is other else [(f"/{v}/{w}/{i}", label)]
    for i in range(200):
        name = "".join(SYLLABLES[(i * m + i // 20) % 20] for m in (1, 3, 7)[: 2 + i % 2])
        hosts.append((f"{('', 'www.', 'blog.', 'm.')[i % 4]}{name}.example.{('org', 'com', 'net')[i % 3]}", 0))
    return hosts, paths


def labelled_table() -> list[tuple[str, int]]:
    """(url, label) of hosts and paths, dealt so that every host meets several paths of either kind."""
    hosts, paths = labelled_parts()
    good, bad = [p for p, y in paths if not y], [p for p, y in paths if y]
    rows = []
    for i, (host, label) in enumerate(hosts):
        rows += [(f"http://{host}{good[(11 * i + k) % len(good)]}", label) for k in range(6)]
        rows += [(f"http://{host}{bad[(11 * i + k) % len(bad)]}", 1) for k in range(1 if label else 2)]
    return rows


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct hashed n-grams of each row's host and path, each with its own start and end marks; rows ascend."""
    found = []
    for salt, parts in enumerate((hosts, paths)):
        data = [b"^" + x.encode() + b"$" for x in parts]
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
        sizes = np.array([len(x) for x in data], dtype=np.int64)
        row = np.repeat(np.arange(len(data)), sizes)
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes from here to the end of the part
        for n in ORDERS:
            width = max(0, len(flat) - n + 1)
            gram = np.zeros(width, dtype=np.uint64)
            for k in range(n):
                gram = (gram << np.uint64(8)) | flat[k : k + width]
            here = after[:width] >= n
            cell = (mix64(gram[here] + np.uint64((2 * n + salt) << 56)) % np.uint64(WIDTH)).astype(np.int64)
            found.append(row[:width][here] * WIDTH + cell)
    distinct = np.unique(np.concatenate(found))
    return distinct // WIDTH, distinct % WIDTH


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as host_of() and path_of() have them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path.split("#")[0].split("?")[0]


def train(labelled, epochs: int = 60, rate: float = 0.01, ridge: float = 1e-2, momentum: float = 0.9) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression by full-batch gradient descent with momentum over (url, label) rows."""
    rows = sorted(labelled, key=lambda r: (str(r[0]), r[1]))[:MAX_LABELLED]
    weights, bias = np.zeros(WIDTH), 0.0
    if not rows:
        return weights, -1.0
    owner, flat = features(*map(list, zip(*(split_url(url) for url, _ in rows), strict=True)))
    used, flat = np.unique(flat, return_inverse=True)
    label, own, move, shift = np.array([y for _, y in rows], dtype=float), np.zeros(len(used)), np.zeros(len(used)), 0.0
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    for _ in range(epochs):
        margin = np.bincount(owner, own[flat], minlength=len(rows)) * scale + bias
        error = 1 / (1 + np.exp(-margin)) - label
        move = momentum * move - rate * (np.bincount(flat, (error * scale)[owner], minlength=len(used)) + ridge * own)
        shift = momentum * shift - rate * float(error.mean())
        own, bias = own + move, bias + shift
    weights[used] = own
    return weights, bias


def labelled_urls(table: DataFrame, bound: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """At most `bound` labelled rows (url, label) of a table, the first by hash."""
    rows = table.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("url", "label")).limit(bound)
    return [(f"http://{r.url}" if "://" not in r.url else r.url, r.label) for r in rows.collect()]


def scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The model's probability of block for each URL."""
    row, cell = features(hosts, paths)
    size = np.maximum(1, np.bincount(row, minlength=len(hosts)))
    return 1 / (1 + np.exp(-(np.bincount(row, weights[cell], minlength=len(hosts)) / np.sqrt(size) + bias)))


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, also where a rule decides)."""
    weights, bias = model[0].astype(np.float32), float(model[1])

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            hosts, paths, out, lo = hosts.tolist(), paths.tolist(), [], 0
            ends = np.cumsum([len(h) + len(p) + 1 for h, p in zip(hosts, paths, strict=True)])
            while lo < len(hosts):  # about SLICE characters at a time, so memory follows the longest URL and not the batch
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
                out.append(scores(hosts[lo:hi], paths[lo:hi], weights, bias))
                lo = hi
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("score", score("host", "path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    return cut.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_urls(spark.createDataFrame(labelled_table(), "url string, label int")))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).select("page_id", "host", "path", "rule", "verdict")
