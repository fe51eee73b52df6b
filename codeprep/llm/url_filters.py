"""URL verdicts: fixed host and path rules first, a small learned model for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 4_096
SIZES = (3, 4, 5)
ROUNDS = 400
RATE = 2.0
PENALTY = 1e-4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# (host, path, verdict): a rule fits the host, its subdomains and every path below.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

# The small labelled table the model learns from: url, 1 for block.
LABELLED = (
    ("http://ads.shop-deals.com/banner/120x600.gif", 1),
    ("https://ads-track.quickclicks.com/en/1", 1),
    ("https://track.clickhouse-ads.org/pixel?id=3", 1),
    ("https://adserver.popnet.org/popunder/12", 1),
    ("http://m.ads-track.cheapads.com/es/77.html", 1),
    ("https://casino-bonus.win-now.com/free/spins", 1),
    ("http://best-casino.betting.org/bonus/99", 1),
    ("https://xxx-cams.adult-site.com/live/1", 1),
    ("http://adult.xxx-video.org/en/2.html", 1),
    ("https://track.mailer.com/click/open/5512", 1),
    ("https://banner.ads.com/en/promo", 1),
    ("http://popup.ads-network.org/de/31", 1),
    ("https://cheap-pills.pharma-deals.com/buy/now", 1),
    ("http://login.spam-offers.org/win/prize", 1),
    ("https://stats.tracker.com/collect/4", 1),
    ("https://ads.example.org/fr/11.html", 1),
    ("https://ads-track.example.com/en/2044", 1),
    ("http://blog.ads-track.example.org/de/9#top", 1),
    ("https://clicktrack.example.com/es/310/", 1),
    ("https://m.spam-deals.example.org/en/55", 1),
    ("https://www.city-library.org/en/catalogue/12", 0),
    ("https://news.example.com/en/2041.html", 0),
    ("http://blog.gardening.org/es/102", 0),
    ("https://m.history.example.com/en/9589", 0),
    ("https://docs.openmaps.org/guide/intro", 0),
    ("http://wiki.mathematics.com/fr/4410#top", 0),
    ("https://www.recipes.com/en/soup/31/", 0),
    ("https://science.example.org/en/22661", 0),
    ("http://m.travel.example.org/es/918", 0),
    ("https://university.com/courses/physics", 0),
    ("https://blog.kitchen.example.com/en/43304.html", 0),
    ("http://museum.org/en/exhibits/7", 0),
    ("https://forum.bicycles.com/fr/12256", 0),
    ("https://www.weather.org/es/today", 0),
    ("https://thther.example.com/en/24121", 0),
    ("http://blog.tionble.example.org/es/4253", 0),
    ("https://m.erand.example.com/fr/14732", 0),
    ("https://books.example.com/en/5399", 0),
    ("http://www.parliament.org/en/minutes/88", 0),
    ("https://health.clinic.com/es/advice/19", 0),
)


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(found), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""

    def fits(rule: tuple) -> Column:
        there = (host == rule[0]) | host.endswith("." + rule[0])
        return there & path.startswith(rule[1])

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    pick = None
    for rule in ordered:
        value = F.struct(F.lit(rule[0] + rule[1]).alias("rule"), F.lit(rule[2]).alias("verdict"))
        pick = F.when(fits(rule), value) if pick is None else pick.when(fits(rule), value)
    return pick if pick is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def slots(host: str, path: str) -> np.ndarray:
    """Feature numbers of the character n-grams of host and path, kept apart."""
    found = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode()
        for size in SIZES:
            for at in range(len(data) - size + 1):
                found.add(zlib.crc32(part.encode() + data[at : at + size]) % FEATURES)
    return np.fromiter(sorted(found), np.int64, len(found))


def plain_parts(url: str) -> tuple[str, str]:
    """Host and path of a labelled url, as ``host_of`` and ``path_of`` cut them."""
    rest = url.partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    host = "".join(c.lower() if c in UPPER else c for c in rest[:end])
    return host, tail[:stop]


def train(labelled: Sequence[tuple[str, int]] = LABELLED) -> np.ndarray:
    """Weights and, last, the bias: plain gradient descent, the same on every run."""
    x = np.zeros((len(labelled), FEATURES + 1))
    for row, (url, _) in zip(x, labelled):
        used = slots(*plain_parts(url))
        row[used] = 1 / np.sqrt(max(len(used), 1))
        row[-1] = 1
    y = np.array([label for _, label in labelled], float)
    w = np.zeros(FEATURES + 1)
    for _ in range(ROUNDS):
        miss = 1 / (1 + np.exp(-x @ w)) - y
        w -= RATE * (x.T @ miss / len(y) + PENALTY * w)
    return w


def block_chance(host: Column, path: Column, weights: np.ndarray) -> Column:
    """The model's chance that a url should be blocked; the weights travel with the tasks.

    Bytes that are no UTF-8 count as U+FFFD.
    """

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        out = np.empty(len(hosts))
        for i, parts in enumerate(zip(hosts.to_pylist(), paths.to_pylist())):
            used = slots(*((part or b"").decode("utf-8", "replace") for part in parts))
            out[i] = weights[used].sum() / np.sqrt(max(len(used), 1)) + weights[-1]
        return pa.array(1 / (1 + np.exp(-out)))

    return score(host.cast("binary"), path.cast("binary"))


def judged(
    pages: DataFrame,
    ident: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the model's ``block_chance``.

    Rules decide first; the longest that fits wins. For the rest a logistic regression on
    hashed character n-grams, trained here from ``labelled``, blocks at 0.5 or more. A null
    url or one without ``://`` has an empty host and path, fits no rule and is judged by
    the model all the same. Rows are judged alone, so equal urls get equal verdicts; other
    columns are not looked at; an empty table gives an empty result.
    """
    weights = train(labelled)
    parts = pages.select(
        F.col(ident), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    chance = block_chance(F.col("host"), F.col("path"), weights)
    found = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    found = found.withColumn("block_chance", chance)
    model = F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow")
    return found.select(
        ident,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), model).alias("verdict"),
        "block_chance",
    )
