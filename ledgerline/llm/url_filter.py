"""URL filter: allow and block rules, and for URLs that no rule fits a logistic regression on hashed character n-grams.

Host and path are cut out of the URL by plain string rules; their n-grams are hashed apart, so `pills` means one thing in
a host and another in a path. The regression is fitted in numpy on a small labelled URL table, passed as a parameter
(LABELLED below by default), and only its weight vector travels to the executors. No shuffle.

Defined results: a URL that is null or has no `://` has an empty host and an empty path; no rule fits it, and the
regression judges the empty strings. Of the rules that fit, the longest wins, the earlier of two equally long ones. URLs of
any length are read whole; rows that repeat a URL or an id are judged alike and all stay; an empty table gives an empty
one; other columns stay, those named like a result are replaced. With labels of one class all other URLs get that class,
with none they are blocked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, fresh, frugal, read_table
from ledgerline.llm.grams import hashed_grams

BITS, SIZES = 16, (3, 4, 5)

#: Rules of the query, (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The labelled URL table: verdict and URL, all made up under top-level domains that are reserved for examples and tests.
LABELLED = """
allow https://www.city-library.example/catalogue/1021
allow https://gardening-notes.example/2021/05/pruning-roses.html
allow http://harbour-times.test/news/local?page=2
allow https://museum-of-history.example/exhibitions/bronze-age
allow https://weather-station.test/forecast/week
allow https://university.example/courses/physics/syllabus.pdf
allow https://docs.openproject.test/guide/install
allow https://recipes-from-home.example/soup/lentil
allow https://townhall.test/services/permits
allow https://mountain-hikes.example/trails/north#map
allow https://science-journal.test/articles/907
allow http://railway-maps.example/lines/coast
allow https://health-clinic.test/advice/vaccination
allow https://theatre-royal.example/programme/autumn
allow https://old-bookshop.test/poetry/985
allow https://astronomy-club.example/observations/44
allow https://farmers-market.test/stalls
allow https://newsroom-archive.example/2019/05/story
allow https://bird-atlas.test/species/owl
allow https://chess-academy.example/lessons/endgames
allow https://school-district.test/calendar/2024
allow https://parliament-records.example/debates/session-12
allow https://encyclopedia.test/wiki/Photosynthesis
allow https://languages.example/grammar/verbs?level=b1
allow https://kernel-mailinglist.test/archive/2020/msg00321.html
allow https://food-safety.example/reports/annual
allow https://knitting-patterns.test/sweaters/cable
allow https://film-reviews.example/classic/1957
allow https://river-authority.test/levels/station/7
allow https://open-data.example/datasets/census/2011
allow https://statistics-office.test/publications/labour
allow https://guitar-lessons.example/chords/minor
allow https://tax-advice.test/forms/self-employed
allow https://cycling-routes.example/tour/lakes
allow https://philosophy-reader.test/essays/on-memory
allow https://aquarium.example/visit/opening-hours
allow https://veterinary-care.test/dogs/nutrition
allow https://legal-aid.example/tenants/rights
allow https://programming-forum.test/questions/4821/sorting-a-list
allow https://orchestra.example/season/concerts
block https://online-casino-bonus.example/register
block https://free-casino-spins.test/slots/77
block http://best-viagra-deals.example/buy/now
block https://adult-xxx-videos.test/watch/18
block https://hot-xxx-cams.example/live/5
block http://win-free-prizes.test/claim/3
block https://fast-cash-loans.example/apply/9
block https://replica-watches-shop.test/rolex/2
block http://clickbait-network.example/you-wont-believe/100
block https://seo-link-exchange.test/out/222
block https://free-download-crack.example/keygen/7
block http://warez-torrents.test/get/15
block https://betting-tips-casino.example/odds/64
block https://online-pharmacy-discount.test/order/no-prescription
block http://generic-meds-discount.example/cialis/12
block https://malware-download.test/setup.exe
block https://account-verify-login.example/phishing/secure
block http://porn-tube.test/videos/55
block https://spammy-offers.example/promo/31
block https://auto-content-spam.test/spin/19
block https://spam-blog-network.example/post/4411
block https://miracle-weight-loss-pills.test/buy/cheap
block https://cheap-cigarettes-online.example/order/8
block https://escort-girls-xxx.test/city/berlin
block http://poker-jackpot-bonus.example/free/spins
block https://crypto-double-your-money.test/invest/now
block https://get-rich-quick.example/secret/method
block https://buy-followers-cheap.test/instagram/1000
block https://essay-writing-cheap.example/order/now
block https://cracked-software-keygen.test/download/serial
block https://payday-loan-cash.example/apply/instant
block http://xxx-porn-pics.test/gallery/88
block https://casino-roulette-win.example/bonus/code
block https://link-farm-directory.test/add/url
block https://spam-mail-farm.example/unsubscribe/9
block https://fake-rolex-cheap.test/sale/70-off
block https://viagra-cialis-cheap.example/pills/online
block https://free-iphone-winner.test/claim/prize
block https://torrent-crack-serial.example/get/full
block https://adult-dating-sex.test/join/free
"""


def labelled_urls(table: str = LABELLED) -> list[tuple[str, str]]:
    return [tuple(line.split(None, 1)) for line in table.strip().splitlines()]


def host_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(after) + 4)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), ascii_lower(host)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(after) + 4)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, else null. rules: a short list, as it becomes one expression."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the last in the chain is asked first
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | F.endswith(host, F.lit("." + rule[:cut]))) & F.startswith(path, F.lit(rule[cut:]))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    a, b = hashed_grams(hosts, SIZES, BITS, seed=1), hashed_grams(paths, SIZES, BITS, seed=2)
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


def _scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    row, bucket = _features(hosts, paths)
    n = np.maximum(1, np.bincount(row, minlength=len(hosts)))
    z = np.bincount(row, weights[bucket], len(hosts)) / np.sqrt(n) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as host_of and path_of have them."""
    rest = (url or "").partition("://")[2]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    end = min((k for k in (rest.find(c, cut) for c in "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]


def fit(labelled: Sequence[tuple[str, str]], rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression; 1 is block. All rows weigh alike within a class, both classes the same."""
    y = np.array([v == "block" for v, _ in labelled], np.float64)
    weights, bias = np.zeros(1 << BITS), 0.0
    if not len(y) or y.min() == y.max():
        return weights, (0.0 if not len(y) else 5.0 * (2 * y[0] - 1))
    hosts, paths = map(list, zip(*(split_url(u) for _, u in labelled)))
    row, bucket = _features(hosts, paths)
    n = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(rounds):
        z = np.bincount(row, weights[bucket], len(y)) / n + bias
        g = (1 / (1 + np.exp(-z)) - y) * share
        weights -= 4.0 * (np.bincount(bucket, (g / n)[row], 1 << BITS) + decay * weights)
        bias -= 1.0 * g.sum()
    return weights, float(bias)


def block_score(host: Column, path: Column, labelled: Sequence[tuple[str, str]]) -> Column:
    """The regression's probability of block."""
    weights, bias = fit(labelled)
    weights = weights.astype(np.float32)

    @F.pandas_udf("double")
    @frugal
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            h, p, n = hosts.tolist(), paths.tolist(), 2000
            yield pd.Series(np.concatenate([_scores(weights, bias, h[k : k + n], p[k : k + n]) for k in range(0, len(h), n)] or [np.zeros(0)]))

    return run(host, path)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """pages with host, path, score (probability of block), rule and verdict; columns of those names are replaced."""
    labelled = labelled_urls() if labelled is None else labelled
    new = ("host", "path", "score", "rule", "verdict")
    rest = [c for c in pages.columns if c not in new]
    (named,) = fresh(pages, "named")
    cut = pages.select(*rest, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    both = cut.withColumn("score", block_score(F.col("host"), F.col("path"), labelled)).withColumn(named, matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return both.select(*rest, "host", "path", "score", F.col(f"{named}.rule").alias("rule"), F.coalesce(F.col(f"{named}.verdict"), own).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
