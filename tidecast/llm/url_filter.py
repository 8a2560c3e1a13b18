"""URL filters: rules first, and for other URLs logistic regression on character n-grams.

Host and path are cut into n-grams, each hashed into a bucket; the weights are fitted from a
small labelled table of URLs and travel with the scoring function. Rules are Column
expressions. One pass over the urls, no shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ascii_lower

#: Labelled URLs the model is fitted on: hosts of unwanted kinds, and ordinary ones.
BLOCKED = """
http://casino-win.example.com/en/1 https://www.best-casino.example.net/play http://online-casino.example.org/bonus
https://poker-room.example.com/join http://slots-jackpot.example.net/spin https://m.mega-slots.example.org/en/9
http://free-bets.example.com/en/12 https://sports-bets.example.org/odds http://www.bet-now.example.net/live
https://cheap-pills.example.net/en/77 http://pills-online.example.com/order https://discount-meds.example.org/buy
http://viagra-shop.example.net/cheap https://pharma-cheap.example.com/pills http://blog.diet-pills.example.org/fr/3
https://adult-x.example.org/en/4 http://www.xxx-video.example.com/watch https://adult-cams.example.net/live
http://hot-xxx.example.org/de/8 https://porn-tube.example.com/v/55 http://m.sex-chat.example.net/join
https://spam-farm.example.com/en/31 http://link-farm.example.net/seo https://seo-spam.example.org/backlinks
http://www.content-farm.example.com/page/2 https://article-spam.example.net/en/6 http://spam-links.example.org/x
https://ads-track.example.com/click http://adserver-track.example.net/pixel https://click-track.example.org/r
http://pop-ads.example.com/banner https://m.ads-network.example.net/en/15 http://track-ads.example.org/go
https://free-money.example.com/win http://win-prize.example.net/claim https://lottery-win.example.org/now
http://payday-loans.example.com/apply https://quick-loans.example.net/cash http://www.easy-cash.example.org/en/2
https://replica-watches.example.com/shop http://fake-luxury.example.net/bags https://warez-crack.example.org/dl
http://torrent-crack.example.com/keygen https://free-keygen.example.net/get http://hack-tools.example.org/free
https://blog.casino-bonus.example.net/de/44 http://www.jackpot-bets.example.org/fr/18
https://m.live-bets.example.com/en/6 http://bets-club.example.net/today http://blog.top-bets.example.org/es/2
""".split()
ALLOWED = """
http://news.example.com/en/1 https://www.dailypaper.example.net/world/2024 http://citynews.example.org/local
https://blog.example.com/en/12 http://blog.gardening.example.net/roses https://www.travelnotes.example.org/fr/9
http://wiki.example.org/page/Spark https://docs.example.com/guide/start http://www.manual.example.net/de/31
https://library.example.org/books/55 http://museum.example.com/en/77 https://www.archive.example.net/item/4
http://university.example.org/courses/8 https://school.example.com/timetable http://m.science.example.net/en/15
https://weather.example.com/today http://maps.example.org/route https://www.recipes.example.net/soup
http://cooking.example.com/bread https://music.example.org/bands/3 http://www.cinema.example.net/films
https://sport.example.com/results http://football.example.org/en/6 https://m.cycling.example.net/fr/18
http://health.example.com/advice https://hospital.example.org/visit http://www.pharmacy.example.net/hours
https://parliament.example.org/acts http://council.example.com/meetings https://www.court.example.net/de/44
http://shop.example.com/shoes https://store.example.org/lamps http://www.market.example.net/fruit
https://forum.example.com/thread/2 http://answers.example.org/q/31 https://m.community.example.net/en/2
http://history.example.com/rome https://nature.example.org/birds http://www.gardens.example.net/trees
https://code.example.com/repo http://software.example.org/release https://www.database.example.net/sql
http://mail.example.com/help https://calendar.example.org/2024 http://www.photos.example.net/es/9
https://weekly.example.com/essay http://letters.example.org/42 https://m.poems.example.net/de/8
http://thenorth.example.com/en/608 https://blog.theother.example.org/es/245 http://www.therest.example.net/fr/17
https://thehouse.example.com/en/9.html http://m.thinking.example.org/de/25 https://thatone.example.net/en/3
http://tions.example.com/en/219 https://blog.nation.example.net/fr/644 http://www.thing.example.org/es/380
https://ththing.example.com/en/77 http://m.thistle.example.net/de/498 https://www.thorn.example.org/en/14
""".split()

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
BLOCK_AT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules are (verdict, ``host/path``).

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally
    long ones the first wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, told apart by a prefix."""
    found = set()
    for mark, part in (("h", host), ("p", path)):
        text = f"^{part}$"
        for n in SIZES:
            found.update(zlib.crc32(f"{mark}{text[i:i + n]}".encode()) % buckets
                         for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(blocked: list[str], allowed: list[str], buckets: int = BUCKETS, l2: float = 1e-4,
        steps: int = 2000, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent; a URL's features have unit length."""
    rows = [(_split(u), 1.0) for u in blocked] + [(_split(u), 0.0) for u in allowed]
    found = [features(*parts, buckets) for parts, _ in rows]
    y = np.array([label for _, label in rows])
    at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    col = np.concatenate(found)
    value = np.repeat([len(f) ** -0.5 for f in found], [len(f) for f in found])
    w, b = np.zeros(buckets), 0.0
    for _ in range(steps):
        z = np.bincount(at, value * w[col], len(rows)) + b
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(col, value * error[at], buckets) + l2 * w)
        b -= rate * error.sum()
    return w, b


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:cut].lower(), path[:end]


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked=None, allowed=None,
          block_at: float = BLOCK_AT) -> DataFrame:
    """Of every page: page_id, host, path, rule, verdict, score.

    A null url, or one without ``://``, has empty host and path and is left to the model,
    which scores what there is. Very long urls are scored whole. Repeated rows and null ids
    each get a row; other columns play no part.
    """
    w, b = fit(blocked or BLOCKED, allowed or ALLOWED)
    used = {int(i): float(w[i]) for i in np.flatnonzero(w)}  # bounded by the labelled table

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = np.empty(len(host))
        for i, (h, p) in enumerate(zip(host, path, strict=True)):
            f = features(h, p)
            z = b + (sum(used.get(x, 0.0) for x in f.tolist()) / len(f) ** 0.5 if len(f) else 0.0)
            out[i] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return pd.Series(out)

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"),
                          score("host", "path").alias("score"))
    by_model = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("says", by_model).alias("verdict"), "score")
