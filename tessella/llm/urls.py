"""URL filter: host and path rules, else a logistic regression on hashed character n-grams.

Everything runs in DataFrame functions. The weights are learnt on the driver by
plain gradient descent from a small labelled table (at most MAX_LABELLED rows)
and are integers, so that scores are exact sums.

Defined results: null urls and urls without ``://`` have an empty host and path
and are allowed; urls of fewer than three characters of host and path have no n-gram,
score 0 and are allowed unless a rule fits; repeated rows pass, and so do extra columns,
but for those that have a name of the result, which are replaced; an empty table gives
no row.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): host and path prefix; a rule also covers subdomains, and the longest wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Buckets for the n-grams of each length, the lengths, and the multipliers of the hash.
BUCKETS, GRAMS, FACTORS = 1024, (3, 4), (7919, 104729, 1299709, 15485863)
MAX_LABELLED, SCALE = 10_000, 1000

#: The labelled table: url, 1 to block.
LABELLED = (
    *((u, 1) for u in (
        "http://spam-farm.example.org/buy/1", "https://cheap-pills.example.org/order", "http://casino-bonus.example.com/win/now",
        "https://free-casino.example.org/slots?id=4", "http://adult-cams.example.net/xxx/live", "https://xxx-videos.example.com/porn/77",
        "http://win-prize.example.org/click/here", "https://clickbait-ads.example.com/ads/track", "http://seo-links.example.org/link-farm/3",
        "https://spam.example.com/spam/offer", "http://payday-loans.example.com/loan/apply", "https://replica-watches.example.org/sale",
        "http://torrent-warez.example.com/crack/keygen", "https://linkfarm.example.org/links/all", "http://spammy-farm.example.com/offers/",
        "https://bet-poker.example.org/poker/bonus", "http://ads.example.com/banner/popup", "https://doorway-spam.example.net/de/1",
        "http://porn-farm.example.org/free/xxx", "https://get-rich.example.com/money/fast", "http://spam-farm.example.org/en/12",
        "https://spam-farm.example.org/de/77.html", "http://content-farm.example.com/es/5", "https://junk-mail.example.org/fr/9",
    )),
    *((u, 0) for u in (
        "https://news.example.com/en/12", "http://blog.example.org/fr/825?page=2", "https://m.example.net/en/25#top", "https://library.example.org/books/5",
        "https://www.example.com/about", "http://docs.example.org/guide/start.html", "https://blog.thanin.example.com/en/853/", "https://university.example.org/research/paper",
        "https://m.therou.example.com/en/474.html", "http://therha.example.com/en/676", "https://museum.example.org/es/collection/9", "https://forum.example.net/thread/33",
        "https://wiki.example.org/page/History", "http://weather.example.com/de/berlin", "https://recipes.example.com/fr/tarte", "https://health.example.org/en/article/8",
        "https://thinre.example.org/en/685", "http://ononer.example.org/es/533/", "https://school.example.com/en/lesson/2", "https://city.example.org/de/rathaus",
        "https://data.example.org/table/17", "http://music.example.com/album/6", "https://sport.example.com/en/results", "https://thther.example.com/es/41",
    )),
)


def host(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    name = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(name, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: str) -> list[int]:
    codes = [ord(c) for c in text]
    return [k * BUCKETS + sum(c * f for c, f in zip(codes[i : i + n], FACTORS)) % BUCKETS for k, n in enumerate(GRAMS) for i in range(len(codes) - n + 1)]


def _parts(url: str) -> str:
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    return rest[:cut].lower() + rest[cut:].split("?")[0].split("#")[0]


@functools.cache
def weights(labelled: tuple = LABELLED, rounds: int = 300, rate: float = 4.0, decay: float = 1e-3) -> tuple[int, ...]:
    """Integer weights of all buckets, the bias last; a url's score is their mean over its n-grams plus the bias."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    rows = [(g, y) for url, y in labelled if (g := _grams(_parts(url)))]
    w = [0.0] * (BUCKETS * len(GRAMS) + 1)
    for _ in range(rounds):
        step: dict[int, float] = {}
        for grams, y in rows:
            z = w[-1] + 8 * sum(w[g] for g in grams) / len(grams)
            slope = (1 / (1 + math.exp(-z)) - y) / len(rows)
            step[len(w) - 1] = step.get(len(w) - 1, 0.0) + slope
            for g in grams:
                step[g] = step.get(g, 0.0) + 8 * slope / len(grams)
        for k in sorted(step):
            w[k] -= rate * (step[k] + decay * w[k])
    return tuple(round(SCALE * 8 * x) for x in w[:-1]) + (round(SCALE * w[-1]),)


def score(text: Column, w: tuple[int, ...]) -> Column:
    """Sum over the n-grams of weight plus bias, as a long; positive means block."""
    table = F.lit(list(w[:-1]))

    def of(codes: Column) -> Column:
        total = None
        for k, n in enumerate(GRAMS):
            def gram(i, k=k, n=n):
                mixed = sum((F.get(codes, i + j) * F.lit(FACTORS[j]) for j in range(1, n)), F.get(codes, i) * F.lit(FACTORS[0]))
                return F.get(table, (mixed % F.lit(BUCKETS) + F.lit(k * BUCKETS)).cast("int")).cast("long") + F.lit(w[-1])

            at = F.when(F.size(codes) >= n, F.sequence(F.lit(0), F.size(codes) - n)).otherwise(F.array().cast("array<int>"))
            part = F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + gram(i))
            total = part if total is None else total + part
        return total

    # A lambda variable holds the code points, so that they are made once for each url.
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("long"))
    return F.element_at(F.transform(F.array(codes), of), 1)


def judge(pages: DataFrame, url: str = "url", rules: tuple = RULES, labelled: tuple = LABELLED) -> DataFrame:
    """pages with host, path, rule, verdict and score."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    out = pages.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, prefix = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + prefix)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    out = out.withColumn("score", score(F.concat("host", "path"), weights(labelled)))
    learnt = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.withColumn("rule", rule if rule is not None else F.lit(None).cast("string")).withColumn("verdict", F.coalesce(verdict, learnt) if verdict is not None else learnt).select(*keep, "host", "path", "rule", "verdict", "score")


def oracle() -> str:
    """judge() on pages in DuckDB's SQL."""
    w = weights()
    cases = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = [(t, v, f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))") for t, v in cases]
    parts = []
    for k, n in enumerate(GRAMS):
        mixed = " + ".join(f"c[i + {j}] * {FACTORS[j]}" for j in range(n))
        parts.append(f"coalesce(list_sum(list_transform(range(1, len(c) - {n - 2}), lambda i: w[({mixed}) % {BUCKETS} + {k * BUCKETS + 1}] + {w[-1]})), 0)")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
g AS (SELECT *, list_transform(regexp_extract_all(host || path, '(?s)(.)', 1), lambda x: CAST(unicode(x) AS BIGINT)) AS c, {list(w[:-1])} AS w FROM h),
s AS (SELECT page_id, host, path, CAST({' + '.join(parts)} AS BIGINT) AS score FROM g)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{t}'" for t, v, f in fits)} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{v}'" for t, v, f in fits)} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM s
"""
