"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

Everything is column expressions: the n-grams of a row are hashed and their weights summed inside the row, so scoring is one
scan without a shuffle. The model is fitted from a small labelled table of urls (:data:`SEED_URLS` unless another is
given); its size, not the corpus, bounds the fitting work, and the weights are one array of ``buckets`` numbers.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
GRAMS = (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path prefix, verdict) of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Small labelled table of urls, 1 = block.
SEED_URLS = [(url, 1) for url in (
    "https://www.casino-royal.example/slots/", "http://online-casino.example/win/now", "https://big-win.example/casino/1",
    "https://free-bets.example/odds", "http://sports-bets.example/free/2", "https://betting-tips.example/en/bets",
    "https://poker-club.example/play.html", "http://lucky-slots.example/jackpot", "https://jackpot-win.example/bonus",
    "https://ads-server.example/banner", "http://track-clicks.example/pixel", "https://ad-track.example/click?id=1",
    "http://popup-ads.example/en/7", "https://adserver.example/track/9", "https://click-tracker.example/ref",
    "http://cheap-pills.example/buy", "https://pharma-deals.example/pills/", "https://payday-loans.example/apply",
    "http://quick-loan.example/cash", "https://adult-cams.example/live", "http://adult-dating.example/meet", "http://xxx-videos.example/hot",
    "http://spam-links.example/farm/", "https://link-farm.example/spam/2", "https://free-crack.example/keygen", "http://warez-downloads.example/crack/", "https://replica-watches.example/sale",
)] + [(url, 0) for url in (
    "https://www.university.example/research/papers", "http://library.example/catalogue/books", "https://blog.writer.example/en/2020",
    "https://news.daily.example/world/article", "http://museum.example/collection/item/5", "https://docs.project.example/guide.html",
    "https://www.city.example/services/", "http://weather.example/forecast/today", "https://recipes.example/soup/12",
    "https://m.history.example/en/2331", "https://science.example/journal/issue/3", "http://school.example/lessons/math",
    "https://garden.example/plants/roses", "https://travel-notes.example/fr/paris", "http://music-lessons.example/piano",
    "https://www.health-service.example/clinics", "https://wiki.example/page?id=7", "https://winter-sports.example/de/ski", "http://forum.example/thread/88",
    "https://code.example/repo/readme", "https://blog.reader.example/de/451", "http://theatre.example/season",
    "https://www.hospital.example/contact.html", "https://photos.example/album/3", "http://english.example/en/grammar",
)]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; columns of these names are replaced."""
    name = f"`{url}`"
    rest = F.coalesce(F.expr(f"case when instr({name}, '://') > 0 then substr({name}, instr({name}, '://') + 3) end"), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def fits(host: str, prefix: str) -> Column:
    """The rule's host or a subdomain of it, with a path that starts with the rule's."""
    of_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return of_host & F.startswith(F.col("path"), F.lit(prefix))


def longest_rule(rules) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null where none fits. ``rules`` is a short list."""
    found = None
    for host, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        value = F.struct(F.lit(host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits(host, prefix), value) if found is None else found.when(fits(host, prefix), value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def gram_buckets(buckets: int = BUCKETS) -> Column:
    """Bucket numbers of the character n-grams of ``^host/path$``, host and path hashed apart."""

    def grams(side: str, n: int) -> Column:
        text = F.concat(F.lit("^"), F.lower(F.col(side)), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.lit(n - 1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(side), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*[grams(side, n) for side in ("host", "path") for n in GRAMS])


def fit(labelled: DataFrame, buckets: int = BUCKETS, regularisation: float = 0.0005) -> tuple[list[float], float]:
    """Weights and intercept from (url, label): rows with a null url or label are left out, a table without both labels gives none.

    ``labelled`` is small by contract; counts are divided by the root of their sum, so long urls do not weigh more.
    """
    rows = with_parts(labelled.where("url is not null and label is not null")).select(gram_buckets(buckets).alias("g"), F.col("label").cast("double").alias("label"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter("g", lambda x: x == b)) / F.sqrt(F.size("g")))
    rows = rows.select(array_to_vector(counts).alias("features"), "label").coalesce(1)
    if rows.select("label").distinct().count() < 2:
        return [0.0] * buckets, 0.0
    model = LogisticRegression(regParam=regularisation, standardization=False, maxIter=40).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def probability(weights: list[float], intercept: float) -> Column:
    """P(block) of the row's host and path."""
    table = F.lit(weights)
    grams = gram_buckets(len(weights))
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(grams)) + F.lit(intercept))))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, score and verdict; input columns of these names are replaced.

    A rule decides where one fits, else the model: block if score >= ``threshold``. A null or broken url has an empty host
    and path, which the model judges like any other. An empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(SEED_URLS, "url string, label int")
    weights, intercept = fit(labelled)
    judged = with_parts(pages).withColumn("score", probability(weights, intercept)).withColumn("_rule", longest_rule(rules))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), learned)}).drop("_rule")
