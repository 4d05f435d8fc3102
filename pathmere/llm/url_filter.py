"""URL filters: host rules first, then logistic regression on hashed character n-grams.

Everything is a DataFrame or SQL expression. A URL's features are the distinct 3- to 5-grams of its
host and its path, hashed to ``DIMENSIONS`` slots. Training takes a small labelled table of URLs
(at most ``max_rows``, those with the least hash): one row gathers its features by URL and by
feature, and one ``aggregate`` expression runs full-batch gradient descent over them. The weights
(at most ``DIMENSIONS`` doubles) return to the driver and become an array literal, so scoring is
one projection without a shuffle that reads the URL column only.

Defined cases: a null URL, or one without "://", has an empty host and path and is judged by the
intercept; labelled rows with a null URL or label are not learned from; without labelled rows
everything is allowed; equal URLs get equal verdicts; the input row is kept in a struct ``row``, so
other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, GRAMS = 8192, (3, 4, 5)
#: (host and path prefix, verdict): a rule fits its host and all subdomains.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: A small labelled table: words of hosts by verdict, each written as the hosts and paths below.
UNWANTED = (
    "casino", "casino-win", "poker-room", "slots-jackpot", "free-bets", "sports-betting", "lotto-bonus", "cheap-pills", "pharma-pills", "viagra-shop", "cialis-online",
    "weight-loss-pills", "adult-x", "adult-video", "xxx-tube", "porn-hub", "sex-cams", "hot-singles", "ads-track", "ad-server", "click-ads", "banner-ads", "tracker-pixel",
    "spam-farm", "link-farm", "seo-spam", "replica-watches", "payday-loan", "crypto-doubler", "free-gift-cards", "win-prizes", "warez-crack", "keygen-serial", "torrent-warez",
    "bet-now", "bets-live", "gambling", "pills-now", "adult", "ads", "spam", "xxx", "casino-bets", "spam-ads",
)
WANTED = (
    "library", "museum", "weather", "recipes", "gardening", "university", "science", "history", "city-news", "daily-press", "sportsclub", "football", "music-school", "theatre",
    "travel-notes", "mountain-trail", "open-source", "developer-docs", "python-notes", "engineering", "health-center", "hospital", "pharmacy-school", "bookshop", "farmers-market",
    "organic-farm", "train-schedule", "adults-education", "additive", "address-book", "tracking-birds", "winter-garden", "freedom-press", "parliament", "justice", "philosophy",
    "anderson", "national-park", "reading-room", "heritage", "ontario", "estate", "interest", "orchestra", "hearth", "thornton", "winton", "archives", "courses", "weekend-hikes",
    "islands", "graffiti", "houses", "themes", "methods", "legends", "friends", "spaghetti", "dynasties", "the-times", "northern", "athletics", "mathematics", "worthing",
    "others", "whether", "together", "anthology", "this-and-that", "roadside", "understanding", "ancient-lands", "handbooks", "tides", "stories", "authors", "month-in-review",
    "kitchen", "energy", "green-valley", "pathfinder", "film-editing", "alphabet", "better-health", "tabletop", "addresses", "loads", "roads", "spartan",
)
#: Paths by verdict; each comes with the same neutral hosts, so only the path can decide.
UNWANTED_PATHS = (
    "casino/bonus", "casino-games/slots", "online-casino", "poker/free-chips", "slots/jackpot", "bet/live-odds", "sports-betting/odds", "lotto/winners", "gambling/roulette",
    "pills/buy-cheap", "buy-pills-online", "cheap-viagra", "viagra/order", "cialis/no-prescription", "weight-loss/pills", "porn/videos", "xxx/gallery", "adult/cams", "sex/chat-live",
    "ads/click", "adserver/banner", "click/track", "tracking/pixel.gif", "banner-ads/728", "spam/offer", "free-gift-cards", "win-prizes/claim", "free-iphone/claim", "payday-loan/apply",
    "replica-watches/sale", "warez/download", "crack/keygen", "keygen-serial/free", "torrent/warez", "crypto-doubler/send", "get-rich/now",
)
WANTED_PATHS = (
    "about/team", "contact", "news/politics", "articles/climate", "blog/cooking-pasta", "docs/install", "docs/api/reference", "library/catalogue", "recipes/bread", "science/physics",
    "history/rome", "sports/football-results", "travel/norway", "music/classical", "wiki/mountains", "courses/algebra", "events/calendar", "weather/today", "books/reviews", "museum/visits",
    "garden/tulips", "health/exercise", "education/schools", "articles/addresses", "wiki/bettina", "docs/tracker-setup", "photos/islands", "research/papers", "help/faq", "products/chairs",
    "jobs/open", "press/releases", "stories/winter", "guides/cycling", "forum/questions", "archive/letters",
    "", "en/17", "en/2304", "de/51/", "de/1206", "fr/388.html", "fr/9", "es/6420", "es/73", "page/12", "2021/05/14", "index.html",
)
NEUTRAL_HOSTS = ("http://www.maple-street.example.com/", "https://oakfield.example.org/", "https://blog.riverbend.example.net/", "http://home.stonebridge.example.com/")
_HOSTS = ("http://www.{}.example.com/", "https://{}.example.org/", "https://blog.{}.example.net/", "http://m.{}.example.com/", "https://{}.com/")
_PATHS = ("en/{}", "de/{}/", "fr/{}.html", "es/{}", "")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as written; null if none does."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, below = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + below), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def features(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Distinct slots of the n-grams of "^host$" and "^path$"."""

    def grams(text: Column, tag: str) -> Column:
        # characters by position, bound once: a substring would walk a long text from its start each time
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        slot = lambda c, i, n: F.pmod(F.xxhash64(F.lit(tag), F.concat(*[F.get(c, i + k) for k in range(n)])), F.lit(dimensions)).cast("int")

        def of(c: Column) -> Column:
            runs = [
                F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: slot(c, i, n))).otherwise(F.array().cast("array<int>"))  # noqa: B023
                for n in GRAMS
            ]
            return F.concat(*runs)

        return F.get(F.transform(F.array(letters), of), F.lit(0))

    return F.array_distinct(F.concat(grams(host, "host"), grams(path, "path")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The tables above as ``(url, label)``: label 1 is to be blocked."""
    words = spark.createDataFrame([(w, label) for label, group in ((1, UNWANTED), (0, WANTED)) for w in group], "word string, label int")
    at = F.xxhash64("word")
    urls = F.transform(
        F.array(*map(F.lit, _HOSTS)),
        lambda host, i: F.concat(F.replace(host, F.lit("{}"), F.col("word")), F.replace(F.get(F.array(*map(F.lit, _PATHS)), F.pmod(at + i, F.lit(len(_PATHS))).cast("int")), F.lit("{}"), F.pmod(at, F.lit(9973)).cast("string"))),
    )
    paths = spark.createDataFrame([(h + p, label) for label, group in ((1, UNWANTED_PATHS), (0, WANTED_PATHS)) for p in group for h in NEUTRAL_HOSTS], "url string, label int")
    return words.select(F.explode(urls).alias("url"), "label").unionByName(paths)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[float, ...]


def train(labelled: DataFrame, steps: int = 150, rate: float = 2.0, l2: float = 1e-3, dimensions: int = DIMENSIONS, max_rows: int = 20_000) -> Model:
    """Logistic regression on ``(url, label)`` by gradient descent inside one expression."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_rows)
    url = F.col("url")
    listed = rows.select(F.struct(features(host_of(url), path_of(url), dimensions).alias("x"), F.col("y")).alias("r")).agg(F.collect_list("r").alias("rows"))
    listed = listed.where(F.size("rows") > 0).select(F.col("rows.x").alias("x"), F.col("rows.y").alias("y"), F.size("rows").alias("n"))
    # urls by slot: slot 0..dimensions-1 of w, the intercept last
    pairs = listed.select(F.posexplode("x").alias("r", "f")).select("r", F.explode("f").alias("f")).groupBy("f").agg(F.collect_list("r").alias("p"))
    by_slot = pairs.agg(F.map_from_entries(F.collect_list(F.struct("f", "p"))).alias("m")).select(F.expr(f"transform(sequence(0, {dimensions - 1}), f -> coalesce(m[f], array()))").alias("p"))
    both = listed.withColumn("k", F.lit(1)).join(by_slot.withColumn("k", F.lit(1)), "k")  # one row each
    error = f"transform(x, (f, r) -> 1D / (1D + exp(-(w[{dimensions}] + aggregate(f, 0D, (a, j) -> a + w[j])) )) - y[r])"
    step = f"transform(p, (rows, j) -> w[j] - {rate}D * (aggregate(rows, 0D, (a, r) -> a + e[r]) / n + {l2}D * w[j]))"
    bias = f"array(w[{dimensions}] - {rate}D * aggregate(e, 0D, (a, v) -> a + v) / n)"
    fit = f"aggregate(sequence(1, {steps}), array_repeat(0D, {dimensions + 1}), (w, i) -> element_at(transform(array({error}), e -> concat({step}, {bias})), 1))"
    found = both.select(F.expr(fit).alias("w")).collect()
    return Model(found[0]["w"][-1], tuple(found[0]["w"][:-1])) if found else Model(-1.0, (0.0,) * dimensions)


def score_of(host: Column, path: Column, model: Model) -> Column:
    """Probability that the URL is to be blocked."""
    weights = F.expr(f"array({', '.join(f'{w:.9e}D' for w in model.weights)})")  # folded to one literal
    total = F.aggregate(features(host, path, len(model.weights)), F.lit(float(model.bias)), lambda a, f: a + F.get(weights, f))
    return 1 / (1 + F.exp(-total))


def judged(pages: DataFrame, model: Model, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``(row, host, path, rule, verdict, score)`` for every row of ``pages``."""
    parts = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score_of(F.col("host"), F.col("path"), model).alias("score"))
    said = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return scored.select("row", "host", "path", "rule", said.alias("verdict"), "score")
