"""URL filters: listed rules first, then logistic regression on hashed character n-grams.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
the path follows up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and all
subdomains if the url's path starts with the rule's; the longest that fits wins (of equally
long ones the one with the longer host). Other urls are judged by a logistic regression on
hashed n-grams (three to five characters, apart for host and path), fitted to a small table of
labelled urls (``url``, ``label``: 1 means block); everything runs on Spark's own functions.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and
is judged on its empty n-grams (the bias alone). Repeated pages each get a row.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES, REGULARISATION, THRESHOLD = 1 << 16, (3, 4, 5), 0.01, 0.5
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules in use: verdict and host/path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: The small labelled table: urls to block, then urls to allow.
BLOCKED = [f"{scheme}://{host}/{rest}" for scheme, host, rest in [
    ("http", "cheap-pills.example.org", "en/buy-now.html"), ("https", "spam-farm.example.net", "en/44?utm_source=feed"),
    ("http", "www.casino-bonus.example.org", "de/12"), ("http", "free-casino.example.net", "en/win"),
    ("https", "pills-online.example.org", "es/33.html"), ("http", "adult-chat.example.org", "en/9"),
    ("http", "www.spam-links.example.org", "fr/links"), ("https", "seo-farm.example.net", "en/100"),
    ("http", "cheap-loans.example.org", "en/offer?ref=x"), ("https", "m.poker-bonus.example.org", "de/bonus"),
    ("http", "replica-watches.example.net", "en/cheap"), ("http", "free-pills.example.org", "en/7#top"),
    ("https", "win-money.example.org", "en/click"), ("http", "xxx-video.example.net", "en/free"),
    ("http", "link-farm.example.org", "en/728"), ("https", "cheap-meds.example.org", "fr/450")]]
ALLOWED = [f"{scheme}://{host}/{rest}" for scheme, host, rest in [
    ("https", "library.example.org", "en/12"), ("http", "blog.gardening.example.org", "en/853/"),
    ("https", "www.history.example.org", "de/97.html"), ("https", "m.weather.example.net", "en/25#top"),
    ("http", "news.example.org", "fr/825?page=2&ref=x"), ("https", "university.example.net", "en/670"),
    ("http", "docs.thread.example.org", "en/960"), ("https", "blog.mother.example.net", "de/533/"),
    ("https", "museum.example.org", "es/978?page=2"), ("http", "www.river.example.org", "en/453#top"),
    ("https", "other.example.net", "de/474.html"), ("https", "m.then.example.org", "en/777?utm_source=feed"),
    ("http", "nation.example.org", "fr/414"), ("https", "the.weather.example.org", "en/471"),
    ("https", "station.example.net", "en/148.html"), ("http", "blog.thinker.example.org", "es/797")]]


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_and_path(rows: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url).cast("string")
    return rows.withColumn("host", F.translate(_part(u, 1), UPPER, SMALL)).withColumn("path", _part(u, 2))


def _grams(column: str, mark: str) -> Column:
    chars = F.filter(F.split(F.col(column), ""), lambda c: c != "")

    def of(n):
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(f"{mark}{n}:"), *[F.get(chars, i + k) for k in range(n)]))
    return F.concat(*[of(n) for n in SIZES])


def _features(rows: DataFrame) -> DataFrame:
    grams = rows.withColumn("grams", F.concat(_grams("host", "h"), _grams("path", "p")))
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(grams)


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """A model from a small table ``url, label`` (1: block); null labels are left out."""
    rows = host_and_path(labelled.selectExpr("url", "cast(label as double) as label").where("label is not null"))
    return LogisticRegression(regParam=REGULARISATION, maxIter=50, tol=1e-8).fit(_features(rows).select("features", "label").coalesce(1))


def rule(rules: list[tuple[str, str]] = RULES) -> Column:
    """The rule that decides, of columns ``host`` and ``path``; null where none fits."""
    out = None
    for _, text in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return F.lit(None).cast("string") if out is None else out


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the model's ``score`` (1: block) of each page."""
    rows = host_and_path(pages.select("page_id", "url")).withColumn("rule", rule(rules))
    scored = model.transform(_features(rows)).withColumn("score", vector_to_array("probability")[1])
    listed = None
    for verdict, text in rules:
        listed = F.when(F.col("rule") == text, verdict) if listed is None else listed.when(F.col("rule") == text, verdict)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", (own if listed is None else F.coalesce(listed, own)).alias("verdict"), "score")
