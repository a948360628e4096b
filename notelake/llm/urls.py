"""URL verdicts by host rules and, beyond them, gradient-boosted trees on lexical features.

The note model has no table of URLs, so these operators are general: they take any table with a
``url`` column and keep its other columns.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import common

SAMPLE = 20_000  # labelled URLs learned from, at most
TREES, DEPTH = 20, 3
FOLDS, WEIGHT = 5, 10.0  # of suffix rates: parts of the hosts, and URLs of the overall rate added to each suffix
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "letters", "hyphens", "entropy",
    "parameters", "fragment", "suffix_share", "suffix_blocked",
)

# A small labelled table, for users without labels of their own.
ALLOWED = """
http://garden.example.org/en/12
https://www.riverside.example.com/fr/340.html
http://news.harbour.example.net/de/77/
https://blog.carpenter.example.com/2021/05/winter-walk
https://m.library.example.org/es/605?page=2
http://weather.example.net/en/871#top
https://www.bakery.example.com/menu
http://museum.example.org/visit/opening-times
https://docs.compiler.example.net/guide/install.html
https://school.example.org/en/classes/2
http://www.orchard.example.net/fr/18?utm_source=feed
https://m.railway.example.com/de/459
http://choir.example.org/concerts/2019
https://shop.example.com/books/novels?page=3
https://blog.mountain.example.net/en/203.html
http://recipes.example.com/soup/leek-and-potato
https://www.townhall.example.org/de/516/
https://forum.example.net/topic/482#reply
http://poems.example.org/es/93.html
https://old-town.example.com/history
http://www.workshop.example.com/en/664
https://m.painter.example.net/es/712?ref=home
https://theatre.example.org/fr/29
http://blog.teacher.example.org/en/150?utm_source=feed
https://www.lakeside.example.net/en/938/
http://astronomy.example.com/en/57#top
https://city-archive.example.org/letters/1887
https://m.cyclist.example.com/en/321.html
http://hospital.example.net/contact
https://www.seafarer.example.org/en/845?page=2&ref=x
"""
BLOCKED = """
http://cheap-watches.example.org/en/14
https://www.fast-loans.example.com/fr/342.html
http://news.free-casino.example.net/de/78/
https://blog.adult-dates.example.com/en/206
https://m.spam-links.example.org/es/603?page=2
http://best-pills.example.net/en/873#top
https://www.win-big-now.example.com/bonus
http://replica-bags.example.org/sale/all-items-90-off
https://x7k2q9v4b1.example.net/download/setup.exe?id=88213&k=19
https://a1b2c3d4.e5f6.example.org/login/verify?session=99182736&token=5512&u=17
http://www.hot-singles.example.net/fr/19?utm_source=feed
https://m.easy-money.example.com/de/457
http://crypto-double.example.org/go/2019
https://free-gift-card-generator.example.com/claim?aff=1832&sub=77&click=90213
https://blog.link-farm.example.net/en/201.html
http://lose-weight-fast.example.com/trick/one-weird-trick
https://www.slot-games.example.org/de/518/
https://secure-update-account.example.net/verify/482#form
http://xxx-videos.example.org/es/91.html
https://93485-21-bonus.example.com/offer
http://www.seo-boost.example.com/en/662
https://m.fake-shop.example.net/es/710?ref=home
https://poker-room.example.org/fr/27
http://blog.buy-followers.example.org/en/152?utm_source=feed
https://www.cheap-meds.example.net/en/936/
http://adult-cams.example.com/en/59#top
https://qz81xw05.example.org/r/1887/5512/9941
https://m.spam-blog.example.com/en/323.html
http://win-prizes.example.net/contact
https://www.torrent-files.example.org/en/847?page=2&ref=x
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path as it is; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per code point."""
    n = F.length(text)
    parts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n,
    )
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def _suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _lexical(urls: DataFrame) -> DataFrame:
    """``row, url`` with the features of the url itself."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumn(
        "made",
        F.struct(
            F.length(url).cast("double").alias("length"),
            F.length(host).cast("double").alias("host_length"),
            F.length(path).cast("double").alias("path_length"),
            F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double").alias("depth"),
            F.size(F.split(host, r"\.")).cast("double").alias("labels"),
            _share(url, "[^0-9]").alias("digits"),
            _share(host, "[^a-z]").alias("letters"),
            F.length(F.regexp_replace(host, "[^-]", "")).cast("double").alias("hyphens"),
            _entropy(host).alias("entropy"),
            F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double").alias("parameters"),
            F.contains(url, F.lit("#")).cast("double").alias("fragment"),
            _suffix(host).alias("suffix"),
        ),
    )


class UrlModel:
    """Boosted trees, and the table of suffixes among the URLs they were learned from."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, rate: float, constant: str):
        self.trees, self.suffixes, self.rate, self.constant = trees, suffixes, rate, constant


def _rate(blocked: Column, urls: Column, rate: float) -> Column:
    """The share of blocked ones, drawn to the overall rate where there are few."""
    return (blocked + WEIGHT * rate) / (urls + WEIGHT)


def _vectors(known: DataFrame) -> DataFrame:
    """Rows of :func:`_lexical` with ``suffix_share`` and ``suffix_blocked`` as the trees take them."""
    known = known.withColumns({f"made_{f}": F.col(f"made.{f}") for f in FEATURES[:-2]})
    known = known.withColumnsRenamed({f: f"made_{f}" for f in FEATURES[-2:]}).drop("made")
    made = VectorAssembler(inputCols=[f"made_{f}" for f in FEATURES], outputCol="made_vector").transform(known)
    return made.drop(*(f"made_{f}" for f in FEATURES))


def example_urls(spark: SparkSession) -> DataFrame:
    """``(url, verdict)``: the labelled table of this module."""
    rows = [(u, "allow") for u in ALLOWED.split()] + [(u, "block") for u in BLOCKED.split()]
    return spark.createDataFrame(rows, "url string, verdict string")


def learn_urls(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """A model from ``labelled(url, verdict)``, verdicts being allow or block.

    At most ``sample`` different URLs, those with the least hashes, are learned from; one with both
    verdicts has the more frequent one, ``block`` in a tie.  A suffix counts by its share of the URLs and by its
    smoothed rate of blocked ones, which each learned URL takes from the hosts of other folds, so that no
    label reaches its own row.  Labels that follow from rules on the suffix teach the trees that suffix again:
    give labels of another origin, or those of :func:`example_urls`.  With one verdict
    only, or no labelled URL at all (then allow), the model is that constant.
    """
    blocks = (F.col("verdict") == "block").cast("double")
    rows = labelled.where("verdict in ('allow', 'block') and url is not null").select(F.col("url").cast("string").alias("url"), blocks.alias("label"))
    drawn = rows.groupBy("url").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    drawn = common.stored(drawn.orderBy(F.xxhash64("url"), "url").limit(sample), "labelled_urls")
    total, rate = drawn.agg(F.count("*"), F.avg("label")).first()
    if not total or rate in (0.0, 1.0):
        return UrlModel(None, None, rate or 0.0, "block" if rate else "allow")
    host, _ = host_and_path(F.col("url"))
    made = _lexical(drawn.withColumn("fold", F.pmod(F.xxhash64(host), F.lit(FOLDS))))
    by_fold = made.groupBy(F.col("made.suffix").alias("suffix_name"), "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    of_all = by_fold.groupBy("suffix_name").agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all"))
    share = (F.col("n_all") / float(total)).alias("suffix_share")
    # Neither table has more rows than URLs were drawn, so the bound of the sample bounds the broadcasts.
    apart = by_fold.join(F.broadcast(of_all), "suffix_name").select(
        "suffix_name", "fold", share, _rate(F.col("b_all") - F.col("b"), F.col("n_all") - F.col("n"), rate).alias("suffix_blocked")
    )
    joined = made.withColumn("suffix_name", F.col("made.suffix")).join(F.broadcast(apart), ["suffix_name", "fold"])
    trees = GBTClassifier(featuresCol="made_vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7)
    suffixes = common.stored(of_all.select("suffix_name", share, _rate(F.col("b_all"), F.col("n_all"), rate).alias("suffix_blocked")), "url_suffixes")
    return UrlModel(trees.fit(_vectors(joined.select("label", "made", "suffix_share", "suffix_blocked"))), suffixes, rate, "allow")


def judge_urls(urls: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The columns of ``urls``, as ``row``, with ``host, path, rule, verdict, score``.

    A rule (``host/path``) fits its host and all subdomains where the path starts with the rule's; the
    longest that fits decides.  Where none does, the model does by its chance of
    ``block`` (``score``, from 0.5 on).  A NULL url or one without ``://`` has empty host and path, and
    is judged by the model like any other.  Repeated rows are each judged.
    """
    rows = urls.select(F.struct(*urls.columns).alias("row"), F.col("url"))
    if model.trees is None:
        scored = rows.withColumn("score", F.lit(1.0 if model.constant == "block" else 0.0))
    else:
        known = _lexical(rows).join(F.broadcast(model.suffixes), F.col("made.suffix") == F.col("suffix_name"), "left")
        known = known.select(
            "row", "url", "made", F.coalesce("suffix_share", F.lit(0.0)).alias("suffix_share"),
            F.coalesce("suffix_blocked", F.lit(model.rate)).alias("suffix_blocked"),
        )
        made = model.trees.transform(_vectors(known))
        scored = made.withColumn("score", vector_to_array("probability")[1])
    host, path = host_and_path(F.col("url"))
    scored = scored.select("row", "score", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return scored.select(
        "row", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )
