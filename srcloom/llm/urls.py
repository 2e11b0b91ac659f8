"""URL filters: host and path rules, and for all other urls logistic regression on hashed n-grams.

Everything is DataFrame and Spark ML work in the JVM. The model is trained from a small labelled table of
urls: character n-grams of host and path, kept apart by a mark, are hashed to a fixed number of features.
``LABELLED`` is a table for a start; any (url, label) table does, as long as it is small.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the score of a url
without n-grams; repeated rows get equal verdicts; extra columns do not matter, as only ``keep`` is returned; without labelled
urls of both kinds the score is 0 and the method allows. Of rules of equal length the first listed wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm.common import LOWER, UPPER, quoted, without

FEATURES = 1 << 14
GRAMS = (3, 4)
ITERATIONS = 40
REGULARISATION = 1e-3
# Score from which the method blocks.
CUT = 0.5

Rules = Sequence[tuple[str, str]]

# Small table of labelled urls, written for this library.
LABELLED = """
block http://casino-royal.example.org/play/1
block https://www.best-casino.example.net/en/bonus
block http://online-casino-slots.example.com/
block http://win-big.example.com/en/88
block https://win-jackpot-now.example.org/win
block http://sport-bets.example.net/odds/12
block https://m.bets-today.example.com/en/7.html
block http://free-spins.example.org/en/31
block http://free-money-fast.example.com/fr/2
block https://poker-stars-bonus.example.net/de/4/
block http://buy-pills-online.example.com/cart
block https://cheap-meds.example.org/en/9?ref=a
block http://diet-pills-now.example.net/es/5
block http://cheap-watches.example.com/sale
block https://replica-bags-cheap.example.org/de/77
block http://payday-loans.example.net/apply
block https://spam-mail-lists.example.com/en/6
block http://link-farm.example.org/links/1
block http://content-farm.example.com/en/512
block http://ads-server.example.net/click?id=4
block https://popup-ads.example.com/en/3#top
block http://track-clicks.example.org/pixel
block http://ad-tracker.example.com/track/9
block http://adult-video.example.net/en/20
block https://www.adult-chat.example.org/fr/8
block http://x-rated-adult.example.com/1
block http://xxx-pics.example.net/en/14
block http://warez-crack-keygen.example.com/download
block http://download-cracked-games.example.org/en/40
block http://miracle-cure.example.net/en/11
allow https://www.cityschool.example.org/en/412
allow http://library.example.net/en/1200.html
allow https://blog.gardening.example.com/en/54
allow http://m.weather.example.com/en/88/
allow https://museum.example.org/fr/31
allow http://www.botany.example.net/de/907
allow https://recipes.example.com/es/64
allow http://physics.university.example.org/en/3301
allow https://docs.software.example.com/en/21?page=2&ref=x
allow http://blog.travels.example.net/fr/18?utm_source=feed
allow https://www.newspaper.example.com/de/7001#top
allow http://history.example.org/en/640#top
allow https://m.theatre.example.net/en/95?page=3&ref=x
allow http://www.thornton.example.com/en/2211
allow https://thistle.example.org/en/1730/
allow http://tionary.example.com/en/5122.html
allow https://blog.anderson.example.net/en/830
allow http://ingrid.example.com/en/4410?utm_source=feed
allow https://www.orchestra.example.org/de/15/
allow http://erlangen.example.com/de/233.html
allow https://hospital.example.net/es/602
allow http://m.parliament.example.org/en/78
allow https://astronomy.example.com/fr/991/
allow http://railway.example.net/en/17.html
allow https://blog.beekeeping.example.org/es/8?page=2&ref=x
allow http://www.heritage.example.com/en/3054
allow https://nationalpark.example.net/en/41?utm_source=feed
allow http://theresa.example.org/en/2900
allow https://enthusiast.example.com/fr/477#top
allow http://ministry.example.net/de/6120
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then the path up to
    ``?``, ``#`` or the end. Both are empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does.

    A rule is a host and the start of a path; it fits its host and all subdomains.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path; the mark before each tells the two apart."""
    return F.concat(*[_grams_of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in GRAMS])


def _grams_of(mark: str, text: Column, n: int) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    places = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - n + 1))
    return F.transform(
        F.coalesce(places, F.array().cast("array<int>")), lambda i: F.concat(F.lit(mark), framed.substr(i, F.lit(n)))
    )


def _hashed(urls: DataFrame) -> DataFrame:
    gram = urls.withColumn("_grams", grams(F.col("_host"), F.col("_path")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(gram)


def labelled_urls(spark: SparkSession, text: str = LABELLED) -> DataFrame:
    """(url, label) from lines of ``block url`` and ``allow url``; label 1 for block."""
    lines = [line.split() for line in text.strip().splitlines()]
    rows = [F.struct(F.lit(u).alias("url"), F.lit(float(says == "block")).alias("label")) for says, u in lines]
    return spark.range(1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """Logistic regression from a small table (url, label); null if it lacks one of the labels."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    host, path = host_and_path(F.col("url"))
    hashed = _hashed(rows.select(F.col("label").cast("double"), host.alias("_host"), path.alias("_path")))
    kinds = hashed.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return None
    return LogisticRegression(
        featuresCol="_features", labelCol="label", maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False
    ).fit(hashed.select("label", "_features"))


def judge(
    pages: DataFrame, rules: Rules, model: LogisticRegressionModel | None, keep: Sequence[str], url: str = "url"
) -> DataFrame:
    """The kept columns with host, path, rule (null if none fits), verdict and the method's score to block."""
    kept = without(keep, ["host", "path", "rule", "verdict", "score"])
    host, path = host_and_path(quoted(url))
    parted = pages.select(*[quoted(c).alias(f"_keep_{i}") for i, c in enumerate(kept)], host.alias("_host"), path.alias("_path"))
    if model is None:
        score = F.lit(0.0)
    else:
        parted = model.setFeaturesCol("_features").transform(_hashed(parted))
        score = vector_to_array(F.col("probability"))[1]
    rule, says = rule_of(F.col("_host"), F.col("_path"), rules)
    return parted.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(says, F.when(score >= CUT, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
