"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides train two variable-order Markov models over host and path, one
of accepted and one of rejected URLs. A character's probability after its last ``order``
characters is smoothed with the one after a shorter context, down to an even
distribution, so contexts that were never seen fall back by themselves. The score of a
URL is the mean log ratio per character; the threshold is the one with the best balanced
accuracy on the tenth of the decided URLs that the models did not see.

All counts are shuffled and combined aggregates over all URLs; n-grams are scored once
per distinct n-gram, and distinct URLs once per URL. Nothing but the threshold, one
number, stands outside the plan.

Cases: a null URL or one without ``://`` has an empty host and path and is scored as the
empty text; repeated rows are judged alike; without examples of both kinds scores are
what the other model gives and the threshold is 0; an empty table gives an empty
result; columns with the names of output columns are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

ORDER = 4
#: Weight of the shorter context, in observations.
BACKOFF = 4.0
#: Characters over which the lowest order is even.
ALPHABET = 256
#: Width of the bins in which the threshold is sought.
BIN = 0.01
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of each text, with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), F.col("s"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("s") + 1)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))))


def gram_ratios(training: DataFrame, wanted: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """gram, ratio: log of accepted over rejected probability of its last character.

    ``training`` has gram, accepted, rejected (weights); ``wanted`` the distinct grams.
    """
    def suffixes(df: DataFrame) -> DataFrame:
        cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.struct(k.alias("k"), F.right("gram", k).alias("tail"))))
        return df.withColumn("x", cut).withColumns({"k": F.col("x.k"), "tail": F.col("x.tail")}).drop("x")

    head = F.expr("substring(tail, 1, k - 1)")
    seen = suffixes(training).groupBy("k", "tail").agg(F.sum("accepted").alias("na"), F.sum("rejected").alias("nr"))
    contexts = seen.groupBy("k", head.alias("head")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"))
    parts = (
        suffixes(wanted).withColumn("head", head)
        .join(seen, ["k", "tail"], "left").join(contexts, ["k", "head"], "left")
        .na.fill(0, ["na", "nr", "ca", "cr"])
        .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "na", "nr", "ca", "cr"))).alias("parts"))
    )

    def probability(n: str, c: str) -> Column:
        return F.aggregate("parts", F.lit(1.0 / ALPHABET), lambda p, x: (x[n] + backoff * p) / (x[c] + backoff))

    return parts.select("gram", (F.log(probability("na", "ca")) - F.log(probability("nr", "cr"))).alias("ratio"))


def best_threshold(scored: DataFrame) -> Column:
    """Scalar: the score with the best balanced accuracy, halfway between the bins it parts.
    ``scored`` has score, verdict and n.

    Scores are clipped to [-20, 20], so there are 4001 bins at most."""
    bins = scored.select(
        F.round(F.least(F.greatest("score", F.lit(-20.0)), F.lit(20.0)) / BIN).cast("long").alias("bin"), "verdict", "n",
    ).groupBy("bin").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("r"))
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rate = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0)) / F.sum(c).over(every)
    lower = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 1)
    rated = bins.select(((F.col("bin") + lower) / 2 * BIN).alias("edge"), (1 - rate("a", below) + rate("r", below)).alias("accuracy"))
    return rated.agg(F.max_by("edge", F.struct("accuracy", -F.abs("edge")))).scalar()


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Adds host, path, rule (null where none fits), score and verdict."""
    base = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rule, verdict = deciding_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "__ruled": verdict, "__s": F.concat("host", "path")})
    urls = cut_lineage(ruled.groupBy(F.col("__s").alias("s"), F.col("__ruled").alias("verdict")).agg(F.count("*").alias("n")))
    held_out = F.pmod(F.xxhash64("s"), F.lit(10)) == 0
    train = _grams(urls.filter(F.col("verdict").isNotNull() & ~held_out), order).groupBy("gram").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("rejected"))
    spelled = _grams(urls.select("s").distinct(), order)
    ratios = cut_lineage(gram_ratios(train, spelled.select("gram").distinct(), order, backoff))
    scores = cut_lineage(spelled.join(ratios, "gram").groupBy("s").agg(F.avg("ratio").alias("score")))
    threshold = best_threshold(urls.filter(F.col("verdict").isNotNull() & held_out).join(scores, "s"))
    own = scores.withColumnsRenamed({"s": "__s"})
    return (
        ruled.join(own, "__s", "left")
        .withColumn("verdict", F.coalesce("__ruled", F.when(F.col("score") >= F.coalesce(threshold, F.lit(0.0)), "allow").otherwise("block")))
        .drop("__s", "__ruled")
    )
