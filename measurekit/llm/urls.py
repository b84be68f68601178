"""URL filter: rules by host and path, and for all other URLs a language-model ratio. DataFrame functions only.

Two smoothed variable-order Markov models over characters are learned from the URLs that rules accept and reject. Each URL is cut
once into grams of the longest order; counts of shorter orders are sums over these. A gram's probability in a model interpolates
all orders by how often its context was seen and with how many followers (a context never seen passes on to the next shorter
one), and the model is one table of the difference of log probabilities per distinct gram. A URL's score is the mean
difference over its characters; the threshold is calibrated on rule-decided URLs of one hash fold that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, fresh

# (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
# Characters the models tell apart; every other one counts as the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/~"
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z in lower case; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The fitting rule as a struct(length, rule, verdict), null if none. Ties: the later in the alphabet. For lists of a few hundred rules."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def spelled(host: Column, path: Column) -> Column:
    """Host and path in the models' alphabet, between an opening and a closing mark."""
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.concat(F.translate(host, UPPER, LOWER), F.translate(path, UPPER, LOWER)), "[^a-z0-9./_-]", "~"), F.lit("$"))


def grams(urls: DataFrame, name: str) -> DataFrame:
    """One row per character of column `name` with the characters before it: gram, ORDER + 1 long."""
    return urls.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(name) - ORDER))).withColumn("gram", F.substring(F.col(name), F.col("at"), F.lit(ORDER + 1))).drop("at")


def ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio): the log probability of a gram's last character among accepted URLs minus that among rejected ones.

    counted(gram, accepted, rejected) has every gram of any URL; the counts are those of the training URLs.
    """
    kinds = ("accepted", "rejected")
    at = counted.select("gram", *kinds)
    out = None
    for k in range(ORDER + 1):                              # k characters of context
        level = at.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(*[F.sum(c).alias(c) for c in kinds])
        ctx = level.groupBy(F.expr(f"left(g, {k})").alias("ctx")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in kinds], *[F.sum((F.col(c) > 0).cast("long")).alias(f"u_{c}") for c in kinds])
        level = level.withColumn("ctx", F.expr(f"left(g, {k})")).join(ctx, "ctx")
        if out is None:
            shorter = [F.lit(1.0 / (len(ALPHABET) + 1))] * 2
        else:
            level = level.withColumn("short", F.expr(f"right(g, {k})")).join(out.select(F.col("g").alias("short"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in kinds]), "short")
            shorter = [F.col(f"q_{c}") for c in kinds]
        p = [F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"u_{c}") * q) / (F.col(f"n_{c}") + F.col(f"u_{c}"))).otherwise(q).alias(f"p_{c}") for c, q in zip(kinds, shorter)]
        out = level.select("g", *p)
    return out.select(F.col("g").alias("gram"), (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score, under names no column of pages has, to its rows.

    The rule's verdict, or `allow` if the score reaches the threshold and `block` if not. A null URL and one without :// have an
    empty host and path and are scored as such; equal URLs get equal verdicts. If the rules decide no URL, or all alike, there
    is nothing to learn and what no rule fits is allowed.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    of = lambda c: longest_rule(host(F.col(c)), path(F.col(c)), rules)
    urls = (pages.groupBy(spelled(host(F.col(url)), path(F.col(url))).alias("s"), of(url)["verdict"].alias("ruled")).agg(F.count("*").alias("n")))
    # a spelling may stand for several URLs; it is trained on as often as it occurs
    urls = (urls.groupBy("s").agg(F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("blocked")))
    urls = scratch.keep(urls.withColumn("counted", (F.crc32(F.col("s").cast("binary")) % FOLDS != 0).cast("long")), "urls")
    spelt = grams(urls, "s")
    counted = spelt.groupBy("gram").agg(F.sum(F.col("allowed") * F.col("counted")).alias("accepted"), F.sum(F.col("blocked") * F.col("counted")).alias("rejected"))
    table = scratch.keep(ratios(scratch.keep(counted, "counted")), "ratios")
    scores = spelt.select("s", "gram").join(table, "gram").groupBy("s").agg(F.round(F.avg("ratio"), 6).alias("score"))
    scores = scratch.keep(urls.select("s", "allowed", "blocked", "counted").join(scores, "s"), "scores")
    limit = threshold(scores)
    scratch.drop_others("scores")
    names = fresh(pages, "host", "path", "rule", "verdict", "score", "spelling")
    rows = pages.withColumn(names[0], host(F.col(url))).withColumn(names[1], path(F.col(url))).withColumn(names[5], spelled(F.col(names[0]), F.col(names[1])))
    rows = rows.join(scores.select(F.col("s").alias(names[5]), F.col("score").alias(names[4])), names[5])
    best = longest_rule(F.col(names[0]), F.col(names[1]), rules)
    method = F.when(F.lit(limit is None) | (F.col(names[4]) >= F.lit(limit)), "allow").otherwise("block")
    return rows.select(*pages.columns, names[0], names[1], best["rule"].alias(names[2]), F.coalesce(best["verdict"], method).alias(names[3]), names[4])


def threshold(scores: DataFrame) -> float | None:
    """The score from which on to accept: it gives the best mean of the shares of accepted and rejected URLs judged right in the
    fold not counted, or in all if that fold lacks a kind. Ties: the lowest. The search is over scores in steps of 0.01, so it
    gathers a few thousand sums whatever the number of URLs; one row reaches the driver."""
    def search(df: DataFrame):
        steps = df.groupBy(F.floor(F.col("score") * 100).alias("step")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
        below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        cum = steps.select("step", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in "ab"], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in "ab"])
        right = (1 - F.col("a_below") / F.col("a_all")) + F.col("b_below") / F.col("b_all")
        return cum.filter("a_all > 0 AND b_all > 0").orderBy(right.desc(), "step").select("step").limit(1).collect()

    found = search(scores.filter("counted = 0")) or search(scores)
    return found[0].step / 100 if found else None


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")
