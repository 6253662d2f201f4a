"""URL filter: listed rules, and for the rest association rules mined by FP-growth.

A URL's tokens are its scheme, the labels of its host, the names in its path and the keys
of its query. Spark's FP-growth finds frequent combinations of tokens and verdict over the
labelled URLs; a combination that implies a verdict with enough confidence and support
is a rule, unless a part of it implies the same at least as surely. Rules are indexed by
their rarest token; a URL meets the rules of its tokens and keeps those it wholly contains.
The surest rule decides, then the one with more support, then the longer one, then block.

Defined results: a null URL or one without ``://`` has an empty host and path and no tokens.
It and any other URL that no rule fits get the default verdict. With fewer than
``LEAST`` labelled URLs nothing is mined. Equal URLs are judged once; every row is kept. FP-growth lists every
frequent combination, so ``support`` must stay above the share of URLs that have dozens of
tokens in common.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import must_be_free, stored

#: Fixed values of the contract: host, path, verdict.
LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
          ("net", "/es/", "block"), ("net", "/fr/", "block")]
SUPPORT = 0.01
#: Nor is a combination frequent that fewer URLs have.
LEAST = 20
CONFIDENCE = 0.9
DEFAULT = "allow"
MOST_LISTED = 1000


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """The longest rule that fits, as a struct (length, host length, rule, verdict), or null."""
    if len(rules) > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} listed rules")
    fitting = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                      F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host"),
                               F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
               for h, p, verdict in rules]
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size:int,host:int,rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """The different tokens of a URL."""
    scheme = F.when(F.instr(url, "://") > 1, F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))))

    def named(prefix: str, text: Column) -> Column:
        words = F.filter(F.split(text, "[^\\p{L}\\p{N}]+"), lambda x: x != "")
        return F.transform(words, lambda x: F.concat(F.lit(prefix), F.lower(x)))

    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("query:"), F.lower(F.substring_index(x, "=", 1))))
    parts = [scheme, named("host:", host_of(url)), named("path:", path_of(url)), keys]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(x, none) for x in parts)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, token, verdict, sure, support) from ``url`` and ``verdict`` of ``labelled``.

    ``token`` is the rarest of ``tokens``, under which the rule is indexed.
    """
    mark = F.concat(F.lit("verdict:"), "verdict")
    baskets = stored(labelled.select(F.array_append(tokens_of(F.col("url")), mark).alias("items")), "baskets")
    spark = labelled.sparkSession
    rows = baskets.count()
    if rows < LEAST:
        return spark.createDataFrame([], "tokens array<string>, token string, verdict string, sure double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(support, LEAST / rows), minConfidence=confidence).fit(baskets)
    found = stored(model.associationRules.where(F.col("consequent")[0].startswith("verdict:")).select(
        F.array_sort("antecedent").alias("tokens"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"),
        F.col("confidence").alias("sure"), "support"), "rules")
    less = found.select(F.col("tokens").alias("part"), F.col("verdict").alias("same"), F.col("sure").alias("surer"),
                        F.col("tokens")[0].alias("at"))
    more = found.select("*", F.explode("tokens").alias("at"))
    useless = more.join(less, "at").where(
        (F.col("same") == F.col("verdict")) & (F.col("surer") >= F.col("sure")) & (F.size("part") < F.size("tokens"))
        & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens", "verdict").distinct()
    kept = found.join(useless, ["tokens", "verdict"], "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    rarest = (kept.select("*", F.explode("tokens").alias("token")).join(often, "token")
              .groupBy("tokens", "verdict", "sure", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("token")))
    return stored(rarest.select("tokens", "token", "verdict", "sure", "support"), "index")


def judge(pages: DataFrame, url: str = "url", rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE,
          default: str = DEFAULT, names=("host", "path", "rule", "verdict", "reason")) -> DataFrame:
    """``pages`` with host, path, listed rule, verdict, and ``reason``: listed, mined or default.

    The listed rules also label the URLs that the association rules are mined from. ``names``
    are the new columns' names and must be free.
    """
    must_be_free(pages, names)
    address = F.col("url")
    urls = stored(pages.select(F.col(url).alias("url")).where(F.col(url).isNotNull()).groupBy("url").agg(F.count("*").alias("n"))
                  .withColumn("listed", listed_rule(host_of(address), path_of(address), rules)), "urls")
    labelled = urls.where("listed is not null").select(
        "url", F.col("listed.verdict").alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("col")
    index = mine(labelled, support, confidence)
    met = urls.where("listed is null").select("url", tokens_of(address).alias("own"))
    met = (met.select("url", "own", F.explode("own").alias("token")).join(index, "token")
           .where(F.size(F.array_except("tokens", "own")) == 0)
           .groupBy("url").agg(F.max(F.struct("sure", "support", F.size("tokens"), "verdict"))["verdict"].alias("mined")))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    listed = listed_rule(host, path, rules)
    found = pages.join(met.select(F.col("url").alias("_judged_url"), "mined"), F.col(url) == F.col("_judged_url"), "left")
    return found.select(
        *(pages[c] for c in pages.columns), host.alias(names[0]), path.alias(names[1]), listed["rule"].alias(names[2]),
        F.coalesce(listed["verdict"], F.when(listed.isNull(), F.col("mined")), F.lit(default)).alias(names[3]),
        F.when(listed.isNotNull(), "listed").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias(names[4]))
