"""URL filter: listed rules first, then association rules mined from labelled pages.

Spark's FP-growth mines combinations of URL tokens (host labels and their hyphenated parts, path
segments, query names) that go with pages labelled bad. Labels come from two sources: the labels table
is of documents, so a page has those of the document that it holds, whose id ends the path; and a
page whose host has a word of ``SEEDS`` is labelled bad, whatever its text. Rules below a support,
a confidence (its lower bound) or a lift are pruned. What is mined are the words and combinations that go with the
labels; these then block pages that nobody labelled. A rule is filed under its rarest token in an
inverted index; a URL looks up its tokens there and is blocked by a rule all of whose tokens it has.
URLs that no rule blocks are allowed.

Cases: a null URL, or one without ``://``, has an empty host and path and no tokens, fits no rule and
is allowed; a page without an id in its path has no document's label; two labels of a document: bad if
one is; repeated rows give repeated verdicts; of listed rules of one length none can tie, as their
texts differ and each fits by host and path; very long URLs are worked on whole; without labels and
seeds nothing is mined; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import table, written

#: (host, path, verdict)
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A combination stands in this share of labelled URLs, and in so many at least.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.0005, 10, 0.6
#: A rule makes bad so many times as likely as it is among all labelled pages (else a token of every page is one).
MIN_LIFT = 1.2
#: The confidence that counts is the lower end of its 99 % (two-sided) interval by Wilson: of thousands of
#: combinations some reach any plain share by chance.
Z = 2.575
#: Words of hosts that are known for what they sell; a page there is labelled bad.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)(\\??[^#]*)"
_HELD = "/([0-9]+)(?:\\.[A-Za-z]+)?/?$"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def held(url: Column) -> Column:
    """The id of the document that a page holds: the number that ends the path, ``/en/12``, ``/en/12/`` or ``/en/12.html``."""
    return F.regexp_extract(path(url), _HELD, 1).try_cast("long")


def tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``w:`` parts of hyphenated ones, ``p:`` path segments (numbers as #), ``q:`` query names."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    tagged = lambda tag, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "^\\?", "")
    return F.array_distinct(F.concat(
        tagged("h:", F.split(plain(host(url)), "\\.")),
        tagged("w:", F.flatten(F.transform(F.filter(F.split(plain(host(url)), "\\."), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))),
        tagged("p:", F.split(plain(path(url)), "/")),
        tagged("q:", F.transform(F.split(plain(query), "&"), lambda x: F.substring_index(x, "=", 1))),
    ))


def listed(rules: tuple = LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits (``host`` and ``path`` columns), as text, and its verdict."""
    rule = verdict = None
    for name, start, said in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        rule = F.when(fits, f"{name}{start}") if rule is None else rule.when(fits, f"{name}{start}")
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def labelled(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """``(url, bad)`` of the pages that a document's label or a seed word speaks of."""
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    seeded = F.arrays_overlap(F.split(host(F.col("url")), "[.-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    rows = pages.select("url", held(F.col("url")).alias("doc_id"), F.coalesce(seeded, F.lit(False)).alias("seeded")).join(bad, "doc_id", "left")
    return rows.where(F.col("seeded") | F.col("bad").isNotNull()).select("url", F.when(F.col("seeded"), 1).otherwise(F.col("bad")).alias("bad"))


def mined(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """``(rule_tokens, confidence)`` of the rules that FP-growth finds among labelled pages."""
    from pyspark.ml.fpm import FPGrowth

    spark = pages.sparkSession
    end = F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    items = labelled(pages, labels, seeds).select(F.concat(tokens(F.col("url")), end).alias("items")).where(F.size("items") > 0)
    n = items.count()
    if n < MIN_COUNT:
        return spark.createDataFrame([], "rule_tokens array<string>, confidence double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=max(MIN_SUPPORT, MIN_COUNT / n), minConfidence=MIN_CONFIDENCE, numPartitions=parts).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= MIN_LIFT))
    held, share = F.col("support") * n / F.col("confidence"), F.col("confidence")
    least = (share + Z * Z / (2 * held) - Z * F.sqrt(share * (1 - share) / held + Z * Z / (4 * held * held))) / (1 + Z * Z / held)
    rules = rules.where(least >= MIN_CONFIDENCE)
    return rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)``; mined rules are matched once for each distinct URL.

    Rules are written first, so that their size is known and decides how they are joined: as they are
    few, common tokens of URLs go to no shuffle.
    """
    rules = written(rules, "rules")
    urls = pages.select("url").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    held = looked.join(rules.select(F.explode("rule_tokens").alias("token")).distinct(), "token").groupBy("token").count()
    filed = rules.withColumn("rule_no", F.xxhash64("rule_tokens"))
    rarest = filed.select("rule_no", F.explode("rule_tokens").alias("token")).join(held, "token").groupBy("rule_no").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    filed = written(filed.join(rarest, "rule_no").select("token", "rule_tokens", "confidence"), "filed")
    hit = looked.join(filed, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    blocked = hit.groupBy("url").agg(F.max("confidence").alias("confidence"))
    rule, verdict = listed()
    out = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).join(blocked, "url", "left")
    return out.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, mined(pages, table(spark, sf_dir, "labels"), SEEDS)).select("page_id", "host", "path", "rule", "verdict")
