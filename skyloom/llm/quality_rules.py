"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (0) or abstains (-1); rules overlap, so that a fault is seen by several.
Expectation-maximisation over the histogram of vote patterns (at most 3 to the number of rules,
whatever the number of documents) fits a mixture of a good kind of text and one kind a fault: how
common each is, and how often each rule votes bad on it, when it votes. The posterior probability of
the good kind replaces a filter that all rules must pass: a bad vote that no other rule bears out
is taken for an error of its rule. Rates have a flat prior (one pseudo-count a vote), no bounds.

Cases: null, empty and blank texts have no words and fail the base rule; shares of fewer than ``FEW``
words are not judged; very long texts are worked on whole, row by row, without a shuffle; a
posterior of exactly ``THRESHOLD`` is kept; repeated rows give repeated results; an empty table gives
an empty result; further columns are left out.

Repeated windows are found by 64-bit hashes of three words; two different windows of one text
would have to collide to change a count (for 100,000 windows: 3 in 10 billion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import SPACES, table, words, written

#: name -> (measure, good from, good to, bad below, bad above). Outside both a rule abstains.
RULES = {
    "length": ("n_words", 80, None, 50, None),
    "symbols": ("symbol_share", None, 0.02, None, 0.1),
    "letters": ("letter_share", 0.9, None, 0.8, None),
    "word_size": ("mean_word", 3.5, 7.0, 2.5, 8.5),
    "capitals": ("capital_share", None, 0.12, None, 0.3),
    "marks": ("mark_share", None, 0.05, None, 0.15),
    "lines": ("dup_share", None, 0.1, None, 0.3),
    "repeats": ("repeat_share", None, 0.15, None, 0.4),
    "variety": ("variety", 0.45, None, 0.3, None),
}
#: What a fault shows up in; where expectation-maximisation starts.
FAULTS = (("symbols", "letters", "word_size"), ("lines", "repeats", "variety"), ("capitals", "marks"))
#: Shares of fewer words than this say little.
FEW = 30
ROUNDS, THRESHOLD = 40, 0.5


def measured(docs: DataFrame) -> DataFrame:
    """The counts of each text. Three projections, so no array is computed twice; no exchange."""
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")))
    a = a.withColumn("n", F.size("w"))
    cut = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    a = a.select(
        "doc_id", "w", "n",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        cut("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        cut("[A-Z]+").alias("n_capitals"),
        cut("[!?|]+").alias("n_marks"),
        cut("[\\p{L}\\p{M}\\p{N}]+").alias("n_letters"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    keys = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    b = a.withColumn("keys", keys).drop("w")
    b = b.withColumn("alike", F.size(F.array_distinct("keys")) < F.size("keys"))
    placed = F.when(F.col("alike"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("p")))))
    b = b.withColumn("placed", placed).drop("keys", "alike")
    same = lambda i, j: F.get("placed", i)["k"] == F.get("placed", j)["k"]
    twice = F.sort_array(F.filter(
        F.transform(F.sequence(F.lit(0), F.size("placed") - 1), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get("placed", i)["p"])),
        lambda p: p.isNotNull()))
    b = b.withColumn("twice", F.when(F.col("placed").isNotNull(), twice)).drop("placed")
    steps = F.transform("twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("twice", i + 1) - p, F.lit(3))))
    total = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0))
    return b.withColumn("n_repeat_words", total.cast("long")).withColumn("n_words", F.col("n").cast("long")).drop("twice", "n")


def votes() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    measure = {
        "n_words": F.col("n_words"), "symbol_share": F.col("n_symbols") / n, "dup_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n, "mean_word": F.col("word_chars") / n, "capital_share": F.col("n_capitals") / chars,
        # long texts reuse words, so their share is taken against the root of their length
        "variety": F.least(F.lit(1.0), F.col("n_distinct") / n * F.sqrt(F.greatest(n / 300, F.lit(1.0)))), "mark_share": F.col("n_marks") / n,
        "letter_share": F.col("n_letters") / chars,
    }
    out = []
    for name, (key, good_from, good_to, below, above) in RULES.items():
        m, bad, good = measure[key], F.lit(False), F.lit(True)
        bad = bad if below is None else bad | (m < below)
        bad = bad if above is None else bad | (m > above)
        good = good if good_from is None else good & (m >= good_from)
        good = good if good_to is None else good & (m <= good_to)
        vote = F.when(bad, 0).when(good, 1).otherwise(-1)
        out.append((vote if name == "length" else F.when(F.col("n_words") < FEW, -1).otherwise(vote)).cast("int").alias(name))
    return out


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + f(x))


def _bound(value: Column, f) -> Column:
    """``f(value)``, with the value computed once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), f), 0)


def kinds(v: Column, state: Column) -> Column:
    """P(kind | votes), the good kind first. ``state``: array of (share, bad), ``bad`` a rate for each rule."""
    def like(kind: Column) -> Column:
        terms = F.zip_with(v, kind["bad"], lambda x, bad: F.when(x < 0, F.lit(0.0)).when(x == 0, F.log(bad)).otherwise(F.log(1 - bad)))
        return F.log(kind["share"]) + _total(terms, lambda x: x)

    def shares(logs: Column) -> Column:
        return _bound(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), lambda p: F.transform(p, lambda x: x / _total(p, lambda y: y)))

    return _bound(F.transform(state, like), shares)


def fitted(judged: DataFrame) -> DataFrame:
    """One row: ``m``, an array of the kinds' (share, bad), the good kind first.

    Only the histogram of vote patterns, bounded by the number of rules, meets in one row; all rounds
    are one expression over it.
    """
    k, names = len(RULES), list(RULES)
    patterns = judged.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    first = [(0.85, [0.02] * k)] + [(0.15 / len(FAULTS), [0.9 if n in fault else 0.05 for n in names]) for fault in FAULTS]
    start = F.array(*[F.struct(F.lit(share).alias("share"), F.array(*map(F.lit, bad)).alias("bad")) for share, bad in first])
    rules = F.array(*map(F.lit, range(k)))

    def settle(s: Column) -> Column:
        """Shares and rates of the patterns ``s`` (v, n, q)."""
        whole = _total(s, lambda r: r["n"])

        def kind(y: Column) -> Column:
            def rate(j: Column) -> Column:
                cast = F.aggregate(s, F.struct(F.lit(1.0).alias("bad"), F.lit(2.0).alias("all")), lambda acc, r: F.struct(
                    (acc["bad"] + F.when(F.get(r["v"], j) == 0, r["n"] * F.get(r["q"], y)).otherwise(0.0)).alias("bad"),
                    (acc["all"] + F.when(F.get(r["v"], j) >= 0, r["n"] * F.get(r["q"], y)).otherwise(0.0)).alias("all")))
                return _bound(cast, lambda c: c["bad"] / c["all"])

            share = (_total(s, lambda r: r["n"] * F.get(r["q"], y)) + 1) / (whole + len(first))
            return F.struct(share.alias("share"), F.transform(rules, rate).alias("bad"))

        return F.transform(F.array(*map(F.lit, range(len(first)))), kind)

    def turn(state: Column, _: Column) -> Column:
        return _bound(F.transform("p", lambda r: F.struct(r["v"].alias("v"), r["n"].alias("n"), kinds(r["v"], state).alias("q"))), settle)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn).alias("m"))


def judged(docs: DataFrame) -> DataFrame:
    """One row a document: counts, ``v`` (votes), ``quality`` (posterior), ``base_failed`` and ``kept``.

    The model is one row and comes to the driver; it goes back into the plan as literals.
    """
    rows = written(measured(docs), "counts").withColumn("v", F.array(*votes()))
    model = fitted(rows).first()["m"]
    state = F.array(*[F.struct(F.lit(kind["share"]).alias("share"), F.array(*map(F.lit, kind["bad"])).alias("bad")) for kind in model])
    rows = rows.withColumn("quality", _bound(state, lambda s: F.get(kinds(F.col("v"), s), 0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= THRESHOLD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
