"""Quality classifier: weak labellers, a label model by expectation-maximisation, a hashed linear scorer.

1. Labellers vote good (1), bad (0) or abstain (-1) on every document. Those of form overlap: each
   fault (noise, repetition, shouting) is seen by several. Those of harm count words of a lexicon,
   which is mined from a bounded sample of labelled rows.
2. Expectation-maximisation over the histogram of vote patterns of all documents (at most 3 to the
   number of labellers) estimates how often each labeller votes bad, when it votes, on texts of each kind: good
   ones, and one kind a fault. Whether it votes says nothing of the kind; a kind's rates of good and
   bad sum to 1, and the posterior uses the very likelihood that the fit raises. The prior on rates
   is flat (one pseudo-count a vote); nothing is clipped. A document is good if it is so in both models.
3. Posterior labels of a bounded sample of documents train a logistic scorer over hashed words and
   votes; it then scores every document, and those more likely bad than good are rejected.

``LABELLED`` and ``TRAINED`` bound the rows of the two samples (those with the smallest id hashes),
``TRAINED_CHARS`` the text of the second; a single longer text is not trained on, but scored.

Cases: null and empty texts are bad by the length labeller and nothing else; shares of fewer than
``FEW`` words are not judged; very long texts are worked on whole, one at a time; ties of id hashes
go by id, and rows of one id come into a sample together; repeated rows give repeated scores;
without labels the lexicon is empty and nothing is found harmful; an empty table gives an empty
result; further columns are left out. The stage drops rows by their own text, never by their id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import table

LABELLED, TRAINED, TRAINED_CHARS = 20_000, 20_000, 64_000_000
BITS, ROUNDS, EPOCHS, THRESHOLD = 16, 100, 4, 0.5
#: Shares of fewer words than this say little.
FEW = 30
CACHE = 100_000
#: A lexicon word follows so many different words in toxic texts, and is so many times as common in them.
TOXIC_CONTEXTS, TOXIC_LIFT = 8, 50.0
#: labeller -> (good from, good to, bad below, bad above)
FORM = {
    "length": (80, None, 40, None),
    "symbols": (None, 0.02, None, 0.1),
    "letters": (0.9, None, 0.8, None),
    "clean": (0.9, None, 0.7, None),
    "word_size": (3.5, 7.0, 2.5, 8.5),
    "capitals": (None, 0.12, None, 0.3),
    "marks": (None, 0.05, None, 0.15),
    "lines": (None, 0.1, None, 0.3),
    "repeats": (None, 0.15, None, 0.4),
    "variety": (0.45, None, 0.3, None),
}
#: What a fault shows up in; where expectation-maximisation starts.
FAULTS = (("symbols", "letters", "clean", "word_size"), ("lines", "repeats", "variety"), ("capitals", "marks"))
HARM = {"harm_any": (None, 0, None, 0), "harm_kinds": (None, 0, None, 1), "harm_rate": (None, 0, None, 0.004)}
LABELLERS = (*FORM, *HARM)
_WORD = re.compile(r"\w+")
_SYMBOLS, _CAPITALS, _MARKS = re.compile(r"[#*$%&|<>]"), re.compile(r"[A-Z]"), re.compile(r"[!?|]")
_AROUND = ".,;:!?\"'()[]\u00ab\u00bb\u201c\u201d\u2018\u2019"


def _vote(x: float, good_from: float | None, good_to: float | None, below: float | None, above: float | None) -> int:
    if (below is not None and x < below) or (above is not None and x > above):
        return 0
    return 1 if (good_from is None or x >= good_from) and (good_to is None or x <= good_to) else -1


def votes(text: str | None, words: list[str], bare: list[str], lexicon: frozenset[str]) -> tuple[int, ...]:
    """One vote a labeller; ``bare``: the text's lower-cased words without punctuation."""
    text = text or ""
    n = len(words)
    if n == 0:
        return (0,) + (-1,) * (len(LABELLERS) - 1)
    chars = sum(map(len, words))
    hits = [w for w in bare if w in lexicon] if lexicon else []
    measure = {"length": n, "harm_any": len(hits), "harm_kinds": len(set(hits)), "harm_rate": len(hits) / n}
    if n >= FEW:
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        windows = Counter(zip(words, words[1:], words[2:]))
        measure |= {
            "symbols": len(_SYMBOLS.findall(text)) / n,
            "letters": sum(map(len, bare)) / chars,
            "clean": sum(w.strip(_AROUND).isalnum() for w in words) / n,
            "word_size": chars / n,
            "capitals": len(_CAPITALS.findall(text)) / chars,
            "marks": len(_MARKS.findall(text)) / n,
            "lines": 1 - len(set(lines)) / len(lines),
            "repeats": sum(c for c in windows.values() if c > 1) / (n - 2),
            "variety": len(set(words)) / n * max(1.0, (n / 300) ** 0.5),
        }
    return tuple(_vote(measure[k], *bounds) if k in measure else -1 for k, bounds in (FORM | HARM).items())


def label_model(patterns: dict[tuple[int, ...], float], faults: tuple[tuple[int, ...], ...], rounds: int = ROUNDS) -> dict:
    """Mixture of a good kind (0) and one kind a fault, by expectation-maximisation.

    ``share[y]``: of kind y; ``rate[y, j, v]``: how often labeller j votes v (0 bad, 1 good) on texts of
    kind y, when it votes. ``faults``: the labellers that are first taken to see each fault.
    """
    k = len(next(iter(patterns), ())) or 1 + max(map(max, faults))
    v, n = _coded(list(patterns), k), np.array(list(patterns.values()), float)
    rate = np.full((1 + len(faults), k, 2), (0.05, 0.95))
    rate[0] = (0.02, 0.98)
    for y, own in enumerate(faults):
        rate[y + 1, list(own)] = (0.9, 0.1)
    share = np.array([0.85, *[0.15 / len(faults)] * len(faults)])
    for _ in range(rounds):
        w = n[:, None] * _kinds(v, share, rate)
        share = (w.sum(0) + 1) / (n.sum() + len(share))
        cast = np.einsum("py,pjv->yjv", w, v) + 1
        rate = cast / cast.sum(axis=2, keepdims=True)
    return {"share": share, "rate": rate}


def _coded(patterns: list[tuple[int, ...]], k: int) -> np.ndarray:
    v = np.array(patterns, int).reshape(len(patterns), k)
    return np.stack([v == x for x in (0, 1)], axis=2).astype(float)


def _kinds(coded: np.ndarray, share: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(kind | votes)."""
    log = np.einsum("pjv,yjv->py", coded, np.log(rate)) + np.log(share)
    q = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
    return q / q.sum(axis=1, keepdims=True)


class LabelModel:
    """The two fits, of form and of harm, on one histogram of patterns."""

    def __init__(self, patterns: dict[tuple[int, ...], float]) -> None:
        cut, names = len(FORM), list(FORM)
        form, harm = Counter(), Counter()
        for p, n in patterns.items():
            form[p[:cut]] += n
            harm[p[cut:]] += n
        self.cut = cut
        self.form = label_model(form, tuple(tuple(names.index(x) for x in f) for f in FAULTS))
        self.harm = label_model(harm, (tuple(range(len(HARM))),))

    def good(self, patterns: list[tuple[int, ...]]) -> np.ndarray:
        """P(good | votes)."""
        out = np.ones(len(patterns))
        for model, own in ((self.form, [p[: self.cut] for p in patterns]), (self.harm, [p[self.cut :] for p in patterns])):
            out *= _kinds(_coded(own, model["rate"].shape[1]), model["share"], model["rate"])[:, 0]
        return out

    def accuracies(self) -> dict[str, float]:
        """How often each labeller's vote is right."""
        out = {}
        for model, names in ((self.form, FORM), (self.harm, HARM)):
            share, rate = model["share"], model["rate"]
            out |= dict(zip(names, share[0] * rate[0, :, 1] + share[1:] @ rate[1:, :, 0]))
        return out


class Featurizer:
    """Votes, and distinct hashed features: words and votes."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        self.lexicon, self.cache = lexicon, {}

    def votes(self, text: str | None) -> tuple[int, ...]:
        return votes(text, (text or "").split(), _WORD.findall((text or "").lower()), self.lexicon)

    def __call__(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray]:
        words, bare = (text or "").split(), _WORD.findall((text or "").lower())
        own = votes(text, words, bare, self.lexicon)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, out = self.cache, set()
        for w in set(bare):
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1)
            out.add(h)
        # votes have places of their own
        return own, np.array(sorted(out) + [(1 << BITS) + 3 * j + v + 1 for j, v in enumerate(own)], np.int64)


def values(f: np.ndarray) -> np.ndarray:
    """Feature values: 1 for a vote; words share a length of 1, whatever the text's length."""
    word = f < 1 << BITS
    return np.where(word, 1 / np.sqrt(max(1, int(word.sum()))), 1.0)


def train(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad, on posterior labels; word weights are held small."""
    size = (1 << BITS) + 3 * len(LABELLERS)
    w, g, b, gb = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    decay = np.where(np.arange(size) < 1 << BITS, 1e-3, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS if rows else 0):
        for k in order.permutation(len(rows)):
            f, y = rows[k]
            x = values(f)
            d = 1 / (1 + np.exp(-np.clip((w[f] * x).sum() + b, -30, 30))) - y
            step = d * x + decay[f] * w[f]
            g[f] += step * step
            w[f] -= 0.2 * step / np.sqrt(g[f])
            gb += d * d
            b -= 0.2 * d / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def _vote_rows(lexicon: frozenset[str]):
    """Rows (votes, n, features): the histogram of a task's votes, and the features of each row of the sample (n: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Featurizer(lexicon), Counter()

        def rows(own: list[tuple[int, ...]], n: list[int], features: list) -> pa.RecordBatch:
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([list(v) for v in own], ints), pa.array(n, pa.int64()), pa.array(features, ints)], names=["votes", "n", "features"])

        for batch in batches:
            taken = []
            for text, sampled in zip(batch.column("text"), batch.column("sampled").to_pylist()):
                if sampled:
                    taken.append(made(text.as_py()))
                    total[taken[-1][0]] += 1
                else:
                    total[made.votes(text.as_py())] += 1
            if taken:
                yield rows([v for v, _ in taken], [0] * len(taken), [f.tolist() for _, f in taken])
        yield rows(list(total), list(total.values()), [None] * len(total))

    return run


def _scores(lexicon: frozenset[str], w: np.ndarray, b: float):
    made = Featurizer(lexicon)

    def score(text: str | None) -> float:
        f = made(text)[1]
        return 1 / (1 + np.exp(-np.clip((w[f] * values(f)).sum() + b, -30, 30)))

    return score


def _score(lexicon: frozenset[str], w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(lexicon, w, b)
        for batch in batches:
            out = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def _keep(lexicon: frozenset[str], w: np.ndarray, b: float):
    """Whole rows of good texts; a row whose id is null has no verdict and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(lexicon, w, b)
        for batch in batches:
            good = [not i.is_valid or score(t.as_py()) >= THRESHOLD for i, t in zip(batch.column("doc_id"), batch.column("text"))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest id hashes: a bounded sample that doesn't depend on the partitioning."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def toxic_words(docs: DataFrame, labels: DataFrame) -> frozenset[str]:
    """Words of toxic texts, from at most ``LABELLED`` labelled rows; equal texts count once.

    Support is the number of different words before it, so near copies of a text don't add to it.
    """
    sample = F.broadcast(_least(labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), LABELLED))
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", F.lower("text").alias("text")).distinct()
    counts = texts.groupBy("toxic").count().collect()
    total = {r["toxic"]: r["count"] for r in counts}
    toxic, other = total.get(1, 0), total.get(0, 0)
    if not toxic or not other:
        return frozenset()
    split = texts.select("toxic", F.array_remove(F.split("text", r"[^\p{L}\p{N}_]+"), "").alias("w"))
    words = split.select("toxic", F.posexplode("w").alias("at", "word"), "w").select("toxic", "word", F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)).otherwise("").alias("before"))
    held = words.where("length(word) > 1").groupBy("word").agg(
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("t"), F.sum((F.col("toxic") == 0).cast("long")).alias("o"))
    good = held.where((F.col("t") >= TOXIC_CONTEXTS) & (F.col("t") / toxic >= TOXIC_LIFT * (F.col("o") + 0.5) / other))
    return frozenset(r["word"] for r in good.collect())  # bounded by the words of LABELLED texts over TOXIC_CONTEXTS


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[frozenset[str], LabelModel, np.ndarray, float]:
    """The lexicon, the label model, and the scorer's weights and bias."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = toxic_words(docs, labels)
    sizes = _least(docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).where(F.col("chars") <= TRAINED_CHARS), TRAINED)
    running = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most TRAINED rows
    ids = sizes.withColumn("running", running).where(F.col("running") <= TRAINED_CHARS).select("doc_id", F.lit(True).alias("sampled"))
    made = docs.join(F.broadcast(ids), "doc_id", "left").select("text", "sampled").mapInArrow(_vote_rows(lexicon), "votes array<int>, n long, features array<int>")
    made = made.groupBy("votes", "features").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).toArrow()
    seen, sample = Counter(), []
    for v, f, n, rows in zip(*(made.column(c) for c in ("votes", "features", "n", "rows"))):
        own = tuple(v.as_py())
        seen[own] += n.as_py()
        if f.is_valid:
            sample += [(own, np.array(f.values, np.int64))] * rows.as_py()
    model = LabelModel(seen)
    sample.sort(key=lambda r: (r[0], r[1].tobytes()))
    q = model.good([v for v, _ in sample])
    return (lexicon, model, *train([(f, y) for (_, f), y in zip(sample, q)]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score, kept)`` for every document."""
    lexicon, _, w, b = fitted(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_score(lexicon, w, b), "doc_id long, score double").withColumn("kept", F.col("score") >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier keeps, with all their columns; nothing is shuffled for it."""
    lexicon, _, w, b = fitted(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(_keep(lexicon, w, b), docs.schema)
