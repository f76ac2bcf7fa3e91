"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are words: runs of letters, digits and underscores, lower-cased; in scripts
that are written without spaces, each character is a word. Words are 64-bit hashes from then on.
Windows of ``LEAST`` words are the seeds (an item of fewer words is one seed as a whole). A document's
windows are held against the seeds; what it has in common with some item is kept as runs of words.
Seeds are then joined with the items that have them, and greedy string tiling marks the longest match
of words that no tile covers yet, again and again, down to ``LEAST`` words; the matches of a length
are found by running Karp-Rabin hashes. Tiles don't overlap, and their order doesn't matter, so a
passage that was reordered is still covered. An item is leaked in a document if tiles cover at
least ``COVERAGE`` of its words.

A leaked item has at least a tenth of its words as starts of shared windows (tiles of k words have
k - LEAST + 1 of them), so its commonest windows, one fewer than that, needn't be looked up: what
stands in thousands of items leads to few pairs.

The seeds go to every task while there are at most ``SEEDS``; beyond that nothing is sent, and all
windows of all documents are joined with them. Documents are neither shuffled nor grouped.

Cases: null and empty texts share nothing, and null or empty items leak nowhere; an item of fewer
words than ``LEAST`` leaks where it stands as a whole; equal items are matched each; of matches of a
length the first in the text comes first, then the first in the item; repeated documents give
repeated rows; null ids are results like others; very long and repetitive texts take time in
proportion to their length for each length of tile; an empty table on either side gives an empty
result; further columns are left out. The stage drops rows, not ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import table, written

LEAST, COVERAGE = 5, 0.5
#: So many seeds (8 bytes each) go to every task, at most.
SEEDS = 8_000_000
#: A word-hash cache is emptied at this size.
CACHE = 100_000
#: Characters of scripts without spaces: Han, kana, Thai, Lao, Myanmar, Khmer.
_SINGLE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_SINGLE}]+|[{_SINGLE}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

TILES = "array<struct<at:int,item_at:int,length:int>>"
SCHEMA = f"doc_id long, text_key long, item_id long, item_words int, covered_words int, coverage double, tiles {TILES}"


class Words:
    """Hashes of the words of a text; keeps a bounded cache."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        try:
            h = [cache[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = [cache[w] for w in words]
        return np.array(h, np.uint64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words; windows of another length hash otherwise."""
    count = len(words) - n + 1
    if count < 1:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _BASE + words[k : k + count]
    return out ^ (out >> np.uint64(32))


class Running:
    """Karp-Rabin hashes, modulo 2**64, of windows of any length: differences of one running sum."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).astype(np.uint64))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]).astype(np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
        self.marked = np.zeros(n, bool)
        self.marks = np.zeros(n + 1, np.int64)

    def mark(self, start: int, n: int) -> None:
        self.marked[start : start + n] = True

    def settle(self) -> None:
        self.marks[1:] = np.cumsum(self.marked)

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of ``n`` words without a mark, as of the last ``settle``."""
        if n > len(self.marked):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.marks[n:] == self.marks[: len(self.marks) - n])
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tiling(item, text, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, length), the longest first.

    Words are whole numbers; in signed lists a number below zero matches nothing. The longest length
    that a free window of both has is found by bisection, as any shorter one has it too; all its
    matches are then marked in one pass over the text.
    """
    item, text = (np.asarray(x) for x in (item, text))
    nothing = [x < 0 if x.dtype.kind == "i" else np.zeros(len(x), bool) for x in (item, text)]
    item, text = item.astype(np.uint64), text.astype(np.uint64)
    a, b = Running(item), Running(text)
    a.marked |= nothing[0]
    b.marked |= nothing[1]
    a.settle()
    b.settle()
    tiles: list[tuple[int, int, int]] = []

    def common(n: int) -> bool:
        return bool(np.isin(b.free(n)[1], a.free(n)[1]).any())

    most = min(len(item), len(text))
    while most >= least:
        if not common(most):
            low, high = least - 1, most  # common(low) or low < least; not common(high)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if common(middle) else (low, middle)
            most = low
            if most < least:
                break
        starts, hashes = a.free(most)
        places: dict[int, list[int]] = {}
        for at, h in zip(starts[::-1].tolist(), hashes[::-1].tolist()):
            places.setdefault(h, []).append(at)  # the first place is the last of its list
        starts, hashes = b.free(most)
        met = np.isin(hashes, a.free(most)[1])
        until = -1
        for at, h in zip(starts[met].tolist(), hashes[met].tolist()):
            if at < until:
                continue
            own = places[h]
            while own and a.marked[own[-1] : own[-1] + most].any():
                own.pop()  # marks stay, so this place is gone for good
            if own and np.array_equal(item[own[-1] : own[-1] + most], text[at : at + most]):
                tiles.append((at, own[-1], most))
                a.mark(own[-1], most)
                b.mark(at, most)
                until = at + most
        a.settle()
        b.settle()
        most -= 1
    return tiles


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_key, item_id, words, seeds): an item's words, and its windows in order."""
    words_of = Words()
    longs = pa.list_(pa.int64())
    for batch in batches:
        words = [words_of(t.as_py()) for t in batch.column("text")]
        seeds = [windows(w, min(LEAST, len(w))) if len(w) else np.empty(0, np.uint64) for w in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_key"), batch.column("item_id"), pa.array([w.view(np.int64) for w in words], longs), pa.array([s.view(np.int64) for s in seeds], longs)],
            names=["item_key", "item_id", "words", "seeds"])


def _hits(seeds, lengths: list[int]):
    """Rows (key, doc_id, text_key, at, words, seeds) of documents that share a seed: the words of shared windows, gaps marked by place -1.

    ``seeds``: broadcast of all seeds, sorted; None: every window is taken.
    """
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Words()
        known = None if seeds is None else seeds.value
        for batch in batches:
            rows, ats, kept, found = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                cover, own = np.zeros(len(words) + 1, np.int64), []
                for n in lengths:
                    h = windows(words, n)
                    if not len(h):
                        continue
                    if known is None:
                        hit = np.arange(len(h))
                    else:
                        place = np.searchsorted(known, h)
                        place[place == len(known)] = 0
                        hit = np.flatnonzero(known[place] == h)
                    if len(hit):
                        own.append(h[hit])
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + n, -1)
                if not own:
                    continue
                at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                gaps = np.flatnonzero(np.diff(at) > 1) + 1
                rows.append(k)
                ats.append(np.insert(at, gaps, -1).astype(np.int32))
                kept.append(np.insert(words[at], gaps, 0).view(np.int64))
                found.append(np.unique(np.concatenate(own)).view(np.int64))
            if rows:
                of = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(of) for c in ("key", "doc_id", "text_key")), pa.array(ats, ints), pa.array(kept, longs), pa.array(found, longs)],
                    names=["key", "doc_id", "text_key", "at", "words", "seeds"])

    return run


def _tile_rows(coverage: float):
    tile = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, at, words, item_id, item in zip(*(batch.column(c) for c in ("doc_id", "text_key", "at", "words", "item_id", "item_words"))):
                where, own = np.array(at.values), np.array(item.values, np.int64)
                text, n = np.array(words.values, np.int64), len(own)
                # numbers of the item's words; what is not one of them, and gaps, match nothing
                known, number = np.unique(own, return_inverse=True)
                place = np.minimum(np.searchsorted(known, text), len(known) - 1)
                text = np.where((known[place] == text) & (where >= 0), place, -1)
                tiles = tiling(number.astype(np.int64), text, min(LEAST, n))
                covered = sum(k for *_, k in tiles)
                if covered >= coverage * n:
                    rows.append((doc.as_py(), key.as_py(), item_id.as_py(), n, covered, covered / n, [{"at": int(where[a]), "item_at": i, "length": k} for a, i, k in sorted(tiles)]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), tile)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=["doc_id", "text_key", "item_id", "item_words", "covered_words", "coverage", "tiles"])

    return run


def _index(items: DataFrame, coverage: float) -> DataFrame:
    """``(seed, item_key)`` without the commonest windows of each item, as many as a leak can do without."""
    least = F.greatest(F.lit(1), F.ceil(F.size("words") * coverage / LEAST))
    seeds = items.select("item_key", least.alias("least"), F.explode("seeds").alias("seed"))
    held = seeds.select("item_key", "seed").distinct().groupBy("seed").agg(F.count("*").alias("df"))
    ranked = seeds.join(held, "seed").groupBy("item_key", "least").agg(F.sort_array(F.collect_list(F.struct("df", "seed")), asc=False).alias("all"))
    return ranked.select("item_key", F.explode(F.expr("slice(all, int(least), size(all))")).alias("s")).select(F.col("s.seed").alias("seed"), "item_key").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document row and item that leaked into it; ``text_key`` is the text's xxhash64."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text")).withColumn("key", F.monotonically_increasing_id())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item_key", F.monotonically_increasing_id())
    items = written(items.mapInArrow(_seed_rows, "item_key long, item_id long, words array<long>, seeds array<long>").where(F.size("words") > 0), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.lit(LEAST), F.size("words"))).distinct().collect())  # at most LEAST numbers
    seeds = items.select(F.explode("seeds").alias("seed")).distinct()
    sent = None
    if seeds.count() <= SEEDS:
        sent = spark.sparkContext.broadcast(np.sort(seeds.toArrow().column("seed").to_numpy().view(np.uint64)))
    hits = docs.mapInArrow(_hits(sent, lengths), "key long, doc_id long, text_key long, at array<int>, words array<long>, seeds array<long>")
    hits = written(hits, "hits")  # from here on a row's key is fixed
    pairs = hits.select("key", F.explode("seeds").alias("seed")).join(_index(items, coverage), "seed").select("key", "item_key").distinct()
    own = items.select("item_key", "item_id", F.col("words").alias("item_words"))
    met = hits.drop("seeds").join(pairs, "key").join(own, "item_key")
    return met.select("doc_id", "text_key", "at", "words", "item_id", "item_words").mapInArrow(_tile_rows(coverage), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no leaked benchmark item."""
    mark = "key of text"
    leaked = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key")).distinct()
    leaked = written(leaked, "leaked").alias("l")
    keyed = docs.withColumn(mark, F.xxhash64("text")).alias("k")
    here = F.col("k.doc_id").cast("long").eqNullSafe(F.col("l.l_id")) & (F.col(f"k.{mark}") == F.col("l.l_key"))
    return keyed.join(leaked, here, "left_anti").select(*docs.columns)
