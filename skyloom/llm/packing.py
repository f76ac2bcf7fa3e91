"""Packing of tokenised documents into sequences, as a cutting-stock problem solved by column generation.

A document's tokens are cut into pieces of ``SIZE`` tokens and a rest. The rests' lengths, rounded up
to ``UNIT`` tokens, make a histogram of at most SIZE / UNIT classes, whatever the number of documents.
A pattern says how many rests of each class share a sequence. A linear program over patterns minimises
the number of sequences; a knapsack dynamic program prices new patterns with its duals until none
helps by more than ``GAP``. Patterns are rounded down, and what rounding leaves over is filled by an
exact subset-sum program, sequence by sequence. Documents are ranked within their class in a
distributed way, and ranks are mapped to patterns, so no list of documents meets in one place.

A sequence whose length is a power of two needs no padding; all others are padded to ``SIZE``.

Cases: null and empty texts have the end token alone; equal rows give equal pieces, each with its
own place; an empty table gives an empty result; further columns are left out. Very long documents
are many whole sequences and one rest.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import table, written

SIZE, UNIT, END_ID, GAP = 2048, 8, 1, 1e-3
#: Pieces in one group of the ranking, about.
GROUP = 50_000
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as the tokenizer file gives them.

    The ranks file beside it holds the same vocabulary for a faster library, which gives equal ids
    for every text without the special token's string (tests hold both against each other); texts
    with that string go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.path, self.load, self.exact = path, Tokenizer.from_file, None
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks_file):
            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or SPECIAL in text:
            self.exact = self.exact or self.load(self.path)  # rarely needed, and large
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, "<u4")


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            rows, ids_of = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py())
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        ids_of.append(piece.astype(np.int32))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 5]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts by class (weight = index) with the largest value."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1] + value[1 : c + 1]
        k = int(np.argmax(gain))
        best[c], last[c] = (gain[k], k + 1) if gain[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def linear_program(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used (fractions), by the revised simplex method on columns."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m = len(classes)
    basis = [np.eye(m)[k] * (capacity // c) for k, c in enumerate(classes)]
    inverse = np.diag([1.0 / (capacity // c) for c in classes])
    x = inverse @ demand[classes].astype(float)
    for _ in range(40 * m + 200):
        dual = inverse.sum(axis=0)
        value = np.zeros(capacity + 1)
        value[classes] = np.maximum(dual, 0)
        gain, counts = best_pattern(value, capacity)
        if gain <= 1 + GAP:
            break
        column = counts[classes].astype(float)
        direction = inverse @ column
        able = direction > 1e-9
        ratio = np.where(able, x / np.where(able, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x -= step * direction
        x[out] = step
        x[x < 0] = 0
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[out] = column
    patterns = []
    for column, times in zip(basis, x):
        counts = np.zeros(capacity + 1, np.int64)
        counts[classes] = column.astype(np.int64)
        patterns.append((counts, float(times)))
    return patterns


def _fill(left: dict[int, int], room: int) -> list[int]:
    """Classes, at most as often as they are left, whose sum comes closest to ``room``."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for c in sorted((c for c in left if c <= room), reverse=True):
        for _ in range(min(left[c], room // c)):
            grown = reach | (reach << c) & mask
            if grown == reach:
                break
            steps.append((c, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for c, before in reversed(steps):
        if not before >> at & 1:
            out.append(c)
            at -= c
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (count by class) and how many sequences use each; covers the histogram exactly."""
    demand = np.zeros(capacity + 1, np.int64)
    for c, n in histogram.items():
        demand[c] = n
    out, left, fractions = [], demand.copy(), []
    for counts, times in linear_program(demand, capacity):
        used = np.flatnonzero(counts)
        n = min(int(times + 1e-9), int((left[used] // counts[used]).min()))
        fractions.append((times - n, used, counts))
        if n > 0:
            left[used] -= n * counts[used]
            out.append(({int(c): int(counts[c]) for c in used}, n))
    # what rounding down left over: the same patterns once more, those that lost most first, while they fit
    for _, used, counts in sorted(fractions, key=lambda f: -f[0]):
        if (left[used] >= counts[used]).all():
            left[used] -= counts[used]
            out.append(({int(c): int(counts[c]) for c in used}, 1))
    rest = {int(c): int(left[c]) for c in np.flatnonzero(left)}
    while rest:
        first = max(rest)
        own = [first]
        rest[first] -= 1
        own += _fill({c: n for c, n in rest.items() if n}, capacity - first)
        for c in own[1:]:
            rest[c] -= 1
        rest = {c: n for c, n in rest.items() if n}
        pattern = {c: own.count(c) for c in set(own)}
        if out and out[-1][0] == pattern:
            out[-1] = (pattern, out[-1][1] + 1)
        else:
            out.append((pattern, 1))
    return out


def runs(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, places a sequence, first sequence): which ranks a pattern takes."""
    out, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        for c, n in sorted(pattern.items()):
            at = taken.get(c, 0)
            out.append((c, at, at + n * times, n, sequence))
            taken[c] = at + n * times
        sequence += times
    return out


def placed(pieces: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``pieces`` should be a written table."""
    spark = pieces.sparkSession
    capacity = size // unit
    whole = capacity + 1
    pieces = pieces.withColumn("class", F.when(F.col("length") == size, whole).otherwise(F.ceil(F.col("length") / unit)).cast("int"))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most capacity + 1 rows
    n_whole = histogram.pop(whole, 0)
    patterns = plan(histogram, capacity)
    if n_whole:
        patterns.append(({whole: 1}, n_whole))
    groups = max(16, (sum(histogram.values()) + n_whole) // GROUP)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("class", "part").count()
    first = counts.select("class", "part", (F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count")).alias("first"))
    order = Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order)).join(first, ["class", "part"]).withColumn("rank", F.col("first") + F.col("rank") - 1)
    table_of = spark.createDataFrame(runs(patterns), "run_class int, run_from long, run_to long, each long, sequence long")  # bounded by the number of patterns
    met = ranked.join(F.broadcast(table_of), (F.col("class") == F.col("run_class")) & (F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to")))
    met = met.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("run_from")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return met.drop("class", "part", "rank", "first", "run_class", "run_from", "run_to", "each", "sequence")


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece; ``with_ids`` adds the token ids themselves."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.mapInArrow(_pieces(path or tokenizer_path(), SIZE, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))
    return placed(written(made, "pieces"))


def sequences(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the packed sequences, padded with 0 unless the length is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    exact = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", "n_tokens", F.when(exact, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(0), (F.lit(size) - F.col("n_tokens")).cast("int")))).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
