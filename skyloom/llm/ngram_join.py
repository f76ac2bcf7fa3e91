"""Jaccard self-join of texts by their sets of word shingles, with token-combination prefixes.

A text is lower-cased (A-Z) and split at ASCII white space; its tokens are the distinct shingles of
``width`` words, as 64-bit hashes. Two texts link when ``100 * |x & y| >= percent * |x | y|``.

Method. All tokens have one global order, and a set's prefix is what comes first in it. The order
puts tokens of the lowest share of the hash space first (the region), by how many sets hold them,
rarest first; the other tokens follow by hash. Counting is needed in the region alone, yet it covers
all sets. A token of the region that more than ``RARE`` sets hold belongs to one of several classes
of frequent tokens; such a class is indexed by pairs of its tokens, every other token by itself. A
prefix is extended until its weight (one for each single token, and for a class of n frequent tokens
n - 1) exceeds the number of tokens that a partner may lack. Take two sets that link, and the prefix
that ends first: all it shares with the other set lies in the other's prefix too. To share no index
key, the partner would have to lack as many tokens as that prefix weighs, and it can't. So no link is
lost. Sets of fewer than percent / (100 - percent) tokens link with equal sets only.

Equal sets are one representative from the start. Index keys give candidate pairs: each set with the
first of its key. Sets that share a key but are not connected then get an index of all their tokens,
in which copies that were edited too much to link are mostly told apart by their own rare tokens; there
too each set meets the first of its key. At last pairs of a key that are still in different components
are tried: all of them where few sets have the key, else those whose differences from the key's first
set have enough in common, found by a prefix index of these differences. Each pair is verified on the whole sets. A key that thousands of near copies
share thus costs one pair a copy.

Sets are keyed by an id of their own: the least document that holds the set, or, if that id is null or
stands at different texts, a hash of the text. Counts of keys and tokens are aggregated before they
are joined back, so a key that a third of all rows have is split like any skewed join.

Cases: null texts and texts without words have an empty set and link with nothing (component: their
own id); fewer than ``width`` words are one shingle; each row is a document by itself, so rows of one
id with different texts may be in different components, and a null id is no one's smallest (a
component of null ids alone is null); very long texts are shingled whole; ties of sizes and keys go
by the set's id; an empty table gives an empty result; further columns of the documents are left out
of the result. The stage drops rows, not ids: of each group one row stays, also of exact repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import components, dropped, table, written

#: A token that more sets hold is frequent.
RARE = 32
#: Among sets of a key that more have, pairs are found by their differences from the first of the key.
SMALL_KEY = 64
#: Up to so many ids that a broadcast of them is small (8 bytes each); beyond it, a shuffled join.
BROADCAST_IDS = 1_000_000
#: A word-hash cache is emptied at this size.
CACHE = 100_000
#: Rows are worked on in pieces of at most so many bytes, or one row: as Python objects, and as their keys, they take up to forty times that.
PIECE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps a bounded cache of word hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.cache = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        try:
            h = [cache[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            h = [cache[w] for w in words]
        h = np.array(h, np.uint64)
        n = len(h) - self.width + 1
        if n < 1:
            parts, n = h, 1
            out = np.array([len(h)], np.uint64)
            for x in parts:
                out = _mixed(out * _MIX + x)
            return out
        out = np.full(n, self.width, np.uint64)
        for k in range(self.width):
            out = _mixed(out * _MIX + h[k : k + n])
        return np.unique(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in their order, in slices of at most ``PIECE_BYTES``; a row that is larger comes alone."""
    for batch in batches:
        left = [batch]
        while left:
            piece = left.pop()
            if piece.nbytes <= PIECE_BYTES or piece.num_rows < 2:
                yield piece
            else:
                half = piece.num_rows // 2
                left += [piece.slice(half), piece.slice(0, half)]


def allowed(size, percent: int):
    """How many of its tokens a set's partner may lack."""
    return size - -(-size * percent // 100)


def classes(bucket, percent: int):
    """Number of classes of frequent tokens for sets of a size bucket: about three prefix tokens each."""
    return np.maximum(1, np.ceil(1.15**bucket * (100 - percent) / 300)).astype(np.int64)


def bucket_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(1.15)).astype(np.int64)


def _region(percent: int) -> int:
    """Tokens with hashes below this are in the region: about twice what prefixes need."""
    return min(2**64 - 1, 2**64 * 1875 * (100 - percent) // 100_000)


def _top(bucket: int, percent: int) -> int:
    """The last bucket of partners that are at least as large."""
    return int(np.ceil(np.log(100 / percent) / np.log(1.15)))


def _sets(width: int, percent: int, limit: int):
    """Rows: id, text_key, size, 128 bits that name the set, tokens of the region (below ``limit``), first tokens beyond it."""
    limit = np.uint64(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in _pieces(batches):
            sizes, names, near, far = [], [], [], []
            for text in batch.column("text"):
                s = shingle(text.as_py())
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s) * (100 - percent) < percent:  # links with equal sets only
                    near.append([])
                    far.append([])
                    continue
                k = int(np.searchsorted(s, limit))
                b = int(bucket_of(np.array([len(s)]))[0])
                spare = int(classes(b + _top(b, percent), percent)) + 1
                need = max(0, allowed(len(s), percent) + 1 + spare - k)
                near.append(s[:k].view(np.int64))
                far.append(s[k : k + need].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int32()), pa.array(names, pa.binary()), pa.array(near, longs), pa.array(far, longs)], names=["id", "text_key", "size", "name", "near", "far"])

    return run


def _keys(percent: int):
    """Rows (key, id, size) for the index, from each set's region tokens that others share (with counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out_key, out_id, out_size = [], [], []
            for id_, size, near_n, shared, far in zip(*(batch.column(c).to_pylist() for c in ("id", "size", "near_n", "shared", "far"))):
                keys = index_keys(size, near_n, [(x["df"], x["token"]) for x in shared or ()], far or [], percent)
                out_key.append(keys)
                out_id.append(np.full(len(keys), id_, np.int64))
                out_size.append(np.full(len(keys), size, np.int32))
            if out_key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((out_key, pa.int64()), (out_id, pa.int64()), (out_size, pa.int32()))], names=["key", "id", "size"])

    return run


def index_keys(size: int, near_n: int, shared: list, far: list, percent: int) -> np.ndarray:
    """Index keys of one set. ``shared``: (count, token) of region tokens with a count of two or more."""
    need = allowed(size, percent) + 1 - (near_n - len(shared))  # tokens of no other set come first
    if need <= 0:
        return np.empty(0, np.int64)
    shared.sort()
    rare = [t for df, t in shared if df <= RARE]
    if len(rare) >= need:
        return np.array(rare[:need], np.int64)
    need -= len(rare)
    frequent, keys = [t for df, t in shared if df > RARE], [rare]
    hashes = np.array(frequent, np.int64).view(np.uint64)
    b = int(bucket_of(np.array([size]))[0])
    for bucket in range(b, b + _top(b, percent) + 1):  # a set meets larger partners in their bucket
        of = (_mixed(hashes ^ _MIX) % np.uint64(classes(bucket, percent))).tolist()
        members, weight = {}, 0
        for c, h in zip(of, hashes):
            if weight >= need:
                break
            weight += c in members
            members.setdefault(c, []).append(h)
        if weight < need:
            keys.append(far[: need - weight])
        for c, m in members.items():
            if len(m) > 1:
                m = np.array(m, np.uint64)
                m.sort()
                i, j = np.triu_indices(len(m), 1)
                keys.append(_mixed(_mixed(m[i] * _MIX + np.uint64(bucket)) + m[j]).view(np.int64))
    return np.unique(np.concatenate([np.array(k, np.int64) for k in keys]))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What set b and its pivot a don't have in common."""
    for batch in _pieces(batches):
        sizes, edits = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            sizes.append((len(x), len(y)))
            edits.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array([a for a, _ in sizes], pa.int32()), pa.array([b for _, b in sizes], pa.int32()), pa.array(edits, pa.list_(pa.int64()))],
            names=["a", "b", "size_a", "size", "edits"])


def edit_prefixes(size_a: int, size: int, n: int, percent: int) -> tuple[int, int]:
    """How many edits to index for a set as the one with fewer edits, and as the one with more.

    Two sets link if they differ in at most D = s * (100 - percent) / (100 + percent) tokens, with s
    the sum of their sizes. They differ in n + m - 2 * (edits in common), so the common edits of linked
    sets are at least (n + m - D) / 2. If both sets link with the pivot they are connected already; so
    if this one does, its partner doesn't, and has more edits than the pivot allows.
    """
    share = lambda s: s * (100 - percent) // (100 + percent)
    most = share(size + size * 100 // percent)
    least = n
    if n <= share(size_a + size):
        least = max(n, share(size_a + -(-size * percent // 100)) + 1)
    return max(0, (n + most - least) // 2 + 1), min(n, most + 1)


def _edit_keys(percent: int):
    """Rows (token, a, b, size, n, few, rest): edits to index, rarest of the pivot's sets first; how many are left from each on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = []
            for a, b, size_a, size, n, shared in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "size_a", "size", "n", "shared"))):
                order = sorted((x["df"], x["token"]) for x in shared or ())
                own = n - len(order)  # edits of no other set come first
                for few, p in zip((True, False), edit_prefixes(size_a, size, n, percent)):
                    rows += [(token, a, b, size, n, few, n - own - k) for k, (_, token) in enumerate(order[: max(0, p - own)])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=["token", "a", "b", "size", "n", "few", "rest"])

    return run


def _binary(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["id", "tokens"])

    return run


def _counted(rows: DataFrame, by: list[str], name: str, more_than: int = 1) -> DataFrame:
    """Rows of groups of over ``more_than``, with their number. A group of any size stays spread: its count is joined back."""
    counts = written(rows.groupBy(*by).agg(F.count("*").alias(name)).where(F.col(name) > more_than), "counts")
    return rows.join(counts, by)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; the ids go by broadcast only if they are few."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified pairs."""
    return _on_sets(docs, pairs, width, _verify(percent), "a long, b long, linked boolean")


def _on_sets(docs: DataFrame, pairs: DataFrame, width: int, work, schema: str) -> DataFrame:
    """``work`` on the two sets of each pair. Each pair carries one set through the second shuffle."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    sets = written(_texts_of(docs, ids).dropDuplicates(["id"]).mapInArrow(_binary(width), "id long, tokens binary"), "sets")
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("set_b")), "b")
    out = written(met.mapInArrow(work, schema), "links")
    dropped(sets)
    return out


def _apart(rows: DataFrame, key: str, more, percent: int) -> DataFrame:
    """Pairs of a key in different components; ``more`` may compare any column with its ``other_`` one."""
    right = rows.select([key] + [F.col(c).alias(f"other_{c}") for c in rows.columns if c != key])
    met = rows.join(right, key).where((F.col("id") != F.col("other_id")) & (F.col("component") != F.col("other_component")) & _close(percent) & more)
    return met.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b"))


def _edited(docs: DataFrame, rows: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs among sets of large keys, by an index of their differences from the first of the key.

    A linked pair of which not both link with the pivot has such differences in common.
    """
    pivots = written(rows.groupBy("key").agg(F.min("id").alias("a")), "pivots")
    of = rows.join(pivots, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    made = _on_sets(docs, written(of, "pairs"), width, _edits, "a long, b long, size_a int, size int, edits array<long>")
    made = made.withColumn("n", F.size("edits"))
    tokens = made.select("a", "b", F.explode("edits").alias("token"))
    shared = _counted(tokens, ["a", "token"], "df").groupBy("a", "b").agg(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token")).alias("shared"))
    index = made.drop("edits").join(shared, ["a", "b"]).mapInArrow(_edit_keys(percent), "token long, a long, b long, size int, n int, few boolean, rest int")
    index = index.withColumnRenamed("b", "id").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    index = written(index.withColumn("key", F.xxhash64("a", "token")).drop("a", "token"), "edits")
    # at the first edit that two sets have in common, both must have as many left as they need in common
    least = F.col("n") + F.col("other_n") - F.floor((F.col("size") + F.col("other_size")) * (100 - percent) / (100 + percent))
    enough = 2 * F.least("rest", "other_rest") >= least
    return _apart(index, "key", F.col("few") & ~F.col("other_few") & (F.col("n") <= F.col("other_n")) & enough, percent)


SETS = "id long, text_key long, size int, name binary, near array<long>, far array<long>"


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """Rows ``(key, id, size)`` of all keys that two sets or more have."""
    tokens = sets.select("id", F.explode("near").alias("token"))
    shared = _counted(tokens, ["token"], "df").groupBy("id").agg(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token")).alias("shared"))
    sized = sets.select("id", "size", F.size("near").alias("near_n"), "far").join(shared, "id", "left")
    index = written(sized.mapInArrow(_keys(percent), "key long, id long, size int"), "index")
    return written(_counted(index, ["key"], "n").drop("n"), "index")


def _star(met: DataFrame, percent: int) -> DataFrame:
    """Each set with the first of its key."""
    pivots = met.groupBy("key").agg(F.min(F.struct("id", "size")).alias("p")).select("key", F.col("p.id").alias("other"), F.col("p.size").alias("other_size"))
    pairs = met.join(written(pivots, "pivots"), "key").where((F.col("id") != F.col("other")) & _close(percent))
    return pairs.select(F.col("other").alias("a"), F.col("id").alias("b")).distinct()


def _close(percent: int):
    return 100 * F.least("size", "other_size") >= percent * F.greatest("size", "other_size")


def _open(met: DataFrame, known: DataFrame) -> DataFrame:
    """Index rows with components, of keys whose sets are in two components or more."""
    tagged = met.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return tagged.join(written(mixed, "mixed"), "key", "left_semi")


def _own_ids(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Documents and sets with ``id`` as the key of one text; whether any differs from the document's id.

    An id that is null or stands at different sets gives way to a hash of the text, made negative.
    """
    odd = sets.where("size > 0").groupBy("id").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("id is null or lo <> hi")
    odd = written(odd.select("id", F.lit(True).alias("odd")), "odd-ids")
    sets = sets.withColumn("doc_id", F.col("id"))
    if odd.isEmpty():
        return docs, sets, False

    def keyed(rows: DataFrame) -> DataFrame:
        met = rows.join(odd.withColumnRenamed("id", "odd_id"), F.col("id").eqNullSafe(F.col("odd_id")), "left").drop("odd_id")
        hashed = F.col("text_key").bitwiseOR(F.lit(-(2**63)))
        return met.withColumn("id", F.when(F.col("odd"), hashed).otherwise(F.col("id"))).drop("odd")

    return keyed(docs), written(keyed(sets), "prefixes"), True


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, text_key, size, component_id)`` of every row. ``docs``: id, text."""
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    sets = written(docs.mapInArrow(_sets(width, percent, _region(percent)), SETS), "prefixes")
    docs, sets, odd = _own_ids(docs, sets)
    # equal sets: one representative each, found by their 128-bit names alone
    same = sets.where("size > 0").groupBy("name").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least"))
    reps = same.select(F.col("rep").alias("id")).distinct()
    few = sets.select("id", "size", "near", "far").join(reps, "id", "left_semi").where(F.size("near") + F.size("far") > 0).dropDuplicates(["id"])
    # first the region's index: each set against the first of its key
    met = _index(written(few, "representatives"), percent)
    first = _links(docs, written(_star(met, percent), "pairs"), width, percent)
    edges = first.where("linked").select("a", "b")
    known = written(components(edges), "known")
    # sets with a key in common, yet in different components: an index of all their tokens, so that prefixes are as rare as can be
    ids = written(_open(met, known).select("id").distinct(), "open")
    dropped(met)
    again = _texts_of(docs, ids).dropDuplicates(["id"]).mapInArrow(_sets(width, percent, 2**64 - 1), SETS)
    met = _index(written(again.select("id", "size", "near", "far"), "representatives"), percent)
    tagged = written(_open(met, known), "open")
    done = first.select("a", "b")
    apart = known.withColumnRenamed("component", "component_a"), known.withColumnRenamed("component", "component_b")
    star = _star(tagged.select("key", "id", "size"), percent).join(done, ["a", "b"], "left_anti")
    star = star.join(apart[0].withColumnRenamed("id", "a"), "a", "left").join(apart[1].withColumnRenamed("id", "b"), "b", "left")
    star = star.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")
    second = _links(docs, written(star, "pairs"), width, percent)
    edges = edges.union(second.where("linked").select("a", "b"))
    known = written(components(edges), "known")
    # what is still apart: pairs of a key in different components
    tagged = written(_counted(_open(tagged.drop("component"), known), ["key"], "n"), "open")
    rest = _apart(tagged.where(F.col("n") <= SMALL_KEY), "key", F.col("id") < F.col("other_id"), percent).union(_edited(docs, tagged.where(F.col("n") > SMALL_KEY), known, width, percent))
    rest = rest.distinct().join(done.union(second.select("a", "b")), ["a", "b"], "left_anti")
    third = _links(docs, written(rest, "pairs"), width, percent)
    final = components(edges.union(third.where("linked").select("a", "b"))).withColumnRenamed("id", "rep")
    # components of representatives, then of all rows; a component's id is its smallest document
    own = same.join(final, "rep", "left").withColumn("group", F.coalesce("component", "rep")).withColumn("component_id", F.col("group"))
    if odd:
        own = written(own.drop("component_id"), "components")
        own = own.join(written(own.groupBy("group").agg(F.min("least").alias("component_id")), "smallest"), "group")
    rows = sets.select("doc_id", "text_key", "size", "name").join(own.select("name", "group", "component_id"), "name", "left")
    return rows.select("doc_id", "text_key", "size", "group", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def linked(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``."""
    rows = _grouped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), width, percent)
    return rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), width=3, percent=90)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): that with the smallest id, then text hash.

    A row with a null id comes last in its group; texts without words stay.
    """
    columns, mark = docs.columns, "key of text"
    rows = written(_grouped(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), 5, 80).where("size > 0"), "groups")
    texts = written(rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.min("group").alias("group")), "texts")
    first = texts.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    met = texts.join(written(first, "first"), "group").withColumn("gone", ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("text_key") != F.col("first.text_key")))
    # rows to act on: the others of a group, and repeats of the one that stays
    acts = written(met.where("gone or n > 1").select(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"), "gone"), "acts").alias("a")
    keyed = docs.withColumn(mark, F.xxhash64("text")).alias("k")
    here = F.col("k.doc_id").cast("long").eqNullSafe(F.col("a.a_id")) & (F.col(f"k.{mark}") == F.col("a.a_key"))
    kept = keyed.join(acts.where("gone"), here, "left_anti").alias("k")
    twice = acts.where("not gone").alias("a")
    if twice.isEmpty():
        return kept.select(*columns)
    repeats = kept.join(twice, here, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.join(twice, here, "left_anti").unionByName(repeats).select(*columns)
