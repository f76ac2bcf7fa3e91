"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. A ledger holds which pairs
of blob and rule version were scanned, and the spans that were found. A scan takes only pairs that
the ledger lacks; findings then go to every path and version that has the blob. A blob that stands at
thousands of paths is thus scanned once, and its text is shuffled once for each task that read it.

``Ledger`` keeps the ledger in a folder of the shared store: each update adds one folder of rows, which
counts from the moment its job has ended, so a lost run adds nothing and the next one scans again.
Give it the same path run after run and old blobs are never read by a rule again; a query or stage
that is given none starts an empty one.

Cases: null texts count as empty, and have no spans; very long texts are scanned whole, in time in
proportion to their length; spans at one place go in the order of the rules; repeated rows give
repeated results, blobs that two updates added at once count once; an empty table gives an empty
result; further columns of the versions table are kept, clashing names apart.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import shared_dir, table

#: Rule set name; a change of any rule needs another name, so that old blobs are scanned again.
RULES_VERSION = "2026-11-a"

#: kind, pattern, least length of the group that decides (0: the whole match), group. Base kinds first.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 0),
)
#: A rule is tried only where its literal occurs; None: always.
HINTS = {"access": "AKIA", "private_key": "-----BEGIN", "github": "gh", "jwt": "eyJ", "slack": "xox", "url_login": "://"}
KINDS = tuple(r[0] for r in BASE_RULES + MORE_RULES)

SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str, rules: tuple = BASE_RULES + MORE_RULES) -> list[tuple[str, int, int]]:
    """Spans of a text in code points, end exclusive, by start and then rule order."""
    out = []
    for order, (kind, _, least, group) in enumerate(rules):
        if (hint := HINTS.get(kind)) and hint not in text:
            continue
        for m in _compiled(order, rules).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


_PATTERNS: dict[str, re.Pattern] = {}


def _compiled(order: int, rules: tuple) -> re.Pattern:
    pattern = rules[order][1]
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = re.compile(pattern, re.ASCII)
    return _PATTERNS[pattern]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, kind)], names=["blob", "spans"])


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows ``(blob, rules, spans)`` for the blobs of ``versions`` that the ledger lacks.

    The partial aggregation drops copies before the shuffle, so a hot blob sends one text a task.
    """
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.where(F.col("rules") == RULES_VERSION).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.mapInArrow(_scan, f"blob string, spans {SPANS}").select("blob", F.lit(RULES_VERSION).alias("rules"), "spans")


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", blob: str = "blob", spans: str = "spans") -> DataFrame:
    """All rows and columns of ``versions`` with their ``blob`` and ``spans`` (columns of these names are replaced).

    Blobs without spans stay out of the join's right side; it is small and has each blob once.
    """
    known = ledger.where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    keyed = versions.drop(blob, spans).withColumn(blob, blob_id(F.col(text)))
    return keyed.join(known, blob, "left").withColumn(spans, F.coalesce(spans, F.array().cast(SPANS)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class Ledger:
    """The scanned pairs of blob and rule version, in a folder; each update is one folder in it."""

    SCHEMA = f"blob string, rules string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/skyloom/{spark.sparkContext.applicationId}/ledger-{uuid.uuid4().hex}"
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def rows(self) -> DataFrame:
        done = []
        if self._fs.exists(self._at()):
            names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at()))
            done = [f"{self.path}/{n}" for n in names if self._fs.exists(self._at(n, "_SUCCESS"))]
        return self.spark.read.schema(self.SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], self.SCHEMA)

    def update(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """Scans what the ledger lacks of ``versions``, and gives all its rows."""
        seen = self.rows()
        new = scan(versions, text, None if seen.isEmpty() else seen)
        new.write.parquet(f"{self.path}/update-{uuid.uuid4().hex}")
        return self.rows()


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every span (start, end; by start) replaced by ``[REDACTED]``; spans that overlap become one."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(columns: list[str], found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            own = {c: batch.column(c) for c in columns}
            changed = [len(s) > 0 for s in batch.column(found)]
            for k, (text, spans) in enumerate(zip(own["text"], batch.column(found))):
                texts.append(redacted(text.as_py() or "", [(s["start"], s["end"]) for s in spans.as_py()]) if changed[k] else text.as_py())
            if "n_chars" in own:
                sizes = [len(t) if c else n.as_py() for t, c, n in zip(texts, changed, own["n_chars"])]
                own["n_chars"] = pa.array(sizes, own["n_chars"].type)
            own["text"] = pa.array(texts, own["text"].type)
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return run


def query(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, Ledger(spark, ledger_path).update(docs))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Documents with all secrets blanked out; ``n_chars`` follows the text where it changed."""
    found = "spans of secrets"
    rows = findings(docs, Ledger(spark, ledger_path).update(docs.select("text")), blob="blob of text", spans=found)
    return rows.select(*docs.columns, found).mapInArrow(_redact(docs.columns, found), docs.schema)
