"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small Parquet files. Shards of similar size (one tier is a factor of
``RATIO``) are merged into files of about the target size once a tier holds ``FAN_IN`` of them. Each
change is a new manifest, which names all live shards by pages of at most ``PAGE`` shards; a commit
writes the pages it changes and no others. A version is published by renaming the finished manifest
to its name, which fails if the name is taken: of two writers one wins, a writer that dies leaves only
a draft, and readers see the old or the new state and nothing between. That needs a file system whose
rename is atomic and can refuse to overwrite (HDFS, local disks); plain object stores lack it.

A writer announces its folder before it writes there and withdraws that after its commit. ``vacuum``
leaves announced folders alone, until the announcement is older than ``LEASE`` seconds (its writer is
taken for dead), and all shards of the versions it is told to keep.

Cases: nulls and repeated rows are stored as they are; very long texts are rows like others; equal
sizes are of one tier and merged by name; an empty arrival adds no shard; an empty store reads as an
empty table; columns may have any name.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import shared_dir, table

RATIO, FAN_IN, PAGE, LEASE = 4, 4, 1000, 86_400


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> None:
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *filter(None, parts)]))

    def _files(self, *parts: str) -> list[tuple[str, int]]:
        """(path below the store, bytes) of the Parquet files in a folder."""
        found, out = self._fs.listFiles(self._path(*parts), True), []
        root = self._fs.makeQualified(self._path()).toString()
        while found.hasNext():
            x = found.next()
            name = x.getPath().toString()
            if name.endswith(".parquet") and "/_" not in name[len(root) :]:
                out.append((name[len(root) + 1 :], x.getLen()))
        return sorted(out)

    def version(self) -> int:
        if not self._fs.exists(self._path("_manifests")):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests")))
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _read(self, *parts: str) -> dict:
        stream = self._fs.open(self._path(*parts))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content) -> str:
        out = self._fs.create(self._path("_manifests", name), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return name

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema``, ``pages`` and, from these, all live ``shards``."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "pages": [], "shards": []}
        m = self._read("_manifests", f"v{version}.json")
        m["shards"] = [s | {"page": p} for p in m["pages"] for s in self._read("_manifests", p)]
        return m

    def _rename(self, draft: str, name: str) -> None:
        """Renames without overwriting; raises if the name is taken."""
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        context.rename(self._path("_manifests", draft), self._path("_manifests", name), options)

    def commit(self, base: dict, add: list[dict], remove: set[str], schema: str | None) -> dict:
        """Publishes base - remove + add as the next version; fails if another writer took it."""
        version, touched = base["version"] + 1, {s["page"] for s in base["shards"] if s["file"] in remove}
        sizes: dict[str, int] = {}
        for s in base["shards"]:
            sizes[s["page"]] = sizes.get(s["page"], 0) + 1
        last = base["pages"][-1:]
        if add and last and sizes.get(last[0], 0) + len(add) <= PAGE:
            touched.add(last[0])  # a page that has room is filled first
        fresh = [{k: v for k, v in s.items() if k != "page"} for s in base["shards"] if s["page"] in touched and s["file"] not in remove] + add
        pages = [p for p in base["pages"] if p not in touched]
        pages += [self._write(f"page-{uuid.uuid4().hex}.json", fresh[k : k + PAGE]) for k in range(0, len(fresh), PAGE)]
        draft = self._write(f"draft-{uuid.uuid4().hex}", {"version": version, "schema": schema or base["schema"], "pages": pages})
        try:
            self._rename(draft, f"v{version}.json")
        except Exception as error:
            self._fs.delete(self._path("_manifests", draft), False)
            raise RuntimeError(f"version {version} is taken by another writer; read it and try again") from error
        return self.manifest(version)

    def _announced(self, folder: str):
        """The file that says that a writer is at work in a folder."""
        return self._path("_writing", folder.rsplit("/", 1)[-1])

    def _begin(self) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path("_writing"))
        self._fs.create(self._announced(folder), False).close()
        return folder

    def _end(self, folder: str) -> None:
        self._fs.delete(self._announced(folder), False)

    def append(self, *arrivals: DataFrame) -> dict:
        """Each arrival becomes immutable shards and a manifest version."""
        base = self.manifest()
        for df in arrivals:
            folder = self._begin()
            df.write.parquet(f"{self.path}/{folder}")
            base = self._add(base, folder, df.schema.json())
            self._end(folder)
        return base

    def append_split(self, df: DataFrame, arrival, n: int) -> dict:
        """``n`` arrivals told apart by a column of 0..n-1, written by one job, committed one by one."""
        base, folder, name = self.manifest(), self._begin(), "shard_bin"
        while name in map(str.lower, df.columns):
            name += "_"
        df.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        for k in range(n):
            if self._fs.exists(self._path(folder, f"{name}={k}")):
                files = [{"file": f, "bytes": b, "tier": 0} for f, b in self._in(folder, f"{name}={k}")]
                base = self.commit(base, files, set(), df.schema.json())
        self._end(folder)
        return base

    def _in(self, *parts: str) -> list[tuple[str, int]]:
        folder = "/".join(parts)
        return [(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]

    def _add(self, base: dict, folder: str, schema: str) -> dict:
        return self.commit(base, [{"file": f, "bytes": b, "tier": 0} for f, b in self._in(folder)], set(), schema)

    def _merges(self, shards: list[dict]) -> list[list[dict]]:
        """The tiers to merge: those with ``FAN_IN`` shards or more that aren't full-sized."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < 0.75 * self.target:
                tiers.setdefault(int(math.log(max(s["bytes"], 1), RATIO)), []).append(s)
        return [own for _, own in sorted(tiers.items()) if len(own) >= FAN_IN]

    def _merging(self):
        """A session of its own, in which a scan packs whole files into tasks of about the target size."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        return session

    def compact(self) -> dict:
        """Merges until no tier is full; each round is one manifest version.

        A tier is one job: each task reads shards of about the target size together and writes one file,
        so nothing is shuffled, and there are as many tasks as files to be made.
        """
        base, session = self.manifest(), self._merging()
        while merges := self._merges(base["shards"]):
            schema, add, gone, folders = self._schema(base), [], set(), []
            for own in merges:
                folder = self._begin()
                folders.append(folder)
                rows = session.read.schema(schema).parquet(*(f"{self.path}/{s['file']}" for s in own))
                rows.write.parquet(f"{self.path}/{folder}")
                made = self._in(folder)
                if len(made) < len(own):
                    add += [{"file": f, "bytes": b, "tier": 1 + max(s["tier"] for s in own)} for f, b in made]
                    gone |= {s["file"] for s in own}
            if gone:
                base = self.commit(base, add, gone, None)
            for folder in folders:
                self._end(folder)
            if not gone:
                break
        return base

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with ``_metadata`` columns of their files available."""
        m = self.manifest(version)
        if not m["schema"] or not m["shards"]:
            schema = self._schema(m) if m["schema"] else "none int"
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(self._schema(m)).parquet(*(f"{self.path}/{s['file']}" for s in m["shards"]))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that none of the newest ``keep`` manifests lists and no writer is at work on; returns how many.

        Versions older than these can't be read afterwards; keep as many as the longest reader needs.
        """
        writing = set()
        if self._fs.exists(self._path("_writing")):
            for s in self._fs.listStatus(self._path("_writing")):
                if time.time() - s.getModificationTime() / 1000 < LEASE:
                    writing.add(s.getPath().getName())
        found, n = [f for f, _ in self._files("data")], 0  # listed before the manifests: a commit between only adds to these
        newest = self.version()
        live = {s["file"] for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)["shards"]}
        for f in found:
            if f not in live and f.split("/")[1] not in writing:
                n += bool(self._fs.delete(self._path(f), False))
        return n


def query(spark: SparkSession, sf_dir: str, arrivals: int = 8, target_bytes: int = 32 << 20) -> DataFrame:
    """Documents arrive in parts, are compacted, and are read back from the newest manifest with their shard."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/skyloom/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}", target_bytes)
    store.append_split(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"), arrivals)
    store.compact()
    store.vacuum()
    rows = store.read()
    file = F.col("_metadata.file_path")
    return rows.select("doc_id", F.length("text").cast("long").alias("text_chars"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       F.concat(F.element_at(F.split(file, "/"), -2), F.lit("/"), F.element_at(F.split(file, "/"), -1)).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
