"""Choices made before a solve: catalogue, index tiers, costs, parameters and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SkyError(Exception):
    """An error with the exit code of the command line."""

    code = 2


class NoSolution(SkyError):
    code = 1


class BadImage(SkyError):
    code = 16


class NoCatalogue(SkyError):
    code = 32


class CatalogueError(SkyError):
    code = 33


@dataclass
class SolveOptions:
    """What a solve may be told; the defaults are those of the command line."""

    radius_deg: float = 180.0
    fov_deg: float = 0.0
    max_stars: int = 500
    tolerance: float = 0.007
    hfd_min: float = 1.5
    binning: int = 0
    database: str | None = None
    sip: bool = False
    scales: list[float] = field(default_factory=list)

    def check(self) -> None:
        """Raises for values no solve can use."""
        if not 0 < self.fov_deg < float("inf"):
            raise SkyError("the field of view must be a positive number")
        if not 0 <= self.radius_deg <= 1e6 * self.fov_deg:
            raise SkyError("the search radius must be positive and at most a million fields")
        if not 0 < self.tolerance <= 0.1:
            raise SkyError("the tolerance must be over 0 and at most 0.1")


#: Catalogues: name, least and largest field (degrees), preference among those that cover a field (fixed values).
DATABASES = (
    ("d80", 0.15, 6.0, 8), ("v50", 0.2, 6.0, 6), ("d50", 0.2, 6.0, 5), ("d20", 0.3, 6.0, 4), ("v05", 0.6, 6.0, 3), ("d05", 0.6, 6.0, 2), ("g05", 3.0, 20.0, 7), ("w08", 20.0, 80.0, 7),
)


def databases(spark: SparkSession, rows=DATABASES) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "name string, lo double, hi double, pref int, listed int")


def select_database(spark: SparkSession, fields: DataFrame, fov: str, rows=DATABASES) -> DataFrame:
    """For each field the preferred catalogue that covers it, else the one with the nearest range; ties go to the first listed.

    The list of catalogues is a handful of rows, so it is broadcast.
    """
    met = fields.join(F.broadcast(databases(spark, rows)), F.lit(True))
    covers = F.col(fov).between(F.col("lo"), F.col("hi"))
    away = F.greatest(F.col("lo") - F.col(fov), F.col(fov) - F.col("hi"), F.lit(0.0))
    order = Window.partitionBy("field_id").orderBy(F.desc(covers), F.when(covers, -F.col("pref").cast("double")).otherwise(away), "listed")
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "lo", "hi", "pref", "listed")


def tiers_for(spark: SparkSession, fields: DataFrame, fov: str, radii: list[float]) -> DataFrame:
    """The tiers of an index whose fields, 2.5 to 12 radii wide, include each field."""
    tiers = spark.createDataFrame([(k, float(r)) for k, r in enumerate(radii)], "tier long, r double")
    return fields.join(F.broadcast(tiers), F.col(fov).between(2.5 * F.col("r"), 12 * F.col("r"))).withColumn("fits", F.lit(True)).drop("r")


#: Radius in degrees, patterns, stars and stars read of a tier, as measured on the deepest catalogue (fixed values).
TIER_COSTS = (
    (6.0, 5_212.0, 1_864.0, 5_165.0), (3.0, 21_404.0, 7_595.0, 26_921.0), (1.5, 87_162.0, 30_471.0, 143_476.0), (0.75, 349_669.0, 122_537.0, 625_508.0),
    (0.4, 1_185_086.0, 421_308.0, 2_006_011.0), (0.2, 3_639_264.0, 1_427_214.0, 4_121_724.0), (0.1, 4_428_404.0, 4_285_114.0, 13_777_880.0), (0.06, 12_900_826.0, 12_303_302.0, 51_962_040.0),
)
#: Share of the shallower tiers' stars that the deepest lacks; seconds a star read, serial and by threads; memory; file layout (fixed values).
SHARED, SERIAL, PARALLEL, RAM, FILE = 0.116, 1.06e-6, 2.5e-6, (60e6, 37.0, 29.0), (256.0 + 721.0 * 4.0, 40.0, 24.0, 12.0)


def tier_costs(spark: SparkSession, tiers: DataFrame, source: str) -> DataFrame:
    """``tiers`` (tier, radius) with patterns, stars and stars read: those of the nearest measured radius, less for shallow catalogues."""
    known = spark.createDataFrame([(*r, k) for k, r in enumerate(TIER_COSTS)], "r double, patterns double, stars double, read double, listed int")
    met = tiers.join(F.broadcast(known), F.lit(True))
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("tier").orderBy(F.abs(F.col("r") - F.col("radius")), "listed"))).where("_r = 1").drop("_r", "r", "listed")
    near = lambda r: F.abs(F.col("radius") - r) < 1e-6
    if source.lower() in ("d05", "g05"):
        fine = near(0.06)
        return best.select("tier", "radius", F.when(fine, 10_110_000.0).otherwise(F.col("patterns")).alias("patterns"), F.when(fine, 10_540_000.0).otherwise(F.col("stars")).alias("stars"),
                           F.when(fine, 18_160_000.0).when(near(0.1), 10_960_000.0).otherwise(F.col("read")).alias("read"))
    if source.lower() == "w08":
        deep = F.col("radius") < 2.0
        return best.select("tier", "radius", F.when(deep, F.least("patterns", F.lit(55_000.0))).otherwise(F.col("patterns")).alias("patterns"),
                           F.when(deep, 15_000.0).otherwise(F.col("stars")).alias("stars"), F.when(deep, 45_000.0).otherwise(F.col("read")).alias("read"))
    return best.select("tier", "radius", "patterns", "stars", "read")


def cost(costs: DataFrame, threads: int = 1) -> DataFrame:
    """Bytes, seconds, memory and patterns of an index with these tiers (``tier_costs``), stars in several tiers counted once."""
    stars = F.max("stars") + SHARED * (F.sum("stars") - F.max("stars"))
    sums = costs.agg(F.count("*").alias("n"), F.sum("patterns").alias("p"), stars.alias("s"), F.sum("read").alias("read"))
    per = SERIAL + PARALLEL / max(1, threads)
    return sums.select((FILE[0] + FILE[1] * F.col("n") + FILE[2] * F.col("p") + FILE[3] * F.col("s")).cast("long").alias("bytes"), (F.col("read") * per).alias("seconds"),
                       (RAM[0] + RAM[1] * F.col("p") + RAM[2] * F.col("s")).cast("long").alias("memory"), F.col("p").cast("long").alias("patterns"))


def concerns(size: float, seconds: float, available: float | None = None, disk: float | None = None, memory: float = 0.0) -> list[str]:
    """What deserves a notice before an index is built; free memory or disk that isn't known raises none."""
    found = [("it takes over 1 GB of disk", size > 1e9), ("it takes over five minutes", seconds > 300)]
    if disk is not None:
        found.append(("it needs more disk than is free", size > disk))
    if available is not None:
        found += [("it needs more memory than is free", memory > available), ("it needs over half of the free memory", available >= memory > available / 2)]
    return [text for text, true in found if true]


def recommend(catalogues: DataFrame, fov: float, purpose: str) -> DataFrame:
    """The smallest catalogue for a purpose that covers a field."""
    return catalogues.where((F.col("purpose") == purpose) & (F.col("lo") <= fov) & (F.col("hi") >= fov)).orderBy("bytes", "name").limit(1)


def rank_index_files(files: DataFrame, fov: float) -> DataFrame:
    """Index files whose scales overlap 0.2 to 1.5 fields, those near half a field first."""
    return files.where((F.col("hi") >= 0.2 * fov) & (F.col("lo") <= 1.5 * fov)).orderBy(F.abs((F.col("lo") + F.col("hi")) / 2 - fov / 2), "name")


def freshness(index_stamp: str | None, source_stamp: str | None) -> str:
    """Whether an index still belongs to its catalogue."""
    if not index_stamp:
        return "unknown"
    return "fresh" if index_stamp == source_stamp else "stale"


def source_stamp(files: DataFrame) -> str:
    """A fingerprint of catalogue files from names, sizes and first bytes (``path, length, content``)."""
    rows = files.select(F.sha2(F.concat_ws("\n", F.element_at(F.split("path", "/"), -1), F.col("length").cast("string"), F.sha2(F.substring("content", 1, 4096), 256)), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)).first()[0]
