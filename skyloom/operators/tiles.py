"""Sky tilings: which tile a direction is in, which tiles a field overlaps, and strips for directories.

Rings are tables of (ring, lower declination, upper declination, tiles, first tile), small and fixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiles in each ring, from the south pole to the equator; the north mirrors the south.
HALF_1476 = (1, 3, 9, 15, 21, 27, 33, 38, 43, 48, 52, 56, 60, 63, 65, 67, 68, 69)
HALF_290 = (1, 4, 8, 12, 16, 20, 24, 28, 32)
#: Height of a ring of the finer tiling; the polar caps are half as high (fixed value, degrees).
RING_DEG = 180 / 35


def _rings(tiles: list[int], bounds: list[float]) -> list[tuple[int, float, float, int, int]]:
    out, base = [], 1
    for k, n in enumerate(tiles):
        out.append((k, bounds[k], bounds[k + 1], n, base))
        base += n
    return out


def rings_1476() -> list[tuple[int, float, float, int, int]]:
    """Rings of equal height between two half-height caps; boundaries rounded to ten digits as published."""
    degrees = [float(f"{RING_DEG * (k - 17.5 - 0.5):.10g}") for k in range(1, 36)]
    return _rings([*HALF_1476, *reversed(HALF_1476)], [-math.pi / 2, *(math.radians(d) for d in degrees), math.pi / 2])


def rings_290() -> list[tuple[int, float, float, int, int]]:
    """Rings of tiles of equal area; the caps count as half a tile."""
    tiles = [*HALF_290, *reversed(HALF_290)]
    weight = [0.5 if n == 1 else n for n in tiles]
    degrees = [round(math.degrees(math.asin(max(-1.0, min(1.0, 2 * sum(weight[:k]) / sum(weight) - 1)))), 9) for k in range(len(tiles) + 1)]
    return _rings(tiles, [math.radians(d) for d in degrees])


def _pick(rings: list, dec: Column, value, strict: bool) -> Column:
    """A value of the ring that a declination is in, as one CASE expression: no join for so small a table."""
    out = F.lit(value(rings[0]))
    for ring in rings[1:]:
        inside = dec > ring[1] if strict else dec >= ring[1]
        out = F.when(inside, F.lit(value(ring))).otherwise(out)
    return out


def area_1476(ra: Column, dec: Column) -> Column:
    """The tile of a direction; a ring's lower boundary belongs to the ring below."""
    rings = rings_1476()
    n, base = (_pick(rings, dec, lambda r, k=k: r[k], True) for k in (3, 4))
    return (base + F.when(n == 1, 0).otherwise(F.floor(ra * n / (2 * math.pi)))).cast("long")


def area_290(ra: Column, dec: Column) -> Column:
    """The tile of a direction; a ring's lower boundary belongs to it."""
    rings = rings_290()
    n, base = (_pick(rings, dec, lambda r, k=k: r[k], False) for k in (3, 4))
    return (base + F.least(n - 1, F.floor(F.pmod(ra, F.lit(2 * math.pi)) * n / (2 * math.pi)))).cast("long")


def _gap(rings: list, ra: Column, dec: Column) -> dict[str, Column]:
    """Distances to the tile's edges, along the parallel and the meridian."""
    n, lo, hi = (_pick(rings, dec, lambda r, k=k: r[k], True) for k in (3, 1, 2))
    turn, cap = ra * n / (2 * math.pi), n == 1
    part, step = turn - F.floor(turn), 2 * math.pi / n
    south = F.when(cap & (dec < 0), F.lit(rings[0][2] - rings[0][1])).otherwise(dec - lo)
    return {
        "east": F.when(cap, 2 * math.pi).otherwise(step * (1 - part) * F.cos(dec)), "west": F.when(cap, 2 * math.pi).otherwise(step * part * F.cos(dec)),
        "north": F.when(cap & (dec > 0), F.lit(math.pi / 2 - rings[-1][1])).otherwise(hi - dec), "south": south,
    }


def areas_of_field_1476(fields: DataFrame, ra: str = "ra", dec: str = "dec", fov: str = "fov") -> DataFrame:
    """Tiles that a square field's corners fall into, where they hold at least 1 % of it.

    Adds ``area`` and ``share``; one row for each field and tile (the first corner's share).
    """
    rings, tau = rings_1476(), 2 * math.pi
    size = F.least(F.col(fov), F.lit(math.radians(5.142857)))
    f = fields.withColumn("_f", size)
    corners = []
    for k, (way, up) in enumerate(((1, 1), (-1, 1), (1, -1), (-1, -1))):
        d = F.col(dec) + up * F.col("_f") / 2
        r = F.col(ra) + way * F.col("_f") / 2 / F.greatest(F.cos(d), F.lit(1e-6))
        r = F.when(r < 0, r + tau).when(r >= tau, r - tau).otherwise(r)
        gap = _gap(rings, r, d)
        h, v = gap["west" if way > 0 else "east"], gap["south" if up > 0 else "north"]
        share = F.least(h, F.col("_f")) * F.least(v, F.col("_f")) / (F.col("_f") * F.col("_f"))
        corners.append(F.struct(F.lit(k).alias("k"), area_1476(r, d).alias("area"), share.alias("share")))
    rows = f.withColumn("_c", F.explode(F.array(*corners))).drop("_f").where(F.col("_c.share") >= 0.01)
    first = F.min(F.struct("_c.k", "_c.share"))
    keys = fields.columns
    return rows.select(*keys, "_c").groupBy(*keys, F.col("_c.area").alias("area")).agg(first.alias("m")).select(*keys, "area", F.col("m.share").alias("share"))


def areas_in_band(spark: SparkSession, lo: float, hi: float, rings: list) -> DataFrame:
    """Tiles of rings that touch a band of declination."""
    rows = [(n, base) for _, a, b, n, base in rings if b >= lo and a <= hi]
    df = spark.createDataFrame(rows, "n int, base int")
    return df.select(F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("area")).select(F.col("area").cast("long").alias("area"))


def areas_of_field_290(fields: DataFrame, ra: str = "ra", dec: str = "dec", fov: str = "fov") -> DataFrame:
    """All tiles that a field overlaps, round the poles and across right ascension 0. Adds ``area``."""
    rings, half = rings_290(), F.least(F.lit(math.pi), F.greatest(F.lit(0.0), F.col(fov) / 2))
    low, high = F.greatest(F.lit(-math.pi / 2), F.col(dec) - half), F.least(F.lit(math.pi / 2), F.col(dec) + half)
    pole = (F.col(dec) + half >= math.pi / 2 - 1e-12) | (F.col(dec) - half <= -math.pi / 2 + 1e-12)
    ring_of = lambda d: _pick(rings, d, lambda r: r[0], False)
    f = fields.withColumn("_ring", F.explode(F.sequence(ring_of(low), ring_of(high))))
    of = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in rings]), F.col("_ring") + 1)
    n, base = of(3), of(4)
    near = F.least(of(2), F.greatest(of(1), F.col(dec)))
    reach = half / F.greatest(F.cos(near), F.lit(1e-300))
    every = pole | (n == 1) | (F.cos(near) < 1e-6) | (reach >= math.pi)
    cell = lambda r: F.floor(F.pmod(r, F.lit(2 * math.pi)) / (2 * math.pi / n))
    first, last = cell(F.col(ra) - reach), cell(F.col(ra) + reach)
    span = F.when(every, n - 1).otherwise(F.pmod(last - first, n))
    start = F.when(every, F.lit(0)).otherwise(first)
    out = f.withColumn("_k", F.explode(F.sequence(F.lit(0), span.cast("int")))).withColumn("area", (base + F.pmod(start + F.col("_k"), n)).cast("long"))
    return out.select(*fields.columns, "area").distinct()


def file_name(area: Column, rings: list, suffix: str) -> Column:
    """The name of a tile's file: ring and cell, counted from 1."""
    ring, base = F.lit(1), F.lit(1)
    for k, _, _, _, first in rings[1:]:
        ring, base = F.when(area >= first, k + 1).otherwise(ring), F.when(area >= first, first).otherwise(base)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(ring), two(area - base + 1), F.lit(suffix))


def strip(dec: Column) -> Column:
    """One of 720 strips of a quarter degree."""
    return F.least(F.lit(719), F.greatest(F.lit(0), F.floor((dec + math.pi / 2) / math.pi * 720))).cast("long")
