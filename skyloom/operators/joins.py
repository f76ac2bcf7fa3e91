"""Joins that Spark lacks: band joins, ball joins and nearest joins, as equi-joins on cells.

Each puts one side into its cell and the other into its own and the neighbouring cells, joins on the
cell, and tests exactly. Work grows with the pairs that are close, not with all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(values: list[Column], size: float, reach: int) -> Column:
    """All cells within ``reach`` of the values' cell, as an array of arrays."""
    out = F.array(F.array().cast("array<bigint>"))
    for v in values:
        own = F.floor(v / size).cast("long")
        out = _widened(out, F.array(*[own + k for k in range(-reach, reach + 1)]))
    return out


def _widened(cells: Column, steps: Column) -> Column:
    return F.flatten(F.transform(cells, lambda c: F.transform(steps, lambda s: F.concat(c, F.array(s)))))


def band_join(left: DataFrame, right: DataFrame, dims: list[tuple[str, str]], tolerance: float, cells: int = 2) -> DataFrame:
    """Rows of both sides that differ by at most ``tolerance`` in every dimension.

    ``dims``: (left column, right column). The first ``cells`` dimensions make the cell. Column names of
    the two sides must differ.
    """
    keyed = [F.col(a) for a, _ in dims[:cells]], [F.col(b) for _, b in dims[:cells]]
    l = left.withColumn("_cell", F.array(*[F.floor(c / tolerance).cast("long") for c in keyed[0]]))
    r = right.withColumn("_cell", F.explode(_cells(keyed[1], tolerance, 1)))
    close = reduce(lambda x, y: x & y, [F.abs(F.col(a) - F.col(b)) <= tolerance for a, b in dims])
    return l.join(r, "_cell").where(close).drop("_cell")


def ball_join(left: DataFrame, right: DataFrame, dims: list[tuple[str, str]], radius: float, cells: int = 2) -> DataFrame:
    """Rows within a Euclidean distance, with that distance's square as ``d2``."""
    d2 = reduce(lambda x, y: x + y, [(F.col(a) - F.col(b)) ** 2 for a, b in dims])
    return band_join(left, right, dims, radius, cells).withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, dims: list[tuple[str, str]], radius: float) -> DataFrame:
    """For each left row its nearest right row within ``radius``; ties by the right id."""
    near = ball_join(left, right, dims, radius)
    return near.groupBy(left_id).agg(F.min(F.struct("d2", right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.d2").alias("d2"))


def mutual_best(pairs: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """First each ``a`` keeps its cheapest ``b``, then each ``b`` its cheapest ``a``; ties by id."""
    one = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(a).orderBy(cost, b))).where("_r = 1")
    return one.withColumn("_r", F.row_number().over(Window.partitionBy(b).orderBy(cost, a))).where("_r = 1").drop("_r")


def nearest_neighbours(points: DataFrame, k: int, group: str, id_: str = "star_id", apart2: float = 1.0) -> DataFrame:
    """The ``k`` nearest neighbours of each point of its group, further than ``apart2`` squared apart.

    Groups are star lists of one image, which are bounded, so all pairs of a group are compared.
    """
    other = points.select(group, F.col(id_).alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    d2 = (F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2
    met = points.join(other, group).where(F.col(id_) != F.col("nb")).withColumn("d2", d2).where(F.col("d2") > apart2)
    return met.withColumn("slot", F.row_number().over(Window.partitionBy(group, id_).orderBy("d2", "nb"))).where(F.col("slot") <= k)
