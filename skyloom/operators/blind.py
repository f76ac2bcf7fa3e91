"""Blind search, image side: the patterns of an image that are looked up in an index of the sky.

Patterns are rows, so many images search at once; an image's star list is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import sphere

GLOBAL, PER_CELL, CELLS = 20, 2, 6
WINDOWS = (16.0, 11.0, 8.0, 5.6, 4.0, 2.8, 2.0)
ANCHORS, NEAR = 150, 5


def code(ax, ay, bx, by, x, y, flip: bool) -> tuple[Column, Column]:
    """A point in the frame in which A is (0, 0) and B is (1, 1), in either parity."""
    ax, ay, bx, by, x, y = map(sphere.col, (ax, ay, bx, by, x, y))
    east, north = bx - ax, by - ay
    length2 = east * east + north * north
    # along and across AB, in its length; A to B then lies on the diagonal, an eighth of a turn further on
    along = ((x - ax) * east + (y - ay) * north) / length2
    across = ((y - ay) * east - (x - ax) * north) / length2
    return (along - across, along + across) if flip else (along + across, along - across)


def image_patterns(stars: DataFrame, width: int, height: int, group: str = "field_id") -> DataFrame:
    """Sets of four stars: of the brightest that are spread over the frame, and of the brightest in windows.

    ``stars``: (group, star_id, x, y, snr). Output: group, q (array of id, px, py by brightness), each set once.
    """
    order = [F.desc("snr"), "star_id"]
    cell = lambda c, n: F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor(F.col(c) / n * CELLS)))
    ranked = stars.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    spread = ranked.withColumn("_c", F.struct(cell("x", width).alias("a"), cell("y", height).alias("b"))).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_c").orderBy("rank"))).where(F.col("_k") <= PER_CELL)
    picked = spread.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where(F.col("_g") <= GLOBAL)
    point = F.struct("rank", F.col("star_id").alias("id"), F.col("x").alias("px"), F.col("y").alias("py"))
    whole = picked.groupBy(group).agg(F.sort_array(F.collect_list(point)).alias("m"))
    own = whole.select(group, F.explode(_fours(F.col("m"))).alias("q"))
    anchors = ranked.where(F.col("rank") <= ANCHORS).select(group, F.col("rank").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*[F.lit((min(width, height) / d) ** 2) for d in WINDOWS])).alias("r2"))
    near = anchors.join(ranked, group).where((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2 <= F.col("r2"))
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy(group, "anchor", "r2").orderBy("rank"))).where(F.col("_k") <= NEAR)
    windows = near.groupBy(group, "anchor", "r2").agg(F.sort_array(F.collect_list(point)).alias("m")).where(F.size("m") >= 4)
    own = own.unionByName(windows.select(group, F.explode(_fours(F.col("m"))).alias("q")))
    return own.dropDuplicates([group, "q"])


def _fours(m: Column) -> Column:
    """All sets of four of an array of any length up to 20, in order."""
    n = F.size(m)
    range_ = lambda lo: F.when(lo < n, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<int>"))
    four = lambda a, b, c: F.transform(range_(c + 1), lambda d: F.array(F.get(m, a), F.get(m, b), F.get(m, c), F.get(m, d)))
    three = lambda a, b: F.flatten(F.transform(range_(b + 1), lambda c: four(a, b, c)))
    two = lambda a: F.flatten(F.transform(range_(a + 1), lambda b: three(a, b)))
    return F.flatten(F.transform(range_(F.lit(0)), two))


def triangle_code(ax, ay, bx, by, cx, cy, flip: bool) -> Column:
    """(x, y) of C in the frame of A and B, A and B swapped if x is over a half; null for A and B less than a pixel apart."""
    x, y = code(ax, ay, bx, by, cx, cy, flip)
    apart = (sphere.col(bx) - sphere.col(ax)) ** 2 + (sphere.col(by) - sphere.col(ay)) ** 2
    other = x > 0.5
    return F.when(apart >= 1, F.struct(F.when(other, 1 - x).otherwise(x).alias("cx"), F.when(other, 1 - y).otherwise(y).alias("cy"), other.alias("swapped")))


def quad_code(ax, ay, bx, by, cx, cy, dx, dy, flip: bool) -> Column:
    """The codes of C and D in the frame of A and B: their x sum to one at most, and C's is the smaller (y of a tie)."""
    apart = (sphere.col(bx) - sphere.col(ax)) ** 2 + (sphere.col(by) - sphere.col(ay)) ** 2
    c, d = code(ax, ay, bx, by, cx, cy, flip), code(ax, ay, bx, by, dx, dy, flip)
    turn = c[0] + d[0] > 1
    pair = [F.struct(*[F.when(turn, 1 - v).otherwise(v).alias(n) for v, n in zip(p, "xy")]) for p in (c, d)]
    return F.when(apart >= 1, F.sort_array(F.array(*pair)))
