"""Star patterns of images and catalogues: quads, triangles, seeds, pairs and index anchors."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import patterns as P
from skyloom.operators.joins import nearest_neighbours

#: Groups of up to so many stars make all their triangles.
ALL_TRIANGLES = 45


def subsets(items: Column, n: int, k: int) -> Column:
    """All ``k``-subsets of an array of exactly ``n`` elements, in lexicographic order."""
    return F.array(*[F.array(*[F.get(items, i) for i in c]) for c in combinations(range(n), k)])


def group_size(n_image: int, n: int) -> int | None:
    """How many stars a group has, for so many image stars; None: too few stars."""
    if n_image < 15 and n > 6:
        return 7
    if n_image < 30 and n > 5:
        return 6
    return 9 if n > 4 else None


def brightest(stars: DataFrame, n: int, group: str, order: list) -> DataFrame:
    """The first ``n`` rows of each group."""
    return stars.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _points(group: str, neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """Each star with its neighbours as one array, itself first."""
    near = neighbours.groupBy(group, "star_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("nb").alias("id"), F.col("nx").alias("px"), F.col("ny").alias("py")))).alias("_n"))
    own = F.array(F.struct(F.col("star_id").alias("id"), F.col("x").alias("px"), F.col("y").alias("py")))
    return near.select(group, "star_id", F.concat(own, F.transform("_n", lambda s: F.struct(s["id"].alias("id"), s["px"].alias("px"), s["py"].alias("py")))).alias("members"))


def _record(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Longest edge, ratios, centre and direction of the longest edge of each set of stars."""
    pairs = list(combinations(range(k), 2))
    # each step is bound by a one-row explode: inlined into the next it would outgrow what can be compiled
    at = rows.select(group, "q", F.explode(F.array(F.struct(*[F.get("q", i)[f"p{c}"].alias(f"{c}{i}") for i in range(k) for c in "xy"]))).alias("p")).select(group, "q", "p.*")
    xs, ys = [F.col(f"x{i}") for i in range(k)], [F.col(f"y{i}") for i in range(k)]
    size = [F.hypot(xs[i] - xs[j], ys[i] - ys[j]).alias(f"d{i}{j}") for i, j in pairs]
    turn = [F.atan2(ys[j] - ys[i], xs[j] - xs[i]).alias(f"t{i}{j}") for i, j in pairs]
    centre = [(sum(c[1:], c[0]) / k).alias(n) for c, n in ((xs, "cx"), (ys, "cy"))]
    far = at.select(group, F.transform("q", lambda p: p["id"]).alias("ids"), F.explode(F.array(F.struct(*size, *turn, *centre))).alias("p")).select(group, "ids", "p.*")
    longest = F.array_max(F.array(*[F.struct(F.col(f"d{i}{j}").alias("d"), F.lit(n).alias("n"), F.col(f"t{i}{j}").alias("t")) for n, (i, j) in enumerate(pairs)]))
    out = far.select(group, "ids", "cx", "cy", F.explode(F.array(F.struct(F.sort_array(F.array(*[F.col(f"d{i}{j}") for i, j in pairs]), asc=False).alias("e"), longest["t"].alias("t")))).alias("p")).select(group, "ids", "cx", "cy", "p.*")
    ratio = [(F.get("e", i) / F.get("e", 0)).alias(f"r{i - 1}") for i in range(1, len(pairs) if k == 4 else k)]
    return out.where(F.get("e", 0) >= 1e-10).select(group, "ids", F.get("e", 0).alias("d1"), *ratio, "cx", "cy", F.pmod("t", F.lit(math.pi)).alias("angle"))


def _sized(n_image: Column, n: Column) -> Column:
    """``group_size`` as an expression."""
    return F.when((n_image < 15) & (n > 6), 7).when((n_image < 30) & (n > 5), 6).when(n > 4, 9)


def quads(points: DataFrame, group: str = "field_id", image: DataFrame | None = None) -> DataFrame:
    """All quads of each star's group of nearest neighbours, each set of four stars once.

    Equal sets are dropped by their sorted star numbers, which doesn't depend on any order of rows.
    ``points``: (group, star_id, x, y); ``image``: the image's stars, whose number sets the size of the
    groups (default: ``points``). Output: ids, d1, r0..r4, cx, cy, angle.
    """
    n = points.groupBy(group).agg(F.count("*").alias("_own"))
    n = n.withColumn("_image", F.col("_own")) if image is None else n.join(image.groupBy(group).agg(F.count("*").alias("_image")), group)
    sizes = n.select(group, _sized(F.col("_image"), F.col("_own")).alias("_k"))
    near = nearest_neighbours(points, 8, group)
    whole = _points(group, near, points).join(sizes, group).where(F.size("members") >= F.col("_k"))
    each = None
    for k in (6, 7, 9):
        sets = whole.where(F.col("_k") == k).select(group, F.explode(subsets(F.col("members"), k, 4)).alias("q"))
        each = sets if each is None else each.unionByName(sets)
    each = each.withColumn("q", F.sort_array("q")).dropDuplicates([group, "q"])
    return _record(each, group, 4)


def neighbour_triangles(points: DataFrame, group: str = "field_id") -> DataFrame:
    """N10, N11 for groups of more than ``ALL_TRIANGLES`` stars: each star with pairs of its seven nearest neighbours, each once."""
    near = nearest_neighbours(points, 7, group)
    whole = _points(group, near, points)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("members") - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.size("members") - 1), lambda j: j > i), lambda j: F.array(F.get("members", 0), F.get("members", i), F.get("members", j)))))
    each = whole.where(F.size("members") >= 3).select(group, F.explode(pairs).alias("q")).withColumn("q", F.sort_array("q")).dropDuplicates([group, "q"])
    return _record(each, group, 3)


def triangles(points: DataFrame, group: str = "field_id") -> DataFrame:
    """All triangles of a group of up to ``ALL_TRIANGLES`` stars, else those of nearest neighbours."""
    sized = points.join(points.groupBy(group).agg(F.count("*").alias("_own")), group)
    few, many = sized.where(F.col("_own") <= ALL_TRIANGLES).drop("_own"), sized.where(F.col("_own") > ALL_TRIANGLES).drop("_own")
    star = lambda n: few.select(group, F.struct(F.col("star_id").alias("id"), F.col("x").alias("px"), F.col("y").alias("py")).alias(n))
    pairs_ = star("a").join(star("b"), group).where(F.col("a.id") < F.col("b.id"))
    each = pairs_.join(star("c"), group).where(F.col("b.id") < F.col("c.id")).select(group, F.array("a", "b", "c").alias("q"))
    return _record(each, group, 3).unionByName(neighbour_triangles(many, group))


def seeds(points: DataFrame, group: str = "field_id", n: int = 150, limit: int = 600) -> DataFrame:
    """Each of the brightest with three of its four nearest neighbours, the widest pairs first."""
    by = brightest(points, n, group, ["mag", "star_id"])
    near = _points(group, nearest_neighbours(by, 4, group), by).where(F.size("members") == 5)
    triples = F.array(*[F.array(*[F.get("members", i) for i in (0, *c)]) for c in combinations(range(1, 5), 3)])
    each = near.select(group, F.explode(triples).alias("q")).withColumn("q", F.sort_array("q")).dropDuplicates([group, "q"])
    made = _record(each, group, 4)
    return brightest(made, limit, group, [F.desc("d1"), "ids"])


def pairs(points: DataFrame, most: float, group: str = "field_id", least: float = 8.0) -> DataFrame:
    """Pairs of an image's stars from ``least`` to ``most`` apart."""
    other = points.select(group, F.col("star_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = points.join(other, group).where(F.col("star_id") < F.col("b")).withColumn("length", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")))
    return met.where(F.col("length").between(least, most)).select(group, F.col("star_id").alias("a"), "b", "length")


def anchors(stars: DataFrame, radius: float, members: int) -> DataFrame:
    """Stars that are the brightest within ``radius`` (radians), with their next brightest neighbours.

    Strips of declination and cells of right ascension that are never narrower than the radius make it
    an equi-join. ``stars``: (star_id, ra, dec, mag). One row an anchor with at least four members.
    """
    bands = int(math.pi / radius)
    band = lambda d: F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((d + math.pi / 2) / math.pi * bands))).cast("int")
    height = math.pi / bands

    def cells(b: Column) -> Column:
        low = F.least(F.abs(b * height - math.pi / 2), F.abs((b + 1) * height - math.pi / 2))
        high = F.greatest(F.abs(b * height - math.pi / 2), F.abs((b + 1) * height - math.pi / 2))
        return F.when(high >= math.pi / 2 - radius, 1).otherwise(F.greatest(F.lit(1), F.floor(2 * math.pi * F.cos(F.greatest(low, high)) / radius))).cast("int")

    def cell(ra: Column, b: Column) -> Column:
        return F.least(cells(b) - 1, F.floor(F.pmod(ra, F.lit(2 * math.pi)) / (2 * math.pi) * cells(b))).cast("int")

    own = stars.select("*", band(F.col("dec")).alias("_b")).select("*", cell(F.col("ra"), F.col("_b")).alias("_c"))
    there = stars.select(*[F.col(c).alias(f"o_{c}") for c in ("star_id", "ra", "dec", "mag")], band(F.col("dec")).alias("_ob"))
    there = there.withColumn("_b", F.explode(F.array(F.col("_ob") - 1, F.col("_ob"), F.col("_ob") + 1))).where((F.col("_b") >= 0) & (F.col("_b") < bands))
    mid = cell(F.col("o_ra"), F.col("_b"))
    there = there.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(mid + k, cells(F.col("_b"))) for k in (-1, 0, 1)])))).drop("_ob")
    from skyloom.functions.sphere import separation

    near = own.join(there, ["_b", "_c"]).where((F.col("star_id") != F.col("o_star_id")) & (separation("ra", "dec", "o_ra", "o_dec") <= radius))
    brighter = (F.col("o_mag") < F.col("mag")) | ((F.col("o_mag") == F.col("mag")) & (F.col("o_star_id") < F.col("star_id")))
    marked = near.withColumn("_brighter", F.max(brighter.cast("int")).over(Window.partitionBy("star_id"))).where("_brighter = 0")
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("star_id").orderBy("o_mag", "o_star_id"))).where(F.col("_r") < members)
    member = F.struct(F.col("_r").alias("r"), F.col("o_star_id").alias("id"), F.col("o_ra").alias("ra"), F.col("o_dec").alias("dec"))
    return ranked.groupBy("star_id", "ra", "dec", "mag").agg(F.sort_array(F.collect_list(member)).alias("others")).where(F.size("others") >= 3)


def anchor_patterns(found: DataFrame, members: int) -> DataFrame:
    """Keyed patterns of each anchor's members, on its tangent plane."""
    from skyloom.functions.sphere import tangent_project

    plane = lambda m: F.struct(m["id"].alias("id"), *[c.alias(n) for c, n in zip(tangent_project(F.col("ra"), F.col("dec"), m["ra"], m["dec"]), ("px", "py"))])
    own = F.struct(F.col("star_id").alias("id"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    all_ = found.select("star_id", F.concat(F.array(own), F.transform("others", plane)).alias("m"), (F.size("others") + 1).alias("n"))
    parts = None
    for n in range(4, members + 1):
        sets = all_.where(F.col("n") == n).select("star_id", F.explode(subsets(F.col("m"), n, 4)).alias("q"))
        parts = sets if parts is None else parts.unionByName(sets)
    xs, ys = [F.get("q", i)["px"] for i in range(4)], [F.get("q", i)["py"] for i in range(4)]
    d = parts.withColumn("e", P.descriptor(xs, ys)).withColumn("order", P.canonical(xs, ys))
    ids = F.transform("order", lambda i: F.get("q", i)["id"])
    d = d.select(F.col("star_id").alias("anchor"), ids.alias("ids"), F.transform(F.slice("e", 1, 5), lambda v: v / F.get("e", 5)).alias("descriptor"))
    return d.withColumn("key", P.key(F.col("descriptor")))


def three_neighbour_quads(points: DataFrame, group: str = "field_id") -> DataFrame:
    """Each star with its three nearest neighbours, each set of four once.

    In lists of 150 stars or more a neighbour stands at most twice the root of their number away in
    the order of x. Output as of ``quads``.
    """
    sized = points.withColumn("_n", F.count("*").over(Window.partitionBy(group))).withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy("x", "star_id")))
    reach = F.when(F.col("_n") >= 150, F.floor(2 * F.sqrt(F.col("_n").cast("double")) + 0.5)).otherwise(F.col("_n"))
    other = sized.select(group, F.col("star_id").alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("_at").alias("_nat"))
    met = sized.withColumn("_reach", reach).join(other, group).where((F.col("star_id") != F.col("nb")) & (F.abs(F.col("_at") - F.col("_nat")) <= F.col("_reach")))
    met = met.withColumn("d2", (F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2).where("d2 > 1")
    near = met.withColumn("slot", F.row_number().over(Window.partitionBy(group, "star_id").orderBy("d2", "nb"))).where("slot <= 3")
    whole = _points(group, near, points).where(F.size("members") == 4)
    return _record(whole.select(group, F.sort_array("members").alias("q")).dropDuplicates([group, "q"]), group, 4)
