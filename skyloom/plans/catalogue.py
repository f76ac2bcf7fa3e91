"""Named queries of the engine and the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import patterns as P
from skyloom.functions import sphere, text
from skyloom.operators import blind, catalogue_scan, fit, joins, patterns, pixels, planning, solve, tiles, votes
from skyloom.plans import views as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
R0, D0 = f"{V.RA0}e0", f"{V.DEC0}e0"
WCS = {"ra0": V.RA0, "dec0": V.DEC0, "crpix1": 1500.5, "crpix2": 1500.5, "cd": (-8e-4, 1e-4, 1e-4, 8e-4)}
SIP_A = [0.0, 0.0, 0.0, 1e-6, 2e-6, 0.0, 1e-9, 0.0, 0.0, 0.0]


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = V.sql_with(list(uses), sql) if uses else sql
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def named(df: DataFrame, *keys: str, **cols: Column) -> DataFrame:
    return df.select(*keys, *[c.alias(k) for k, c in cols.items()])


# Scalar functions on the sphere


@query("g01_gnomonic", """SELECT star_id, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM std_stars""", ("std_stars",))
def _(spark, d):
    x, y = sphere.gnomonic(V.RA0, V.DEC0, "ra", "dec")
    return named(V.view(spark, d, "field_stars"), "star_id", x=r(x, 4), y=r(y, 4))


@query("g02_inverse_gnomonic", f"""SELECT star_id, round(ra0 - 2e0 * pi() * floor(ra0 / (2e0 * pi())), 9) + 0e0 AS ra, round(dec0, 9) + 0e0 AS dec FROM (
  SELECT star_id, {R0} + atan2(-x * pi() / 648000e0, cos({D0}) - y * pi() / 648000e0 * sin({D0})) AS ra0,
         asin((sin({D0}) + y * pi() / 648000e0 * cos({D0})) / sqrt(1e0 + (x * x + y * y) * (pi() / 648000e0) * (pi() / 648000e0))) AS dec0 FROM std_stars)""", ("std_stars",))
def _(spark, d):
    ra, dec = sphere.inverse_gnomonic(V.RA0, V.DEC0, "x", "y")
    return named(V.view(spark, d, "std_stars"), "star_id", ra=r(ra, 9), dec=r(dec, 9))


@query("g03_separation", f"""SELECT star_id, round(acos(least(1e0, greatest(-1e0, sin(dec) * sin({D0}) + cos(dec) * cos({D0}) * cos(ra - {R0})))), 8) + 0e0 AS sep FROM sky_stars""", ("sky_stars",))
def _(spark, d):
    return named(V.view(spark, d, "sky_stars"), "star_id", sep=r(sphere.separation("ra", "dec", V.RA0, V.DEC0), 8))


@query("g04_unit_vector", "SELECT star_id, round(cos(dec) * cos(ra), 9) + 0e0 AS ux, round(cos(dec) * sin(ra), 9) + 0e0 AS uy, round(sin(dec), 9) + 0e0 AS uz FROM sky_stars", ("sky_stars",))
def _(spark, d):
    x, y, z = sphere.unit("ra", "dec")
    return named(V.view(spark, d, "sky_stars"), "star_id", ux=r(x, 9), uy=r(y, 9), uz=r(z, 9))


@query("g05_tangent_plane", f"""SELECT star_id, round(CASE WHEN h > 1e-9 THEN cos(dec) * sin(ra - {R0}) / h END, 6) + 0e0 AS xi,
  round(CASE WHEN h > 1e-9 THEN (sin(dec) * cos({D0}) - cos(dec) * sin({D0}) * cos(ra - {R0})) / h END, 6) + 0e0 AS eta
  FROM (SELECT *, sin(dec) * sin({D0}) + cos(dec) * cos({D0}) * cos(ra - {R0}) AS h FROM sky_stars)""", ("sky_stars",))
def _(spark, d):
    xi, eta = sphere.tangent_project(V.RA0, V.DEC0, "ra", "dec")
    return named(V.view(spark, d, "sky_stars"), "star_id", xi=r(xi), eta=r(eta))


@query("g05_tangent_round_trip", """SELECT star_id, round(ra, 9) + 0e0 AS ra, round(dec, 9) + 0e0 AS dec FROM field_stars""", ("field_stars",))
def _(spark, d):
    xi, eta = sphere.tangent_project(V.RA0, V.DEC0, "ra", "dec")
    f = V.view(spark, d, "field_stars").select("star_id", xi.alias("xi"), eta.alias("eta"))
    ra, dec = sphere.tangent_deproject(V.RA0, V.DEC0, "xi", "eta")
    return named(f, "star_id", ra=r(ra, 9), dec=r(dec, 9))


_PIX = f"""FROM (SELECT star_id, u + 1e-6 * u * u + 2e-6 * u * v + 1e-9 * u * u * u AS u, v FROM (SELECT star_id, x - 1500.5e0 AS u, y - 1500.5e0 AS v FROM detections))"""


@query("g06_pixel_to_sky", f"""SELECT star_id, round(ra - 2e0 * pi() * floor(ra / (2e0 * pi())), 9) + 0e0 AS ra, round(dec, 9) + 0e0 AS dec FROM (
  SELECT star_id, {R0} + atan2(xi, cos({D0}) - eta * sin({D0})) AS ra,
    atan2(sin({D0}) + eta * cos({D0}), sqrt((cos({D0}) - eta * sin({D0})) * (cos({D0}) - eta * sin({D0})) + xi * xi)) AS dec FROM (
    SELECT star_id, radians(-8e-4 * u + 1e-4 * v) AS xi, radians(1e-4 * u + 8e-4 * v) AS eta {_PIX}))""", ("detections",))
def _(spark, d):
    ra, dec = sphere.pixel_to_sky(WCS | {"a": SIP_A, "b": [0.0] * 10}, "x", "y")
    return named(V.view(spark, d, "detections"), "star_id", ra=r(ra, 9), dec=r(dec, 9))


@query("g07_sky_to_pixel", f"""SELECT star_id, round(CASE WHEN h > 0 THEN (8e-4 * xi - 1e-4 * eta) / (-6.5e-7) + 1500.5e0 END, 4) + 0e0 AS x,
  round(CASE WHEN h > 0 THEN (-8e-4 * eta - 1e-4 * xi) / (-6.5e-7) + 1500.5e0 END, 4) + 0e0 AS y FROM (
  SELECT star_id, h, degrees(cos(dec) * sin(ra - {R0}) / h) AS xi, degrees((sin(dec) * cos({D0}) - cos(dec) * sin({D0}) * cos(ra - {R0})) / h) AS eta
  FROM (SELECT *, sin(dec) * sin({D0}) + cos(dec) * cos({D0}) * cos(ra - {R0}) AS h FROM field_stars))""", ("field_stars",))
def _(spark, d):
    x, y = sphere.sky_to_pixel(WCS, "ra", "dec")
    return named(V.view(spark, d, "field_stars"), "star_id", x=r(x, 4), y=r(y, 4))


_CD = "SELECT hyp_id, cos(ra) * scale AS a, sin(ra) * scale AS b, sin(dec) + 0.1e0 AS c, cos(dec) * scale AS e FROM hypotheses"


def _cd(spark, d):
    h = V.view(spark, d, "hypotheses")
    return h.select("hyp_id", (F.cos("ra") * F.col("scale")).alias("a"), (F.sin("ra") * F.col("scale")).alias("b"), (F.sin("dec") + 0.1).alias("c"), (F.cos("dec") * F.col("scale")).alias("e"))


@query("g09_old_style_keywords", f"""SELECT hyp_id, round(f * sqrt(a * a + b * b), 8) + 0e0 AS cdelt1, round(sqrt(c * c + e * e), 8) + 0e0 AS cdelt2, round(degrees(atan2(f * c, e)), 7) + 0e0 AS crota2
  FROM (SELECT *, CASE WHEN a * e - b * c < 0 THEN -1e0 ELSE 1e0 END AS f FROM ({_CD}))""", ("hypotheses",))
def _(spark, d):
    k = sphere.old_style("a", "b", "c", "e")
    return named(_cd(spark, d), "hyp_id", cdelt1=r(k["cdelt1"], 8), cdelt2=r(k["cdelt2"], 8), crota2=r(k["crota2"], 7))


@query("g11_anisotropy", f"""SELECT hyp_id, floor(1e4 / ((q + r) / abs(q - r)) + 0.5e0) AS k FROM (SELECT hyp_id, sqrt((a + e) * (a + e) + (c - b) * (c - b)) / 2e0 AS q, sqrt((a - e) * (a - e) + (c + b) * (c + b)) / 2e0 AS r FROM ({_CD}))""", ("hypotheses",))
def _(spark, d):
    return named(_cd(spark, d), "hyp_id", k=F.floor(1e4 / sphere.anisotropy("a", "b", "c", "e") + 0.5).cast("double"))


@query("g20_g21_affine", f"""SELECT hyp_id, round(greatest(abs(a * b + c * e) / (c1 * c2), abs(c1 / c2 - 1e0)), 6) + 0e0 AS err, round(e / det, 6) + 0e0 AS ia, round(-b / det, 6) + 0e0 AS ib,
  round(-(e / det * 2e0 - b / det * 3e0), 6) + 0e0 AS ic FROM (SELECT *, sqrt(a * a + c * c) AS c1, sqrt(b * b + e * e) AS c2, a * e - b * c AS det FROM ({_CD})) WHERE abs(det) > 1e-3""", ("hypotheses",))
def _(spark, d):
    rows = _cd(spark, d).where(F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("c")) > 1e-3)
    inv = sphere.inverse_affine("a", "b", 2.0, "c", "e", 3.0)
    return named(rows, "hyp_id", err=r(sphere.shape_error("a", "b", "c", "e")), ia=r(inv["ia"]), ib=r(inv["ib"]), ic=r(inv["ic"]))


@query("g24_spiral", """SELECT i, CASE WHEN i = 0 THEN 0 WHEN side = 0 THEN k WHEN side = 1 THEN k - 1 - t WHEN side = 2 THEN -k ELSE 1 - k + t END AS x,
  CASE WHEN i = 0 THEN 0 WHEN side = 0 THEN 1 - k + t WHEN side = 1 THEN k WHEN side = 2 THEN k - 1 - t ELSE -k END AS y FROM (
  SELECT i, k, p // greatest(2 * k, 1) AS side, p % greatest(2 * k, 1) AS t FROM (SELECT i, k, i - (2 * k - 1) * (2 * k - 1) AS p FROM (
  SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(floor((floor(sqrt(s_suppkey)) + 1) / 2) AS BIGINT) AS k FROM supplier)))""")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("i"))
    x, y = sphere.spiral("i")
    return s.select("i", x.alias("x"), y.alias("y"))


@query("g26_g27_thresholds", """SELECT star_id, CAST(least(30, greatest(10, ceil(star_id * 0.15e0))) AS BIGINT) AS least_stars,
  CASE WHEN star_id % 9 = 0 THEN 'Infinity'::DOUBLE ELSE round(((mag * mag + 5e0) - mag) / 14 / (mag / greatest(1, 2e0 * (star_id - 10))), 6) + 0e0 END AS f FROM sky_stars WHERE mag > 0""", ("sky_stars",))
def _(spark, d):
    s = V.view(spark, d, "sky_stars").where("mag > 0")
    return named(s, "star_id", least_stars=sphere.least_stars("star_id"), f=r(sphere.f_statistic(F.col("mag") * F.col("mag") + 5, F.when(F.col("star_id") % 9 == 0, 0.0).otherwise(F.col("mag")), 3, 10, F.col("star_id"))))


# Pattern descriptors

_QUAD = """SELECT a.star_id AS id, [struct_pack(x := a.x, y := a.y), struct_pack(x := b.x, y := b.y), struct_pack(x := c.x, y := c.y), struct_pack(x := e.x, y := e.y)] AS p
  FROM std_stars a JOIN std_stars b ON b.star_id = a.star_id + 1 JOIN std_stars c ON c.star_id = a.star_id + 2 JOIN std_stars e ON e.star_id = a.star_id + 3"""
_EDGES = f"""SELECT id, list_sort(list_transform([[1,2],[1,3],[1,4],[2,3],[2,4],[3,4]], lambda t: sqrt((p[t[1]].x - p[t[2]].x) * (p[t[1]].x - p[t[2]].x) + (p[t[1]].y - p[t[2]].y) * (p[t[1]].y - p[t[2]].y)))) AS e FROM ({_QUAD})"""
_BINS = f"""SELECT id, list_transform([1,2,3,4,5], lambda k: least(127, greatest(0, floor(e[k] / e[6] * 128e0)))) AS b, list_transform([1,2,3,4,5], lambda k: e[k] / e[6]) AS d FROM ({_EDGES})"""


def _four(spark, d) -> tuple[DataFrame, list[Column], list[Column]]:
    s = V.view(spark, d, "std_stars").select("star_id", "x", "y")
    rows = s.select(F.col("star_id").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    for k in (1, 2, 3):
        rows = rows.join(s.select((F.col("star_id") - k).alias("id"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), "id")
    return rows, [F.col(f"x{k}") for k in range(4)], [F.col(f"y{k}") for k in range(4)]


@query("g15_g18_descriptor_key", f"""SELECT id, round(d[1], 6) + 0e0 AS d0, round(d[5], 6) + 0e0 AS d4, CAST((((b[1] * 256 + b[2]) * 256 + b[3]) * 256 + b[4]) * 256 + b[5] AS BIGINT) AS key FROM ({_BINS})""", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    rows = rows.withColumn("e", P.descriptor(xs, ys)).withColumn("d", F.transform(F.slice("e", 1, 5), lambda v: v / F.get("e", 5)))
    return named(rows, "id", d0=r(F.get("d", 0)), d4=r(F.get("d", 4)), key=P.key(F.col("d")))


_OPTS = "list_transform([1,2,3,4,5], lambda k: CASE WHEN d[k] * 128e0 - b[k] < 0.32e0 AND b[k] > 0 THEN [b[k], b[k] - 1] WHEN d[k] * 128e0 - b[k] > 0.68e0 AND b[k] < 127 THEN [b[k], b[k] + 1] ELSE [b[k]] END)"


@query("g19_probe_keys", f"""SELECT id, CAST(count(*) AS BIGINT) AS n, CAST(min(k) AS BIGINT) AS lo, CAST(max(k) AS BIGINT) AS hi FROM (
  SELECT id, (((a * 256 + b) * 256 + c) * 256 + d) * 256 + e AS k FROM (SELECT id, a, b, c, d, unnest(o[5]) AS e, o FROM (SELECT id, a, b, c, unnest(o[4]) AS d, o FROM (
  SELECT id, a, b, unnest(o[3]) AS c, o FROM (SELECT id, a, unnest(o[2]) AS b, o FROM (SELECT id, unnest(o[1]) AS a, o FROM (SELECT id, {_OPTS} AS o FROM ({_BINS}))))))))
  GROUP BY id""", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    rows = rows.withColumn("e", P.descriptor(xs, ys)).withColumn("d", F.transform(F.slice("e", 1, 5), lambda v: v / F.get("e", 5))).select("id", P.probes(F.col("d")).alias("k"))
    return rows.select("id", F.size("k").cast("long").alias("n"), F.array_min("k").alias("lo"), F.array_max("k").alias("hi"))


@query("g16_canonical_order", f"""SELECT id, list_transform(list_sort(list_transform([1,2,3,4], lambda i: struct_pack(t := list_sum(list_transform([1,2,3,4], lambda j: sqrt((p[i].x - p[j].x) * (p[i].x - p[j].x) + (p[i].y - p[j].y) * (p[i].y - p[j].y)))), i := i))), lambda s: s.i)[1] - 1 AS first_vertex FROM ({_QUAD})""", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    return rows.select("id", F.get(P.canonical(xs, ys), 0).alias("first_vertex"))


# Pixels

_HIST = "SELECT image_id, CAST(CASE WHEN v > 0 THEN floor(v) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM pixels WHERE v IS NOT NULL GROUP BY 1, 2"


@query("p01_normalise", """WITH s AS (SELECT image_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM pixels GROUP BY image_id),
  k AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS rn, count(*) OVER (PARTITION BY image_id) AS m FROM pixels),
  t AS (SELECT image_id, v AS p FROM k WHERE rn - 1 = least(floor(m * 0.999e0), m - 1))
  SELECT image_id, x, y, round(CASE WHEN hi - lo < 4096 AND p > lo THEN v * (20000e0 / (p - lo)) + (100e0 - lo * (20000e0 / (p - lo))) ELSE v END, 6) + 0e0 AS v FROM pixels JOIN s USING (image_id) JOIN t USING (image_id)""", ("pixels",))
def _(spark, d):
    return named(pixels.normalised(V.view(spark, d, "pixels")), "image_id", "x", "y", v=r("v"))


@query("p02_bin", """SELECT image_id, CAST(floor(x / 3e0) AS INT) AS x, CAST(floor(y / 3e0) AS INT) AS y, round(avg(v), 6) + 0e0 AS v FROM pixels
  JOIN (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1) USING (image_id) WHERE x < floor(w / 3e0) * 3 AND y < floor(h / 3e0) * 3 GROUP BY 1, 2, 3""", ("pixels",))
def _(spark, d):
    return named(pixels.binned(V.view(spark, d, "pixels"), 3), "image_id", "x", "y", v=r("v"))


@query("p03_debayer", """WITH s AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), m AS (SELECT image_id, x % 2 + 2 * (y % 2) AS ph, avg(v) AS m FROM pixels JOIN s USING (image_id)
  WHERE x BETWEEN floor(w / 4e0) AND least(floor(w * 3 / 4e0), w - 1) AND y BETWEEN floor(h / 4e0) AND least(floor(h * 3 / 4e0), h - 1) GROUP BY 1, 2)
  SELECT image_id, x, y, CASE WHEN f <> 1 THEN round_even(v * f, 0) ELSE v END + 0e0 AS v FROM (SELECT image_id, x, y, v, max(m) OVER (PARTITION BY image_id) / m AS f FROM pixels JOIN m ON m.image_id = pixels.image_id AND m.ph = x % 2 + 2 * (y % 2)) q(image_id, x, y, v, f)""".replace("SELECT image_id, x, y, v, max(m) OVER (PARTITION BY image_id) / m AS f FROM pixels JOIN m ON m.image_id = pixels.image_id AND m.ph = x % 2 + 2 * (y % 2)", "SELECT pixels.image_id, x, y, v, g.f FROM pixels JOIN (SELECT image_id, ph, max(m) OVER (PARTITION BY image_id) / m AS f FROM m) g ON g.image_id = pixels.image_id AND g.ph = x % 2 + 2 * (y % 2)"), ("pixels",))
def _(spark, d):
    return named(pixels.debayered(V.view(spark, d, "pixels")), "image_id", "x", "y", v=F.col("v") + 0.0)


@query("p04_binning", """SELECT hyp_id, CAST(greatest(1, least(CASE WHEN scale < 1 THEN least(16, greatest(1, floor(1e0 / scale + 0.5e0))) ELSE 1 END, floor(least(100 + hyp_id % 9, 2 + hyp_id % 7) / 2e0))) AS BIGINT) AS bin FROM hypotheses""", ("hypotheses",))
def _(spark, d):
    return V.view(spark, d, "hypotheses").select("hyp_id", pixels.binning(F.col("scale"), 100 + F.col("hyp_id") % 9, 2 + F.col("hyp_id") % 7).alias("bin"))


@query("b01_histogram", f"""WITH h AS ({_HIST}) SELECT image_id, bin, n FROM h WHERE bin <= 65001""", ("pixels",))
def _(spark, d):
    return pixels.histogram(V.view(spark, d, "pixels"))


def _clip_sql(rounds: int) -> str:
    out = [f"WITH h AS ({_HIST})", "s0 AS (SELECT DISTINCT image_id, 0e0 AS mean, 0e0 AS sd, 65001e0 AS hi, false AS done FROM h)"]
    for k in range(rounds):
        out.append(f"""t{k} AS (SELECT s.*, a.t, a.s AS su, a.q FROM s{k} s JOIN (SELECT h.image_id, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(bin * n) AS DOUBLE) AS s, CAST(sum(bin * bin * n) AS DOUBLE) AS q
          FROM h JOIN s{k} x ON x.image_id = h.image_id WHERE bin <= hi GROUP BY 1) a USING (image_id))""")
        out.append(f"u{k} AS (SELECT *, su / t AS m2, sqrt(CASE WHEN t > 1 THEN greatest(0e0, (q - su * su / t) / (t - 1)) ELSE 0e0 END) AS s2 FROM t{k})")
        out.append(f"""s{k + 1} AS (SELECT image_id, CASE WHEN done THEN mean ELSE m2 END AS mean, CASE WHEN done THEN sd ELSE s2 END AS sd,
          CASE WHEN done THEN hi WHEN s2 > 0 THEN least(65001e0, floor(m2 + 2 * s2 + 0.5e0)) ELSE hi END AS hi, done OR ({'true' if k else 'false'} AND abs(m2 - mean) < 0.1e0 AND abs(s2 - sd) < 0.1e0) AS done FROM u{k})""")
    return ", ".join(out) + f" SELECT image_id, round(mean, 6) + 0e0 AS mean, round(sd, 6) + 0e0 AS sd FROM s{rounds}"


@query("b02_clipped_mean", _clip_sql(6), ("pixels",))
def _(spark, d):
    return named(pixels.clipped_mean(pixels.histogram(V.view(spark, d, "pixels"))), "image_id", mean=r("mean"), sd=r("sd"))


_MODE = f"""h AS ({_HIST}), a AS (SELECT image_id, floor(sum(bin * n) / (SELECT count(*) FROM pixels p WHERE p.image_id = h.image_id)) AS mean FROM h GROUP BY image_id),
  b AS (SELECT a.image_id, mean, arg_max(bin, n * 100000 - bin) AS mode FROM a LEFT JOIN h ON h.image_id = a.image_id AND bin BETWEEN 1 AND mean GROUP BY 1, 2),
  bg AS (SELECT image_id, CASE WHEN mean = 0 THEN 0e0 WHEN mean > 1.5e0 * coalesce(mode, 0) THEN mean ELSE mode END + 0e0 AS background FROM b)"""


@query("b03_background_mode", f"WITH {_MODE} SELECT image_id, background FROM bg", ("pixels",))
def _(spark, d):
    px = V.view(spark, d, "pixels")
    return pixels.background_mode(pixels.histogram(px), px.groupBy("image_id").agg(F.count("*").alias("n_pixels"))).select("image_id", (F.col("background") + 0.0).alias("background"))


def _noise_sql(rounds: int = 7) -> str:
    out = [_MODE, """z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS hh, greatest(1, floor((max(y) + 1) / 71e0 + 0.5e0)) AS st0 FROM pixels GROUP BY 1), z2 AS (SELECT *, st0 + CASE WHEN st0 % 2 = 0 THEN 1 ELSE 0 END AS st FROM z)""",
           """g AS (SELECT p.image_id, v - background AS dv FROM pixels p JOIN z2 USING (image_id) JOIN bg USING (image_id) WHERE x >= 15 AND x <= w - 16 AND (x - 15) % st = 0 AND y >= 15 AND y <= hh - 16 AND (y - 15) % st = 0 AND v < 2 * background AND v <> 0)""",
           "n0 AS (SELECT image_id, 1e9 AS sd, false AS done FROM bg)"]
    for k in range(rounds):
        out.append(f"""n{k + 1} AS (SELECT image_id, CASE WHEN done THEN sd ELSE new END AS sd, done OR abs(sd - new) < 0.05e0 * new AS done FROM (
          SELECT n.image_id, n.sd, n.done, coalesce((SELECT sqrt(avg(dv * dv)) FROM g WHERE g.image_id = n.image_id AND ({'true' if k == 0 else f'abs(dv) <= 3 * n.sd'})), 0e0) AS new FROM n{k} n))""")
    return ", ".join(out)


@query("b04_noise", f"WITH {_noise_sql()} SELECT image_id, round(sd, 6) + 0e0 AS noise FROM n7", ("pixels",))
def _(spark, d):
    px = V.view(spark, d, "pixels")
    bg = pixels.background_mode(pixels.histogram(px), px.groupBy("image_id").agg(F.count("*").alias("n_pixels")))
    return named(pixels.noise(px, bg), "image_id", noise=r("noise"))


@query("b05_star_levels", f"""WITH {_noise_sql()}, c AS (SELECT h.image_id, bin, sum(n) OVER (PARTITION BY h.image_id ORDER BY bin DESC) AS above FROM h JOIN bg USING (image_id) WHERE bin >= floor(background + 1) AND bin < 65001),
  l AS (SELECT image_id, max(CASE WHEN above >= 60 THEN bin END) AS r6, max(CASE WHEN above >= 240 THEN bin END) AS r24 FROM c GROUP BY 1)
  SELECT image_id, round(greatest(3.5e0 * sd, 1e0, coalesce(r6, 0) - background - 1), 6) + 0e0 AS star_level, round(greatest(3.5e0 * sd, 1e0, coalesce(r24, 0) - background - 1), 6) + 0e0 AS star_level2
  FROM bg JOIN n7 USING (image_id) LEFT JOIN l USING (image_id)""", ("pixels",))
def _(spark, d):
    return named(pixels.background(V.view(spark, d, "pixels"), 10), "image_id", star_level=r("star_level"), star_level2=r("star_level2"))


# Sky tilings

_RINGS = {name: "(VALUES " + ", ".join(f"({k}, {lo!r}e0, {hi!r}e0, {n}, {base})" for k, lo, hi, n, base in rings) + ") t(ring, lo, hi, n, base)" for name, rings in (("1476", tiles.rings_1476()), ("290", tiles.rings_290()))}


@query("a01_area_1476", f"""SELECT star_id, CAST(base + CASE WHEN n = 1 THEN 0 ELSE floor(ra * n / (2e0 * pi())) END AS BIGINT) AS area FROM sky_stars JOIN {_RINGS['1476']} ON (dec > lo OR ring = 0) AND (dec <= hi OR ring = 35)""", ("sky_stars",))
def _(spark, d):
    return V.view(spark, d, "sky_stars").select("star_id", tiles.area_1476(F.col("ra"), F.col("dec")).alias("area"))


@query("a05_area_290", f"""SELECT star_id, CAST(base + least(n - 1, floor((ra - 2e0 * pi() * floor(ra / (2e0 * pi()))) * n / (2e0 * pi()))) AS BIGINT) AS area FROM sky_stars JOIN {_RINGS['290']} ON dec >= lo AND (dec < hi OR ring = 17)""", ("sky_stars",))
def _(spark, d):
    return V.view(spark, d, "sky_stars").select("star_id", tiles.area_290(F.col("ra"), F.col("dec")).alias("area"))


@query("a02_areas_of_field_1476")
def _(spark, d):
    return named(tiles.areas_of_field_1476(V.view(spark, d, "fields")), "field_id", "area", share=r("share"))


@query("a03_areas_in_band", f"SELECT CAST(unnest(range(base, base + n)) AS BIGINT) AS area FROM {_RINGS['1476']} WHERE hi >= 0.1e0 AND lo <= 0.4e0")
def _(spark, d):
    return tiles.areas_in_band(spark, 0.1, 0.4, tiles.rings_1476())


@query("a04_file_name", f"""SELECT area, lpad(CAST(ring + 1 AS VARCHAR), 2, '0') || lpad(CAST(area - base + 1 AS VARCHAR), 2, '0') || '.1476' AS name
  FROM (SELECT CAST(p_partkey % 1476 + 1 AS BIGINT) AS area FROM part) JOIN {_RINGS['1476']} ON area >= base AND area < base + n""")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 1476 + 1).cast("long").alias("area"))
    return p.select("area", tiles.file_name(F.col("area"), tiles.rings_1476(), ".1476").alias("name"))


@query("a06_areas_of_field_290", f"""SELECT DISTINCT field_id, CAST(base + ((CASE WHEN every THEN 0 ELSE c_lo END + k) % n + n) % n AS BIGINT) AS area FROM (
  SELECT *, unnest(range(CAST(CASE WHEN every THEN n ELSE ((c_hi - c_lo) % n + n) % n + 1 END AS BIGINT))) AS k FROM (
  SELECT *, pole OR n = 1 OR cosd < 1e-6 OR half / greatest(cosd, 1e-300) >= pi() AS every,
    floor(((ra - half / cosd) - 2e0 * pi() * floor((ra - half / cosd) / (2e0 * pi()))) / (2e0 * pi() / n)) AS c_lo, floor(((ra + half / cosd) - 2e0 * pi() * floor((ra + half / cosd) / (2e0 * pi()))) / (2e0 * pi() / n)) AS c_hi FROM (
  SELECT *, cos(least(hi, greatest(lo, dec))) AS cosd FROM (SELECT *, fov / 2e0 AS half, dec + fov / 2e0 >= pi() / 2e0 - 1e-12 OR dec - fov / 2e0 <= 1e-12 - pi() / 2e0 AS pole FROM fields) f
  JOIN {_RINGS['290']} ON hi > greatest(-pi() / 2e0, dec - half) AND lo <= least(pi() / 2e0, dec + half))))""", ("fields",))
def _(spark, d):
    return tiles.areas_of_field_290(V.view(spark, d, "fields")).select("field_id", "area")


@query("a08_strip", "SELECT star_id, CAST(least(719, greatest(0, floor((dec + pi() / 2e0) / pi() * 720e0))) AS BIGINT) AS strip FROM sky_stars", ("sky_stars",))
def _(spark, d):
    return V.view(spark, d, "sky_stars").select("star_id", tiles.strip(F.col("dec")).alias("strip"))


@query("a10_nearest_within", """SELECT star_id, b AS other, round(d2, 6) + 0e0 AS d2 FROM (SELECT a.star_id, b.star_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
  row_number() OVER (PARTITION BY a.star_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.star_id) AS rn
  FROM detections a JOIN detections b ON a.star_id <> b.star_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400) WHERE rn = 1""", ("detections",))
def _(spark, d):
    s = V.view(spark, d, "detections")
    left, right = s.select("star_id", "x", "y"), s.select(F.col("star_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = joins.ball_join(left, right, [("x", "ox"), ("y", "oy")], 20.0).where(F.col("star_id") != F.col("other"))
    best = near.groupBy("star_id").agg(F.min(F.struct("d2", "other")).alias("m"))
    return best.select("star_id", F.col("m.other").alias("other"), r(F.col("m.d2")).alias("d2"))


# Catalogue scans

_WINDOW = f"abs(ra - {R0}) * cos({D0}) < 0.01e0 AND abs(dec - {D0}) < 0.01e0"


@query("k01_k03_brightest_in_window", f"SELECT star_id, mag FROM field_stars WHERE {_WINDOW} ORDER BY mag, star_id LIMIT 50", ("field_stars",))
def _(spark, d):
    return catalogue_scan.brightest(V.view(spark, d, "field_stars"), V.RA0, V.DEC0, 0.02, 50).select("star_id", "mag")


@query("k07_band_scan", "SELECT star_id, mag FROM sky_stars WHERE dec BETWEEN 0.1e0 AND 0.4e0 AND mag <= 12e0", ("sky_stars",))
def _(spark, d):
    return catalogue_scan.band(V.view(spark, d, "sky_stars"), 0.1, 0.4, 12.0).select("star_id", "mag")


@query("k08_tile_scan", f"""SELECT s.star_id, s.area FROM (SELECT star_id, CAST(base + least(n - 1, floor(ra * n / (2e0 * pi()))) AS BIGINT) AS area FROM sky_stars JOIN {_RINGS['290']} ON dec >= lo AND (dec < hi OR ring = 17)) s
  WHERE area BETWEEN 146 AND 177""", ("sky_stars",))
def _(spark, d):
    tiled = catalogue_scan.tiled(V.view(spark, d, "sky_stars"), "290")
    return tiled.where(F.col("area").between(146, 177)).select("star_id", "area")


@query("k12_header_magnitude", "SELECT star_id, (CAST(floor(mag * 10) AS BIGINT) % 200 - 16) / 10e0 AS mag FROM field_stars", ("field_stars",))
def _(spark, d):
    return V.view(spark, d, "field_stars").select("star_id", catalogue_scan.header_mag(F.floor(F.col("mag") * 10).cast("long") % 200).alias("mag"))


@query("k14_density", """SELECT name, CASE WHEN lower(name) = 'w08' THEN 1 WHEN nn IN (0, 17, 18) THEN NULL ELSE nn * 100 END AS density FROM (
  SELECT name, CAST(substr(name, 2, 2) AS BIGINT) AS nn FROM (SELECT DISTINCT substr('dgvW', CAST(p_partkey % 4 + 1 AS INT), 1) || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') AS name FROM part))""")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat(F.substring(F.lit("dgvW"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)), F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0")).alias("name")
    return p.select(name).distinct().select("name", catalogue_scan.density(F.col("name")).alias("density"))


# Headers and text


@query("m09_m11_header_numbers", """SELECT file_id, TRY_CAST(trim(split_part(substr(card_ra, 11), ' /', 1), ' ''') AS DOUBLE) AS ra, TRY_CAST(replace(trim(split_part(substr(card_focal, 11), ' /', 1)), 'D', 'E') AS DOUBLE) AS focal FROM headers""", ("headers",))
def _(spark, d):
    h = V.view(spark, d, "headers")
    cards = text.cards(F.concat_ws("\n", "card_ra", "card_focal", "card_pixel"))
    h = h.select("file_id", cards.alias("cards"))
    return h.select("file_id", text.number(F.col("cards"), "ra").alias("ra"), text.number(F.col("cards"), "FOCALLEN").alias("focal"))


@query("m02_pixel_scale", """SELECT file_id, round(3.76e0 / (400 + file_id % 1000) * 206.265e0, 9) + 0e0 AS scale FROM headers""", ("headers",))
def _(spark, d):
    h = V.view(spark, d, "headers").select("file_id", text.cards(F.concat_ws("\n", "card_ra", "card_focal", "card_pixel")).alias("c"))
    s = text.pixel_scale(text.number(F.col("c"), "FOCALLEN"), text.number(F.col("c"), "XPIXSZ"), text.number(F.col("c"), "XBINNING"))
    return named(h, "file_id", scale=r(s, 9))


@query("m01_pointing", """SELECT file_id, TRY_CAST(trim(split_part(substr(card_ra, 11), ' /', 1), ' ''') AS DOUBLE) IS NOT NULL AS given FROM headers""", ("headers",))
def _(spark, d):
    h = V.view(spark, d, "headers").select("file_id", text.cards(F.concat_ws("\n", "card_ra", "card_focal", F.lit("DEC     = 10"))).alias("c"))
    ra, _dec = text.pointing(F.col("c"))
    return h.select("file_id", ra.isNotNull().alias("given"))


@query("w05_float_card", """SELECT star_id, rpad('CRVAL1  = ' || lpad(replace(replace(printf('%.12E', round(degrees(ra), 8)), 'E+0', 'E+00'), 'E-0', 'E-00'), 20, ' '), 80, ' ') AS card FROM sky_stars""", ("sky_stars",))
def _(spark, d):
    return V.view(spark, d, "sky_stars").select("star_id", text.float_card("CRVAL1", F.round(F.degrees("ra"), 8)).alias("card"))


@query("w08_star_csv", """SELECT star_id, printf('%.4f', x + 1) || ',' || printf('%.4f', y + 1) || ',' || printf('%.4f', hfd) || ',' || CAST(CAST(round_even(snr, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round_even(snr * hfd, 0) AS BIGINT) AS VARCHAR) || ',' || printf('%.8f', star_id % 360 + 0.25e0) || ',' || printf('%.8f', 45.5e0 - star_id % 90) AS line FROM detections""", ("detections",))
def _(spark, d):
    return V.view(spark, d, "detections").select("star_id", text.star_line(F.col("x"), F.col("y"), F.col("hfd"), F.col("snr"), F.col("snr") * F.col("hfd"), F.radians(F.col("star_id") % 360 + 0.25), F.radians(45.5 - F.col("star_id") % 90)).alias("line"))


@query("w11_sexagesimal", """SELECT star_id, printf('%02d %02d %02d.%d', t // 36000, t // 600 % 60, t // 10 % 60, t % 10) AS ra FROM (SELECT star_id, CAST(floor(ra * 12e0 / pi() * 36000e0 + 0.5e0) AS BIGINT) % 864000 AS t FROM sky_stars)""", ("sky_stars",))
def _(spark, d):
    return V.view(spark, d, "sky_stars").select("star_id", text.ra_text(F.col("ra")).alias("ra"))


# Patterns and joins

_TOP = "SELECT * FROM std_stars"
_KNN = """SELECT a.field_id, a.star_id, b.star_id AS nb, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, row_number() OVER (PARTITION BY a.field_id, a.star_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.star_id) AS slot
  FROM top a JOIN top b ON a.field_id = b.field_id AND a.star_id <> b.star_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 1"""


def _top(spark, d) -> DataFrame:
    return V.view(spark, d, "std_stars")


def _top_detections(spark, d) -> DataFrame:
    return V.view(spark, d, "detections")


@query("n01_nearest_neighbours", f"WITH top AS ({_TOP}), k AS ({_KNN}) SELECT field_id, star_id, nb, CAST(slot AS BIGINT) AS slot FROM k WHERE slot <= 8", ("std_stars",))
def _(spark, d):
    return joins.nearest_neighbours(_top(spark, d), 8, "field_id").select("field_id", "star_id", "nb", F.col("slot").cast("long").alias("slot"))


_QUADS = f"""WITH top AS ({_TOP}), k AS (SELECT * FROM ({_KNN}) WHERE slot <= 8),
  m AS (SELECT field_id, star_id AS c, star_id AS id, ax AS x, ay AS y FROM k WHERE slot = 1 UNION ALL SELECT field_id, star_id, nb, bx, by_ FROM k),
  g AS (SELECT field_id, c FROM m GROUP BY 1, 2 HAVING count(*) = 9),
  q AS (SELECT DISTINCT a.field_id, a.id AS i, b.id AS j, e.id AS l, f.id AS o, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, e.x AS x3, e.y AS y3, f.x AS x4, f.y AS y4 FROM m a JOIN g ON g.field_id = a.field_id AND g.c = a.c
    JOIN m b ON b.field_id = a.field_id AND b.c = a.c AND b.id > a.id JOIN m e ON e.field_id = a.field_id AND e.c = a.c AND e.id > b.id JOIN m f ON f.field_id = a.field_id AND f.c = a.c AND f.id > e.id),
  s AS (SELECT field_id, i, j, l, o, list_reverse_sort([sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)), sqrt((x1-x3)*(x1-x3)+(y1-y3)*(y1-y3)), sqrt((x1-x4)*(x1-x4)+(y1-y4)*(y1-y4)), sqrt((x2-x3)*(x2-x3)+(y2-y3)*(y2-y3)), sqrt((x2-x4)*(x2-x4)+(y2-y4)*(y2-y4)), sqrt((x3-x4)*(x3-x4)+(y3-y4)*(y3-y4))]) AS e FROM q)"""


@query("n04_quads", _QUADS + " SELECT field_id, i, j, l, o, round(e[1], 4) + 0e0 AS d1, round(e[2] / e[1], 6) + 0e0 AS r0, round(e[6] / e[1], 6) + 0e0 AS r4 FROM s WHERE e[1] >= 1e-10", ("std_stars",))
def _(spark, d):
    q = patterns.quads(_top(spark, d))
    return q.select("field_id", *[F.get("ids", k).alias(n) for k, n in enumerate("ijlo")], r("d1", 4).alias("d1"), r("r0").alias("r0"), r("r4").alias("r4"))


_TRI = f"""WITH top AS ({_TOP}), k AS (SELECT * FROM ({_KNN}) WHERE slot <= 7),
  t AS (SELECT DISTINCT a.field_id, list_sort([a.star_id, a.nb, b.nb]) AS ids, list_reverse_sort([sqrt((a.ax-a.bx)*(a.ax-a.bx)+(a.ay-a.by_)*(a.ay-a.by_)), sqrt((a.ax-b.bx)*(a.ax-b.bx)+(a.ay-b.by_)*(a.ay-b.by_)), sqrt((a.bx-b.bx)*(a.bx-b.bx)+(a.by_-b.by_)*(a.by_-b.by_))]) AS e
  FROM k a JOIN k b ON a.field_id = b.field_id AND a.star_id = b.star_id AND a.slot < b.slot)"""


@query("n10_triangles", _TRI + " SELECT field_id, ids[1] AS i, ids[2] AS j, ids[3] AS l, round(max(e[1]), 4) + 0e0 AS d1, round(max(e[2] / e[1]), 6) + 0e0 AS r0 FROM t GROUP BY ALL", ("std_stars",))
def _(spark, d):
    q = patterns.triangles(_top(spark, d))
    return q.select("field_id", *[F.get("ids", k).alias(n) for k, n in enumerate("ijl")], r("d1", 4).alias("d1"), r("r0").alias("r0"))


@query("n10_triangles_by_count", """WITH t AS (SELECT a.field_id, a.star_id AS i, b.star_id AS j, c.star_id AS l, list_reverse_sort([sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)), sqrt((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y))]) AS e
  FROM detections a JOIN detections b ON a.field_id = b.field_id AND a.star_id < b.star_id JOIN detections c ON c.field_id = a.field_id AND b.star_id < c.star_id)
  SELECT field_id, i, j, l, round(e[1], 4) + 0e0 AS d1, round(e[2] / e[1], 6) + 0e0 AS r0 FROM t WHERE e[1] >= 1e-10""", ("detections",))
def _(spark, d):
    """Fields of forty detections: all their triangles."""
    q = patterns.triangles(_top_detections(spark, d))
    return q.select("field_id", *[F.get("ids", k).alias(n) for k, n in enumerate("ijl")], r("d1", 4).alias("d1"), r("r0").alias("r0"))


_D = "sqrt((m[{i}].x-m[{j}].x)*(m[{i}].x-m[{j}].x)+(m[{i}].y-m[{j}].y)*(m[{i}].y-m[{j}].y))"
_SEEDS = f"""WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY mag, star_id) AS bright FROM std_stars) WHERE bright <= 150), k AS (SELECT * FROM ({_KNN}) WHERE slot <= 4),
  g AS (SELECT field_id, star_id, ax, ay, list(struct_pack(id := nb, x := bx, y := by_) ORDER BY slot) AS near FROM k GROUP BY ALL HAVING count(*) = 4),
  s AS (SELECT DISTINCT field_id, list_sort(list_append(list_filter(near, lambda e, i: i <> gone), struct_pack(id := star_id, x := ax, y := ay))) AS m FROM g, (SELECT unnest([1, 2, 3, 4]) AS gone)),
  e AS (SELECT field_id, array_to_string(list_transform(m, lambda p: p.id), '-') AS ids, greatest({", ".join(_D.format(i=i, j=j) for i in range(1, 5) for j in range(i + 1, 5))}) AS d FROM s)
  SELECT field_id, ids, round(d, 4) + 0e0 AS d1 FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY d DESC, ids) AS place FROM e WHERE d >= 1e-10) WHERE place <= 600"""


@query("n15_seed_quads", _SEEDS, ("std_stars",))
def _(spark, d):
    q = patterns.seeds(_top(spark, d))
    return q.select("field_id", F.concat_ws("-", F.transform("ids", lambda i: i.cast("string"))).alias("ids"), r("d1", 4).alias("d1"))


@query("n16_image_pairs", """WITH top AS (SELECT * FROM detections)
  SELECT a.field_id, a.star_id AS a, b.star_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 5) + 0e0 AS length FROM top a JOIN top b ON a.field_id = b.field_id AND a.star_id < b.star_id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) BETWEEN 8 AND 600""", ("detections",))
def _(spark, d):
    return named(patterns.pairs(_top_detections(spark, d), 600.0), "field_id", "a", "b", length=r("length", 5))


@query("n17_anchors", """WITH p AS (SELECT a.star_id, b.star_id AS o, (b.mag < a.mag OR (b.mag = a.mag AND b.star_id < a.star_id)) AS brighter FROM sky_stars a JOIN sky_stars b ON a.star_id <> b.star_id
  AND acos(least(1e0, greatest(-1e0, sin(a.dec) * sin(b.dec) + cos(a.dec) * cos(b.dec) * cos(a.ra - b.ra)))) <= 0.12e0)
  SELECT star_id, least(4, count(*)) AS others FROM p GROUP BY star_id HAVING count(*) >= 3 AND NOT bool_or(brighter)""", ("sky_stars",))
def _(spark, d):
    return patterns.anchors(V.view(spark, d, "sky_stars"), 0.12, 5).select("star_id", F.size("others").cast("long").alias("others"))


@query("i01_index_patterns")
def _(spark, d):
    found = patterns.anchors(V.view(spark, d, "sky_stars"), 0.12, 5)
    p = patterns.anchor_patterns(found, 5)
    return p.select("anchor", "key", F.concat_ws("-", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))


def _matches(spark, d, tolerance: float = 0.007) -> DataFrame:
    img = _top_detections(spark, d)
    return solve.matched_quads(patterns.quads(img), patterns.quads(_top(spark, d), image=img), tolerance)


_IMG = _QUADS.replace("FROM std_stars", "FROM detections").replace("WITH top AS", "WITH itop AS").replace("FROM top a JOIN top b", "FROM itop a JOIN itop b")
for _old, _new in ((", k AS", ", ik AS"), ("FROM k WHERE", "FROM ik WHERE"), ("FROM k)", "FROM ik)"), ("  m AS (", "  im AS ("), ("FROM m ", "FROM im "), ("JOIN m ", "JOIN im "), ("  g AS (", "  ig AS ("), ("JOIN g ON g.field_id = a.field_id AND g.c", "JOIN ig ON ig.field_id = a.field_id AND ig.c"), ("  q AS (", "  iq AS ("), ("FROM q)", "FROM iq)"), ("  s AS (", "  isq AS (")):
    _IMG = _IMG.replace(_old, _new)
_MATCH = _QUADS + ", " + _IMG[5:] + """, mm AS (SELECT isq.field_id, isq.i AS i1, isq.j AS j1, isq.l AS l1, isq.o AS o1, s.i AS i2, s.j AS j2, s.l AS l2, s.o AS o2, s.e[1] / isq.e[1] AS ratio, (SELECT sum(abs(isq.e[t] / isq.e[1] - s.e[t] / s.e[1])) FROM (SELECT unnest([2,3,4,5,6]) AS t)) AS cost FROM isq JOIN s ON isq.field_id = s.field_id
  AND abs(isq.e[2] / isq.e[1] - s.e[2] / s.e[1]) <= 0.007e0 AND abs(isq.e[3] / isq.e[1] - s.e[3] / s.e[1]) <= 0.007e0 AND abs(isq.e[4] / isq.e[1] - s.e[4] / s.e[1]) <= 0.007e0 AND abs(isq.e[5] / isq.e[1] - s.e[5] / s.e[1]) <= 0.007e0 AND abs(isq.e[6] / isq.e[1] - s.e[6] / s.e[1]) <= 0.007e0)"""


def _flat(m: DataFrame) -> DataFrame:
    return m.select("field_id", *[F.get("img_ids", k).alias(f"{n}1") for k, n in enumerate("ijlo")], *[F.get("cat_ids", k).alias(f"{n}2") for k, n in enumerate("ijlo")], "scale_ratio", "cost", "img_ids", "cat_ids")


@query("j03_quad_band_join", _MATCH + " SELECT field_id, i1, j1, l1, o1, i2, j2, l2, o2, round(ratio, 6) + 0e0 AS ratio FROM mm", ("std_stars", "detections"))
def _(spark, d):
    m = _flat(_matches(spark, d))
    return m.select("field_id", *[f"{n}{k}" for k in "12" for n in "ijlo"], r("scale_ratio").alias("ratio"))


@query("v01_scale_filter", _MATCH + " SELECT field_id, i1, j1, l1, o1, i2, j2, l2, o2 FROM mm JOIN (SELECT field_id, median(ratio) AS med FROM mm GROUP BY 1) USING (field_id) WHERE abs(ratio - med) <= 0.007e0 * med", ("std_stars", "detections"))
def _(spark, d):
    m = votes.near_median(_matches(spark, d), 0.007, "field_id")
    return _flat(m).select("field_id", *[f"{n}{k}" for k in "12" for n in "ijlo"])


@query("j07_mutual_best", _MATCH + """, b1 AS (SELECT *, row_number() OVER (PARTITION BY field_id, i1, j1, l1, o1 ORDER BY round(cost, 12), i2, j2, l2, o2) AS k FROM mm),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY field_id, i2, j2, l2, o2 ORDER BY round(cost, 12), i1, j1, l1, o1) AS k2 FROM b1 WHERE k = 1) SELECT field_id, i1, j1, l1, o1, i2, j2, l2, o2 FROM b2 WHERE k2 = 1""", ("std_stars", "detections"))
def _(spark, d):
    m = _matches(spark, d).withColumn("cost", F.round("cost", 12)).withColumn("a", F.struct("field_id", "img_ids")).withColumn("b", F.struct("field_id", "cat_ids"))
    return _flat(joins.mutual_best(m, "a", "b", "cost")).select("field_id", *[f"{n}{k}" for k in "12" for n in "ijlo"])


@query("j05_code_ball_join", """SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label AND (CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) * (CAST(a.embedding[1] AS DOUBLE) - b.embedding[1]) + (CAST(a.embedding[2] AS DOUBLE) - b.embedding[2]) * (CAST(a.embedding[2] AS DOUBLE) - b.embedding[2]) + (CAST(a.embedding[3] AS DOUBLE) - b.embedding[3]) * (CAST(a.embedding[3] AS DOUBLE) - b.embedding[3]) + (CAST(a.embedding[4] AS DOUBLE) - b.embedding[4]) * (CAST(a.embedding[4] AS DOUBLE) - b.embedding[4]) <= 0.01e0""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    code = lambda p: e.select(F.col("vec_id").alias(p), F.col("label").alias(f"{p}_label"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"{p}{k}") for k in range(4)])
    near = joins.ball_join(code("a"), code("b"), [(f"a{k}", f"b{k}") for k in range(4)], 0.1)
    return near.where((F.col("a") < F.col("b")) & (F.col("a_label") == F.col("b_label"))).select("a", "b")


@query("j06_mutual_nearest", """WITH p AS (SELECT d.field_id, d.star_id AS a, c.star_id AS b, (d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y) AS d2 FROM detections d JOIN (SELECT field_id, star_id, 1500e0 + (x * cos(0.35e0) - y * sin(0.35e0)) / 3e0 AS x, 1500e0 - (x * sin(0.35e0) + y * cos(0.35e0)) / 3e0 AS y FROM std_stars) c
  ON c.field_id = d.field_id AND (d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y) <= 36),
  l AS (SELECT *, row_number() OVER (PARTITION BY field_id, a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY field_id, b ORDER BY d2, a) AS rb FROM p) SELECT field_id, a, b FROM l WHERE ra = 1 AND rb = 1""", ("std_stars", "detections"))
def _(spark, d):
    c, s = math.cos(V.TURN), math.sin(V.TURN)
    std = V.view(spark, d, "std_stars").select("field_id", "star_id", (1500 + (F.col("x") * c - F.col("y") * s) / V.SCALE).alias("x"), (1500 - (F.col("x") * s + F.col("y") * c) / V.SCALE).alias("y"))
    return solve.mutual_nearest(V.view(spark, d, "detections"), std, 6.0).select("field_id", "a", "b")


@query("j08_key_lookup")
def _(spark, d):
    index = patterns.anchor_patterns(patterns.anchors(V.view(spark, d, "sky_stars"), 0.12, 5), 5)
    probes = index.select(F.col("anchor").alias("probe"), P.probes(F.col("descriptor")).alias("keys"))
    found = solve.lookup(probes, index.select("key", "anchor"))
    return found.select("probe", "anchor").distinct()


@query("j10_stars_near", f"""SELECT field_id, star_id FROM fields f JOIN sky_stars s ON acos(least(1e0, greatest(-1e0, sin(f.dec) * sin(s.dec) + cos(f.dec) * cos(s.dec) * cos(f.ra - s.ra)))) <= f.fov""", ("fields", "sky_stars"))
def _(spark, d):
    return catalogue_scan.stars_near(V.view(spark, d, "fields"), V.view(spark, d, "sky_stars"), "fov").select("field_id", "star_id")


# Votes

_KEY = """SELECT hyp_id, ra, dec, scale, band, CAST(floor((ra - 2e0 * pi() * floor(ra / (2e0 * pi()))) / (2e0 * pi()) * nra) % nra AS BIGINT) AS ra_bin, CAST(floor(ln(greatest(scale, 1e-12)) / 0.2e0) AS BIGINT) AS s_bin FROM (
  SELECT *, greatest(1, floor(2e0 * pi() / (0.1e0 / greatest(cos((band + 0.5e0) * 0.1e0 - pi() / 2e0), 1e-6)))) AS nra FROM (SELECT *, CAST(least(31, greatest(0, floor((dec + pi() / 2e0) / 0.1e0))) AS BIGINT) AS band FROM hypotheses))"""


@query("v04_sky_votes", f"SELECT band, ra_bin, s_bin, count(*) AS votes FROM ({_KEY}) GROUP BY 1, 2, 3", ("hypotheses",))
def _(spark, d):
    return votes.sky_votes(V.view(spark, d, "hypotheses"), 0.1, 0.2)


_NRA = "greatest(1, floor(2e0 * pi() / (0.1e0 / greatest(cos(({b} + 0.5e0) * 0.1e0 - pi() / 2e0), 1e-6))))"
_SMOOTH = f"""WITH v AS (SELECT band, ra_bin, s_bin, count(*) AS votes FROM ({_KEY}) GROUP BY ALL),
  c AS (SELECT band, ra_bin, s_bin, ds, (band + 0.5e0) * 0.1e0 - pi() / 2e0 + dd * 0.1e0 AS d2, (ra_bin + 0.5e0) * 2e0 * pi() / {_NRA.format(b="band")} AS ra, dr FROM v, (SELECT unnest([-1, 0, 1]) AS dd), (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS ds)),
  b AS (SELECT band, ra_bin, s_bin, s_bin + ds AS ns, CAST(least(31, greatest(0, floor((d2 + pi() / 2e0) / 0.1e0))) AS BIGINT) AS nb, ra + dr * 0.1e0 / greatest(cos(d2), 1e-6) AS r2 FROM c WHERE abs(d2) <= pi() / 2e0),
  n AS (SELECT DISTINCT band, ra_bin, s_bin, ns, nb, CAST(floor((r2 - 2e0 * pi() * floor(r2 / (2e0 * pi()))) / (2e0 * pi()) * nn) % nn AS BIGINT) AS nr FROM (SELECT *, {_NRA.format(b="nb")} AS nn FROM b))
  SELECT n.band, n.ra_bin, n.s_bin, CAST(sum(o.votes) AS BIGINT) AS smoothed FROM n JOIN v o ON o.band = n.nb AND o.ra_bin = n.nr AND o.s_bin = n.ns GROUP BY ALL"""


@query("v05_smoothed_votes", _SMOOTH, ("hypotheses",))
def _(spark, d):
    return votes.smoothed(votes.sky_votes(V.view(spark, d, "hypotheses"), 0.1, 0.2), 0.1)


@query("v06_ranked_regions")
def _(spark, d):
    return votes.regions(votes.sky_votes(V.view(spark, d, "hypotheses"), 0.1, 0.2), 0.1, 50)


@query("v07_medoid", f"""WITH k AS ({_KEY}), m AS (SELECT band, hyp_id, cos(dec) * cos(ra) AS x, cos(dec) * sin(ra) AS y, sin(dec) AS z, row_number() OVER (PARTITION BY band ORDER BY hyp_id) AS rn, count(*) OVER (PARTITION BY band) AS n FROM k),
  s AS (SELECT a.band, a.hyp_id, a.rn, a.n, round(sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 9) AS t FROM m a JOIN m b ON a.band = b.band AND b.rn <= 64 WHERE a.rn <= 64 GROUP BY 1, 2, 3, 4)
  SELECT band, hyp_id FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY CASE WHEN n <= 2 THEN rn ELSE t END, rn) AS k FROM s) WHERE k = 1""", ("hypotheses",))
def _(spark, d):
    h = V.view(spark, d, "hypotheses")
    band, _r, _s = votes.sky_key(F.col("ra"), F.col("dec"), F.col("scale"), 0.1, 0.2)
    return votes.medoid(h.withColumn("band", band), "band", "hyp_id")


_ANGLE = """, turns AS (SELECT isq.field_id, i, j, l, o, CASE e[1] WHEN sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) THEN atan2(y2-y1, x2-x1) WHEN sqrt((x1-x3)*(x1-x3)+(y1-y3)*(y1-y3)) THEN atan2(y3-y1, x3-x1) WHEN sqrt((x1-x4)*(x1-x4)+(y1-y4)*(y1-y4)) THEN atan2(y4-y1, x4-x1)
  WHEN sqrt((x2-x3)*(x2-x3)+(y2-y3)*(y2-y3)) THEN atan2(y3-y2, x3-x2) WHEN sqrt((x2-x4)*(x2-x4)+(y2-y4)*(y2-y4)) THEN atan2(y4-y2, x4-x2) ELSE atan2(y4-y3, x4-x3) END AS t FROM isq JOIN iq USING (field_id, i, j, l, o))"""
_VOTE = _MATCH + _ANGLE + _ANGLE.replace("turns AS", "cturns AS").replace("isq", "s").replace("JOIN iq", "JOIN q") + """,
  w AS (SELECT mm.field_id, ratio, floor(ratio / 0.05e0 + 0.5e0) AS sk, a.t AS ti, b.t AS tc FROM mm JOIN turns a ON a.field_id = mm.field_id AND a.i = i1 AND a.j = j1 AND a.l = l1 AND a.o = o1 JOIN cturns b ON b.field_id = mm.field_id AND b.i = i2 AND b.j = j2 AND b.l = l2 AND b.o = o2),
  v AS (SELECT field_id, ratio, sk, kind, floor((CASE WHEN kind = 0 THEN ti - tc ELSE ti + tc END - pi() * floor((CASE WHEN kind = 0 THEN ti - tc ELSE ti + tc END) / pi())) / (pi() / 18e0) + 0.5e0) % 18 AS ak FROM w CROSS JOIN (SELECT unnest([0, 1]) AS kind)),
  p AS (SELECT field_id, kind, sk, ak, row_number() OVER (PARTITION BY field_id ORDER BY count(*) DESC, kind DESC, sk DESC, ak DESC) AS k FROM v GROUP BY 1, 2, 3, 4),
  z AS (SELECT v.*, median(ratio) OVER (PARTITION BY v.field_id) AS med FROM v JOIN p USING (field_id, kind, sk, ak) WHERE k = 1)
  SELECT field_id, kind, CAST(sk AS BIGINT) AS sk, CAST(ak AS BIGINT) AS ak, count(*) AS kept, round(median(ratio), 3) + 0e0 AS scale FROM z WHERE abs(ratio - med) <= 0.007e0 * med GROUP BY 1, 2, 3, 4"""


@query("v03_vote_filter", _VOTE, ("std_stars", "detections"))
def _(spark, d):
    m = votes.voted(_matches(spark, d), 0.007, "field_id")
    return m.groupBy("field_id", "kind", F.col("sk").cast("long").alias("sk"), F.col("ak").cast("long").alias("ak")).agg(F.count("*").alias("kept"), r(F.median("scale_ratio"), 3).alias("scale"))


@query("v16_covered_cells", """SELECT field_id, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM (SELECT field_id, least(2, greatest(0, floor(x / 3000e0 * 3))) AS a, least(2, greatest(0, floor(y / 3000e0 * 3))) AS b, count(*) AS n FROM detections GROUP BY 1, 2, 3) GROUP BY 1""", ("detections",))
def _(spark, d):
    return votes.covered_cells(V.view(spark, d, "detections"), "field_id", V.WIDTH, V.HEIGHT, 3, "x", "y")


@query("v17_density_limit", """SELECT field_id, CAST(least(500, floor(2000e0 * degrees(fov) * degrees(fov) * 0.75e0 + 0.5e0)) AS BIGINT) AS stars FROM fields""", ("fields",))
def _(spark, d):
    return V.view(spark, d, "fields").select("field_id", votes.density_limit(F.lit(500), F.lit(2000.0), F.degrees("fov"), F.lit(4.0), F.lit(3.0)).alias("stars"))


@query("g25_spread", """SELECT field_id, round(sqrt(var_pop(x) + var_pop(y)) / (0.5e0 * sqrt(18000000e0)), 8) + 0e0 AS spread FROM detections GROUP BY 1""", ("detections",))
def _(spark, d):
    return named(votes.spread(V.view(spark, d, "detections"), "field_id", V.WIDTH, V.HEIGHT, "x", "y"), "field_id", spread=r("spread", 8))


# Fits

_PAIRS = "SELECT d.field_id, d.x AS ix, d.y AS iy, s.x AS cx, s.y AS cy FROM detections d JOIN std_stars s USING (star_id)"
_AFF = f"""WITH p AS ({_PAIRS}), m AS (SELECT field_id, count(*) AS n, avg(ix) AS mx, avg(iy) AS my, avg(cx) AS nx, avg(cy) AS ny FROM p GROUP BY 1),
  s AS (SELECT p.field_id, n, mx, my, nx, ny, sum((ix-mx)*(ix-mx)) AS sxx, sum((ix-mx)*(iy-my)) AS sxy, sum((iy-my)*(iy-my)) AS syy, sum((cx-nx)*(ix-mx)) AS ux, sum((cx-nx)*(iy-my)) AS uy, sum((cy-ny)*(ix-mx)) AS vx, sum((cy-ny)*(iy-my)) AS vy FROM p JOIN m USING (field_id) GROUP BY ALL),
  f AS (SELECT *, (ux*syy-uy*sxy)/(sxx*syy-sxy*sxy) AS a, (uy*sxx-ux*sxy)/(sxx*syy-sxy*sxy) AS b, (vx*syy-vy*sxy)/(sxx*syy-sxy*sxy) AS d, (vy*sxx-vx*sxy)/(sxx*syy-sxy*sxy) AS e FROM s)"""


def _true_pairs(spark, d) -> DataFrame:
    std = V.view(spark, d, "std_stars").select("star_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return V.view(spark, d, "detections").select("field_id", "star_id", F.col("x").alias("ix"), F.col("y").alias("iy")).join(std, "star_id").drop("star_id")


@query("f03_affine", _AFF + " SELECT field_id, n, round(a, 6) + 0e0 AS a, round(b, 6) + 0e0 AS b, round(nx - a*mx - b*my, 3) + 0e0 AS c, round(d, 6) + 0e0 AS d, round(e, 6) + 0e0 AS e, round(ny - d*mx - e*my, 3) + 0e0 AS f FROM f", ("std_stars", "detections"))
def _(spark, d):
    p = fit.affine(_true_pairs(spark, d), "field_id")
    return p.select("field_id", "n", *[r(k, 3 if k in "cf" else 6).alias(k) for k in "abcdef"])


@query("f05_refit_rms", _AFF + " SELECT p.field_id, round(sqrt(avg((a*(ix-mx)+b*(iy-my)+nx-cx)*(a*(ix-mx)+b*(iy-my)+nx-cx)+(d*(ix-mx)+e*(iy-my)+ny-cy)*(d*(ix-mx)+e*(iy-my)+ny-cy))), 6) + 0e0 AS rms FROM p JOIN f USING (field_id) GROUP BY 1", ("std_stars", "detections"))
def _(spark, d):
    return named(fit.refit(_true_pairs(spark, d), "field_id"), "field_id", rms=r("rms"))


@query("f04_plate_constants", _AFF + " SELECT field_id, floor((q + r) / abs(q - r) * 1e4 + 0.5e0) AS k FROM (SELECT field_id, sqrt((a+e)*(a+e)+(d-b)*(d-b))/2e0 AS q, sqrt((a-e)*(a-e)+(d+b)*(d+b))/2e0 AS r FROM f) WHERE (q + r) / abs(q - r) <= 1.08e0", ("std_stars", "detections"))
def _(spark, d):
    p = fit.affine(_true_pairs(spark, d), "field_id").withColumn("t", sphere.anisotropy("a", "b", "d", "e")).where("t <= 1.08")
    return p.select("field_id", F.floor(F.col("t") * 1e4 + 0.5).cast("double").alias("k"))


@query("f06_f07_robust_polynomial")
def _(spark, d):
    p = fit.poly_plates(_true_pairs(spark, d), "field_id", 10)
    return p.select("field_id", "used", r("rms", 4).alias("rms"), r(F.get("cu", 1), 4).alias("cu1"))


@query("f10_sip")
def _(spark, d):
    return solve_sip(_true_pairs(spark, d).withColumn("cx", F.col("cx") + 2e-8 * (F.col("ix") - 1500) ** 3)).withColumn("largest", r("largest", 12))


def solve_sip(pairs: DataFrame) -> DataFrame:
    from skyloom.operators import distortion

    return distortion.sip(pairs, "field_id", V.WIDTH, V.HEIGHT)


@query("x01_verified_pairs", "SELECT field_id, count(*) AS n, count(*) AS right FROM detections GROUP BY 1", ("detections",))
def _(spark, d):
    std = V.view(spark, d, "std_stars")
    plate = fit.affine(_true_pairs(spark, d), "field_id")
    got = solve.verified(plate, V.view(spark, d, "detections"), std)
    return got.groupBy("field_id").agg(F.count("*").alias("n"), F.sum((F.col("det_id") == F.col("cat_id")).cast("long")).alias("right"))


@query("x03_distortion")
def _(spark, d):
    from skyloom.operators import distortion

    bent = _true_pairs(spark, d).withColumn("cx", F.col("cx") + 1e-9 * (F.col("ix") - 1500) ** 3)
    return distortion.chosen(bent, "field_id", V.WIDTH, V.HEIGHT)


# Search and planning


@query("c01_solve_fields", f"""SELECT field_id, round(1.5e0 - x / cos(0.3e0) * pi() / 648000e0, 5) + 0e0 AS ra0, round(0.3e0 + y * pi() / 648000e0, 5) + 0e0 AS dec0, 3e0 AS scale, round(degrees({V.TURN}e0) - 180, 2) AS crota2, n AS stars_matched, n >= 30 AS accepted
  FROM (SELECT field_id, count(*) AS n, -1.5e0 * cos({V.TURN}e0) + 1.5e0 * sin({V.TURN}e0) AS x, 1.5e0 * sin({V.TURN}e0) + 1.5e0 * cos({V.TURN}e0) AS y FROM detections GROUP BY 1)""", ("detections",))
def _(spark, d):
    s = solve.solve_fields(V.view(spark, d, "detections"), V.view(spark, d, "field_stars"), V.RA0, V.DEC0, V.WIDTH, V.HEIGHT)
    return s.select("field_id", r("ra0", 5).alias("ra0"), r("dec0", 5).alias("dec0"), r(F.col("cdelt2") * 3600, 2).alias("scale"), r("crota2", 2).alias("crota2"), "stars_matched", "accepted")


@query("c06_first_success", "SELECT hyp_id, ra FROM hypotheses WHERE scale > 2.5e0 ORDER BY hyp_id LIMIT 1", ("hypotheses",))
def _(spark, d):
    h = V.view(spark, d, "hypotheses").withColumn("ok", F.col("scale") > 2.5)
    return solve.first_success(h, "hyp_id").select("hyp_id", "ra")


@query("c11_scale_ladder", "SELECT round(1.7e0 * pow(sqrt(2e0), k), 9) + 0e0 AS scale, CAST(row_number() OVER (ORDER BY abs(k), k < 0) AS BIGINT) AS place FROM (SELECT unnest(range(-4, 13)) AS k)")
def _(spark, d):
    rows = [(float(s), k + 1) for k, s in enumerate(solve.ladder(1.7))]
    return named(spark.createDataFrame(rows, "scale double, place long"), "place", scale=r("scale", 9))


@query("l03_select_database", """SELECT field_id, name FROM (SELECT field_id, name, row_number() OVER (PARTITION BY field_id ORDER BY deg BETWEEN lo AND hi DESC, CASE WHEN deg BETWEEN lo AND hi THEN -pref WHEN deg < lo THEN lo - deg ELSE deg - hi END, place) AS k
  FROM (SELECT field_id, degrees(fov) AS deg FROM fields), (VALUES ('d80', 0.15e0, 6e0, 8, 1), ('v50', 0.2e0, 6e0, 6, 2), ('d50', 0.2e0, 6e0, 5, 3), ('d20', 0.3e0, 6e0, 4, 4), ('v05', 0.6e0, 6e0, 3, 5), ('d05', 0.6e0, 6e0, 2, 6), ('g05', 3e0, 20e0, 7, 7), ('w08', 20e0, 80e0, 7, 8)) t(name, lo, hi, pref, place)) WHERE k = 1""", ("fields",))
def _(spark, d):
    f = V.view(spark, d, "fields").withColumn("deg", F.degrees("fov"))
    return planning.select_database(spark, f, "deg").select("field_id", "name")


@query("i06_i07_tiers_for_fields", "SELECT field_id, tier, fits FROM (SELECT field_id, k AS tier, degrees(fov) BETWEEN 2.5e0 * r AND 12e0 * r AS fits FROM fields CROSS JOIN (SELECT unnest(range(9)) AS k, unnest([0.05e0 * pow(2e0, t) FOR t IN range(9)]) AS r)) WHERE fits", ("fields",))
def _(spark, d):
    return planning.tiers_for(spark, V.view(spark, d, "fields").withColumn("deg", F.degrees("fov")), "deg", [0.05 * 2**k for k in range(9)]).select("field_id", "tier", "fits")


@query("l13_human_bytes", "SELECT star_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1000000 THEN printf('%.1f kB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) WHEN n < 1000000000000 THEN printf('%.1f GB', n / 1e9) ELSE printf('%.1f TB', n / 1e12) END AS size FROM (SELECT star_id, star_id * star_id * star_id * 1000 AS n FROM sky_stars)", ("sky_stars",))
def _(spark, d):
    s = V.view(spark, d, "sky_stars").withColumn("n", F.col("star_id") * F.col("star_id") * F.col("star_id") * 1000)
    return s.select("star_id", text.human_bytes(F.col("n")).alias("size"))


# Blind search


@query("g22_frame_code", """SELECT id, round(v, 6) + 0e0 AS cx, round(u, 6) + 0e0 AS cy FROM (SELECT id, px * c + py * s AS u, py * c - px * s AS v FROM (SELECT id, px, py, (aby + abx) / (abx * abx + aby * aby) AS c, (aby - abx) / (abx * abx + aby * aby) AS s FROM (
  SELECT id, p[2].x - p[1].x AS abx, p[2].y - p[1].y AS aby, p[3].x - p[1].x AS px, p[3].y - p[1].y AS py FROM (""" + _QUAD + "))))", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    u, v = blind.code(xs[0], ys[0], xs[1], ys[1], xs[2], ys[2], False)
    return named(rows, "id", cx=r(u), cy=r(v))


@query("n12_image_patterns")
def _(spark, d):
    q = blind.image_patterns(_top_detections(spark, d), V.WIDTH, V.HEIGHT)
    return q.select("field_id", F.concat_ws("-", F.array_sort(F.transform("q", lambda p: p["id"])).cast("array<string>")).alias("ids"))


# Detection: order-dependent kernels, one image a group


@query("t01_t13_analyse_images")
def _(spark, d):
    from skyloom.operators import detect

    stars = detect.analysed(detect.rendered(V.view(spark, d, "field_stars"), 320, 320, 50))
    return stars.groupBy("image_id").agg(F.count("*").alias("stars"), r(F.median("hfd"), 4).alias("hfd_median"))


def solve_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several images of one patch of sky, solved side by side."""
    return solve.solve_fields(V.view(spark, sf_dir, "detections"), V.view(spark, sf_dir, "field_stars"), V.RA0, V.DEC0, V.WIDTH, V.HEIGHT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from skyloom.plans import more  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from skyloom.plans import more  # noqa: F401

    return dict(_ORACLE)
