"""Further named queries: records, choices, files and codes, with the SQL that says the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import sphere, text
from skyloom.operators import blind, catalogue_scan, fit, joins, patterns, pixels, planning, solve, tiles, votes
from skyloom.plans import views as V
from skyloom.plans.catalogue import _AFF, _KNN, _QUAD, _RINGS, _four, _top, _top_detections, _true_pairs, D0, R0, named, query, r
from skyloom.sources import packed

TURN = f"{V.TURN}e0"


@query("t08_integer_distance", "SELECT o_orderkey AS n, CAST(s + CASE WHEN o_orderkey > s * s + s THEN 1 ELSE 0 END AS BIGINT) AS d FROM (SELECT o_orderkey, CAST(floor(sqrt(o_orderkey)) AS BIGINT) AS s FROM orders)")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), sphere.round_root("o_orderkey").alias("d"))


@query("t09_t14_median_size", "SELECT f.field_id, round(coalesce(m, 0e0), 6) + 0e0 AS hfd_median FROM (SELECT DISTINCT field_id FROM field_stars) f LEFT JOIN (SELECT field_id, median(hfd) AS m FROM detections WHERE hfd > 2.5e0 GROUP BY 1) d USING (field_id)", ("field_stars", "detections"))
def _(spark, d):
    large = V.view(spark, d, "detections").where("hfd > 2.5").groupBy("field_id").agg(F.median("hfd").alias("m"))
    return named(V.view(spark, d, "field_stars").select("field_id").distinct().join(large, "field_id", "left"), "field_id", hfd_median=r(F.coalesce("m", F.lit(0.0))))


@query("w12_report", "SELECT field_id, 'HFD_MEDIAN=' || CASE WHEN n > 0 THEN printf('%.2f', m) ELSE '21.47' END || chr(10) || 'STARS=' || CAST(n AS VARCHAR) AS report FROM (SELECT field_id, median(hfd) AS m, count(hfd) AS n FROM field_stars LEFT JOIN (SELECT star_id, hfd FROM detections WHERE field_id % 3 <> 0) USING (star_id) GROUP BY 1)", ("field_stars", "detections"))
def _(spark, d):
    seen = V.view(spark, d, "detections").where("field_id % 3 <> 0").select("star_id", "hfd")
    g = V.view(spark, d, "field_stars").join(seen, "star_id", "left").groupBy("field_id").agg(F.median("hfd").alias("m"), F.count("hfd").alias("n"))
    return named(g, "field_id", report=text.report(F.col("m"), F.col("n")))


@query("t17_exit_code", "SELECT star_id, CAST(((CAST(round_even(hfd * 100, 0) AS BIGINT) * 1000000 + star_id + 2147483648) % 4294967296) - 2147483648 AS INT) AS code FROM detections", ("detections",))
def _(spark, d):
    return named(V.view(spark, d, "detections"), "star_id", code=text.exit_code(F.col("hfd"), F.col("star_id")))


@query("t18_least_snr", "SELECT star_id, CASE WHEN star_id % 7 = 0 THEN 30e0 ELSE CAST(star_id % 7 AS DOUBLE) END AS least FROM detections", ("detections",))
def _(spark, d):
    return named(V.view(spark, d, "detections"), "star_id", least=text.least_snr(F.col("star_id") % 7))


@query("w09_csv_path", r"SELECT file_id, regexp_replace(p, '\.[^./]*$', '') || '.csv' AS path FROM (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN '/a.b/img' WHEN file_id % 3 = 1 THEN '/a.b/img.tar.fits' ELSE 'x.y/z.' END || CASE WHEN file_id % 2 = 0 THEN '' ELSE 'q' END AS p FROM headers)", ("headers",))
def _(spark, d):
    k = F.col("file_id")
    p = F.concat(F.when(k % 3 == 0, "/a.b/img").when(k % 3 == 1, "/a.b/img.tar.fits").otherwise("x.y/z."), F.when(k % 2 == 0, "").otherwise("q"))
    return named(V.view(spark, d, "headers"), "file_id", path=text.csv_path(p))


#: Values that few decimal digits hold, so that both engines print the same.
_SOLUTION = "SELECT star_id AS field_id, k * 3 / 8e0 AS crpix1, k * 5 / 8e0 AS crpix2, radians(star_id % 360 + 0.25e0) AS ra0, radians(star_id % 90 - 45.5e0) AS dec0, -k / 1024e0 AS cdelt1, k / 1024e0 AS cdelt2, star_id % 180 - 90.5e0 AS crota2, -k / 512e0 AS cd1_1, k / 256e0 AS cd1_2, k / 128e0 AS cd2_1, k / 64e0 AS cd2_2, star_id % 60 AS stars_matched, k / 16e0 AS rms FROM (SELECT star_id, star_id % 1000 + 1 AS k FROM detections)"


def _solution(spark, d):
    return spark.sql(_SOLUTION.replace("FROM detections", "FROM {src}"), src=V.view(spark, d, "detections"))


def _plain(c: str) -> str:
    return f"replace(replace(regexp_replace(printf('%.13E', {c}), 'E[+]0?', 'E'), 'E-0', 'E-'), ' ', '')"


@query("w03_summary", f"""SELECT field_id, 'PLTSOLVD=T' || chr(10) || 'CRPIX1=' || {_plain('crpix1')} || chr(10) || 'CRPIX2=' || {_plain('crpix2')} || chr(10) || 'CRVAL1=' || printf('%.9f', degrees(ra0)) || chr(10) || 'CRVAL2=' || printf('%.9f', degrees(dec0)) || chr(10)
  || 'CDELT1=' || {_plain('cdelt1')} || chr(10) || 'CDELT2=' || {_plain('cdelt2')} || chr(10) || 'CROTA1=' || printf('%.4f', crota2) || chr(10) || 'CROTA2=' || printf('%.4f', crota2) || chr(10) || 'CD1_1=' || {_plain('cd1_1')} || chr(10) || 'CD1_2=' || {_plain('cd1_2')} || chr(10)
  || 'CD2_1=' || {_plain('cd2_1')} || chr(10) || 'CD2_2=' || {_plain('cd2_2')} || chr(10) || 'CMDLINE=solve -f a' || chr(10) || CASE WHEN field_id % 2 = 0 THEN 'WARNING=w' || chr(10) ELSE '' END || 'NSTARS=' || CAST(field_id AS VARCHAR) || chr(10) || 'NQUADS=' || CAST(stars_matched AS VARCHAR) || chr(10) || 'RMS=' || printf('%.4f', rms) AS ini FROM ({_SOLUTION})""", ("detections",))
def _(spark, d):
    s = _solution(spark, d)
    return named(s, "field_id", ini=text.ini_text(F.col("field_id"), F.lit("solve -f a"), F.when(F.col("field_id") % 2 == 0, "w")))


@query("w02_cards", f"""SELECT field_id, CAST(place AS INT) AS place, rpad(card, 80, ' ') AS card FROM ({_SOLUTION}) s, LATERAL (SELECT * FROM (VALUES (4, 'CRPIX1', crpix1), (5, 'CRPIX2', crpix2), (6, 'CRVAL1', degrees(ra0)), (7, 'CRVAL2', degrees(dec0)), (8, 'CDELT1', cdelt1), (9, 'CDELT2', cdelt2), (10, 'CROTA2', crota2), (11, 'CD1_1', cd1_1), (12, 'CD1_2', cd1_2), (13, 'CD2_1', cd2_1), (14, 'CD2_2', cd2_2)) t(place, k, v)) t,
  LATERAL (SELECT rpad(k, 8, ' ') || '= ' || lpad(replace(replace(printf('%.12E', v), 'E+0', 'E+00'), 'E-0', 'E-00'), 20, ' ') AS card)""", ("detections",))
def _(spark, d):
    cards = _solution(spark, d).select("field_id", F.posexplode(text.wcs_cards()).alias("place", "card"))
    return cards.where(F.col("place").between(4, 14))


@query("w06_sip_keywords", """SELECT star_id, CAST(i AS INT) AS place, CASE WHEN k = 0 THEN b || '_ORDER' ELSE b || '_' || t END AS key, CASE WHEN k = 0 THEN 3e0 ELSE star_id + 10 * p + c END AS value FROM detections,
  (SELECT p, b, k, row_number() OVER (ORDER BY p, k) - 1 AS i, CASE WHEN b = 'B' AND k = 2 THEN '0_1' WHEN b = 'B' AND k = 3 THEN '1_0' ELSE list_extract(['', '0_0', '1_0', '0_1', '2_0', '1_1', '0_2', '3_0', '2_1', '1_2', '0_3'], k + 1) END AS t,
    CASE WHEN b = 'B' AND k = 2 THEN 2 WHEN b = 'B' AND k = 3 THEN 1 ELSE k - 1 END AS c FROM (VALUES (0, 'A'), (1, 'B'), (2, 'AP'), (3, 'BP')) v(p, b), (SELECT unnest(range(11)) AS k))""", ("detections",))
def _(spark, d):
    values = [F.array(*[F.col("star_id") + float(10 * n + k) for k in range(10)]) for n in range(4)]
    return V.view(spark, d, "detections").select("star_id", F.posexplode(text.sip_keywords(*values)).alias("place", "s")).select("star_id", "place", F.col("s.key").alias("key"), F.col("s.value").alias("value"))


@query("l13_duration", "SELECT o_orderkey AS n, CASE WHEN n < 10 THEN 'under 10 s' WHEN n < 55 THEN printf('~%d s', CAST(floor(n / 5 + 0.5e0) AS BIGINT) * 5) WHEN n < 3600 THEN printf('~%d min', greatest(1, CAST(floor(n / 60 + 0.5e0) AS BIGINT))) ELSE printf('~%d h %d min', CAST(floor(n / 60 + 0.5e0) AS BIGINT) // 60, CAST(floor(n / 60 + 0.5e0) AS BIGINT) % 60) END AS said FROM (SELECT o_orderkey, o_orderkey * 0.7e0 AS n FROM orders)")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("n"), text.duration(F.col("o_orderkey") * 0.7).alias("said"))


@query("c15_scale_warning", """SELECT star_id, CASE WHEN abs(3e0 / hfd - 1) > 0.05e0 THEN printf('Warning scale was inaccurate! Set FOV=%.2fd, scale=%.1f"', hfd * 3000 / 3600e0, hfd) END AS warning FROM detections""", ("detections",))
def _(spark, d):
    return named(V.view(spark, d, "detections"), "star_id", warning=text.scale_warning(F.lit(3.0), F.col("hfd"), F.lit(3000)))


@query("m03_header_wcs", "SELECT file_id, round(radians(10 + file_id % 50), 9) AS ra0, CAST(file_id % 7 AS DOUBLE) AS cd1_1, CASE WHEN file_id % 2 = 0 THEN 1e-4 ELSE 0e0 END AS cd1_2 FROM headers WHERE file_id % 7 <> 0 AND file_id % 5 <> 0", ("headers",))
def _(spark, d):
    k = F.col("file_id")
    cards = F.concat_ws("\n", F.concat(F.lit("CRVAL1  = "), (10 + k % 50).cast("string")), F.lit("crval2  = '2.5'"), F.when(k % 5 != 0, F.lit("CRPIX1  = 100.5 / pixels")), F.lit("CRPIX2  = 1.005D2"),
                        F.concat(F.lit("CD1_1   = "), (k % 7).cast("string")), F.when(k % 2 == 0, F.lit("CD1_2   = 1.0E-4")))
    w = V.view(spark, d, "headers").select("file_id", text.cards(cards).alias("c")).select("file_id", text.header_wcs(F.col("c")).alias("w")).where("w is not null")
    return w.select("file_id", r(F.col("w.ra0"), 9).alias("ra0"), F.col("w.cd1_1").alias("cd1_1"), F.col("w.cd1_2").alias("cd1_2"))


@query("m15_pointing_hint", "SELECT file_id, round(CASE WHEN file_id % 3 = 0 THEN (file_id % 24) * pi() / 12 ELSE radians(file_id % 360) END, 9) AS ra, round(CASE WHEN file_id % 3 = 0 THEN radians(least(90, greatest(-90, file_id % 300 - 90))) ELSE radians(file_id % 90) END, 9) AS dec FROM headers WHERE file_id % 3 <> 2", ("headers",))
def _(spark, d):
    k = F.col("file_id")
    given = k % 3 == 0
    ra, dec = text.pointing_hint(F.when(given, k % 24), F.when(given, k % 300), F.when(k % 3 == 1, k % 360), F.when(k % 3 == 1, k % 90))
    return named(V.view(spark, d, "headers").where(ra.isNotNull()), "file_id", ra=r(ra, 9), dec=r(dec, 9))


@query("p05_binned_size", "SELECT hyp_id, CAST((100 + hyp_id % 9) // greatest(1, hyp_id % 4) AS BIGINT) AS w, CAST(77 // greatest(1, hyp_id % 4) AS BIGINT) AS h FROM hypotheses", ("hypotheses",))
def _(spark, d):
    w, h = pixels.binned_size(100 + F.col("hyp_id") % 9, F.lit(77), F.col("hyp_id") % 4)
    return named(V.view(spark, d, "hypotheses"), "hyp_id", w=w, h=h)


@query("g12_fast_atan2", """SELECT hyp_id, round(CASE WHEN x = 0 THEN sign(y) * pi() / 2 WHEN x < 0 THEN a + CASE WHEN y >= 0 THEN pi() ELSE -pi() END ELSE a END, 9) + 0e0 AS t FROM (SELECT *, CASE WHEN abs(y / x) <= 1 THEN (y / x) / (1 + 0.28125e0 * (y / x) * (y / x)) ELSE sign(y / x) * pi() / 2 - (x / y) / (1 + 0.28125e0 * (x / y) * (x / y)) END AS a
  FROM (SELECT hyp_id, CASE WHEN hyp_id % 11 = 0 THEN 0e0 ELSE cos(ra) END AS x, sin(ra) * scale AS y FROM hypotheses))""", ("hypotheses",))
def _(spark, d):
    x = F.when(F.col("hyp_id") % 11 == 0, 0.0).otherwise(F.cos("ra"))
    return named(V.view(spark, d, "hypotheses"), "hyp_id", t=r(sphere.fast_atan2(F.sin("ra") * F.col("scale"), x), 9))


@query("g13_positive_modulus", "SELECT hyp_id, round((dec * 7) - pi() * floor(dec * 7 / pi()), 9) + 0e0 AS m FROM hypotheses", ("hypotheses",))
def _(spark, d):
    return named(V.view(spark, d, "hypotheses"), "hyp_id", m=r(sphere.pmod(F.col("dec") * 7, math.pi), 9))


@query("g23_pixels_in_frame", f"""SELECT star_id, round(x, 4) + 0e0 AS x, round(y, 4) + 0e0 AS y FROM (SELECT star_id, h, (8e-4 * xi - 1e-4 * eta) / (-6.5e-7) + 1500.5e0 AS x, (-8e-4 * eta - 1e-4 * xi) / (-6.5e-7) + 1500.5e0 AS y FROM (
  SELECT star_id, h, degrees(cos(dec) * sin(ra - {R0}) / h) AS xi, degrees((sin(dec) * cos({D0}) - cos(dec) * sin({D0}) * cos(ra - {R0})) / h) AS eta FROM (SELECT *, sin(dec) * sin({D0}) + cos(dec) * cos({D0}) * cos(ra - {R0}) AS h FROM field_stars)) WHERE h > 0) WHERE x BETWEEN 0 AND 3000 AND y BETWEEN 0 AND 3000""", ("field_stars",))
def _(spark, d):
    from skyloom.plans.catalogue import WCS

    x, y = sphere.sky_to_pixel(WCS, "ra", "dec")
    rows = V.view(spark, d, "field_stars").select("star_id", x.alias("x"), y.alias("y"))
    return named(rows.where(F.col("x").between(0, 3000) & F.col("y").between(0, 3000)), "star_id", x=r("x", 4), y=r("y", 4))


_CU, _CV = [5.0, 3.0, 0.02, 1e-5, 2e-5, -1e-5, 1e-9, 0.0, 2e-9, 0.0], [-7.0, -0.02, 3.0, 2e-5, 0.0, 1e-5, 0.0, 1e-9, 0.0, -1e-9]


@query("g28_polynomial_round_trip", "SELECT star_id, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y FROM detections", ("detections",))
def _(spark, d):
    s = V.view(spark, d, "detections").select("star_id", F.explode(F.array(F.struct((F.col("x") - 1500).alias("x"), (F.col("y") - 1500).alias("y")))).alias("p")).select("star_id", "p.*")
    s = s.select("star_id", F.explode(F.array(F.struct(sphere.polynomial(_CU, "x", "y").alias("u"), sphere.polynomial(_CV, "x", "y").alias("v")))).alias("p")).select("star_id", "p.*")
    s = s.select("star_id", sphere.polynomial_inverse(_CU, _CV, "u", "v", settled=1e-7).alias("p"))
    return named(s, "star_id", x=r(F.col("p.x") + 1500, 3), y=r(F.col("p.y") + 1500, 3))


@query("n07_three_neighbour_quads", f"""WITH top AS (SELECT * FROM std_stars), k AS (SELECT * FROM ({_KNN}) WHERE slot <= 3), g AS (SELECT field_id, star_id, list_sort(list_append(list(nb), star_id)) AS ids FROM k GROUP BY 1, 2 HAVING count(*) = 3)
  SELECT DISTINCT field_id, ids[1] AS i, ids[2] AS j, ids[3] AS l, ids[4] AS o FROM g""", ("std_stars",))
def _(spark, d):
    q = patterns.three_neighbour_quads(_top(spark, d))
    return q.select("field_id", *[F.get("ids", k).alias(n) for k, n in enumerate("ijlo")])


_TRIANGLES = """t AS (SELECT a.field_id, a.star_id AS i, b.star_id AS j, c.star_id AS l, (a.x + b.x + c.x) / 3 AS cx, (a.y + b.y + c.y) / 3 AS cy, list_reverse_sort([sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)), sqrt((b.x-c.x)*(b.x-c.x)+(b.y-c.y)*(b.y-c.y))]) AS e
  FROM detections a JOIN detections b ON a.field_id = b.field_id AND a.star_id < b.star_id JOIN detections c ON c.field_id = a.field_id AND b.star_id < c.star_id)"""


@query("n11_triangle_records", f"WITH {_TRIANGLES} SELECT field_id, i, j, l, round(e[2] / e[1], 6) + 0e0 AS r0, round(e[3] / e[1], 6) + 0e0 AS r1, round(cx, 4) + 0e0 AS cx, round(cy, 4) + 0e0 AS cy FROM t WHERE e[1] >= 1e-10", ("detections",))
def _(spark, d):
    q = patterns.triangles(_top_detections(spark, d))
    return q.select("field_id", *[F.get("ids", k).alias(n) for k, n in enumerate("ijl")], r("r0").alias("r0"), r("r1").alias("r1"), r("cx", 4).alias("cx"), r("cy", 4).alias("cy"))


_CAT_TRIANGLES = f"""top AS (SELECT * FROM std_stars), k AS (SELECT * FROM ({_KNN}) WHERE slot <= 7),
  c AS (SELECT field_id, ids[1] AS i, ids[2] AS j, ids[3] AS l, max(e) AS e FROM (SELECT a.field_id, list_sort([a.star_id, a.nb, b.nb]) AS ids, list_reverse_sort([sqrt((a.ax-a.bx)*(a.ax-a.bx)+(a.ay-a.by_)*(a.ay-a.by_)), sqrt((a.ax-b.bx)*(a.ax-b.bx)+(a.ay-b.by_)*(a.ay-b.by_)), sqrt((a.bx-b.bx)*(a.bx-b.bx)+(a.by_-b.by_)*(a.by_-b.by_))]) AS e
  FROM k a JOIN k b ON a.field_id = b.field_id AND a.star_id = b.star_id AND a.slot < b.slot) GROUP BY ALL)"""
_TRI_MATCH = f"WITH {_TRIANGLES}, {_CAT_TRIANGLES}, m AS (SELECT t.field_id, t.i AS i1, t.j AS j1, t.l AS l1, c.i AS i2, c.j AS j2, c.l AS l2, c.e[1] / t.e[1] AS ratio FROM t JOIN c ON t.field_id = c.field_id AND abs(t.e[2] / t.e[1] - c.e[2] / c.e[1]) <= 0.0021e0 AND abs(t.e[3] / t.e[1] - c.e[3] / c.e[1]) <= 0.0021e0)"


def _triangle_matches(spark, d):
    img, cat = patterns.triangles(_top_detections(spark, d)), patterns.triangles(_top(spark, d))
    left = img.select("field_id", F.col("ids").alias("img"), F.col("r0").alias("a0"), F.col("r1").alias("a1"), F.col("d1").alias("ad"))
    right = cat.select(F.col("field_id").alias("other"), F.col("ids").alias("cat"), F.col("r0").alias("b0"), F.col("r1").alias("b1"), F.col("d1").alias("bd"))
    met = joins.band_join(left, right, [("a0", "b0"), ("a1", "b1")], 0.0021).where("field_id = other")
    return met.withColumn("scale_ratio", F.col("bd") / F.col("ad"))


def _six(m):
    return m.select("field_id", *[F.get(c, k).alias(f"{n}{i}") for i, c in ((1, "img"), (2, "cat")) for k, n in enumerate("ijl")])


@query("j04_triangle_band_join", _TRI_MATCH + " SELECT field_id, i1, j1, l1, i2, j2, l2 FROM m", ("std_stars", "detections"))
def _(spark, d):
    return _six(_triangle_matches(spark, d))


@query("v02_triangle_scale_filter", _TRI_MATCH + " SELECT field_id, i1, j1, l1, i2, j2, l2 FROM m JOIN (SELECT field_id, median(ratio) AS med FROM m GROUP BY 1) USING (field_id) WHERE abs(ratio - med) <= 0.007e0 * med", ("std_stars", "detections"))
def _(spark, d):
    return _six(votes.near_median(_triangle_matches(spark, d), 0.007, "field_id"))


@query("j02_range_join", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND abs(CAST(a.embedding[5] AS DOUBLE) - b.embedding[5]) <= 0.01e0 AND abs(CAST(a.embedding[6] AS DOUBLE) - b.embedding[6]) <= 0.01e0")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    code = lambda p: e.select(F.col("vec_id").alias(p), *[F.get("embedding", F.lit(k)).cast("double").alias(f"{p}{k}") for k in (4, 5)])
    return joins.band_join(code("a"), code("b"), [("a4", "b4"), ("a5", "b5")], 0.01, cells=1).where("a < b").select("a", "b")


_FRAME = "SELECT id, p[2].x - p[1].x AS abx, p[2].y - p[1].y AS aby, p[3].x - p[1].x AS x1, p[3].y - p[1].y AS y1, p[4].x - p[1].x AS x2, p[4].y - p[1].y AS y2 FROM (" + _QUAD + ")"
_COEF = f"SELECT *, (aby + abx) / (abx * abx + aby * aby) AS c, (aby - abx) / (abx * abx + aby * aby) AS s FROM ({_FRAME}) WHERE abx * abx + aby * aby >= 1"


@query("n13_triangle_codes", f"SELECT id, round(CASE WHEN u > 0.5e0 THEN 1 - u ELSE u END, 6) + 0e0 AS cx, round(CASE WHEN u > 0.5e0 THEN 1 - v ELSE v END, 6) + 0e0 AS cy, u > 0.5e0 AS swapped FROM (SELECT id, y1 * c - x1 * s AS u, x1 * c + y1 * s AS v FROM ({_COEF}))", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    t = rows.select("id", blind.triangle_code(xs[0], ys[0], xs[1], ys[1], xs[2], ys[2], False).alias("t")).where("t is not null")
    return t.select("id", r(F.col("t.cx")).alias("cx"), r(F.col("t.cy")).alias("cy"), F.col("t.swapped").alias("swapped"))


@query("n14_quad_codes", f"""SELECT id, round(q[1].x, 6) + 0e0 AS cx, round(q[1].y, 6) + 0e0 AS cy, round(q[2].x, 6) + 0e0 AS dx, round(q[2].y, 6) + 0e0 AS dy FROM (SELECT id, list_sort([struct_pack(x := CASE WHEN u1 + u2 > 1 THEN 1 - u1 ELSE u1 END, y := CASE WHEN u1 + u2 > 1 THEN 1 - v1 ELSE v1 END),
  struct_pack(x := CASE WHEN u1 + u2 > 1 THEN 1 - u2 ELSE u2 END, y := CASE WHEN u1 + u2 > 1 THEN 1 - v2 ELSE v2 END)]) AS q FROM (SELECT id, y1 * c - x1 * s AS u1, x1 * c + y1 * s AS v1, y2 * c - x2 * s AS u2, x2 * c + y2 * s AS v2 FROM ({_COEF})))""", ("std_stars",))
def _(spark, d):
    rows, xs, ys = _four(spark, d)
    q = rows.select("id", blind.quad_code(*[v for p in zip(xs, ys) for v in p], False).alias("q")).where("q is not null")
    return q.select("id", *[r(F.get("q", k)[c]).alias(f"{n}{c}") for k, n in enumerate("cd") for c in "xy"])


@query("v10_v11_acceptance", """SELECT hyp_id, n >= least(30, greatest(10, ceil(seen * 0.15e0))) AND spread >= 0.2e0 AND n >= 4 * chance AND rms <= 2 AND (n >= 30 OR (trusted AND off <= 0.1e0 AND rms <= 0.5e0)) AS accepted FROM (SELECT hyp_id, hyp_id % 50 AS n, hyp_id % 301 AS seen, (hyp_id % 17) / 40e0 AS spread, (hyp_id % 23) / 10e0 AS rms, (hyp_id % 13) * 1e0 AS chance, hyp_id % 2 = 0 AS trusted, (hyp_id % 5) / 20e0 AS off FROM hypotheses)""", ("hypotheses",))
def _(spark, d):
    k = F.col("hyp_id")
    ok = votes.accepted(k % 50, sphere.least_stars(k % 301), (k % 17) / 40, (k % 23) / 10, k % 13, (k % 5) / 20, k % 2 == 0)
    return named(V.view(spark, d, "hypotheses"), "hyp_id", accepted=ok)


@query("v12_projection_score", "SELECT hyp_id, round((hyp_id % 40 - scale) / sqrt(scale + 1), 8) + 0e0 AS score FROM hypotheses", ("hypotheses",))
def _(spark, d):
    return named(V.view(spark, d, "hypotheses"), "hyp_id", score=r(votes.score(F.col("hyp_id") % 40, F.col("scale")), 8))


@query("v14_sparse_acceptance", "SELECT hyp_id, hyp_id % 40 >= 30 OR (hi / 1e0 <= 1.5e0 AND scale >= 1e0 / 1.02e0 AND scale <= hi * 1.02e0) AS accepted FROM (SELECT *, 1e0 + (hyp_id % 10) / 10e0 AS hi FROM hypotheses)", ("hypotheses",))
def _(spark, d):
    return named(V.view(spark, d, "hypotheses"), "hyp_id", accepted=votes.sparse_accepted(F.col("hyp_id") % 40, F.col("scale"), F.lit(1.0), 1 + (F.col("hyp_id") % 10) / 10))


@query("v18_median", "SELECT s_bin, round(median(scale), 9) + 0e0 AS m FROM (SELECT *, CAST(floor(dec * 5) AS BIGINT) AS s_bin FROM hypotheses) GROUP BY 1", ("hypotheses",))
def _(spark, d):
    return named(V.view(spark, d, "hypotheses").groupBy(F.floor(F.col("dec") * 5).cast("long").alias("s_bin")).agg(F.median("scale").alias("v")), "s_bin", m=r("v", 9))


@query("f08_residuals", _AFF + " SELECT p.field_id, round(ix, 4) + 0e0 AS ix, round(iy, 4) + 0e0 AS iy, round(sqrt((a*(ix-mx)+b*(iy-my)+nx-cx)*(a*(ix-mx)+b*(iy-my)+nx-cx)+(d*(ix-mx)+e*(iy-my)+ny-cy)*(d*(ix-mx)+e*(iy-my)+ny-cy)), 6) + 0e0 AS residual FROM p JOIN f USING (field_id)", ("std_stars", "detections"))
def _(spark, d):
    pairs = _true_pairs(spark, d)
    met = pairs.join(fit.affine(pairs, "field_id").select("field_id", *"abcdef"), "field_id")
    off = F.hypot(F.col("a") * F.col("ix") + F.col("b") * F.col("iy") + F.col("c") - F.col("cx"), F.col("d") * F.col("ix") + F.col("e") * F.col("iy") + F.col("f") - F.col("cy"))
    return named(met, "field_id", ix=r("ix", 4), iy=r("iy", 4), residual=r(off))


@query("x10_projected_catalogue", """SELECT field_id, star_id, round(-cos(dec) * sin(ra - c_ra) / h, 3) + 0e0 AS x, round((cos(c_dec) * sin(dec) - sin(c_dec) * cos(dec) * cos(ra - c_ra)) / h, 3) + 0e0 AS y FROM (SELECT f.field_id, s.star_id, s.ra, s.dec, f.ra AS c_ra, f.dec AS c_dec,
  (cos(f.dec) * cos(s.dec) * cos(s.ra - f.ra) + sin(f.dec) * sin(s.dec)) * (pi() / 648000e0) AS h FROM fields f JOIN sky_stars s ON acos(least(1e0, greatest(-1e0, sin(f.dec) * sin(s.dec) + cos(f.dec) * cos(s.dec) * cos(f.ra - s.ra)))) <= f.fov)""", ("fields", "sky_stars"))
def _(spark, d):
    fields = V.view(spark, d, "fields")
    near = catalogue_scan.stars_near(fields, V.view(spark, d, "sky_stars"), "fov").select("field_id", "star_id", "ra", "dec", "mag")
    return named(solve.projected(near, fields.select("field_id", F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))), "field_id", "star_id", x=r("x", 3), y=r("y", 3))


@query("x11_moved_planes", f"SELECT star_id, round(-cos(dec) * sin(ra - 1.51e0) / h, 3) + 0e0 AS x, round((cos(0.29e0) * sin(dec) - sin(0.29e0) * cos(dec) * cos(ra - 1.51e0)) / h, 3) + 0e0 AS y FROM (SELECT *, (cos(0.29e0) * cos(dec) * cos(ra - 1.51e0) + sin(0.29e0) * sin(dec)) * (pi() / 648000e0) AS h FROM field_stars)", ("field_stars",))
def _(spark, d):
    x, y = sphere.move_plane(V.RA0, V.DEC0, 1.51, 0.29, "x", "y")
    return named(V.view(spark, d, "std_stars"), "star_id", x=r(x, 3), y=r(y, 3))


@query("a13_nearest_detection", f"""SELECT field_id, a, b FROM (SELECT c.field_id, c.star_id AS a, d.star_id AS b, row_number() OVER (PARTITION BY c.field_id, c.star_id ORDER BY (d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y), d.star_id) AS k
  FROM detections d JOIN (SELECT field_id, star_id, 1500e0 + (x * cos({TURN}) - y * sin({TURN})) / 3e0 AS x, 1500e0 - (x * sin({TURN}) + y * cos({TURN})) / 3e0 AS y FROM std_stars) c ON c.field_id = d.field_id AND (d.x - c.x) * (d.x - c.x) + (d.y - c.y) * (d.y - c.y) <= 14400) WHERE k = 1""", ("std_stars", "detections"))
def _(spark, d):
    c, s = math.cos(V.TURN), math.sin(V.TURN)
    std = V.view(spark, d, "std_stars").select("field_id", F.col("star_id").alias("a"), (1500 + (F.col("x") * c - F.col("y") * s) / V.SCALE).alias("ax"), (1500 - (F.col("x") * s + F.col("y") * c) / V.SCALE).alias("ay"))
    det = V.view(spark, d, "detections").select(F.col("field_id").alias("f"), F.col("star_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = joins.ball_join(std, det, [("ax", "bx"), ("ay", "by")], 120.0).where("field_id = f")
    return near.groupBy("field_id", "a").agg(F.min(F.struct("d2", "b"))["b"].alias("b"))


@query("a07_areas_290_in_band", f"SELECT area, lpad(CAST(ring + 1 AS VARCHAR), 2, '0') || lpad(CAST(area - base + 1 AS VARCHAR), 2, '0') || '.290' AS name FROM (SELECT ring, base, CAST(unnest(range(base, base + n)) AS BIGINT) AS area FROM {_RINGS['290']} WHERE hi >= 0.1e0 AND lo <= 0.4e0)")
def _(spark, d):
    rings = tiles.rings_290()
    areas = tiles.areas_in_band(spark, 0.1, 0.4, rings)
    return areas.select("area", tiles.file_name(F.col("area"), rings, ".290").alias("name"))


@query("k04_k05_next_magnitude", f"SELECT area, CAST(count(CASE WHEN mag <= 12 THEN 1 END) AS BIGINT) AS read, min(CASE WHEN mag > 12 THEN mag END) AS next FROM (SELECT mag, CAST(base + least(n - 1, floor(ra * n / (2e0 * pi()))) AS BIGINT) AS area FROM sky_stars JOIN {_RINGS['290']} ON dec >= lo AND (dec < hi OR ring = 17)) GROUP BY 1", ("sky_stars",))
def _(spark, d):
    tiled = catalogue_scan.tiled(V.view(spark, d, "sky_stars"), "290")
    read = catalogue_scan.read_through(tiled, 12.0).groupBy("area").agg(F.count("*").alias("read"))
    return read.join(catalogue_scan.next_magnitude(tiled, 12.0), "area", "full").select("area", F.coalesce("read", F.lit(0)).alias("read"), F.col("mag").alias("next"))


@query("k10_all_sky_file", "SELECT CAST(CAST(floor(dec * 3) AS BIGINT) AS VARCHAR) AS path, round(CAST(CAST(ra AS FLOAT) AS DOUBLE), 9) AS ra, round(CAST(CAST(dec AS FLOAT) AS DOUBLE), 9) AS dec, round(CAST(CAST(mag * 10 AS FLOAT) AS DOUBLE) / 10, 9) AS mag FROM sky_stars", ("sky_stars",))
def _(spark, d):
    rows = V.view(spark, d, "sky_stars").withColumn("file", F.floor(F.col("dec") * 3).cast("long"))
    return named(packed.stars(packed.files(rows, "file", all_sky=True), all_sky=True), "path", ra=r("ra", 9), dec=r("dec", 9), mag=r("mag", 9))


@query("k01_k11_packed_tiles", f"""SELECT CAST(area AS VARCHAR) AS path, round((CAST(floor(ra / (2 * pi()) * 16777215 + 0.5e0) AS BIGINT) % 16777215) * (2 * pi() / 16777215), 9) + 0e0 AS ra, round(floor(dec / (pi() / 2) * 8388607 + 0.5e0) * (pi() / 2 / 8388607), 9) + 0e0 AS dec, floor(mag * 10 + 0.5e0) / 10 AS mag
  FROM (SELECT ra, dec, mag, CAST(base + least(n - 1, floor(ra * n / (2e0 * pi()))) AS BIGINT) AS area FROM sky_stars JOIN {_RINGS['290']} ON dec >= lo AND (dec < hi OR ring = 17))""", ("sky_stars",))
def _(spark, d):
    tiled = catalogue_scan.tiled(V.view(spark, d, "sky_stars"), "290")
    return named(packed.stars(packed.files(tiled, "area")), "path", ra=r("ra", 9), dec=r("dec", 9), mag=r("mag", 9))


@query("k17_star_decode", "SELECT star_id, round(t - 2e0 * pi() * floor(t / (2e0 * pi())), 9) AS ra, round(atan2(z, sqrt(x * x + y * y)), 9) + 0e0 AS dec FROM (SELECT star_id, atan2(y, x) AS t, x, y, z FROM (SELECT star_id, floor((cos(dec) * cos(ra) + 1) * 2147483647.5e0) / 2147483647.5e0 - 1 AS x, floor((cos(dec) * sin(ra) + 1) * 2147483647.5e0) / 2147483647.5e0 - 1 AS y, floor((sin(dec) + 1) * 2147483647.5e0) / 2147483647.5e0 - 1 AS z FROM sky_stars))", ("sky_stars",))
def _(spark, d):
    u = [F.floor((c + 1) * 2147483647.5) for c in sphere.unit("ra", "dec")]
    ra, dec = sphere.star_of_integers(*u)
    return named(V.view(spark, d, "sky_stars"), "star_id", ra=r(ra, 9), dec=r(dec, 9))


@query("k18_code_decode", "SELECT vec_id, round(-0.25e0 + floor((CAST(embedding[1] AS DOUBLE) + 2) * 10000) / 20000e0, 9) + 0e0 AS code FROM embeddings")
def _(spark, d):
    u = F.floor((F.get("embedding", F.lit(0)).cast("double") + 2) * 10000)
    return named(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", code=r(sphere.code_of_integer(u, -0.25, 20000.0), 9))


@query("k19_quad_centres", "SELECT quad_id, round(t - 2e0 * pi() * floor(t / (2e0 * pi())), 8) AS ra, round(atan2(z, sqrt(x * x + y * y)), 8) + 0e0 AS dec FROM (SELECT quad_id, atan2(sum(sin(ra) * cos(dec)), sum(cos(ra) * cos(dec))) AS t, sum(cos(ra) * cos(dec)) AS x, sum(sin(ra) * cos(dec)) AS y, sum(sin(dec)) AS z FROM (SELECT star_id AS quad_id, unnest([star_id, star_id + 1, star_id + 7, star_id + 9]) AS id FROM field_stars) q JOIN field_stars s ON s.star_id = q.id GROUP BY 1 HAVING count(*) = 4)", ("field_stars",))
def _(spark, d):
    s = V.view(spark, d, "field_stars")
    quads = s.select(F.col("star_id").alias("quad_id"), F.array(*[F.col("star_id") + k for k in (0, 1, 7, 9)]).alias("ids"))
    return named(catalogue_scan.entries(quads, s), "quad_id", ra=r("ra", 8), dec=r("dec", 8))


_SPIRAL = """SELECT i, CASE WHEN i = 0 THEN 0 WHEN side = 0 THEN k WHEN side = 1 THEN k - 1 - t WHEN side = 2 THEN -k ELSE 1 - k + t END AS sx, CASE WHEN i = 0 THEN 0 WHEN side = 0 THEN 1 - k + t WHEN side = 1 THEN k WHEN side = 2 THEN k - 1 - t ELSE -k END AS sy FROM (
  SELECT i, k, p // greatest(2 * k, 1) AS side, p % greatest(2 * k, 1) AS t FROM (SELECT i, k, i - (2 * k - 1) * (2 * k - 1) AS p FROM (SELECT i, CAST(floor((floor(sqrt(i)) + 1) / 2) AS BIGINT) AS k FROM (SELECT unnest(range(81)) AS i))))"""


@query("c05_spiral_positions", f"""SELECT field_id, idx, round(ra, 8) AS ra, round(d, 8) + 0e0 AS dec FROM (SELECT *, (flip + h_ra + turn) - 2e0 * pi() * floor((flip + h_ra + turn) / (2e0 * pi())) AS ra FROM (SELECT *, 0.1e0 * sx / cos(d - CASE WHEN d > 0 THEN 0.05e0 ELSE -0.05e0 END) AS turn FROM (
  SELECT field_id, i AS idx, sx, ra AS h_ra, dec AS h_dec, CASE WHEN raw > pi() / 2 THEN pi() - raw WHEN raw < -pi() / 2 THEN -pi() - raw ELSE raw END AS d, CASE WHEN abs(raw) > pi() / 2 THEN pi() ELSE 0e0 END AS flip FROM (SELECT *, dec + 0.1e0 * sy AS raw FROM fields, ({_SPIRAL}))))
  WHERE turn <= pi() / 2 + 0.05e0 AND turn >= -pi() / 2) WHERE acos(least(1e0, greatest(-1e0, sin(d) * sin(h_dec) + cos(d) * cos(h_dec) * cos(ra - h_ra)))) <= 0.25e0 + 0.05e0""", ("fields",))
def _(spark, d):
    return named(solve.positions(V.view(spark, d, "fields"), 0.1, 0.25), "field_id", "idx", ra=r("ra", 8), dec=r("dec", 8))


@query("i09_index_cost", """WITH t AS (SELECT CAST(s_suppkey % 7 AS BIGINT) AS plan, CAST(s_suppkey AS BIGINT) AS tier, 0.05e0 + (s_suppkey % 97) / 20e0 AS radius FROM supplier), c AS (SELECT t.*, p, s, rd, row_number() OVER (PARTITION BY tier ORDER BY abs(r - radius), listed) AS k FROM t, (VALUES (6.0e0, 5212e0, 1864e0, 5165e0, 0), (3.0e0, 21404e0, 7595e0, 26921e0, 1), (1.5e0, 87162e0, 30471e0, 143476e0, 2),
  (0.75e0, 349669e0, 122537e0, 625508e0, 3), (0.4e0, 1185086e0, 421308e0, 2006011e0, 4), (0.2e0, 3639264e0, 1427214e0, 4121724e0, 5), (0.1e0, 4428404e0, 4285114e0, 13777880e0, 6), (0.06e0, 12900826e0, 12303302e0, 51962040e0, 7)) v(r, p, s, rd, listed))
  SELECT CAST(floor(256 + 2884 + 40 * count(*) + 24 * sum(p) + 12 * (max(s) + 0.116e0 * (sum(s) - max(s)))) AS BIGINT) AS bytes, round(sum(rd) * (1.06e-6 + 2.5e-6 / 8), 6) AS seconds, CAST(floor(60e6 + 37 * sum(p) + 29 * (max(s) + 0.116e0 * (sum(s) - max(s)))) AS BIGINT) AS memory, CAST(sum(p) AS BIGINT) AS patterns FROM c WHERE k = 1""")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rows = s.select(F.col("s_suppkey").cast("long").alias("tier"), (0.05 + (F.col("s_suppkey") % 97) / 20).alias("radius"))
    c = planning.cost(planning.tier_costs(spark, rows, "d80"), 8)
    return c.select("bytes", r("seconds").alias("seconds"), "memory", "patterns")


_FILES = "SELECT CAST(p_partkey AS VARCHAR(20)) AS name, p_size / 40e0 AS lo, p_size / 40e0 + p_retailprice / 2000e0 AS hi FROM part"


@query("i15_index_files", f"SELECT name, CAST(row_number() OVER (ORDER BY abs((lo + hi) / 2 - 0.5e0), name) AS BIGINT) AS place FROM ({_FILES}) WHERE hi >= 0.2e0 AND lo <= 1.5e0")
def _(spark, d):
    files = spark.sql(_FILES.replace("FROM part", "FROM {src}"), src=spark.read.parquet(f"{d}/part.parquet"))
    from pyspark.sql import Window

    ranked = planning.rank_index_files(files, 1.0)
    place = F.row_number().over(Window.orderBy(F.abs((F.col("lo") + F.col("hi")) / 2 - 0.5), "name"))
    return ranked.select("name", place.cast("long").alias("place"))


@query("l05_recommend", "SELECT name FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size / 40e0 AS lo, p_size / 40e0 + 1 AS hi, p_retailprice AS bytes FROM part WHERE p_partkey % 3 = 0) WHERE lo <= 1e0 AND hi >= 1e0 ORDER BY bytes, name LIMIT 1")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    rows = p.select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") / 40).alias("lo"), (F.col("p_size") / 40 + 1).alias("hi"), F.col("p_retailprice").alias("bytes"), F.when(F.col("p_partkey") % 3 == 0, "solve").otherwise("draw").alias("purpose"))
    return planning.recommend(rows, 1.0, "solve").select("name")
