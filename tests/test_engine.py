"""Kernels and functions against brute force, known values and round trips."""

import gzip
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom import cli
from skyloom.functions import patterns as P
from skyloom.functions import sphere, text
from skyloom.operators import catalogue_scan, detect, distortion, fit, joins, patterns, planning, solve, tiles, votes
from skyloom.sources import images, sinks
from skyloom.streaming import arrivals


def test_rings_have_all_tiles():
    assert sum(r[3] for r in tiles.rings_1476()) == 1476
    assert sum(r[3] for r in tiles.rings_290()) == 290
    assert round(math.degrees(tiles.rings_1476()[1][1]), 8) == -87.42857143
    assert round(math.degrees(tiles.rings_290()[1][1]), 9) == -85.232244043


def test_spiral_walks_outwards(spark):
    x, y = sphere.spiral("id")
    got = [tuple(r) for r in spark.range(49).select(x, y).collect()]
    assert got[:9] == [(0, 0), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    assert len(set(got)) == 49 and max(max(map(abs, p)) for p in got) == 3
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(got, got[1:]))


def test_far_side_and_poles_are_null_or_finite(spark):
    df = spark.createDataFrame([(0.0, math.pi / 2), (math.pi, -0.3), (0.0, -math.pi / 2)], "ra double, dec double")
    xi, eta = sphere.tangent_project(0.0, 0.3, "ra", "dec")
    rows = df.select(xi.alias("xi"), eta.alias("eta")).collect()
    assert rows[0]["xi"] is not None and rows[1]["xi"] is None and rows[2]["xi"] is None


def test_probe_keys_include_the_key(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(map(float, rng.random(5))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "d array<double>").select(P.key(F.col("d")).alias("k"), P.probes(F.col("d")).alias("p"))
    for r in df.collect():
        assert r["k"] in r["p"] and 1 <= len(r["p"]) <= 32 and len(set(r["p"])) == len(r["p"])


def test_band_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((150, 3)), rng.random((150, 3))
    left = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "i long, a0 double, a1 double, a2 double")
    right = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)], "j long, b0 double, b1 double, b2 double")
    got = {(r["i"], r["j"]) for r in joins.band_join(left, right, [(f"a{k}", f"b{k}") for k in range(3)], 0.1).collect()}
    assert got == {(i, j) for i in range(150) for j in range(150) if (np.abs(a[i] - b[j]) <= 0.1).all()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 50)), max_size=30), st.lists(st.tuples(st.floats(0, 50), st.floats(0, 50)), max_size=30))
def test_greedy_pairs_equal_brute_force(left, right):
    free, want = set(range(len(right))), []
    for i, (x, y) in enumerate(left):
        near = [((right[k][0] - x) ** 2 + (right[k][1] - y) ** 2, k) for k in free]
        near = [n for n in near if n[0] < 36]
        if near:
            free.discard(min(near)[1])
            want.append((i, min(near)[0]))
    a, b = np.array(left).reshape(-1, 2), np.array(right).reshape(-1, 2)
    got = [(i, (b[k][0] - a[i][0]) ** 2 + (b[k][1] - a[i][1]) ** 2) for i, k in solve.greedy_pairs(a, b, 6.0)]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def _image(stars, w=160, h=140, sigma=2.0):
    gy, gx = np.mgrid[0:h, 0:w]
    img = 1000.0 + (gx * 7919 + gy * 104729) % 17 - 8.0
    for x, y, peak in stars:
        img = img + peak * np.exp(-((gx - x) ** 2 + (gy - y) ** 2) / (2 * sigma**2))
    return img.astype(np.float32)


def test_detection_finds_rendered_stars():
    truth = [(40.3, 50.7, 9000.0), (100.5, 90.2, 5000.0), (120.0, 30.0, 2500.0)]
    found = detect.all_stars(_image(truth), 0.8, 500)
    assert len(found) == 3
    for x, y, _ in truth:
        assert min(math.hypot(f[0] - x, f[1] - y) for f in found) < 0.1
    assert all(3.5 < f[2] < 6.5 for f in found)


def test_detection_of_blank_tiny_and_hot_pixel_images():
    assert detect.all_stars(np.full((100, 100), 500, np.float32), 0.8, 500) == []
    assert detect.all_stars(np.zeros((2, 2), np.float32), 0.8, 500) == []
    hot = np.full((100, 100), 500, np.float32)
    hot[50, 50] = 60000
    assert detect.all_stars(hot, 0.8, 500) == []
    near_edge = _image([(8.0, 8.0, 9000.0)])
    assert detect.all_stars(near_edge, 0.8, 500) == []


def test_sigma_clip_drops_outliers():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 1000, 60), rng.uniform(0, 1000, 60)
    u, v = 3 * x + 5, -3 * y + 7
    u[:5] += 400
    keep = votes.sigma_clipped(x, y, u, v, 1.0)
    assert not keep[:5].any() and keep[5:].all()


def test_polynomial_and_sip_recover_distortion():
    rng = np.random.default_rng(4)
    u, v = rng.uniform(-1500, 1500, 300), rng.uniform(-1500, 1500, 300)
    lu, lv = u + 1e-9 * u**3, v + 2e-6 * u * v
    got = fit.sip_of(u, v, lu, lv, 3000, 3000)
    assert got is not None and abs(got["a"][6] - 1e-9) < 1e-12 and abs(got["b"][4] - 2e-6) < 1e-9
    assert fit.sip_of(u, v, u, v, 3000, 3000) is None or np.abs(fit.sip_of(u, v, u, v, 3000, 3000)["a"]).max() < 1e-6
    assert fit.sip_of(u[:10], v[:10], lu[:10], lv[:10], 3000, 3000) is None
    n, kept = distortion.choose_order(u + 1500, v + 1500, lu, lv, 3000, 3000)
    assert n == 10 and kept[2].sum() > 250


def test_affine_of_few_or_collinear_points_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 2.0, 2.0), (0, 2.0, 2.0, 4.0, 4.0), (0, 3.0, 3.0, 6.0, 6.0), (1, 1.0, 2.0, 3.0, 4.0)], "g int, ix double, iy double, cx double, cy double")
    assert all(r["a"] is None for r in fit.affine(df, "g").collect())


def test_tiled_catalogue_reads_windows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, float(rng.uniform(0, 2 * math.pi)), float(math.asin(rng.uniform(-1, 1))), float(rng.integers(50, 120)) / 10) for k in range(3000)]
    rows += [(9000, 0.001, 0.2, 7.0), (9001, 2 * math.pi - 0.001, 0.2, 7.0)]
    stars = spark.createDataFrame(rows, "star_id long, ra double, dec double, mag double")
    for layout in ("1476", "290"):
        path = str(tmp_path / layout)
        catalogue_scan.write_tiled(stars, path, layout)
        for ra, dec in ((0.0, 0.2), (3.0, 1.5), (1.0, -1.55)):
            got = {r["star_id"] for r in catalogue_scan.in_tiles(spark, path, ra, dec, 0.3, layout).collect()}
            assert got == {r["star_id"] for r in stars.where(catalogue_scan.window(ra, dec, 0.3)).collect()}
        assert {9000, 9001} <= {r["star_id"] for r in catalogue_scan.in_tiles(spark, path, 0.0, 0.2, 0.3, layout).collect()}


def _fits(data, bitpix=-32, extra=()):
    h, w = data.shape
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bitpix:>20}", "NAXIS   =                    2", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}", *extra, "END"]
    head = "".join(c.ljust(80) for c in cards)
    head = head.ljust(-(-len(head) // 2880) * 2880)
    body = data.astype({-32: ">f4", 16: ">i2"}[bitpix]).tobytes()
    return head.encode() + body + b"\0" * (-len(body) % 2880)


def _png(rows):
    h, w = rows.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(bytes([1]) + ((rows[y].astype(int) - np.concatenate([[0], rows[y][:-1]])) % 256).astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    img = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "a.dat").write_bytes(_fits(img, extra=["RA      = 10.5 / degrees", "DEC     = '-2.5'", "FOCALLEN=  400.0D0", "XPIXSZ  = 3.76"]))
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(_fits(img * 2, 16)))
    (tmp_path / "c.png").write_bytes(_png(np.array([[1, 2, 3], [250, 5, 6]], np.uint8)))
    (tmp_path / "d.fits").write_bytes(_fits(img)[:2890])
    (tmp_path / "e.txt").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.images(spark, str(tmp_path)).collect()}
    assert list(rows["a.dat"]["data"]) == img.ravel().tolist() and rows["a.dat"]["width"] == 4
    assert list(rows["b.fits.gz"]["data"]) == (img * 2).ravel().tolist()
    assert list(rows["c.png"]["data"]) == [250, 5, 6, 1, 2, 3]
    assert rows["d.fits"]["status"] != "ok" and rows["e.txt"]["status"] != "ok"
    heads = {r["path"].rsplit("/", 1)[1]: r for r in images.headers(spark, str(tmp_path)).collect()}
    assert heads["a.dat"]["ra"] == 10.5 and heads["a.dat"]["dec"] == -2.5 and abs(heads["a.dat"]["scale"] - 3.76 / 400 * 206.265) < 1e-9
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(images.format_of(F.col("content")).alias("k")).collect()
    assert sorted(str(r["k"]) for r in kinds) == ["None", "fits", "fits", "fits.gz", "png"]


def test_limits():
    with pytest.raises(images.BadFile):
        images.checked(1 << 16, 1 << 15)
    with pytest.raises(images.BadFile):
        images.unzipped(b"\x1f\x8b" + b"\0" * 30 + struct.pack("<I", 10**9))


def test_streamed_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fits").write_bytes(_fits(_image([(40.3, 50.7, 9000.0)])))
    q = arrivals.to_table(arrivals.stars(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "in" / "b.fits").write_bytes(_fits(_image([(40.3, 50.7, 9000.0), (100.0, 80.0, 7000.0)])))
    arrivals.to_table(arrivals.stars(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_cards_and_summaries(spark):
    row = spark.createDataFrame([(1, 1.0, 0.5, 100.5, 100.5, -1e-3, 1e-3, 0.0, -1e-3, 0.0, 0.0, 1e-3, 20, 0.5)], "field_id long, ra0 double, dec0 double, crpix1 double, crpix2 double, cdelt1 double, cdelt2 double, crota2 double, cd1_1 double, cd1_2 double, cd2_1 double, cd2_2 double, stars_matched long, rms double")
    cards = [r["card"] for r in sinks.wcs_files(row).orderBy("place").collect()]
    assert all(len(c) == 80 for c in cards) and cards[-1].strip() == "END" and any("5.729577951308E+001" in c for c in cards)
    old = spark.createDataFrame([(1, 0, "SIMPLE  = T"), (1, 1, "CD1_1   = 5"), (1, 2, "A_ORDER = 3"), (2, 0, "CD1_1   = 5")], "field_id long, place int, card string")
    new = sinks.updated_headers(old, row)
    assert {r["card"] for r in new.where("field_id = 2").collect()} == {"CD1_1   = 5"}
    assert not [r for r in new.where("field_id = 1").collect() if r["card"].startswith("A_ORDER") or r["card"] == "CD1_1   = 5"]
    fields = spark.createDataFrame([(1,), (3,)], "field_id long")
    ini = {r["field_id"]: r["ini"] for r in sinks.summaries(row, fields).collect()}
    assert ini[3] == "PLTSOLVD=F" and ini[1].startswith("PLTSOLVD=T")


def test_text_functions(spark):
    df = spark.createDataFrame([(2 * math.pi - 1e-9, -0.5), (1.0, 0.5)], "ra double, dec double")
    rows = df.select(text.ra_text(F.col("ra")).alias("r"), text.dec_text(F.col("dec")).alias("d")).collect()
    assert rows[0]["r"] == "00 00 00.0" and rows[0]["d"][0] == "-" and rows[1]["d"][0] == "+"
    code = spark.range(1).select(text.exit_code(F.lit(0.125), F.lit(17)).alias("c"), text.csv_path(F.lit("/a.b/img.fits")).alias("p")).first()
    assert code["c"] == 12000017 and code["p"] == "/a.b/img.csv"


def test_regions_are_apart_and_ladder_is_ordered(spark):
    rng = np.random.default_rng(6)
    rows = [(float(1.0 + rng.normal(0, 0.001)), 0.2, 1.0) for _ in range(30)] + [(4.0, -0.8, 1.0)] * 10
    v = votes.sky_votes(spark.createDataFrame(rows, "ra double, dec double, scale double"), 0.05, 0.2)
    got = votes.regions(v, 0.05, 10).orderBy("place").collect()
    assert [r["smoothed"] for r in got] == [30, 10]
    assert solve.ladder(1.0)[:3] == [1.0, math.sqrt(2), 1 / math.sqrt(2)]


def test_group_sizes_and_options():
    assert [patterns.group_size(n, n) for n in (4, 5, 8, 20, 50)] == [None, 9, 7, 6, 9] or patterns.group_size(50, 50) == 9
    assert [patterns.group_size(n, n) for n in (5, 6, 7, 14, 15, 29, 30)] == [9, 6, 7, 7, 6, 6, 9]
    planning.SolveOptions(fov_deg=1.0).check()
    for bad in ({"fov_deg": 0.0}, {"fov_deg": 1.0, "tolerance": 0.5}, {"fov_deg": 1.0, "radius_deg": -1.0}):
        with pytest.raises(planning.SkyError):
            planning.SolveOptions(**bad).check()
    assert planning.concerns(2e9, 10, 1e12, 1e12) == ["it takes over 1 GB of disk"]


def _sky_and_images(rng, centre, fov, width, images):
    """A patch of sky, and images of it at other centres: (stars, detections)."""
    ra0, dec0 = centre
    stars = [(k, float(ra0 + rng.uniform(-0.1, 0.1) / math.cos(dec0)), float(dec0 + rng.uniform(-0.1, 0.1)), float(rng.uniform(6, 12))) for k in range(3000)]
    out = []
    for field, (ra, dec) in images.items():
        for k, r, d, m in stars:
            h = math.sin(d) * math.sin(dec) + math.cos(d) * math.cos(dec) * math.cos(r - ra)
            x = (width - 1) / 2 - math.cos(d) * math.sin(r - ra) / h / math.radians(fov) * width
            y = (width - 1) / 2 + (math.sin(d) * math.cos(dec) - math.cos(d) * math.sin(dec) * math.cos(r - ra)) / h / math.radians(fov) * width
            if 0 < x < width and 0 < y < width:
                out.append((field, k, float(x + rng.normal(0, 0.1)), float(y + rng.normal(0, 0.1)), 100 - m))
    return stars, out


def test_search_finds_images_beside_their_hint_and_refuses_noise(spark):
    rng = np.random.default_rng(31)
    ra0, dec0, fov, width = 2.0, 0.4, 1.0, 1000
    truth = {1: (ra0 + 0.01, dec0 - 0.008), 2: (ra0 - 0.02, dec0 + 0.012)}  # the second is more than a field off
    stars, rows = _sky_and_images(rng, (ra0, dec0), fov, width, truth)
    rows += [(3, k, float(rng.uniform(0, width)), float(rng.uniform(0, width)), float(rng.uniform(1, 9))) for k in range(40)]
    det = spark.createDataFrame(rows, "field_id long, star_id long, x double, y double, snr double")
    hints = spark.createDataFrame([(k, ra0, dec0) for k in (1, 2, 3)], "field_id long, ra double, dec double")
    sky = spark.createDataFrame(stars, "star_id long, ra double, dec double, mag double")
    got = {r["field_id"]: r for r in solve.search_fields(det, sky, hints, fov, 1.2, width, width).collect()}
    assert set(got) == {1, 2} and got[1]["idx"] == 0 and got[2]["idx"] > 0
    for k, (ra, dec) in truth.items():
        assert abs(got[k]["ra0"] - ra) < 1e-5 and abs(got[k]["dec0"] - dec) < 1e-5 and got[k]["accepted"]


def test_acceptance(spark):
    rows = [(40, 200, 0.3, 0.4, 5.0, 0.0, True, True), (29, 200, 0.3, 0.4, 5.0, 0.0, True, False), (29, 100, 0.3, 0.4, 5.0, 0.05, True, True), (29, 100, 0.3, 0.4, 5.0, 0.2, True, False),
            (29, 100, 0.3, 0.4, 5.0, 0.05, False, False), (29, 100, 0.3, 0.6, 5.0, 0.05, True, False), (40, 100, 0.1, 0.4, 5.0, 0.0, True, False), (40, 100, 0.3, 2.1, 5.0, 0.0, True, False), (40, 100, 0.3, 0.4, 10.5, 0.0, True, False)]
    df = spark.createDataFrame(rows, "n long, seen long, spread double, rms double, chance double, off double, trusted boolean, want boolean")
    ok = votes.accepted(F.col("n"), sphere.least_stars("seen"), F.col("spread"), F.col("rms"), F.col("chance"), F.col("off"), F.col("trusted"))
    assert [r["ok"] for r in df.select(ok.alias("ok")).collect()] == [r[-1] for r in rows]
    chance = spark.range(1).select(solve.chance_pairs(F.lit(450), F.lit(500), 384, 384).alias("c")).first()["c"]
    assert abs(chance - 450 * (1 - math.exp(-500 / 384**2 * math.pi * 4))) < 1e-9


def test_positions_over_the_pole(spark):
    step, radius = 0.3, 0.8
    hints = [(1, 1.0, 1.4), (2, 6.2, -0.2), (3, 0.1, -1.5)]
    got = {(r["field_id"], r["idx"]): (r["ra"], r["dec"]) for r in solve.positions(spark.createDataFrame(hints, "field_id long, ra double, dec double"), step, radius).collect()}
    want = {}
    index = {r["i"]: (r["x"], r["y"]) for r in spark.range(200).select(F.col("id").alias("i"), *[c.alias(n) for c, n in zip(sphere.spiral("id"), "xy")]).collect()}
    for f, ra, dec in hints:
        for i in range((2 * int(radius / step + 2) + 1) ** 2):
            sx, sy = index[i]
            d, flip = dec + step * sy, 0.0
            if d > math.pi / 2:
                d, flip = math.pi - d, math.pi
            elif d < -math.pi / 2:
                d, flip = -math.pi - d, math.pi
            turn = step * sx / math.cos(d - (step / 2 if d > 0 else -step / 2))
            if turn > math.pi / 2 + step / 2 or turn < -math.pi / 2:
                continue
            r = (flip + ra + turn) % (2 * math.pi)
            sep = math.acos(max(-1, min(1, math.sin(d) * math.sin(dec) + math.cos(d) * math.cos(dec) * math.cos(r - ra))))
            if sep <= radius + step / 2:
                want[(f, i)] = (r, d)
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_packed_catalogues(spark):
    from skyloom.sources import packed

    rng = np.random.default_rng(41)
    ra, dec, mag = rng.uniform(0, 6.28, 400), rng.uniform(-1.5, 1.5, 400), np.round(rng.uniform(-1, 15, 400), 1)
    for size in (5, 6):
        got = np.array(packed.read_tile(packed.write_tile(ra, dec, mag, size))).T
        want = np.stack([ra, dec, mag], 1)
        assert np.allclose(got[np.lexsort(got.T[:1])], want[np.lexsort(want.T[:1])], atol=1e-6) and (np.diff(got[:, 2]) > -1e-9).all()
    lone = b"x".ljust(109) + bytes([5]) + b"\xff\xff\xff" + bytes([128, 17])
    assert len(packed.read_tile(lone)[0]) == 0 and len(packed.read_tile(b"short")[0]) == 0
    good = packed.write_all_sky(ra, dec, mag)
    bad = b"x".ljust(109) + b" " + b"\0" * 50
    files = spark.createDataFrame([("a", good), ("b", good[:-12]), ("c", b"")], "path string, content binary")
    rows = packed.stars(files, all_sky=True).groupBy("path", "status").count().collect()
    assert {(r["path"], r["count"]) for r in rows if r["status"] == "ok"} == {("a", 400)} and any(r["path"] == "b" and "declares 400" in r["status"] for r in rows)
    rows = packed.stars(spark.createDataFrame([("d", bad), ("e", lone)], "path string, content binary")).collect()
    assert [(r["path"], r["status"]) for r in rows] == [("d", "records of 11 bytes are not read")]


def test_orderings_of_near_ties(spark):
    cases = [([1.0, 2.0, 3.0, 4.0], 1), ([1.0, 1.01, 3.0, 4.0], 2), ([1.0, 1.0, 1.0, 1.0], 8), ([1.0, 2.0, 2.01, 2.02], 4), ([1.0, 1.01, 3.0, 3.01], 4)]
    df = spark.createDataFrame([(k, [3, 1, 0, 2], t) for k, (t, _) in enumerate(cases)], "k int, o array<int>, t array<double>")
    for r in df.select("k", P.orderings(F.col("o"), F.col("t")).alias("all")).collect():
        t, n = cases[r["k"]]
        want = [(3, 1, 0, 2)]
        for i in range(3):
            if t[i + 1] - t[i] <= 0.015 * t[i + 1]:
                for o in list(want):
                    swapped = list(o)
                    swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
                    want += [tuple(swapped)] if tuple(swapped) not in want else []
        assert {tuple(o) for o in r["all"]} == set(want) and len(r["all"]) == n


def test_polynomial_inverse(spark):
    cu, cv = [5.0, 3.0, 0.02, 1e-5, 2e-5, -1e-5], [-7.0, -0.02, 3.0, 2e-5, 0.0, 1e-5]
    df = spark.createDataFrame([(float(x), float(y)) for x in (-900, 0, 700) for y in (-500, 3, 1200)], "x double, y double")
    rows = df.select("x", "y", sphere.polynomial_inverse(cu, cv, sphere.polynomial(cu, "x", "y"), sphere.polynomial(cv, "x", "y")).alias("p")).collect()
    assert all(abs(r["p"]["x"] - r["x"]) < 1e-3 and abs(r["p"]["y"] - r["y"]) < 1e-3 for r in rows)
    assert df.select(sphere.polynomial_inverse([0.0, 1.0, 1.0], [0.0, 1.0, 1.0], "x", "y").alias("p")).first()["p"] is None


def test_costs_concerns_and_choices(spark):
    tiers = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.4)], "tier long, radius double")
    c = planning.cost(planning.tier_costs(spark, tiers, "d80"), 24).first()
    stars = 4_285_114 + 0.116 * (1_427_214 + 421_308)
    assert c["patterns"] == 4_428_404 + 3_639_264 + 1_185_086 and abs(c["bytes"] - (3140 + 120 + 24 * c["patterns"] + 12 * stars)) < 2
    assert abs(c["seconds"] - (13_777_880 + 4_121_724 + 2_006_011) * (1.06e-6 + 2.5e-6 / 24)) < 1e-6
    shallow = {r["radius"]: (r["patterns"], r["read"]) for r in planning.tier_costs(spark, tiers, "W08").collect()}
    assert shallow[0.1] == (55_000.0, 45_000.0)
    assert planning.concerns(0, 301, 10.0, None, 6.0) == ["it takes over five minutes", "it needs over half of the free memory"]
    assert planning.concerns(0, 0, 10.0, None, 11.0) == ["it needs more memory than is free"] and planning.concerns(0, 0) == []
    fields = spark.createDataFrame([(k, f) for k, f in enumerate((4.0, 0.1, 200.0, 10.0, 6.0))], "field_id long, deg double")
    assert [r["name"] for r in planning.select_database(spark, fields, "deg").orderBy("field_id").collect()] == ["d80", "d80", "w08", "g05", "d80"]


def test_text_of_results(spark):
    row = spark.range(1).select(text.csv_path(F.lit("/a.b/img")).alias("p"), text.csv_path(F.lit("x.tar.fits")).alias("q"), text.human_bytes(F.lit(3 * 10**12)).alias("b"), *[text.duration(F.lit(float(s))).alias(f"d{s}") for s in (9, 52, 58, 780, 5400)],
                                text.report(F.lit(2.345), F.lit(0)).alias("r"), text.least_snr(F.lit(0)).alias("s")).first()
    assert tuple(row) == ("/a.b/img.csv", "x.tar.csv", "3.0 TB", "under 10 s", "~50 s", "~1 min", "~13 min", "~1 h 30 min", "HFD_MEDIAN=21.47\nSTARS=0", 30.0)
    sip = spark.range(1).select(text.sip_keywords(*[F.array(*[F.lit(float(10 * n + k)) for k in range(10)]) for n in range(4)]).alias("s")).first()["s"]
    assert len(sip) == 44 and [k["key"] for k in sip[:4]] == ["A_ORDER", "A_0_0", "A_1_0", "A_0_1"] and [(k["key"], k["value"]) for k in sip[12:15]] == [("B_0_0", 10.0), ("B_0_1", 12.0), ("B_1_0", 11.0)]


def test_stars_near_wide_fields(spark):
    rng = np.random.default_rng(21)
    stars = [(k, float(rng.uniform(0, 2 * math.pi)), float(math.asin(rng.uniform(-1, 1)))) for k in range(300)]
    fields = [(0, 1.0, 0.2, 0.6), (1, 0.01, 1.5, 0.4), (2, 3.0, -1.2, 2.0), (3, 5.0, 0.0, 4.0)]
    got = {(r["field_id"], r["star_id"]) for r in catalogue_scan.stars_near(spark.createDataFrame(fields, "field_id long, ra double, dec double, r double"), spark.createDataFrame(stars, "star_id long, ra double, dec double"), "r").collect()}
    apart = lambda f, s: math.acos(max(-1, min(1, math.sin(f[2]) * math.sin(s[2]) + math.cos(f[2]) * math.cos(s[2]) * math.cos(f[1] - s[1]))))
    assert got == {(f[0], s[0]) for f in fields for s in stars if apart(f, s) <= f[3]}


def test_regions_equal_plain_suppression(spark):
    rng = np.random.default_rng(22)
    rows = [(float(rng.uniform(0, 2 * math.pi)), float(math.asin(rng.uniform(-1, 1))), float(np.exp(rng.uniform(-0.5, 0.5)))) for _ in range(400)]
    v = votes.sky_votes(spark.createDataFrame(rows, "ra double, dec double, scale double"), 0.2, 0.2)
    n = {tuple(r)[:3]: r["votes"] for r in v.collect()}
    round_ = lambda reach: {(k[0], k[1], k[2]): set() for k in n}
    keys = spark.createDataFrame([(*k, 1) for k in n], "band long, ra_bin long, s_bin long, votes long")
    near = {}
    for reach in (1, 2):
        near[reach] = round_(reach)
        for r in votes.neighbours(keys, 0.2, reach, 1).collect():
            near[reach][(r["band"], r["ra_bin"], r["s_bin"])].add((r["n_band"], r["n_ra"], r["n_s"]))
    ranked = []
    for k in n:
        there = [x for x in near[1][k] if x in n]
        ranked.append((-sum(n[x] for x in there), k, min(there, key=lambda x: (-n[x], x))))
    taken, want = set(), []
    for total, k, rep in sorted(ranked):
        if len(want) < 12 and k not in taken and rep not in taken:
            taken |= near[2][k] | near[1][rep]
            want.append((len(want), *k, *rep, -total))
    assert [tuple(r) for r in votes.regions(v, 0.2, 12).orderBy("place").collect()] == want


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fits").write_bytes(_fits(_image([(40.3, 50.7, 9000.0), (100.0, 80.0, 7000.0)])))
    assert cli.run(["-f", str(tmp_path / "a.fits"), "-analyse"], spark) == 0
    assert "STARS=2" in capsys.readouterr().out
    assert cli.run(["-f", str(tmp_path / "a.fits")], spark) == 2
    assert cli.run(["-f", str(tmp_path / "a.fits"), "-fov", "1"], spark) == 32


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "field_id long, star_id long, x double, y double, mag double, snr double, ra double, dec double")
    assert patterns.quads(none).count() == 0
    assert solve.solve_fields(none, none, 1.0, 0.2, 100, 100).count() == 0


def test_every_index_pattern_is_looked_up(spark, tmp_path):
    rng = np.random.default_rng(9)
    spark.createDataFrame([(int(k), float(p)) for k, p in zip(rng.permutation(80_000)[:20_000], rng.uniform(900, 2000, 20_000))], "p_partkey long, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    from skyloom.plans import catalogue

    anchors = {r["anchor"] for r in catalogue.queries()["i01_index_patterns"](spark, str(tmp_path)).collect()}
    found = {(r["probe"], r["anchor"]) for r in catalogue.queries()["j08_key_lookup"](spark, str(tmp_path)).collect()}
    assert any(a % 7 for a in anchors) and {(a, a) for a in anchors} <= found


def test_quads_of_sparse_fields(spark):
    from itertools import combinations

    rng = np.random.default_rng(12)
    stars = {n: rng.uniform(0, 1000, (n, 2)) for n in (4, 5, 6, 7, 8, 14, 15, 29, 30)}
    rows = lambda f: [(n, k, float(x), float(y)) for n, at in stars.items() for k, (x, y) in enumerate(at) if f(n, k)]
    points = spark.createDataFrame(rows(lambda n, k: True), "field_id long, star_id long, x double, y double")

    def brute(at, size):
        out = set()
        for i in range(len(at)) if size and len(at) >= size else ():
            near = sorted((((at[i] - at[j]) ** 2).sum(), j) for j in range(len(at)) if j != i and ((at[i] - at[j]) ** 2).sum() > 1)
            out |= {tuple(sorted(c)) for c in combinations([i] + [j for _, j in near[: size - 1]], 4)}
        return out

    def got(df):
        found = {n: [] for n in stars}
        for q in df.collect():
            found[q["field_id"]].append(tuple(q["ids"]))
        return found

    for df, size in ((patterns.quads(points), lambda n: patterns.group_size(n, n)), (patterns.quads(points, image=spark.createDataFrame(rows(lambda n, k: k < 6), points.schema)), lambda n: patterns.group_size(min(n, 6), n))):
        for n, ids in got(df).items():
            assert len(ids) == len(set(ids)) and set(ids) == brute(stars[n], size(n)), n
    assert {n for n, ids in got(patterns.quads(points)).items() if ids} == {6, 7, 8, 14, 15, 29, 30}


def test_small_fields_make_all_triangles(spark):
    from itertools import combinations

    rng = np.random.default_rng(13)
    rows = [(n, k, float(x), float(y)) for n in (2, 3, 12, 45, 46) for k, (x, y) in enumerate(rng.uniform(0, 1000, (n, 2)))]
    points = spark.createDataFrame(rows, "field_id long, star_id long, x double, y double")
    got = [(t["field_id"], *t["ids"]) for t in patterns.triangles(points).collect()]
    near = {(t["field_id"], *t["ids"]) for t in patterns.neighbour_triangles(points.where("field_id = 46")).collect()}
    assert len(got) == len(set(got)) and 0 < len(near) <= 46 * 21
    assert set(got) == near | {(n, *c) for n in (3, 12, 45) for c in combinations(range(n), 3)}
