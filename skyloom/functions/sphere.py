"""Spherical geometry, tangent planes and world coordinates as column expressions.

Angles are radians; standard coordinates are arc seconds with x pointing west; CD matrices are
degrees per pixel; pixels of world coordinates count from 1. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_OF_ARC = math.pi / 648000.0
#: Exponents of (u, v) in the order in which polynomial coefficients are kept (fixed values).
TERMS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def pmod(x: Column, y: float) -> Column:
    """The remainder with the sign of ``y``."""
    return F.pmod(x, F.lit(float(y)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def gnomonic(ra0, dec0, ra, dec, cdelt: float = 1.0) -> tuple[Column, Column]:
    """Sky to standard coordinates about (ra0, dec0)."""
    ra0, dec0, ra, dec = map(col, (ra0, dec0, ra, dec))
    dra = ra - ra0
    depth = (F.cos(dec0) * F.cos(dec) * F.cos(dra) + F.sin(dec0) * F.sin(dec)) * (SECOND_OF_ARC * cdelt)
    return -F.cos(dec) * F.sin(dra) / depth, (F.cos(dec0) * F.sin(dec) - F.sin(dec0) * F.cos(dec) * F.cos(dra)) / depth


def inverse_gnomonic(ra0, dec0, x, y, cdelt: float = 1.0) -> tuple[Column, Column]:
    """Standard coordinates to sky, right ascension in [0, 2 pi)."""
    ra0, dec0 = col(ra0), col(dec0)
    xs, ys = col(x) * (SECOND_OF_ARC * cdelt), col(y) * (SECOND_OF_ARC * cdelt)
    ra = ra0 + F.atan2(-xs, F.cos(dec0) - ys * F.sin(dec0))
    dec = F.asin((F.sin(dec0) + ys * F.cos(dec0)) / F.sqrt(1 + xs * xs + ys * ys))
    return pmod(ra, 2 * math.pi), dec


def separation(ra1, dec1, ra2, dec2) -> Column:
    """The angle between two directions."""
    ra1, dec1, ra2, dec2 = map(col, (ra1, dec1, ra2, dec2))
    return F.acos(clamp(F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(ra1 - ra2), -1.0, 1.0))


def unit(ra, dec) -> tuple[Column, Column, Column]:
    """The direction as a unit vector."""
    ra, dec = col(ra), col(dec)
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def tangent_project(ra0, dec0, ra, dec) -> tuple[Column, Column]:
    """Plane coordinates in radians, east positive; null behind the plane."""
    ra0, dec0, ra, dec = map(col, (ra0, dec0, ra, dec))
    depth = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(ra - ra0)
    seen = depth > 1e-9
    xi = F.cos(dec) * F.sin(ra - ra0) / depth
    eta = (F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(ra - ra0)) / depth
    return F.when(seen, xi), F.when(seen, eta)


def tangent_deproject(ra0, dec0, xi, eta) -> tuple[Column, Column]:
    """Plane coordinates back to the sky."""
    ra0, dec0, xi, eta = map(col, (ra0, dec0, xi, eta))
    depth = F.cos(dec0) - eta * F.sin(dec0)
    norm = F.sqrt(1 + xi * xi + eta * eta)
    return pmod(ra0 + F.atan2(xi, depth), 2 * math.pi), F.asin(clamp((F.sin(dec0) + eta * F.cos(dec0)) / norm, -1.0, 1.0))


def polynomial(coefficients: list[float], u: Column, v: Column) -> Column:
    """A polynomial of up to ten terms; terms that are zero are left out."""
    out = F.lit(0.0)
    for c, (p, q) in zip(coefficients, TERMS):
        if c:
            term = F.lit(float(c))
            for factor, times in ((u, p), (v, q)):
                for _ in range(times):
                    term = term * factor
            out = out + term
    return out


def pixel_to_sky(wcs: dict, x, y) -> tuple[Column, Column]:
    """1-based pixels to sky. ``wcs``: ra0, dec0, crpix1, crpix2, cd (four values), a and b (optional)."""
    u, v = col(x) - wcs["crpix1"], col(y) - wcs["crpix2"]
    if wcs.get("a"):
        u, v = u + polynomial(wcs["a"], u, v), v + polynomial(wcs["b"], u, v)
    cd = wcs["cd"]
    xi, eta = F.radians(cd[0] * u + cd[1] * v), F.radians(cd[2] * u + cd[3] * v)
    sin0, cos0 = math.sin(wcs["dec0"]), math.cos(wcs["dec0"])
    depth = F.lit(cos0) - eta * sin0
    return pmod(wcs["ra0"] + F.atan2(xi, depth), 2 * math.pi), F.atan2(sin0 + eta * cos0, F.hypot(depth, xi))


def sky_to_pixel(wcs: dict, ra, dec) -> tuple[Column, Column]:
    """Sky to 1-based pixels; null on the far half of the sky or for a singular matrix."""
    ra, dec = col(ra), col(dec)
    a, b, c, d = wcs["cd"]
    det = a * d - b * c
    sin0, cos0 = math.sin(wcs["dec0"]), math.cos(wcs["dec0"])
    dra = ra - wcs["ra0"]
    depth = F.sin(dec) * sin0 + F.cos(dec) * cos0 * F.cos(dra)
    xi = F.degrees(F.cos(dec) * F.sin(dra) / depth)
    eta = F.degrees((F.sin(dec) * cos0 - F.cos(dec) * sin0 * F.cos(dra)) / depth)
    ok = (depth > 0) & F.lit(det != 0)
    u, v = (d * xi - b * eta) / (det or 1.0), (a * eta - c * xi) / (det or 1.0)
    if wcs.get("ap"):
        u, v = u + polynomial(wcs["ap"], u, v), v + polynomial(wcs["bp"], u, v)
    return F.when(ok, u + wcs["crpix1"]), F.when(ok, v + wcs["crpix2"])


def old_style(cd11, cd12, cd21, cd22) -> dict[str, Column]:
    """Scales and rotations (degrees) of a CD matrix; a mirrored frame has a negative first scale."""
    cd11, cd12, cd21, cd22 = map(col, (cd11, cd12, cd21, cd22))
    sign = F.when(cd11 * cd22 - cd12 * cd21 < 0, -1.0).otherwise(1.0)
    cdelt1 = sign * F.hypot(cd11, cd12)
    return {
        "cdelt1": cdelt1,
        "cdelt2": F.hypot(cd21, cd22),
        "crota2": F.degrees(F.atan2(sign * cd21, cd22)),
        "crota1": F.when(cdelt1 == 0, 0.0).otherwise(F.degrees(F.atan2(-cd12 / (cdelt1 * sign), cd11 / cdelt1))),
    }


def wcs_of_plate(ra_db, dec_db, plate: Column, width: int, height: int) -> dict[str, Column]:
    """Reference point, CD matrix and old-style keywords of a linear plate (fields a..f)."""
    cx, cy = (width - 1) / 2, (height - 1) / 2
    ra0, dec0 = inverse_gnomonic(ra_db, dec_db, plate["a"] * cx + plate["b"] * cy + plate["c"], plate["d"] * cx + plate["e"] * cy + plate["f"])
    cd = [-plate["a"] / 3600, -plate["b"] / 3600, plate["d"] / 3600, plate["e"] / 3600]
    out = {"ra0": ra0, "dec0": dec0, "crpix1": F.lit(cx + 1), "crpix2": F.lit(cy + 1)}
    return out | dict(zip(("cd1_1", "cd1_2", "cd2_1", "cd2_2"), cd)) | {k: v for k, v in old_style(*cd).items() if k != "crota1"}


def anisotropy(a, b, d, e) -> Column:
    """The ratio of a matrix's singular values; null if it is singular."""
    a, b, d, e = map(col, (a, b, d, e))
    q, r = F.hypot((a + e) / 2, (d - b) / 2), F.hypot((a - e) / 2, (d + b) / 2)
    small = F.abs(q - r)
    return F.when(small > 0, (q + r) / small)


def shape_error(m0, m1, m3, m4) -> Column:
    """How far an affine map is from a similarity."""
    m0, m1, m3, m4 = map(col, (m0, m1, m3, m4))
    c1, c2 = F.hypot(m0, m3), F.hypot(m1, m4)
    return F.when((c1 > 0) & (c2 > 0), F.greatest(F.abs(m0 * m1 + m3 * m4) / (c1 * c2), F.abs(c1 / c2 - 1)))


def inverse_affine(a, b, c, d, e, f) -> dict[str, Column]:
    """The inverse of (a, b, c; d, e, f); null if it is singular."""
    a, b, c, d, e, f = map(col, (a, b, c, d, e, f))
    det = a * e - b * d
    ok = F.abs(det) >= 1e-300
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    out = {"ia": ia, "ib": ib, "ic": -(ia * c + ib * f), "id": id_, "ie": ie, "if": -(id_ * c + ie * f)}
    return {k: F.when(ok, v) for k, v in out.items()}


def spiral(index) -> tuple[Column, Column]:
    """The grid position of a step of an outward square spiral."""
    i = col(index).cast("long")
    root = F.floor(F.sqrt(i.cast("double")))
    k = F.floor((root + 1) / 2)
    past = i - (2 * k - 1) * (2 * k - 1)
    side, t = F.floor(past / (2 * k)), past % (2 * k)
    x = F.when(side == 0, k).when(side == 1, k - 1 - t).when(side == 2, -k).otherwise(1 - k + t)
    y = F.when(side == 0, 1 - k + t).when(side == 1, k).when(side == 2, k - 1 - t).otherwise(-k)
    return F.when(i == 0, 0).otherwise(x).cast("long"), F.when(i == 0, 0).otherwise(y).cast("long")


def least_stars(n) -> Column:
    """How many stars must be verified, of ``n``."""
    return F.least(F.lit(30), F.greatest(F.lit(10), F.ceil(col(n) * 0.15))).cast("long")


def f_statistic(rss_lo, rss_hi, terms_lo: int, terms_hi: int, n) -> Column:
    """F of two nested fits of both axes, with one degree of freedom at least; a perfect fit is infinitely better, or as good."""
    lo, hi = col(rss_lo), col(rss_hi)
    dof1, dof2 = 2 * (terms_hi - terms_lo), F.greatest(2 * (col(n) - terms_hi), F.lit(1))
    return F.when(hi > 0, ((lo - hi) / dof1) / (hi / dof2)).when(lo > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def round_root(n) -> Column:
    """The whole number nearest to the square root of a whole number, exactly."""
    n = col(n).cast("long")
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return r + F.when(n > r * r + r, 1).otherwise(0).cast("long")


def fast_atan2(y, x) -> Column:
    """The angle of (x, y) to 0.0026 radians, from a rational approximation of the arc tangent."""
    x, y = col(x), col(y)
    z = y / F.when(x != 0, x)
    low = lambda t: t / (1 + 0.28125 * t * t)
    flat = F.when(F.abs(z) <= 1, low(z)).otherwise(F.signum(z) * (math.pi / 2) - low(1 / z))
    return F.when(x == 0, F.signum(y) * (math.pi / 2)).when(x < 0, flat + F.when(y >= 0, math.pi).otherwise(-math.pi)).otherwise(flat)


def polynomial(coefficients: list[float], x, y) -> Column:
    """The value of a polynomial with coefficients in the order of ``TERMS``."""
    x, y = col(x), col(y)
    power = lambda v, n: F.lit(1.0) if n == 0 else v * power(v, n - 1)
    out = F.lit(0.0)
    for c, (p, q) in zip(coefficients, TERMS):
        if c:
            out = out + float(c) * power(x, p) * power(y, q)
    return out


def polynomial_inverse(cu: list[float], cv: list[float], u, v, rounds: int = 12, settled: float = 1e-4) -> Column:
    """The point (x, y) that a pair of polynomials takes to (u, v), by steps of the inverse linear part.

    Null if that part is singular or ``rounds`` steps don't settle. The rounds are one aggregate over a sequence.
    """
    u, v = col(u), col(v)
    (c, a, b), (f, d, e) = cu[:3], cv[:3]
    det = a * e - b * d
    if abs(det) < 1e-12 or not math.isfinite(det):
        return F.lit(None).cast("struct<x:double,y:double>")
    step = lambda du, dv: ((e * du - b * dv) / det, (a * dv - d * du) / det)
    x, y = step(u - c, v - f)
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(len(cu) <= 3).alias("done"))

    def turn(s: Column, _: Column) -> Column:
        dx, dy = step(u - polynomial(cu, s["x"], s["y"]), v - polynomial(cv, s["x"], s["y"]))
        moved = F.struct((s["x"] + dx).alias("x"), (s["y"] + dy).alias("y"), (F.abs(dx) + F.abs(dy) < settled).alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.when(s["done"], F.struct(s["x"].alias("x"), s["y"].alias("y"))))


def star_of_integers(x, y, z) -> tuple[Column, Column]:
    """A direction from three unsigned 32-bit numbers that span -1 to 1."""
    x, y, z = (col(c) / ((2**32 - 1) / 2) - 1 for c in (x, y, z))
    return pmod(F.atan2(y, x), 2 * math.pi), F.atan2(z, F.sqrt(x * x + y * y))


def code_of_integer(u, low: float, scale: float) -> Column:
    """A code's value from its unsigned 16-bit number."""
    return low + col(u) / scale


def move_plane(ra0, dec0, ra1, dec1, x, y) -> tuple[Column, Column]:
    """X11: standard coordinates about one centre to those about another."""
    ra, dec = inverse_gnomonic(ra0, dec0, x, y)
    return gnomonic(ra1, dec1, ra, dec)
