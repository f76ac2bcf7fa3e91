"""Header cards, number formats and names as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cards(text: Column) -> Column:
    """A map from upper-case keyword to value text; the first card of a keyword counts.

    Cards stand on lines or run together, 80 characters each. A value ends at a slash outside quotes.
    """
    lines = F.when(F.contains(text, F.lit("\n")), F.split(text, "\r?\n")).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,80}"), F.lit(0)))
    key = lambda c: F.upper(F.regexp_extract(c, "^\\s*([A-Za-z0-9_-]{1,8})\\s*=", 1))
    value = lambda c: F.trim(F.regexp_extract(c, "^[^=]*=((?:[^/']|'[^']*')*)", 1))
    found = F.filter(F.transform(lines, lambda c: F.struct(key(c).alias("key"), value(c).alias("value"))), lambda s: s["key"] != "")
    first = F.filter(found, lambda s, i: F.array_position(F.transform(found, lambda t: t["key"]), s["key"]) == i + 1)
    return F.map_from_entries(first)


def raw(cards_: Column, key: str) -> Column:
    """The value text of a keyword."""
    return F.element_at(cards_, F.lit(key.upper()))


def number(cards_: Column, key: str) -> Column:
    """A finite number, in quotes or not, with E or D before the exponent; else null."""
    plain = F.translate(F.trim(F.regexp_replace(raw(cards_, key), "'", "")), "Dd", "EE")
    n = plain.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def pointing(cards_: Column) -> tuple[Column, Column]:
    """RA and DEC if both are numbers, else CRVAL1 and CRVAL2 (degrees)."""
    ra, dec, c1, c2 = (number(cards_, k) for k in ("RA", "DEC", "CRVAL1", "CRVAL2"))
    own, other = ra.isNotNull() & dec.isNotNull(), c1.isNotNull() & c2.isNotNull()
    return F.when(own, ra).when(other, c1), F.when(own, dec).when(other, c2)


def pointing_hint(ra_hours: Column, spd_degrees: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Where to look (radians): the caller's hours and south polar distance if either is given, else the file's degrees."""
    given = ra_hours.isNotNull() | spd_degrees.isNotNull()
    own = F.radians(F.least(F.lit(90), F.greatest(F.lit(-90), spd_degrees - 90)))
    return (F.when(given, F.coalesce(ra_hours * math.pi / 12, F.lit(0.0))).when(ra.isNotNull() & dec.isNotNull(), F.radians(ra)),
            F.when(given, F.coalesce(own, F.lit(0.0))).when(ra.isNotNull() & dec.isNotNull(), F.radians(dec)))


def pixel_scale(focal: Column, size: Column, binning: Column) -> Column:
    """Arc seconds a pixel, from focal length (mm) and pixel size (um); null outside 0.001 to 10,000."""
    scale = size * F.when(binning > 0, binning).otherwise(1.0) / focal * 206.265
    return F.when((focal > 0) & (size > 0) & scale.between(1e-3, 1e4), scale)


def header_wcs(cards_: Column) -> Column:
    """A tangent-plane solution from cards: needs the reference values and pixels and CD1_1; null else."""
    n = {k: number(cards_, k) for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")}
    ok = n["CD1_1"] != 0
    for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2"):
        ok = ok & n[k].isNotNull()
    fields = [F.radians(n["CRVAL1"]).alias("ra0"), F.radians(n["CRVAL2"]).alias("dec0"), n["CRPIX1"].alias("crpix1"), n["CRPIX2"].alias("crpix2")]
    fields += [F.coalesce(n[k], F.lit(0.0)).alias(k.lower()) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
    return F.when(ok, F.struct(*fields))


def exponent(c: Column) -> Column:
    """A number as ``m.12E+ddd``."""
    out = F.format_string("%.12E", c)
    return F.regexp_replace(out, "E([+-])([0-9]{2})$", "E$10$2")


def float_card(key: str, c: Column) -> Column:
    """An 80-character card of a number."""
    return F.rpad(F.concat(F.lit(f"{key:<8}= "), F.lpad(exponent(c), 20, " ")), 80, " ")


def string_card(key: str, c: Column) -> Column:
    return F.rpad(F.concat(F.lit(f"{key:<8}= '"), F.rpad(F.regexp_replace(c, "'", "''"), 8, " "), F.lit("'")), 80, " ")


def int_card(key: str, c: Column) -> Column:
    return F.rpad(F.concat(F.lit(f"{key:<8}= "), F.lpad(c.cast("string"), 20, " ")), 80, " ")


def logical_card(key: str, c: Column) -> Column:
    return F.rpad(F.concat(F.lit(f"{key:<8}= "), F.lpad(F.when(c, "T").otherwise("F"), 20, " ")), 80, " ")


def wcs_cards() -> Column:
    """The cards of a solution (columns of ``solve_fields``), in order, with END last."""
    numbers = [("CRPIX1", F.col("crpix1")), ("CRPIX2", F.col("crpix2")), ("CRVAL1", F.degrees("ra0")), ("CRVAL2", F.degrees("dec0")), ("CDELT1", F.col("cdelt1")), ("CDELT2", F.col("cdelt2")), ("CROTA2", F.col("crota2"))]
    numbers += [(k.upper(), F.col(k)) for k in ("cd1_1", "cd1_2", "cd2_1", "cd2_2")]
    head = [string_card("CTYPE1", F.lit("RA---TAN")), string_card("CTYPE2", F.lit("DEC--TAN")), string_card("CUNIT1", F.lit("deg")), string_card("CUNIT2", F.lit("deg"))]
    return F.array(*head, *[float_card(k, c) for k, c in numbers], logical_card("PLTSOLVD", F.lit(True)), F.rpad(F.lit("END"), 80, " "))


def plain_exponent(c: Column, digits: int = 13) -> Column:
    """A number as ``m.13Ee``, the exponent as short as it can be."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}E", c), "E[+]0?", "E"), "E-0", "E-")


def ini_text(stars: Column | None = None, cmdline: Column | None = None, warning: Column | None = None, crota1: Column | None = None) -> Column:
    """The summary of a solution as key=value lines; NQUADS holds the matched stars, as readers of such files expect."""
    line = lambda key, value: F.concat(F.lit(f"{key}="), value)
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    out = [F.lit("PLTSOLVD=T"), line("CRPIX1", plain_exponent(F.col("crpix1"))), line("CRPIX2", plain_exponent(F.col("crpix2")))]
    out += [line("CRVAL1", fixed(F.degrees("ra0"), 9)), line("CRVAL2", fixed(F.degrees("dec0"), 9)), line("CDELT1", plain_exponent(F.col("cdelt1"))), line("CDELT2", plain_exponent(F.col("cdelt2")))]
    out += [line("CROTA1", fixed(F.col("crota2") if crota1 is None else crota1, 4)), line("CROTA2", fixed(F.col("crota2"), 4))]
    out += [line(k.upper(), plain_exponent(F.col(k))) for k in ("cd1_1", "cd1_2", "cd2_1", "cd2_2")]
    out.append(line("CMDLINE", F.lit("") if cmdline is None else cmdline))
    if warning is not None:
        out.append(F.when(warning.isNotNull(), line("WARNING", warning)))
    out += [line("NSTARS", (F.col("stars_matched") if stars is None else stars).cast("string")), line("NQUADS", F.col("stars_matched").cast("string")), line("RMS", fixed(F.col("rms"), 4))]
    return F.concat_ws("\n", *out)


#: Order and terms of the polynomials; the B block names its linear terms the other way round (fixed values).
SIP_ORDER, SIP_TERMS = 3, ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))


def sip_keywords(a: Column, b: Column, ap: Column, bp: Column) -> Column:
    """An array of (key, value) of a SIP solution, from its four arrays of coefficients in the order of ``SIP_TERMS``."""
    out = []
    for name, values in (("A", a), ("B", b), ("AP", ap), ("BP", bp)):
        places = [0, 2, 1, *range(3, 10)] if name == "B" else range(10)
        out.append(F.struct(F.lit(f"{name}_ORDER").alias("key"), F.lit(float(SIP_ORDER)).alias("value")))
        out += [F.struct(F.lit(f"{name}_{SIP_TERMS[k][0]}_{SIP_TERMS[k][1]}").alias("key"), F.get(values, k).alias("value")) for k in places]
    return F.array(*out)


def report(hfd: Column, stars: Column) -> Column:
    """The two lines of an analysis; without stars the size is 21.47 (fixed value)."""
    return F.concat(F.lit("HFD_MEDIAN="), F.when(stars > 0, F.format_string("%.2f", hfd)).otherwise("21.47"), F.lit("\nSTARS="), stars.cast("string"))


def least_snr(given: Column) -> Column:
    """The least signal to noise; 0 stands for the default of 30."""
    return F.when(given == 0, 30.0).otherwise(given.cast("double"))


#: The first line of a star list, whatever columns follow (fixed value).
STAR_HEADER = "x,y,hfd,snr,flux,ra[0..360],dec[0..360]"


def star_line(x: Column, y: Column, hfd: Column, snr: Column, flux: Column, ra: Column | None = None, dec: Column | None = None) -> Column:
    """A star as CSV, pixels from 1; SNR and flux round half to even; with a solution its place (radians) in degrees."""
    form = lambda c, n: F.format_string(f"%.{n}f", c)
    whole = lambda c: F.rint(c).cast("long").cast("string")
    sky = [] if ra is None else [form(F.degrees(ra), 8), form(F.degrees(dec), 8)]
    return F.concat_ws(",", form(x + 1, 4), form(y + 1, 4), form(hfd, 4), whole(snr), whole(flux), *sky)


def ra_text(ra: Column) -> Column:
    """Hours, minutes and tenths of seconds; rounding carries over, and 24 hours are 0."""
    t = (F.floor(ra * 12 / math.pi * 36000 + 0.5).cast("long")) % 864000
    return F.format_string("%02d %02d %02d.%d", F.floor(t / 36000), F.floor(t / 600) % 60, F.floor(t / 10) % 60, t % 10)


def dec_text(dec: Column) -> Column:
    """Degrees, minutes and seconds with a sign."""
    t = F.floor(F.abs(dec) * 180 / math.pi * 3600 + 0.5).cast("long")
    return F.concat(F.when(dec < 0, "-").otherwise("+"), F.format_string("%02d %02d %02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60))


def human_bytes(n: Column) -> Column:
    """Bytes with a decimal unit."""
    one = lambda d, unit: F.concat(F.format_string("%.1f", n / d), F.lit(unit))
    return F.when(n < 10**3, F.concat(n.cast("string"), F.lit(" B"))).when(n < 10**6, one(1e3, " kB")).when(n < 10**9, one(1e6, " MB")).when(n < 10**12, one(1e9, " GB")).otherwise(one(1e12, " TB"))


def duration(seconds: Column) -> Column:
    """A duration as people say it."""
    nearest = lambda c: F.floor(c + 0.5).cast("long")
    minutes = nearest(seconds / 60)
    return (F.when(seconds < 10, "under 10 s").when(seconds < 55, F.format_string("~%d s", nearest(seconds / 5) * 5))
            .when(seconds < 3600, F.format_string("~%d min", F.greatest(minutes, F.lit(1)))).otherwise(F.format_string("~%d h %d min", F.floor(minutes / 60), minutes % 60)))


def exit_code(hfd: Column, n: Column) -> Column:
    """Median size and number of stars in one whole number, as 32 bits."""
    v = F.rint(hfd * 100).cast("long") * 1_000_000 + n.cast("long")
    return (F.pmod(v + 2**31, F.lit(2**32)) - 2**31).cast("int")


def scale_warning(assumed: Column, solved: Column, height: Column) -> Column:
    """A warning if the scale that a solve started from is more than 5 % off the solved one; null else (fixed text)."""
    ratio = assumed / F.nullif(solved, F.lit(0.0))
    off = F.abs(ratio - 1) > 0.05
    return F.when(off, F.format_string("Warning scale was inaccurate! Set FOV=%.2fd, scale=%.1f\"", solved * height / 3600.0, solved))


def csv_path(image: Column) -> Column:
    """An image's path with the ending .csv."""
    return F.concat(F.regexp_replace(image, "\\.[^./]*$", ""), F.lit(".csv"))
