"""Results as text: card files, summaries, star lists, and headers brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import text

#: Keywords of an older solution, which a new one replaces.
STALE = ("CTYPE1", "CTYPE2", "CUNIT1", "CUNIT2", "CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CDELT1", "CDELT2", "CROTA1", "CROTA2", "PLTSOLVD")
STALE_PATTERN = "^(CD|PC)[0-9]_[0-9]$|^(A|B|AP|BP)_(ORDER|[0-9]_[0-9])$"


def wcs_files(solutions: DataFrame) -> DataFrame:
    """One row a card, in order: (field_id, place, card)."""
    return solutions.select("field_id", F.posexplode(text.wcs_cards()).alias("place", "card"))


def summaries(solutions: DataFrame, all_fields: DataFrame, cmdline: str = "") -> DataFrame:
    """The key=value summary of each field; unsolved ones say so, with the command line."""
    met = all_fields.select("field_id").join(solutions, "field_id", "left")
    unsolved = F.lit("PLTSOLVD=F" + (f"\nCMDLINE={cmdline}" if cmdline else ""))
    return met.select("field_id", F.when(F.col("ra0").isNotNull(), text.ini_text(cmdline=F.lit(cmdline))).otherwise(unsolved).alias("ini"))


def star_csv(stars: DataFrame) -> DataFrame:
    """The lines of a star list with a header row first: (image_id, place, line)."""
    sky = [F.col("ra"), F.col("dec")] if {"ra", "dec"} <= set(stars.columns) else []
    line = text.star_line(F.col("x"), F.col("y"), F.col("hfd"), F.col("snr"), F.col("flux"), *sky)
    rows = stars.select("image_id", F.col("star_id").alias("place"), line.alias("line"))
    heads = stars.select("image_id").distinct().select("image_id", F.lit(0).cast("long").alias("place"), F.lit(text.STAR_HEADER).alias("line"))
    return heads.unionByName(rows)


def updated_headers(cards: DataFrame, solutions: DataFrame) -> DataFrame:
    """Cards (field_id, place, card) without any older solution, followed by the new one's."""
    key = F.trim(F.substring("card", 1, 8))
    kept = cards.where(~key.isin(*STALE) & ~key.rlike(STALE_PATTERN) & (key != "END"))
    unsolved = cards.join(solutions.select("field_id"), "field_id", "left_anti")
    kept = kept.join(solutions.select("field_id"), "field_id", "left_semi")
    new = wcs_files(solutions).withColumn("place", F.col("place") + 1_000_000)
    return kept.unionByName(new).unionByName(unsolved)
