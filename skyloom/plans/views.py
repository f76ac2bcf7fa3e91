"""Sky data derived from the driver's tables, by SQL that means the same in Spark and DuckDB.

Positions come from a quadratic hash of a key, which scatters like random points; a lattice would
give every star the same neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Centre of the patch of sky, and the frame that sees it.
RA0, DEC0, SIDE = 1.5, 0.3, 0.04
WIDTH, HEIGHT, SCALE, TURN = 3000, 3000, 3.0, 0.35


_REDUCED: dict[str, str] = {}


def u(key: str, a: int, b: int, c: int) -> str:
    """A value in [0, 1) for a whole-number key; keys repeat their values after 89,989, a prime.

    With the largest ``a`` the product passes 64 bits for keys that leave 86,702 or more; ``_REDUCED`` has the
    same value with the square reduced first, which can't, and that is what Spark computes.
    """
    k = f"(({key}) % 89989)"
    text = f"(({k}*{k}*{a} + {k}*{b} + {c}) % 2147483647) / 2147483647e0"
    _REDUCED[text] = f"(({k}*{k} % 2147483647 * {a} + {k}*{b} + {c}) % 2147483647) / 2147483647e0"
    return text


U1, U2, U3, U4 = (u("p_partkey", *k) for k in ((1103515245, 12345, 678901), (950706376, 16807, 424242), (742938285, 39373, 99991), (1226874159, 48271, 31337)))

#: field_id tells apart images of the same patch, fifty stars each, so that their number grows with the table.
FIELD_STARS = f"""SELECT CAST(floor(p_partkey / 50e0) AS BIGINT) AS field_id, CAST(p_partkey AS BIGINT) AS star_id,
  {RA0}e0 + {SIDE}e0 * ({U1} - 0.5e0) AS ra, {DEC0}e0 + {SIDE}e0 * ({U2} - 0.5e0) AS dec, floor(p_retailprice * 10 + 0.5e0) / 1000e0 AS mag FROM part"""
SKY_STARS = f"""SELECT CAST(p_partkey AS BIGINT) AS star_id, 2e0 * pi() * {U1} AS ra, asin(2e0 * {U2} - 1e0) AS dec,
  floor(p_retailprice * 10 + 0.5e0) / 1000e0 AS mag FROM part"""
#: Images a hundred pixels wide, one for each 5,000 events.
PIXELS = """SELECT CAST(floor(event_id / 5000e0) AS BIGINT) AS image_id, CAST(event_id % 100 AS INT) AS x, CAST(floor((event_id % 5000) / 100e0) AS INT) AS y,
  CAST(floor(value * 10) AS DOUBLE) AS v FROM events"""
HYPOTHESES = f"""SELECT CAST(o_orderkey AS BIGINT) AS hyp_id, 2e0 * pi() * {u('CAST(floor(o_orderkey / 37e0) AS BIGINT)', 1103515245, 12345, 678901)} AS ra,
  asin(2e0 * {u('CAST(floor(o_orderkey / 37e0) AS BIGINT)', 950706376, 16807, 424242)} - 1e0) AS dec, exp(2e0 * {u('CAST(floor(o_orderkey / 37e0) AS BIGINT)', 742938285, 39373, 99991)} - 1e0) AS scale FROM orders"""
FIELDS = f"""SELECT CAST(s_suppkey AS BIGINT) AS field_id, 2e0 * pi() * {u('s_suppkey', 1103515245, 12345, 678901)} AS ra,
  asin(2e0 * {u('s_suppkey', 950706376, 16807, 424242)} - 1e0) AS dec, 0.01e0 + 0.2e0 * {u('s_suppkey', 742938285, 39373, 99991)} AS fov FROM supplier"""
HEADERS = """SELECT CAST(c_custkey AS BIGINT) AS file_id,
  'RA      = ' || CASE WHEN c_custkey % 5 = 0 THEN '''none''' ELSE CAST(c_custkey % 360 AS VARCHAR(9)) || '.5' END || ' / degrees' AS card_ra,
  'FOCALLEN= ' || CAST(400 + c_custkey % 1000 AS VARCHAR(9)) || '.0D0 / mm' AS card_focal,
  'XPIXSZ  = ''3.76'' / um' AS card_pixel FROM customer"""
_STD = f"""SELECT field_id, star_id, mag,
  -cos(dec) * sin(ra - {RA0}e0) / ((cos({DEC0}e0) * cos(dec) * cos(ra - {RA0}e0) + sin({DEC0}e0) * sin(dec)) * (pi() / 648000e0)) AS x,
  (cos({DEC0}e0) * sin(dec) - sin({DEC0}e0) * cos(dec) * cos(ra - {RA0}e0)) / ((cos({DEC0}e0) * cos(dec) * cos(ra - {RA0}e0) + sin({DEC0}e0) * sin(dec)) * (pi() / 648000e0)) AS y
  FROM field_stars"""
_J1, _J2 = u("star_id", 1226874159, 48271, 31337), u("star_id", 742938285, 39373, 99991)
#: The frame: rotated, mirrored, 3 arc seconds a pixel, with jitter; a fifth of the stars isn't seen.
DETECTIONS = f"""SELECT field_id, star_id,
  1500e0 + (x * cos({TURN}e0) - y * sin({TURN}e0)) / {SCALE}e0 + 0.1e0 * ({_J1} - 0.5e0) AS x,
  1500e0 - (x * sin({TURN}e0) + y * cos({TURN}e0)) / {SCALE}e0 + 0.1e0 * ({_J2} - 0.5e0) AS y,
  1000e0 - mag AS snr, 2e0 + {_J1} AS hfd FROM std_stars WHERE star_id % 5 <> 0"""
VIEWS = {"field_stars": FIELD_STARS, "sky_stars": SKY_STARS, "std_stars": _STD, "detections": DETECTIONS, "pixels": PIXELS, "hypotheses": HYPOTHESES, "fields": FIELDS, "headers": HEADERS}
_NEEDS = {"std_stars": ["field_stars"], "detections": ["field_stars", "std_stars"]}


def sql_with(names: list[str], body: str) -> str:
    """A query for DuckDB with these views as common table expressions."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*_NEEDS.get(n, ()), n) if x not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" + (", " + body[5:] if body.lstrip().upper().startswith("WITH ") and not body.startswith(" ") else body)


def _in_spark(name: str) -> str:
    sql = VIEWS[name]
    for text, reduced in _REDUCED.items():
        sql = sql.replace(text, reduced)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view as a DataFrame."""
    base = {"pixels": "events", "field_stars": "part", "sky_stars": "part", "hypotheses": "orders", "fields": "supplier", "headers": "customer"}
    if name in base:
        return spark.sql(_in_spark(name).replace(f"FROM {base[name]}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{base[name]}.parquet"))
    of = _NEEDS[name][-1]
    return spark.sql(_in_spark(name).replace(f"FROM {of}", "FROM {src}"), src=view(spark, sf_dir, of))
