"""Star catalogues in packed files: sky tiles of five or six byte records, and the all-sky list.

Files come as a table (path, content), a file a row; a tile holds at most some hundred thousand stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HEADER, GROUP = 110, 0xFFFFFF
RA_UNIT, DEC_UNIT = 2 * math.pi / (2**24 - 1), math.pi / 2 / (2**23 - 1)
STARS = "path string, status string, place long, ra double, dec double, mag double"


class BadCatalogue(ValueError):
    pass


def record_size(content: bytes) -> int:
    """Bytes a record, from the header's last byte; 5, or 6 with a colour."""
    size = 11 if content[HEADER - 1 : HEADER] == b" " else content[HEADER - 1]
    if size not in (5, 6):
        raise BadCatalogue(f"records of {size} bytes are not read")
    return size


def read_tile(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right ascension, declination and magnitude of a tile's stars, in the order of the file.

    A group's header gives the high byte of the declination and the magnitude of the stars that follow.
    """
    if len(content) < HEADER:
        return (np.empty(0),) * 3
    size = record_size(content)
    n = (len(content) - HEADER) // size
    r = np.frombuffer(content, np.uint8, n * size, HEADER).reshape(n, size).astype(np.int64)
    ra = r[:, 0] | r[:, 1] << 8 | r[:, 2] << 16
    heads = ra == GROUP
    own = np.maximum.accumulate(np.where(heads, np.arange(n), -1))
    high = np.where(own >= 0, r[own, 3] - 128, 0)
    mag = np.where(own >= 0, (r[own, 4] - 16) / 10.0, 0.0)
    dec = high << 16 | r[:, 4] << 8 | r[:, 3]
    star = ~heads
    return ra[star] * RA_UNIT, dec[star] * DEC_UNIT, mag[star]


def write_tile(ra: np.ndarray, dec: np.ndarray, mag: np.ndarray, size: int = 5) -> bytes:
    """The bytes of a tile: stars by magnitude in steps of a tenth, each step by the declination's high byte."""
    tenth = np.floor(mag * 10 + 0.5).astype(np.int64) + 16
    a, d = np.floor(ra / RA_UNIT + 0.5).astype(np.int64) % GROUP, np.floor(dec / DEC_UNIT + 0.5).astype(np.int64)
    out, last = bytearray(b"packed".ljust(HEADER - 1) + bytes([size])), None
    tail = b"\0" * (size - 5)
    for k in np.lexsort((a, d, d >> 16, tenth)):
        group = (int(tenth[k]), int(d[k] >> 16))
        if group != last:
            out += b"\xff\xff\xff" + bytes([group[1] + 128, group[0]]) + tail
            last = group
        out += int(a[k]).to_bytes(3, "little") + int(d[k] & 0xFFFF).to_bytes(2, "little") + tail
    return bytes(out)


def read_all_sky(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A count, then magnitude times ten, right ascension and declination as 32-bit floats; the count must match."""
    if len(content) < 4:
        return (np.empty(0),) * 3
    declared, there = int.from_bytes(content[:4], "little"), (len(content) - 4) // 12
    if declared != there:
        raise BadCatalogue(f"the header declares {declared} stars but the file holds {there}")
    r = np.frombuffer(content, "<f4", there * 3, 4).reshape(there, 3).astype(np.float64)
    return r[:, 1], r[:, 2], r[:, 0] / 10.0


def write_all_sky(ra: np.ndarray, dec: np.ndarray, mag: np.ndarray) -> bytes:
    """The brightest first."""
    order = np.argsort(mag, kind="stable")
    rows = np.stack([mag[order] * 10, ra[order], dec[order]], 1).astype("<f4")
    return len(rows).to_bytes(4, "little") + rows.tobytes()


def stars(files: DataFrame, all_sky: bool = False) -> DataFrame:
    """The stars of packed files (path, content), with their place in the file; a bad file is one row with its status."""
    reader = read_all_sky if all_sky else read_tile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    ra, dec, mag = reader(bytes(content))
                except (BadCatalogue, IndexError, OverflowError) as e:
                    yield pd.DataFrame({"path": [path], "status": [str(e)], "place": [None], "ra": [None], "dec": [None], "mag": [None]})
                    continue
                yield pd.DataFrame({"path": path, "status": "ok", "place": np.arange(len(ra)), "ra": ra, "dec": dec, "mag": mag})

    return files.select("path", "content").mapInPandas(run, STARS)


def files(rows: DataFrame, by: str, all_sky: bool = False) -> DataFrame:
    """(path, content) of packed files, one for each value of ``by``. ``rows``: ra, dec, mag."""
    writer = write_all_sky if all_sky else write_tile

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mag", "ra", "dec"])
        return pd.DataFrame({"path": [str(pdf[by].iloc[0])], "content": [writer(*(pdf[c].to_numpy(float) for c in ("ra", "dec", "mag")))]})

    return rows.select(by, "ra", "dec", "mag").groupBy(by).applyInPandas(one, "path string, content binary")
