"""Image files as tables: detection by leading bytes, header projections, and decoders for FITS, PNG, TIFF, XISF and ASDF.

``images`` reads pixels; ``headers`` reads cards only and never decodes pixels. A file that can't be
read is one row with a ``status``, not a failed job. JPEG needs a decoder that isn't part of the
standard environment; such files get a status that says so.
"""

from __future__ import annotations

import bz2
import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import text

MAX_PIXELS = 1 << 30
SCHEMA = "path string, status string, width int, height int, channels int, data array<float>, cards string"

#: Leading bytes of containers (fixed values).
MAGIC = (
    ("xisf", b"XISF0100"), ("asdf", b"#ASDF "), ("jpeg", b"\xff\xd8\xff"), ("png", b"\x89PNG\r\n\x1a\n"),
    ("tiff", b"II*\x00"), ("tiff", b"MM\x00*"), ("tiff", b"II+\x00"), ("tiff", b"MM\x00+"), ("fits", b"SIMPLE  ="),
    ("fits.gz", b"\x1f\x8b"), ("fits.bz2", b"BZh"), ("fits.z", b"\x1f\x9d"),
)


def format_of(content: Column) -> Column:
    """The container by its leading bytes, never by the file's name; null if none fits."""
    out = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(magic)) == F.lit(bytearray(magic)), name).otherwise(out)
    return out


def sniff(content: bytes) -> str | None:
    return next((name for name, magic in MAGIC if content.startswith(magic)), None)


class BadFile(ValueError):
    pass


def checked(width: int, height: int, channels: int = 1) -> None:
    """Refuses images beyond 2**30 samples before anything is decoded."""
    if min(width, height, channels) < 1 or width * height * channels > MAX_PIXELS:
        raise BadFile(f"{width} x {height} x {channels} is not a size that can be read")


def unzipped(content: bytes) -> bytes:
    """Plain FITS bytes; a gzip file may not claim more than its bytes can hold."""
    if content.startswith(b"\x1f\x8b"):
        if len(content) >= 4 and struct.unpack("<I", content[-4:])[0] > 1032 * len(content):
            raise BadFile("the file claims to unpack to more than it can hold")
        return gzip.decompress(content)
    return bz2.decompress(content) if content.startswith(b"BZh") else content


def fits_header(content: bytes) -> tuple[dict[str, str], int, str]:
    """Cards of the first header, where its data begin, and the header's text."""
    lines = []
    for at in range(0, len(content), 80):
        card = content[at : at + 80].decode("latin-1")
        if card.rstrip() == "END":
            end = (at // 2880 + 1) * 2880
            break
        lines.append(card)
    else:
        raise BadFile("the header has no end")
    cards: dict[str, str] = {}
    for c in lines:
        if c[8:10] == "= ":
            m = re.match(r"(?:[^/']|'[^']*')*", c[10:])
            cards.setdefault(c[:8].strip().upper(), m[0].strip().strip("'").strip())
    return cards, end, "\n".join(lines)


_DTYPE = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def read_fits(content: bytes, pixels: bool = True) -> dict:
    """The first plane of an image of any sample type, scaled by BSCALE and BZERO."""
    content = unzipped(content)
    cards, at, lines = fits_header(content)
    axes = int(float(cards.get("NAXIS", 0)))
    if axes < 2:
        raise BadFile("there is no image in the first unit")
    width, height = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    channels = int(cards.get("NAXIS3", 1)) if axes > 2 else 1
    checked(width, height, channels)
    out = {"width": width, "height": height, "channels": channels, "cards": lines}
    if pixels:
        kind = np.dtype(_DTYPE[int(cards["BITPIX"])])
        own = content[at : at + width * height * kind.itemsize]
        if len(own) < width * height * kind.itemsize:
            raise BadFile("the file is shorter than its header says")
        v = np.frombuffer(own, kind).astype(np.float64) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
        out["data"] = v.astype(np.float32)
    return out


def grey(samples: np.ndarray, colours: int) -> np.ndarray:
    """Rows of (height, width, channels) to grey: colours are averaged, alpha dropped, rows from the bottom."""
    return samples[::-1, :, :colours].astype(np.float64).mean(axis=2).astype(np.float32).ravel()


def read_png(content: bytes, pixels: bool = True) -> dict:
    """8 and 16 bit PNG, grey, colour and palette, without interlacing."""
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT" and pixels:
            packed += body
        at += 12 + n
    if head is None:
        raise BadFile("there is no header")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    checked(width, height, channels)
    out = {"width": width, "height": height, "channels": 3 if colour in (2, 3, 6) else 1, "cards": ""}
    if not pixels:
        return out
    if interlaced or depth < 8:
        raise BadFile("interlaced and packed PNG files are not read")
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left = line[x - step] if x >= step else 0
                up, corner = above[x], above[x - step] if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        rows[y] = above = line
    samples = rows.view(">u2" if depth == 16 else np.uint8).reshape(height, width, channels)
    if palette is not None and colour == 3:
        samples = palette[samples[:, :, 0]]
    return out | {"data": grey(samples, {0: 1, 4: 1}.get(colour, 3))}


def read_tiff(content: bytes, pixels: bool = True) -> dict:
    """Plain TIFF strips of whole numbers and floats, chunky or planar, uncompressed or deflated."""
    e = "<" if content[:2] == b"II" else ">"
    if struct.unpack(e + "H", content[2:4])[0] != 42:
        raise BadFile("BigTIFF is not read")
    at = struct.unpack(e + "I", content[4:8])[0]
    size = {1: "B", 3: "H", 4: "I"}
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack(e + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in size:
            width = struct.calcsize(size[kind]) * n
            place = at + 10 + 12 * k if width <= 4 else struct.unpack(e + "I", content[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            tags[tag] = list(struct.unpack(e + size[kind] * n, content[place : place + width]))
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    checked(width, height, channels)
    out = {"width": width, "height": height, "channels": min(channels, 3) if channels > 2 else 1, "cards": ""}
    if not pixels:
        return out
    packing, bits, kind = tags.get(259, [1])[0], tags.get(258, [1])[0], tags.get(339, [1])[0]
    if packing not in (1, 8, 32946) or bits not in (8, 16, 32, 64):
        raise BadFile("this compression or sample size is not read")
    parts = [content[o : o + n] for o, n in zip(tags[273], tags[279])]
    body = b"".join(zlib.decompress(p) if packing != 1 else p for p in parts)
    v = np.frombuffer(body, e + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))[: width * height * channels]
    planar = tags.get(284, [1])[0] == 2
    samples = np.moveaxis(v.reshape(channels, height, width), 0, 2) if planar else v.reshape(height, width, channels)
    return out | {"data": grey(samples, 3 if channels > 2 else 1)}


def read_xisf(content: bytes, pixels: bool = True) -> dict:
    """The first image of an uncompressed XISF file; its offset is taken off and channels are averaged."""
    n = struct.unpack("<I", content[8:12])[0]
    head = content[16 : 16 + n].decode("utf-8", "replace")
    m = re.search(r"<Image\b([^>]*)>", head)
    if not m:
        raise BadFile("there is no image")
    own = dict(re.findall(r'(\w+)="([^"]*)"', m[1]))
    width, height, channels = map(int, own["geometry"].split(":"))
    checked(width, height, channels)
    cards = "\n".join(f"{k:<8}= {v}" for k, v in re.findall(r'<FITSKeyword[^>]*name="([^"]*)"[^>]*value="([^"]*)"', head))
    out = {"width": width, "height": height, "channels": channels, "cards": cards}
    if not pixels:
        return out
    if "compression" in own:
        raise BadFile("compressed XISF files are not read")
    _, at, length = own["location"].split(":")
    kind = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}[own["sampleFormat"]]
    v = np.frombuffer(content[int(at) : int(at) + int(length)], kind).reshape(channels, height, width).astype(np.float64)
    return out | {"data": (v.mean(axis=0) - float(own.get("offset", 0))).astype(np.float32).ravel()}


def read_asdf(content: bytes, pixels: bool = True) -> dict:
    """The largest two-dimensional array of an ASDF file, from its first binary block of that size."""
    head, _, rest = content.partition(b"\n...\n")
    found = re.findall(rb"shape:\s*\[\s*(\d+)\s*,\s*(\d+)\s*\]", head)
    kinds = re.findall(rb"datatype:\s*(\w+)", head)
    if not found:
        raise BadFile("there is no image")
    k = max(range(len(found)), key=lambda i: int(found[i][0]) * int(found[i][1]))
    height, width = map(int, found[k])
    checked(width, height)
    out = {"width": width, "height": height, "channels": 1, "cards": ""}
    if not pixels:
        return out
    order = ">" if b"byteorder: big" in head else "<"
    kind = np.dtype(order + {b"float32": "f4", b"float64": "f8", b"uint16": "u2", b"int16": "i2", b"uint8": "u1", b"int32": "i4"}[kinds[min(k, len(kinds) - 1)]])
    at = 0
    while (at := rest.find(b"\xd3BLK", at)) >= 0:
        n = struct.unpack(">H", rest[at + 4 : at + 6])[0]
        used = struct.unpack(">Q", rest[at + 22 : at + 30])[0]
        start = at + 6 + n
        if used >= width * height * kind.itemsize and rest[at + 10 : at + 14] == b"\x00" * 4:
            return out | {"data": np.frombuffer(rest[start : start + width * height * kind.itemsize], kind).astype(np.float32)}
        at = start + used
    raise BadFile("no binary block holds the image")


READERS = {"fits": read_fits, "fits.gz": read_fits, "fits.bz2": read_fits, "png": read_png, "tiff": read_tiff, "xisf": read_xisf, "asdf": read_asdf}


def read(content: bytes, pixels: bool = True) -> dict:
    """One file by its leading bytes; any failure becomes a status."""
    kind = sniff(content)
    if kind not in READERS:
        return {"status": f"{kind or 'this'} format is not read"}
    try:
        return {"status": "ok"} | READERS[kind](content, pixels)
    except Exception as e:  # noqa: BLE001  a broken file must not fail the job
        return {"status": f"{type(e).__name__}: {e}"}


def _table(files: DataFrame, pixels: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                got = read(bytes(r.content), pixels)
                data = got.get("data")
                yield pd.DataFrame({
                    "path": [r.path], "status": [got["status"]], "width": pd.array([got.get("width")], "Int32"), "height": pd.array([got.get("height")], "Int32"),
                    "channels": pd.array([got.get("channels")], "Int32"), "data": [None if data is None else data.tolist()], "cards": [got.get("cards")]})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def images(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with its pixels, row by row."""
    return _table(spark.read.format("binaryFile").load(path), True)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Size, channels, pointing, scale and solution from the headers alone."""
    rows = _table(spark.read.format("binaryFile").load(path), False).drop("data")
    rows = rows.withColumn("c", text.cards(F.concat(F.coalesce("cards", F.lit("")), F.lit("\n"))))
    ra, dec = text.pointing(F.col("c"))
    scale = text.pixel_scale(text.number(F.col("c"), "FOCALLEN"), text.number(F.col("c"), "XPIXSZ"), text.number(F.col("c"), "XBINNING"))
    return rows.select("path", "status", "width", "height", "channels", ra.alias("ra"), dec.alias("dec"), scale.alias("scale"), text.header_wcs(F.col("c")).alias("wcs"))


def pixels_of(images_: DataFrame) -> DataFrame:
    """The long form (image_id, x, y, v); ``images_`` needs image_id, width and data."""
    rows = images_.select("image_id", "width", F.posexplode("data").alias("at", "v"))
    return rows.select("image_id", (F.col("at") % F.col("width")).cast("int").alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), F.col("v").cast("double").alias("v"))
