"""Raster files as tables (S1-S8): metadata and pixels of TIFF and PNG files read through Spark's binary source.

Decoding one file is a small numpy helper inside tasks; Spark lists, reads and deals the files. What has no decoder
here raises an error that names it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from ..schema import METADATA, default_bands

#: Leading bytes of each format (fixed values).
MAGIC = {"TIFF": ("49492A00", "4D4D002A"), "PNG": ("89504E47",), "JPEG": ("FFD8FF",)}
EXTENSIONS = {"tif": "TIFF", "tiff": "TIFF", "geotiff": "TIFF", "png": "PNG", "jpg": "JPEG", "jpeg": "JPEG"}
#: TIFF tags (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES = 322, 323, 324, 325
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
#: Bytes and struct letter of each TIFF field type (fixed values).
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
WGS84 = "EPSG:4326 (WGS 84)"
PIXEL_ROWS = 1 << 18
#: Directories of one TIFF, more being taken for a damaged file.
MOST_PAGES = 10_000


class UnsupportedRaster(ValueError):
    """A file whose format, compression or sample type has no decoder here."""


class DamagedRaster(ValueError):
    """A file whose parts are not where, or not as long as, its directory says."""


# --- expressions -------------------------------------------------------------------------------------------------


def by_content(content: Column) -> Column:
    """The format by the first bytes; NULL for others."""
    out = None
    for name, heads in MAGIC.items():
        hit = None
        for h in heads:
            one = F.startswith(content, F.unhex(F.lit(h)))
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def sniffed(content: Column, path: Column) -> Column:
    """The format by its first bytes, else the extension in capitals, else UNKNOWN."""
    ext = F.upper(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(by_content(content), F.when(ext != "", ext).otherwise("UNKNOWN"))


def modality(name: Column, channels: Column) -> Column:
    """Four channels or more are multispectral, whatever the name says."""
    return F.when(channels >= 4, "MULTISPECTRAL").when(F.upper(name).rlike("SAR|SENTINEL1|S1|BACKSCATTER|RADAR"), "SAR").otherwise("OPTICAL")


def band_names(channels: Column, mode: Column) -> Column:
    """S6 (fixed values); two channels have none."""
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    more = F.transform(F.sequence(F.lit(5), F.greatest(channels, F.lit(5))), lambda i: F.concat(F.lit("Band "), i.cast("string")))
    four = F.slice(F.concat(names("Red", "Green", "Blue", "Near-Infrared (NIR)"), more), F.lit(1), channels)
    one = F.array(F.when(mode == "SAR", "Intensity / Radar Backscatter").otherwise("Band 1"))
    return F.when(channels >= 4, four).when(channels == 3, names("Red", "Green", "Blue")).when(channels == 1, one).otherwise(F.array().cast("array<string>"))


def crs_of(keys: Column) -> Column:
    """S3: the first projected (3072) or geographic (2048) code among as many entries as the directory declares; the
    world's default where it is short or has none."""
    entries = F.transform(F.sequence(F.lit(1), F.greatest(F.get(keys, 3), F.lit(1))), lambda i: F.struct(F.get(keys, (i * 4).cast("int")).alias("id"), F.get(keys, (i * 4 + 3).cast("int")).alias("code")))
    hit = F.get(F.filter(entries, lambda e: e["id"].isin(2048, 3072)), 0)
    found = F.when(hit["id"] == 3072, F.format_string("EPSG:%d (Projected CRS)", hit["code"])).when(hit["id"] == 2048, F.format_string("EPSG:%d (Geographic CRS)", hit["code"]))
    return F.when(F.size(keys) >= 4, F.coalesce(F.when(F.get(keys, 3) > 0, found), F.lit(WGS84))).otherwise(WGS84)


def placed(scale: Column, tie: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The affine numbers and the bounds; NULL where scale or tie point are short."""
    sx, sy = F.get(scale, 0), F.get(scale, 1)
    ox, oy = F.get(tie, 3) - F.get(tie, 0) * sx, F.get(tie, 4) + F.get(tie, 1) * sy
    ok = (F.size(scale) >= 2) & (F.size(tie) >= 6)
    zero = F.lit(0.0)
    bounds = F.struct(F.bround(ox, 6).alias("west"), F.bround(oy - height * sy, 6).alias("south"), F.bround(ox + width * sx, 6).alias("east"), F.bround(oy, 6).alias("north"))
    return F.when(ok, F.array(ox, sx, zero, oy, zero, -sy)), F.when(ok, bounds)


# --- one file ----------------------------------------------------------------------------------------------------


def _unpacked(form: str, data, at: int) -> tuple:
    """``data`` is bytes, or whatever gives out slices of a file without reading all of it."""
    part = data[at : at + struct.calcsize(form)]
    if len(part) < struct.calcsize(form):
        raise DamagedRaster(f"a directory or its values end after {at + len(part)} bytes")
    return struct.unpack(form, part)


def tiff_pages(data) -> list[dict[int, tuple]]:
    """The directories of a TIFF, each tag with its values."""
    order = "<" if data[:2] == b"II" else ">"
    at, pages = _unpacked(order + "I", data, 4)[0], []
    while at:
        if len(pages) >= MOST_PAGES:
            raise UnsupportedRaster(f"more than {MOST_PAGES} pages, or pages in a circle")
        (count,) = _unpacked(order + "H", data, at)
        listed = data[at + 2 : at + 2 + 12 * count + 4]
        tags: dict[int, tuple] = {"order": order}
        for k in range(count):
            tag, kind, n = _unpacked(order + "HHI", listed, 12 * k)
            if kind not in FIELDS:
                continue
            size, letter = FIELDS[kind]
            held, where = listed, 12 * k + 8
            if size * n > 4:
                held, (where,) = data, _unpacked(order + "I", listed, where)
            if kind == 2:
                tags[tag] = (bytes(held[where : where + n]).split(b"\0")[0].decode("latin-1"),)
            else:
                tags[tag] = _unpacked(order + letter * n, held, where)
        pages.append(tags)
        (at,) = _unpacked(order + "I", listed, 12 * count)
    return pages


def _sample_type(tags: dict) -> np.dtype:
    bits, kind = set(tags.get(BITS, (1,))), tags.get(FORMAT, (1,))[0]
    if len(bits) != 1 or (b := bits.pop()) not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise UnsupportedRaster(f"TIFF samples of {tags.get(BITS)} bits, format {kind}")
    return np.dtype(f"{tags['order']}{'uif'[kind - 1]}{b // 8}")


class Block(NamedTuple):
    """A strip or tile of one plane: its corner, its rows and columns within the picture, and where its bytes are."""

    plane: int
    y: int
    x: int
    rows: int
    columns: int
    start: int
    size: int


def tiff_blocks(tags: dict) -> list[Block]:
    """All strips or tiles of a page; an error where the directory does not list as many as the page needs."""
    h, w, c = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    tiled = TILES in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]))
    starts, sizes = (tags[TILES], tags.get(TILE_SIZES, ())) if tiled else (tags.get(STRIPS, ()), tags.get(STRIP_SIZES, ()))
    across, down = -(-w // bw), -(-h // bh)
    want = across * down * (c if tags.get(PLANAR, (1,))[0] == 2 else 1)
    if not len(starts) == len(sizes) == want:
        raise DamagedRaster(f"{len(starts)} starts and {len(sizes)} sizes of strips or tiles, not {want}")
    out = []
    for n, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, rest = divmod(n, across * down)
        y, x = rest // across * bh, rest % across * bw
        out.append(Block(plane, y, x, min(bh, h - y), min(bw, w - x), start, size))
    return out


def tiff_block(raw: bytes, block: Block, tags: dict) -> np.ndarray:
    """Rows by columns by samples of one strip or tile; plain or deflated, with or without horizontal differences."""
    kind, c = _sample_type(tags), tags.get(SAMPLES, (1,))[0]
    packing, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packing not in (1, 8, 32946):
        raise UnsupportedRaster(f"TIFF compression {packing}")
    if predictor not in (1, 2):
        raise UnsupportedRaster(f"TIFF predictor {predictor}")
    rows, columns = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if TILES in tags else (block.rows, block.columns)
    depth = 1 if tags.get(PLANAR, (1,))[0] == 2 else c
    if len(raw) != block.size:
        raise DamagedRaster(f"the strip or tile at byte {block.start} has {len(raw)} bytes of {block.size}")
    try:
        raw = raw if packing == 1 else zlib.decompress(raw)
    except zlib.error as e:
        raise DamagedRaster(f"the strip or tile at byte {block.start}: {e}") from None
    if len(raw) < rows * columns * depth * kind.itemsize:
        raise DamagedRaster(f"the strip or tile at byte {block.start} has {len(raw)} bytes of samples, not {rows * columns * depth * kind.itemsize}")
    made = np.frombuffer(raw, kind, rows * columns * depth).reshape(rows, columns, depth)
    if predictor == 2:
        made = np.cumsum(made, axis=1, dtype=made.dtype.newbyteorder("="))
    return made[: block.rows, : block.columns]


def tiff_page(data: bytes, tags: dict) -> np.ndarray:
    """Height by width by channels."""
    h, w, c = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    out = np.zeros((h, w, c), _sample_type(tags).newbyteorder("="))
    for b in tiff_blocks(tags):
        planes = slice(b.plane, b.plane + 1) if tags.get(PLANAR, (1,))[0] == 2 else slice(None)
        out[b.y : b.y + b.rows, b.x : b.x + b.columns, planes] = tiff_block(data[b.start : b.start + b.size], b, tags)
    return out


def png_pixels(data: bytes) -> np.ndarray:
    """Height by width by channels of an 8- or 16-bit PNG without interlace; palettes become red, green and blue."""
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None:
        raise UnsupportedRaster("PNG without a header")
    w, h, bits, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if bits not in (8, 16) or interlace or channels is None:
        raise UnsupportedRaster(f"PNG of {bits} bits, colour type {colour}, interlace {interlace}")
    step = channels * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * step)
    out, before = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += before
        elif kind in (3, 4):
            for i in range(len(line)):
                a = int(line[i - step]) if i >= step else 0
                b, c = int(before[i]), int(before[i - step]) if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (int(line[i]) + guess) & 255
        out[y] = before = line
    pixels = out.reshape(h, w, channels) if bits == 8 else out.view(">u2").astype(np.uint16).reshape(h, w, channels)
    return palette[pixels[:, :, 0]] if colour == 3 and palette is not None else pixels


def decoded(data: bytes) -> tuple[np.ndarray, dict]:
    """Samples and TIFF tags of a file; the frames of a TIFF become channels."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        pages = tiff_pages(data)
        if not pages:
            raise UnsupportedRaster("TIFF without a directory")
        return np.concatenate([tiff_page(data, p) for p in pages], axis=2), pages[0]
    if data[:4] == b"\x89PNG":
        return png_pixels(data), {}
    raise UnsupportedRaster("JPEG and unknown formats are read through images()")


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit PNG of height by width by 4."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, _ = rgba.shape
    lines = np.zeros((h, 1 + 4 * w), np.uint8)
    lines[:, 1:] = rgba.astype(np.uint8).reshape(h, 4 * w)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


# --- tables ------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, scene_id (the path below ``path``), length, content and sniffed format of each file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", below(F.col("path"), path).alias("scene_id"), "length", "content", sniffed(F.col("content"), F.col("path")).alias("format"))


def below(path: Column, root: str) -> Column:
    """The path below ``root``: by it files of one name in two folders are two scenes. The name where ``root`` is the
    file itself; where ``root`` is a pattern, the whole path."""
    start = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/")
    return F.when(F.endswith(path, F.lit(start)), scene_name(path)).otherwise(F.regexp_replace(path, F.lit(r"^.*?\Q" + start + r"\E/+"), F.lit("")))


def scene_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def heads(listed: DataFrame) -> DataFrame:
    """scene_id and the metadata of each file as D4, without decoding samples."""
    kind = "scene_id string, path string, format string, width int, height int, channels int, data_type string, scale array<double>, tie array<double>, geo array<int>, nodata string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for scene, path, data, form in zip(part["scene_id"], part["path"], part["content"], part["format"], strict=True):
                if form == "TIFF":
                    pages = tiff_pages(data)
                    t = pages[0]
                    c = sum(p.get(SAMPLES, (1,))[0] for p in pages)
                    rows.append((scene, path, form, t[WIDTH][0], t[HEIGHT][0], c, _sample_type(t).newbyteorder("=").name, list(map(float, t.get(PIXEL_SCALE, ()))), list(map(float, t.get(TIEPOINT, ()))), list(map(int, t.get(GEO_KEYS, ()))), str(t[NODATA][0]) if NODATA in t else None))
                elif form == "PNG":
                    w, h, bits, colour = struct.unpack_from(">IIBB", data, 16)
                    rows.append((scene, path, form, w, h, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(colour, 0), "uint16" if bits == 16 else "uint8", [], [], [], None))
                else:
                    raise UnsupportedRaster(f"{path}: {form}")
            yield pd.DataFrame(rows, columns=["scene_id", "path", "format", "width", "height", "channels", "data_type", "scale", "tie", "geo", "nodata"])

    raw = listed.select("scene_id", "path", "content", "format").mapInPandas(run, kind)
    affine, bounds = placed(F.col("scale"), F.col("tie"), F.col("width"), F.col("height"))
    maps = F.when(F.col("channels") >= 4, _map(4)).when(F.col("channels") >= 3, _map(3)).otherwise(_map(1))
    mode = modality(scene_name(F.col("path")), F.col("channels"))
    crs = F.when(F.size("geo") > 0, crs_of(F.col("geo"))).otherwise(F.when(bounds.isNotNull(), WGS84))
    made = raw.select(
        "scene_id", scene_name(F.col("path")).alias("filename"), "format", "width", "height", "channels", band_names(F.col("channels"), mode).alias("band_names"), (F.col("channels") >= 4).alias("has_nir"),
        mode.alias("modality"), crs.alias("crs"), bounds.alias("bounds"), affine.alias("transform"),
        F.when(bounds.isNotNull(), F.get("scale", F.lit(0))).alias("pixel_size_meters"), "data_type", F.expr("try_cast(trim(nodata) as double)").alias("nodata_value"),
        F.lit(None).cast("string").alias("sensor_name"), F.lit(None).cast("string").alias("acquisition_date"), F.lit(False).alias("is_synthetic_fixture"), maps.alias("band_map"),
    )
    return made.select("scene_id", F.struct(*[F.col(n) for n in METADATA.fieldNames()]).cast(METADATA).alias("metadata"))


def _map(channels: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in default_bands(channels).items() for x in (k, v)])


PIXELS = StructType().add("scene_id", StringType()).add("y", LongType()).add("x", LongType()).add("samples", ArrayType(DoubleType()))


def pixels(listed: DataFrame) -> DataFrame:
    """A row for each pixel with its samples by channel, given out by PIXEL_ROWS. One file is decoded by one
    task; split scenes over files to spread a huge one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["scene_id"], part["content"], strict=True):
                a, _ = decoded(data)
                h, w, c = a.shape
                flat = a.reshape(h * w, c)
                for at in range(0, h * w, PIXEL_ROWS):
                    cut = flat[at : at + PIXEL_ROWS].astype(np.float64)
                    n = np.arange(at, at + len(cut))
                    yield pd.DataFrame({"scene_id": name, "y": n // w, "x": n % w, "samples": list(cut)})

    return listed.select("scene_id", "content").mapInPandas(run, PIXELS)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of JPEG (and other 8-bit) pictures by Spark's own decoder, whose samples come blue first."""
    rows = spark.read.format("image").load(path).select(below(F.col("image.origin"), path).alias("scene_id"), "image.*")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                c = r.nChannels
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, c)
                a = a[:, :, [2, 1, 0, *range(3, c)]] if c >= 3 else a
                n = np.arange(r.height * r.width)
                yield pd.DataFrame({"scene_id": r.scene_id, "y": n // r.width, "x": n % r.width, "samples": list(a.reshape(-1, c).astype(np.float64))})

    return rows.mapInPandas(run, PIXELS)


def uploads(listed: DataFrame, most_bytes: int = 100 << 20) -> tuple[DataFrame, DataFrame]:
    """Files taken, with an id, and files refused, with the reason: extension not known, content of another format,
    or too large."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    want = F.element_at(F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)]), ext)
    reason = F.when(want.isNull(), "extension").when(F.col("length") > most_bytes, "size").when(~by_content(F.col("content")).eqNullSafe(want), "content")
    judged = listed.withColumn("reason", reason)
    taken = judged.filter("reason is null").withColumn("id", F.concat(F.lit("img_"), F.substring(F.sha2("path", 256), 1, 10))).drop("reason")
    return taken, judged.filter("reason is not null").select("path", "length", "format", "reason")
