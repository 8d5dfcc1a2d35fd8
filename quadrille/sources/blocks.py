"""The data source ``raster``: TIFF files scanned by strips, tiles and frames instead of by whole files.

``spark.read.format("raster").load(path)`` has rows (scene_id, frame, y, x, samples). A large file is cut into splits
of whole strips or tiles, whose places are read from its directory alone; small files are put together into splits.
Options for scenes, frames, rows and columns leave out files, frames and blocks before a byte of theirs is read; option
``bands`` leaves out the planes of other channels where a file keeps them apart. Files are opened by byte range through
pyarrow, in local folders and the object stores that it knows; elsewhere raster.files() reads whole files through Spark.

What is read is named by options and not taken from filters: Spark 4.1 keeps the plan of the last pushed filter with the
loaded DataFrame and uses it for all others made of it, so that a union of two filters would read one of them twice.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import raster

SCHEMA = "scene_id string, frame int, y bigint, x bigint, samples array<double>"
#: Bytes of a split, and of files that go together.
SPLIT_BYTES = 8 << 20
#: Rows that are given out together.
BATCH_ROWS = 1 << 16
#: Bytes read at once when a directory is looked for.
HEAD_BYTES = 64 << 10


class Ranged:
    """Slices of an open file, kept in pieces while a directory is read; ``read`` counts the bytes that were fetched."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.read = file, file.size(), 0
        self.held: dict[int, bytes] = {}

    def __getitem__(self, at: slice) -> bytes:
        low, high = min(at.start or 0, self.size), min(at.stop, self.size)
        if high - low > HEAD_BYTES:
            return self.exactly(low, high - low)
        out = b""
        for k in range(low // HEAD_BYTES, -(-high // HEAD_BYTES)):
            if k not in self.held:
                self.held[k] = self.exactly(k * HEAD_BYTES, HEAD_BYTES)
            out += self.held[k]
        skip = low - low // HEAD_BYTES * HEAD_BYTES
        return out[skip : skip + high - low]

    def exactly(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        got = self.file.read(size)
        self.read += len(got)
        return got


class Part(NamedTuple):
    """What a split reads of one frame of a file: blocks that lie together; None for the whole file."""

    frame: int
    blocks: list[raster.Block] | None


@dataclass
class Split(InputPartition):
    """Files with what to read of each, and about how many bytes that is."""

    files: list[tuple[str, list[Part]]]
    size: int

    def __init__(self, files: list[tuple[str, list[Part]]], size: int) -> None:
        super().__init__(0)
        self.files, self.size = files, size


WHOLE = [Part(-1, None)]


def _overlaps(bounds: dict, name: str, low: int, high: int) -> bool:
    """Whether a place from ``low`` to ``high`` (inclusive) meets what is wanted of a column."""
    least, most = bounds.get(name, (None, None))
    return (least is None or high >= least) and (most is None or low <= most)


def _stretch(told: str) -> tuple[int | None, int | None]:
    """First and last of ``from:to``, of which ``to`` is left out; either may be missing."""
    low, colon, high = told.partition(":")
    if not colon:
        raise ValueError(f"{told!r} is no stretch from:to")
    return int(low) if low.strip() else None, int(high) - 1 if high.strip() else None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("the path of the files is needed")
        self.root = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.bounds = {name: _stretch(options[o]) for name, o in (("frame", "frames"), ("y", "rows"), ("x", "columns")) if options.get(o)}
        self.scenes = set(json.loads(options["scenes"])) if options.get("scenes") else None

    # --- splits ---

    def _listed(self) -> tuple[fs.FileSystem, str, list[fs.FileInfo]]:
        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if info.type == fs.FileType.File:
            return store, root.rsplit("/", 1)[0], [info]
        found = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        known = [i for i in found if i.extension.lower() in raster.EXTENSIONS and "/." not in i.path]
        return store, root.rstrip("/"), sorted(known, key=operator.attrgetter("path"))

    def _wanted(self, block: raster.Block, separate: bool) -> bool:
        here = _overlaps(self.bounds, "y", block.y, block.y + block.rows - 1) and _overlaps(self.bounds, "x", block.x, block.x + block.columns - 1)
        return here and (not separate or self.bands is None or block.plane in self.bands)

    def parts(self, pages: list[dict]) -> Iterator[tuple[Part, int]]:
        """The frames of a file that are wanted, cut into runs of places of SPLIT_BYTES or one place, and their bytes.
        The planes of a place stay together."""
        for frame, tags in enumerate(pages):
            if not _overlaps(self.bounds, "frame", frame, frame):
                continue
            separate = tags.get(raster.PLANAR, (1,))[0] == 2
            places: dict[tuple[int, int], list[raster.Block]] = {}
            for b in raster.tiff_blocks(tags):
                if self._wanted(b, separate):
                    places.setdefault((b.y, b.x), []).append(b)
            run, size = [], 0
            for blocks in places.values():
                own = sum(b.size for b in blocks)
                if run and size + own > self.split_bytes:
                    yield Part(frame, run), size
                    run, size = [], 0
                run, size = run + blocks, size + own
            if run:
                yield Part(frame, run), size

    def partitions(self) -> list[Split]:
        """Only files larger than a split are opened here, and only their directories are read."""
        store, root, listed = self._listed()
        splits, files, size = [], [], 0
        for info in listed:
            name = info.path[len(root) + 1 :]
            if self.scenes is not None and name not in self.scenes:
                continue
            if info.size > self.split_bytes and raster.EXTENSIONS[info.extension.lower()] == "TIFF":
                with store.open_input_file(info.path) as file:
                    splits += [Split([(info.path, [part])], n) for part, n in self.parts(raster.tiff_pages(Ranged(file)))]
                continue
            if files and size + info.size > self.split_bytes:
                splits.append(Split(files, size))
                files, size = [], 0
            files, size = [*files, (info.path, WHOLE)], size + info.size
        return splits + ([Split(files, size)] if files else [])

    # --- rows ---

    def _frames(self, file: pa.NativeFile, parts: list[Part]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Frame, corner and samples of each place."""
        ranged = Ranged(file)
        if ranged[0:4] not in (b"II*\0", b"MM\0*"):
            samples, _ = raster.decoded(ranged.exactly(0, ranged.size))
            if _overlaps(self.bounds, "frame", 0, 0):
                yield 0, 0, 0, samples if self.bands is None else samples[:, :, self.bands]
            return
        pages = raster.tiff_pages(ranged)
        for frame, blocks in [p for p, _ in self.parts(pages)] if parts[0].blocks is None else parts:
            tags = pages[frame]
            separate = tags.get(raster.PLANAR, (1,))[0] == 2
            channels = list(range(tags.get(raster.SAMPLES, (1,))[0])) if self.bands is None else self.bands
            places: dict[tuple[int, int], dict[int, np.ndarray]] = {}
            for b in blocks:
                places.setdefault((b.y, b.x), {})[b.plane] = raster.tiff_block(ranged.exactly(b.start, b.size), b, tags)
                if not separate or len(places[b.y, b.x]) == len(set(channels)):
                    got = places.pop((b.y, b.x))
                    yield frame, b.y, b.x, np.concatenate([got[c] for c in channels], axis=2) if separate else got[0][:, :, channels]

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        """Without splits Spark reads one that is None."""
        store, root = self._opened()
        for path, parts in partition.files if partition else ():
            with store.open_input_file(path) as file:
                try:
                    for frame, y0, x0, samples in self._frames(file, parts):
                        yield from self._rows(path[len(root) + 1 :], frame, y0, x0, samples)
                except (raster.DamagedRaster, raster.UnsupportedRaster) as e:
                    raise type(e)(f"{path}: {e}") from None

    def _opened(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return store, (root.rsplit("/", 1)[0] if store.get_file_info(root).type == fs.FileType.File else root.rstrip("/"))

    def _within(self, name: str, places: np.ndarray) -> np.ndarray:
        least, most = self.bounds.get(name, (None, None))
        return (places >= (0 if least is None else least)) & (True if most is None else places <= most)

    def _rows(self, scene: str, frame: int, y0: int, x0: int, samples: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, w, c = samples.shape
        flat = samples.reshape(h * w, c)
        for at in range(0, h * w, BATCH_ROWS):
            n = np.arange(at, min(at + BATCH_ROWS, h * w))
            n = n[self._within("y", n // w + y0) & self._within("x", n % w + x0)]
            cut = flat[n].astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cut) * c + 1, c, dtype=np.int32)), pa.array(cut.ravel()))
            columns = [pa.array([scene] * len(cut)), pa.array(np.full(len(cut), frame, np.int32)), pa.array(n // w + y0), pa.array(n % w + x0), values]
            yield pa.RecordBatch.from_arrays(columns, ["scene_id", "frame", "y", "x", "samples"])


class RasterSource(DataSource):
    """Registered as ``raster``; options path, splitBytes, bands (numbers from 0, comma-separated), frames, rows and columns
    (``from:to``) and scenes (a JSON list of names)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def scan(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, bands: list[int] | None = None, rows: str | None = None, columns: str | None = None, frames: str | None = None, scenes: list[str] | None = None
) -> DataFrame:
    """Rows (scene_id, frame, y, x, samples) of the TIFF and PNG files at or below ``path``; of stretches (``"0:512"``) and
    scenes that are named, and of no others."""
    spark.dataSource.register(RasterSource)
    told = {"splitBytes": split_bytes, "bands": ",".join(map(str, bands)) if bands else None, "rows": rows, "columns": columns, "frames": frames, "scenes": None if scenes is None else json.dumps(scenes)}
    return spark.read.format("raster").options(**{k: v for k, v in told.items() if v is not None}).load(path)
