"""Annotation collections as data sources (S16-S19): ``rsvqa``, ``cdvqa``, ``vrsbench`` and ``landcover``.

``spark.read.format(name).load(root)`` has the declared columns, and no rows where the root is not mounted. Documents
are read as streams, an entry at a time, so their size is no bound on a task's memory; patches of land cover are read by
folders, some hundred to a split, and the option ``patches`` (a JSON list of names) leaves the others unopened; blocks.py
says why filters do not. Files are opened through pyarrow, in local folders and the object stores that it knows; elsewhere
the functions of ``datasets`` read whole documents through Spark.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import datasets

#: Bytes of a document that are read at once.
CHUNK_BYTES = 64 << 10
#: Folders of patches that a split reads.
SPLIT_PATCHES = 256


class DamagedDocument(ValueError):
    """A document that is not JSON of the form that its collection has."""


class Stream:
    """The values of a JSON document one after another; only the one at hand is kept."""

    def __init__(self, file: pa.NativeFile, chunk: int = CHUNK_BYTES) -> None:
        self.file, self.chunk, self.text, self.at = file, chunk, "", 0
        self.decoder, self.parser = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder()

    def more(self, size: int) -> bool:
        raw = self.file.read(size)
        self.text, self.at = self.text[self.at :] + self.decoder.decode(raw, final=not raw), 0
        return bool(raw)

    def peek(self) -> str:
        """The next character that is no blank, '' at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or not self.more(self.chunk):
                return self.text[self.at : self.at + 1]

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise DamagedDocument(f"{wanted!r} is missing")
        self.at += 1

    def value(self) -> Any:
        """The next value. What is read on doubles until it is whole, so a long one is not parsed often."""
        size = self.chunk
        self.peek()
        while True:
            try:
                found, end = self.parser.raw_decode(self.text, self.at)
            except json.JSONDecodeError as e:
                if not self.more(size):
                    raise DamagedDocument(str(e)) from None
                size *= 2
                continue
            # A number may go on in what is not yet read.
            if end < len(self.text) and (self.text[end] in " \t\r\n,]}" or not isinstance(found, (int, float))):
                self.at = end
                return found
            held = end - self.at
            if not self.more(size):
                self.at = held
                return found

    def children(self) -> Iterator[str | None]:
        """The names of the next object's members, or None for each item of an array; who asks reads the values."""
        opened = self.peek()
        closing = {"{": "}", "[": "]"}.get(opened)
        if closing is None:
            raise DamagedDocument("neither an object nor an array")
        self.take(opened)
        if self.peek() == closing:
            return self.take(closing)
        while True:
            name = None
            if opened == "{":
                name = self.value()
                self.take(":")
            yield name
            if self.peek() != ",":
                return self.take(closing)
            self.take(",")


def entries(file: pa.NativeFile, key: str | None, chunk: int = CHUNK_BYTES) -> Iterator[tuple[str | None, Any]]:
    """Names and values of what the member ``key`` of a document holds, or of the document itself."""
    s = Stream(file, chunk)
    for name in s.children():
        if key is None:
            yield name, s.value()
        elif name == key:
            for inner in s.children():
                yield inner, s.value()
        else:
            s.value()


def told(value: Any) -> str | None:
    """Text as it is, other values as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Split(InputPartition):
    """Files, or folders of patches, by their paths."""

    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("path")
        if not self.root:
            raise ValueError("the root of the collection is needed")
        self.options = options

    def opened(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return store, root.rstrip("/")


class Documents(Reader):
    """The entries of one document, ``file``, under its member ``key``; ``row`` makes a row of an entry."""

    file, key = "", None

    def row(self, place: int, name: str | None, value: Any) -> tuple:
        raise NotImplementedError

    def partitions(self) -> list[Split]:
        store, root = self.opened()
        path = f"{root}/{self.file}"
        return [Split([path])] if store.get_file_info(path).type == fs.FileType.File else []

    def read(self, partition: Split | None) -> Iterator[tuple]:
        """Without splits Spark reads one that is None."""
        store, _ = self.opened()
        for path in partition.paths if partition else ():
            with store.open_input_stream(path) as file:
                try:
                    for place, (name, value) in enumerate(entries(file, self.key)):
                        yield self.row(place, name, value)
                except (DamagedDocument, UnicodeDecodeError) as e:
                    raise DamagedDocument(f"{path}: {e}") from None


class Fielded(Documents):
    """Rows of a place and the named members of an entry."""

    fields: tuple[str, ...] = ()

    def row(self, place: int, name: str | None, value: Any) -> tuple:
        if not isinstance(value, dict):
            raise DamagedDocument(f"entry {place} is no object")
        return (place, *(told(value.get(f)) for f in self.fields))


class Questions(Fielded):
    file, key, fields = "questions.json", "questions", ("id", "image_id", "type", "question")


class Answers(Fielded):
    file, key, fields = "answers.json", "answers", ("id", "answer")


class Pairs(Documents):
    file, key = "change_qa.json", "pairs"

    def row(self, place: int, name: str | None, value: Any) -> tuple:
        if name is None or not isinstance(value, list):
            raise DamagedDocument(f"entry {place} is no list with a name")
        return name, [{k: told(v) for k, v in qa.items()} for qa in value]


class Annotations(Documents):
    file = "vrsbench_annotations.json"

    def row(self, place: int, name: str | None, value: Any) -> tuple:
        if name is None:
            raise DamagedDocument("the samples have no names")
        return name, told(value)


class Patches(Reader):
    """A row for each folder of the root that is not hidden: its labels that are classes, and its .tif files."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.wanted = set(json.loads(options["patches"])) if options.get("patches") else None
        self.size = int(options.get("splitpatches", SPLIT_PATCHES))

    def partitions(self) -> list[Split]:
        """Folders asked for by name are looked up; otherwise the root is listed, but no folder in it."""
        store, root = self.opened()
        if self.wanted is not None:
            names = sorted(w for w in self.wanted if w and "/" not in w)
            found = store.get_file_info([f"{root}/{w}" for w in names]) if names else []
        else:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        paths = sorted(i.path for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith("."))
        return [Split(paths[at : at + self.size]) for at in range(0, len(paths), self.size)]

    def read(self, partition: Split | None) -> Iterator[tuple]:
        store, _ = self.opened()
        for folder in partition.paths if partition else ():
            name = folder.rsplit("/", 1)[1]
            held = {i.base_name for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File}
            labels = []
            if (meta := f"{name}_labels_metadata.json") in held:
                with store.open_input_stream(f"{folder}/{meta}") as file:
                    try:
                        labels = json.loads(file.read()).get("labels") or []
                    except (ValueError, AttributeError) as e:
                        raise DamagedDocument(f"{folder}/{meta}: {e}") from None
            yield name, [x for x in labels if x in datasets.LAND_COVER], sorted(f for f in held if f.lower().endswith(".tif"))


class Collection(DataSource):
    """``tables`` are a collection's readers and schemas; of several the option ``table`` names one, else the first."""

    tables: dict[str, tuple[type[Reader], str]] = {}

    def _table(self) -> tuple[type[Reader], str]:
        asked = {k.lower(): v for k, v in self.options.items()}.get("table") or next(iter(self.tables))
        if asked not in self.tables:
            raise ValueError(f"{self.name()} has no table {asked}; it has {', '.join(self.tables)}")
        return self.tables[asked]

    def schema(self) -> str:
        return self._table()[1]

    def reader(self, schema: StructType) -> Reader:
        return self._table()[0]({k.lower(): v for k, v in self.options.items()})


class Rsvqa(Collection):
    tables = {
        "questions": (Questions, "place bigint, id string, image_id string, type string, question string"),
        "answers": (Answers, "at bigint, id string, answer string"),
    }

    @classmethod
    def name(cls) -> str:
        return "rsvqa"


class Cdvqa(Collection):
    tables = {"pairs": (Pairs, "pair_id string, qa array<map<string,string>>")}

    @classmethod
    def name(cls) -> str:
        return "cdvqa"


class Vrsbench(Collection):
    tables = {"annotations": (Annotations, "sample_id string, annotation string")}

    @classmethod
    def name(cls) -> str:
        return "vrsbench"


class LandCover(Collection):
    tables = {"patches": (Patches, "patch_id string, labels array<string>, files array<string>")}

    @classmethod
    def name(cls) -> str:
        return "landcover"


def register(spark: SparkSession) -> None:
    """Make the four formats known to a session."""
    for source in (Rsvqa, Cdvqa, Vrsbench, LandCover):
        spark.dataSource.register(source)


def questions(spark: SparkSession, root: str) -> DataFrame:
    """image_id and its question-answer pairs, like datasets.rsvqa, from the streamed documents."""
    register(spark)
    asked, answered = (spark.read.format("rsvqa").option("table", t).load(root) for t in Rsvqa.tables)
    return datasets.per_image(datasets.join_answers(asked, answered, order="at"))
