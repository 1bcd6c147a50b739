"""Folders of documents as a source of Spark: spark.read.format("documents").load(folder).

    register(spark)
    pages = spark.read.format("documents").option("tasks", "200").load("file:///shared/corpus")

A row is a page (path, kind, page, text); pages count from 1. The suffix picks the reader; files of other suffixes, and
files that their reader cannot read, have no rows. Folders are walked in the tasks, each file is read by the task that
its path's hash names, and the driver lists nothing. Each task walks all folders, so with F files and T tasks
F * T names are listed: choose tasks for the bytes, and give trees of many millions of files by subfolders.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import ship
from .readers import OFFICE

SCHEMA = "path string, kind string, page int, text string"
TASKS = 32
UNREADABLE = (KeyError, TypeError, ValueError, IndexError, AttributeError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError, RecursionError)


def _decoded(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


def _rows(content: bytes) -> Iterator[tuple[int, str]]:
    yield 1, "\n".join(" ".join(r) for r in csv.reader(io.StringIO(_decoded(content), newline="")) if r)


def _first(item: dict, names: tuple[str, ...]) -> str:
    return next((str(item[n]).strip() for n in names if item.get(n) is not None and str(item[n]).strip()), "")


def _items(content: bytes) -> Iterator[tuple[int, str]]:
    """Items by their first text that is not empty, at their places; if none has one, questions with their answers."""
    found = json.loads(_decoded(content))
    items = found if isinstance(found, list) else found["data"] if isinstance(found.get("data"), list) else [found]
    items = [x if isinstance(x, dict) else {"text": x} if isinstance(x, str) else {} for x in items]
    texts = [(k, t) for k, t in enumerate((_first(x, ("text", "content", "page_content")) for x in items), 1) if t]
    pairs = ((k, _first(x, ("question", "Q")), _first(x, ("answer", "A"))) for k, x in enumerate(items, 1))
    yield from texts or ((k, f"Q: {q}\nA: {a}") for k, q, a in pairs if q and a)


def _lines(content: bytes) -> Iterator[tuple[int, str]]:
    """Text of a web page, a line a text node: comments and tags out, entities read, blank lines out."""
    bare = re.sub(r"<[^>]*>", "\n", re.sub(r"<!--.*?-->", "", _decoded(content), flags=re.DOTALL))
    yield 1, "\n".join(x for x in (line.strip() for line in html.unescape(bare).split("\n")) if x)


def _office(kind: str) -> Callable[[bytes], Iterator[tuple[int, str]]]:
    return lambda content: enumerate(OFFICE[kind](content), 1)


READERS: dict[str, Callable[[bytes], Iterator[tuple[int, str]]]] = {
    **dict.fromkeys(("txt", "md"), lambda content: iter([(1, _decoded(content))])),
    **dict.fromkeys(("html", "htm"), _lines),
    **{kind: _office(kind) for kind in OFFICE},
    "csv": _rows,
    "json": _items,
}


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def walk(system: fs.FileSystem, folder: str) -> Iterator[str]:
    """Paths of all files under a folder, one folder's names at a time."""
    waiting = [folder]
    while waiting:
        for info in system.get_file_info(fs.FileSelector(waiting.pop())):
            if info.type == fs.FileType.Directory:
                waiting.append(info.path)
            elif info.type == fs.FileType.File:
                yield info.path


class Share(InputPartition):
    def __init__(self, number: int, of: int) -> None:
        super().__init__((number, of))


class Reader(DataSourceReader):
    def __init__(self, folder: str, tasks: int) -> None:
        self.folder, self.tasks = folder, tasks

    def partitions(self) -> list[Share]:
        return [Share(k, self.tasks) for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        number, of = partition.value
        system, folder = opened(self.folder)
        for path in walk(system, folder):
            kind = suffix(path)
            if kind not in READERS or zlib.crc32(path.encode()) % of != number:
                continue
            with system.open_input_stream(path) as f:
                content = f.read()
            try:
                pages = list(READERS[kind](content))
            except UNREADABLE:
                continue
            if pages:
                n = len(pages)
                yield pa.record_batch([pa.array([path] * n), pa.array([kind] * n), pa.array([p for p, _ in pages], pa.int32()), pa.array([t for _, t in pages], pa.string())], names=["path", "kind", "page", "text"])


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], max(1, int(self.options.get("tasks", TASKS))))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and its executors."""
    ship(spark)
    spark.dataSource.register(Documents)
