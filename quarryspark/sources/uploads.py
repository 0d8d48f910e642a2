"""Uploads as a data source of its own: ``spark.read.format("uploads")`` and ``spark.readStream.format("uploads")``.

Files are listed once a batch and packed into partitions by size; they are opened in the tasks. A schema of fewer columns reads fewer: without
columns of the content no file is opened. A stream takes files by their time of modification, each once."""

from __future__ import annotations

import datetime
import fnmatch
import time
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import docx

_TEXTS = T.ArrayType(T.StringType())
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("path", T.StringType()), ("modified", T.TimestampType()), ("size", T.LongType()), ("part_index", T.IntegerType()), ("kind", T.StringType()), ("level", T.IntegerType()), ("section", _TEXTS), ("cells", _TEXTS), ("merged", T.IntegerType()), ("text", T.StringType()), ("error", T.StringType()))])
_OF_FILE = ("path", "modified", "size")
#: Bytes of the files of a partition, bytes of a file, and seconds after which a file counts as written.
PARTITION_BYTES, FILE_BYTES, SETTLED = 64 << 20, 512 << 20, 2.0


@dataclass(frozen=True)
class File:
    path: str
    modified: int
    size: int


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]


def _parts(name: str, content: bytes) -> Iterator[docx.Block]:
    kind = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    if kind == "txt":
        if (text := content.decode("utf-8", "replace")).strip():
            yield docx.Block("text", text)
    elif kind == "docx":
        yield from docx.blocks(content)
    else:
        raise ValueError(f"unsupported type {kind}")


class _Folder:
    """What both readers share."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        if not options.get("path"):
            raise ValueError("uploads are loaded from a path")
        self.at = options["path"]
        self.glob = options.get("pathGlobFilter", "*")
        self.partition_bytes = int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.file_bytes = int(options.get("maxFileBytes", FILE_BYTES))
        self.settled = float(options.get("settledSeconds", SETTLED))
        self.columns = schema.names
        types = {f.name: f.dataType for f in SCHEMA}
        for f in schema:
            if types.get(f.name) != f.dataType:
                raise ValueError(f"uploads have no column {f.name} {f.dataType.simpleString()}")

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.at) if ":/" in self.at else (fs.LocalFileSystem(), self.at)

    def listed(self, after: int | None = None, until: int | None = None) -> list[File]:
        """Files below the path (or the file there) modified in (after, until], hidden ones left out."""
        system, root = self.system()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p.removeprefix(root).split("/") if x)
        files = [File(x.path, x.mtime_ns or 0, x.size) for x in found if x.type == fs.FileType.File and not hidden(x.path) and fnmatch.fnmatchcase(x.base_name, self.glob)]
        return [x for x in files if (after is None or x.modified > after) and (until is None or x.modified <= until)]

    def packed(self, files: list[File]) -> list[Files]:
        """Files in partitions of about the same bytes; a file is never split."""
        out: list[list[File]] = []
        free = 0
        for x in sorted(files, key=lambda x: x.path):
            if not out or x.size > free:
                out.append([])
                free = self.partition_bytes
            out[-1].append(x)
            free -= x.size + 4096  # opening costs something, too
        return [Files(tuple(x)) for x in out]

    def rows(self, partition: Files) -> Iterator[tuple]:
        inside = [c for c in self.columns if c not in _OF_FILE]
        system = self.system()[0] if inside else None
        for x in partition.files:
            of_file = {"path": x.path, "modified": datetime.datetime.fromtimestamp(x.modified / 1e9, datetime.UTC), "size": x.size}
            for values in self.parts(system, x) if inside else ({},):
                yield tuple((of_file | values).get(c) for c in self.columns)

    def parts(self, system: fs.FileSystem, x: File) -> Iterator[dict]:
        try:
            if x.size > self.file_bytes:
                raise ValueError(f"larger than {self.file_bytes} bytes")
            with system.open_input_stream(x.path) as f:
                found = list(_parts(x.path, f.read()))
            for k, part in enumerate(found):
                cells = None if part.cells is None else list(part.cells)
                yield part._asdict() | {"part_index": k, "section": list(part.section), "cells": cells}
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, FileNotFoundError, NotImplementedError) as e:
            yield {"part_index": 0, "error": f"{type(e).__name__}: {e}"}


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return self.folder.packed(self.folder.listed()) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are times of modification. A file counts once it has been left alone for some seconds, so that none with the same time comes
    after its offset; one that is moved here with an older time must be touched."""

    def __init__(self, folder: _Folder):
        self.folder = folder
        self.last = -1

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        written = time.time_ns() - int(self.folder.settled * 1e9)
        self.last = max([self.last, *(x.modified for x in self.folder.listed(after=self.last, until=written))])
        return {"modified": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last, end["modified"])
        return self.folder.packed(self.folder.listed(start["modified"], end["modified"]))

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done."""


class Uploads(DataSource):
    """Options: path (of any file system that Arrow knows), pathGlobFilter, maxPartitionBytes, maxFileBytes, settledSeconds (streams)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(_Folder(self.options, schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options, schema))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Uploads)
    return spark
