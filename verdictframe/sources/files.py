"""Whole-file facts without whole files in memory.

Spark lists the files and deals them out by size; the task that gets a file reads it in pieces. So a file may be of any
size, and neither a row nor the driver ever holds its content.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at a time.
PIECE = 1 << 20
#: Characters kept of a file's beginning, leading white space left out.
HEAD = 1024
_SCHEMA = "path string, length bigint, sha256 string, head string, is_utf8 boolean"
_LEADING = "﻿ \t\r\n"


def open_file(path: str) -> BinaryIO:
    """A file by the path Spark lists: local, or in a store that Arrow's file systems reach."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + (rest or path).lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner)


def file_facts(source: BinaryIO, piece: int = PIECE) -> tuple[str, str, bool]:
    """(sha256, head, is UTF-8) of a stream that is read once in pieces."""
    digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
    head, text = "", True
    while data := source.read(piece):
        digest.update(data)
        if text:
            try:
                chars = decoder.decode(data)
            except UnicodeDecodeError:
                text = False
                continue
            if len(head) < HEAD:
                head = (head + chars).lstrip(_LEADING)[:HEAD]
    if text:
        try:
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            text = False
    return digest.hexdigest(), head, text


def scan_files(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = open_file, piece: int = PIECE) -> DataFrame:
    """path, length, sha256, head and is_utf8 of every file below a folder; the head of a file that is no text is null.

    Spark lists no files of zero bytes. ``opener`` opens a listed path on the executors; give your own for a store that Arrow does not know.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                with opener(name) as f:
                    sha, head, text = file_facts(f, piece)
                yield pa.RecordBatch.from_pydict(
                    {"path": [name], "length": pa.array([length], pa.int64()), "sha256": [sha], "head": pa.array([head if text else None], pa.string()), "is_utf8": [text]})

    return listed.mapInArrow(read, _SCHEMA)


def below(path: str, folder: str) -> Column:
    """The file's path below a folder."""
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.element_at(F.split(F.col(path), re.escape(f"/{root}/"), 2), -1)
