"""JSON files of many elements as a Spark data source that streams them.

A file holds one list or one object of any length.  A task reads it by byte ranges and
yields the elements one after another, each as its own JSON text; it holds a
range and the element at hand, never the file.  Small files share a task, up to
``TASK_BYTES`` together.  The elements' types are told apart afterwards, by Spark (VARIANT).

Rows: uri, file (path relative to the folder's parent), shape (``list`` or ``object``),
position, name (the key in an object), element (JSON text), error.  A file that is no
JSON yields its elements up to the place where it breaks, then one row with ``error``.
A name that an object repeats gives a row each time.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

FORMAT = "json_elements"
SCHEMA = "uri string, file string, shape string, position long, name string, element string, error string"
RANGE_BYTES = 1 << 20
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20
TASK_BYTES, OPEN_BYTES = 8 << 20, 64 << 10      # read by one task, unless a file is larger; what opening a file counts as
BLANKS = " \t\n\r"


class Broken(ValueError):
    """No JSON from here on."""


class Elements:
    """The elements of one JSON text that comes in pieces: (shape, position, name, element)."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.over, self.gone = pieces, "", 0, False, 0
        self.value = json.JSONDecoder(strict=False).raw_decode
        self.held = 0                   # most characters held at a time

    def more(self) -> bool:
        """One more piece; what has been read is let go."""
        piece = next(self.pieces, None)
        if piece is None:
            self.over = True
            return False
        self.gone += self.at
        self.text, self.at = self.text[self.at:] + piece, 0
        self.held = max(self.held, len(self.text))
        return True

    def sign(self) -> str:
        """The next character that is no blank, not taken; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in BLANKS:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, signs: str) -> str:
        s = self.sign()
        if not s or s not in signs:
            raise Broken(f"one of {signs} expected at character {self.gone + self.at}")
        self.at += 1
        return s

    def one(self) -> tuple[object, str]:
        """The value that starts here, and its text; it may need more pieces (each try reads twice as far)."""
        if not self.sign():
            raise Broken("ended within a list or object")
        while True:
            try:
                value, end = self.value(self.text, self.at)
            except (json.JSONDecodeError, RecursionError) as e:
                failed = e
            else:
                rest = self.text[end:end + 3]       # of a number cut off at its point or exponent
                if self.over or (rest and (len(rest) > 2 or rest.strip("+-.eE"))):
                    text = self.text[self.at:end]
                    self.at = end
                    return value, text
                failed = None           # a number may go on in the next piece
            have = len(self.text) - self.at
            grown = False
            while len(self.text) - self.at < 2 * have and self.more():
                grown = True
            if not grown and failed is not None:
                raise Broken(f"no JSON value at character {self.gone + self.at}")

    def __iter__(self) -> Iterator[tuple[str, int, str | None, str]]:
        opening = self.sign()
        if opening not in ("[", "{"):
            self.one()
            if self.sign():
                raise Broken(f"text behind the value at character {self.gone + self.at}")
            return
        self.at += 1
        shape, closing = ("list", "]") if opening == "[" else ("object", "}")
        position = 0
        if self.sign() == closing:
            self.at += 1
        else:
            while True:
                name = None
                if shape == "object":
                    if self.sign() != '"':
                        raise Broken(f"a name expected at character {self.gone + self.at}")
                    name, _ = self.one()
                    self.take(":")
                _, text = self.one()
                yield shape, position, name, text
                position += 1
                if self.take("," + closing) == closing:
                    break
        if self.sign():
            raise Broken(f"text behind the end at character {self.gone + self.at}")


def decoded(f, size: int = RANGE_BYTES) -> Iterator[str]:
    """The file's text, range by range; bytes that are no UTF-8 are replaced, a byte order mark goes."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    while raw := f.read(size):
        if text := decoder.decode(raw):
            yield text
    if text := decoder.decode(b"", True):
        yield text


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]        # (URI, relative path)


def grouped(listed: list[tuple[str, str, int]], most: int = TASK_BYTES) -> list[Files]:
    """Neighbouring files of ``most`` bytes together; a larger file by itself."""
    out: list[Files] = []
    room = 0
    for uri, file, size in listed:
        size += OPEN_BYTES
        if not out or size > room:
            out.append(Files([]))
            room = most
        out[-1].files.append((uri, file))
        room -= size
    return out


class JsonElements(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "JsonElementsReader":
        return JsonElementsReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


class JsonElementsReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Files]:
        return grouped(files.listed(self.path, ".json"))

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for uri, file in partition.files if partition else ():
            yield from self._read(uri, file)

    def _read(self, uri: str, file: str) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        with files.opened(uri) as f:
            elements = iter(Elements(decoded(f, self.range_bytes)))
            while True:
                try:
                    shape, position, name, text = next(elements)
                except StopIteration:
                    break
                except Broken as e:
                    rows.append((None, None, None, None, f"unparseable JSON: {e}"))
                    break
                rows.append((shape, position, name, text, None))
                chars += len(text)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield self._batch(uri, file, rows)
                    rows, chars = [], 0
        if rows:
            yield self._batch(uri, file, rows)

    def _batch(self, uri: str, file: str, rows: list[tuple]) -> pa.RecordBatch:
        s = pa.string()
        shape, position, name, text, error = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([uri] * len(rows), s), pa.array([file] * len(rows), s), pa.array(shape, s), pa.array(position, pa.int64()),
             pa.array([_valid(n) for n in name], s), pa.array([_valid(t) for t in text], s), pa.array(error, s)],
            names=["uri", "file", "shape", "position", "name", "element", "error"])


def _valid(text: str | None) -> str | None:
    """A name may hold half of a character (escaped); Arrow takes whole ones only."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Elements of the ``*.json`` files under a folder."""
    if not files.listed(path, ".json"):
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(JsonElements)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(path)
