"""CSV members of zip archives as a Spark data source, one input partition per member.

Planning reads each archive's directory, which stands at its end; a task seeks to its
member, inflates it as a stream and parses the records as they come.  Neither an
archive nor a member is ever held whole, and a large archive is read by as many tasks
as it has members.

Rows: archive (path relative to the folder), member, record (number within the member,
from 0, header not counted), text and generator (the first two fields).  Records with
fewer than two fields, members of other kinds and ``__MACOSX`` are skipped.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

FORMAT = "zipped_csv"
SCHEMA = "archive string, member string, record long, text string, generator string"
# Members that are read and that are skipped
SUFFIX, SKIPPED_PREFIX = ".csv", "__MACOSX"
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20     # returned at a time
FIELD_CHARS = 2 ** 31 - 1                   # long texts are ordinary fields


@dataclass
class Member(InputPartition):
    uri: str
    archive: str
    name: str


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "ZippedCsvReader":
        return ZippedCsvReader(self.options["path"])


class ZippedCsvReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Member]:
        out = []
        for uri, archive, _ in files.listed(self.path, ".zip"):
            with files.opened(uri) as f, zipfile.ZipFile(f) as z:
                out += [Member(uri, archive, n) for n in z.namelist() if n.endswith(SUFFIX) and not n.startswith(SKIPPED_PREFIX)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.uri:
            return
        csv.field_size_limit(FIELD_CHARS)
        rows: list[tuple[int, str, str]] = []
        chars = 0
        with files.opened(partition.uri) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as m:
            records = csv.reader(io.TextIOWrapper(m, encoding="utf-8", newline=""))
            next(records, None)
            for i, r in enumerate(records):
                if len(r) >= 2:
                    rows.append((i, r[0], r[1]))
                    chars += len(r[0])
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield self._batch(partition, rows)
                    rows, chars = [], 0
        if rows:
            yield self._batch(partition, rows)

    def _batch(self, at: Member, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        number, text, generator = zip(*rows)
        s = pa.string()
        return pa.RecordBatch.from_arrays(
            [pa.array([at.archive] * len(rows), s), pa.array([at.name] * len(rows), s), pa.array(number, pa.int64()),
             pa.array(text, s), pa.array(generator, s)], names=["archive", "member", "record", "text", "generator"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under a folder, or of a glob of archives."""
    if not any(n.endswith(".zip") for n, _, _ in files.listed(path, ".zip")):
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(ZippedCsv)
    return spark.read.format(FORMAT).load(path)
