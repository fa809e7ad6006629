"""Fault isolation of sources at run time: each source is written to a stage of its own and committed.

A source counts once its stage is committed; one that fails, while it is planned or in any of its
tasks, loses its own stage only and is reported.  A later run reads the committed stages and
tries the others again.  A job whose result counts only if it is made of all sources asks for
``whole`` stages: what is missing is raised, never left out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import CANONICAL_SCHEMA, QUARANTINE_SCHEMA
from .snapshots import SnapshotTable


class SourcesNotWhole(RuntimeError):
    """The stages do not hold all of the sources."""


class Staged(NamedTuple):
    rows: DataFrame
    quarantine: DataFrame
    error: str | None


def _canonical(df: DataFrame) -> DataFrame:
    """The canonical columns, null where the source has none."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in CANONICAL_SCHEMA.fields])


def stage(spark: SparkSession, root: str, name: str, read: Callable) -> Staged:
    """Run one source reader into ``<root>/<name>``; ``read`` gives rows, or (rows, quarantine)."""
    table, bad = (SnapshotTable(spark, f"{root}/{name}{suffix}") for suffix in ("", "_quarantine"))
    quarantine_schema = T.StructType.fromDDL(QUARANTINE_SCHEMA)
    error = None
    if not table.exists():
        try:
            got = read()
            rows, broken = got if isinstance(got, tuple) else (got, None)
            if broken is not None:
                broken = broken.select(F.lit(name).alias("source"), "file_path", "record")
                bad.replace(broken)             # a stage tried again replaces what it had quarantined
            table.append(_canonical(rows), ("source", 0))
        except Exception as e:  # noqa: BLE001 - any failure, at planning or in a task, stops this source alone
            error = f"{name}: {type(e).__name__}: {(str(e).splitlines() or [''])[0][:300]}"
    return Staged(table.read(schema=CANONICAL_SCHEMA), bad.read(schema=quarantine_schema), error)


def stage_all(spark: SparkSession, root: str, sources: dict[str, Callable]) -> dict[str, Staged]:
    return {name: stage(spark, root, name, read) for name, read in sources.items()}


def whole(stages: dict[str, Staged]) -> dict[str, Staged]:
    """The stages, if every source was committed and all of its records were read; else everything missing is raised at once."""
    missing = [s.error for s in stages.values() if s.error is not None]
    for name, s in stages.items():
        n = s.quarantine.count()
        if n:
            missing.append(f"{name}: {n} records in quarantine")
    if missing:
        raise SourcesNotWhole("; ".join(missing))
    return stages
