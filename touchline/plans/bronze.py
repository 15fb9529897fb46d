"""Bronze ingestion: every source of a run is read, given its ingestion columns and written as one table."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from touchline.operators.reshape import cast_void
from touchline.sinks.tables import add_metadata
from touchline.sources import files


@dataclass(frozen=True)
class Source:
    """A named source: how to read it, the system it comes from, and the file it is known by (None: from the scan)."""
    name: str
    system: str
    read: Callable[[SparkSession], DataFrame | None]
    file: str | None = None


def csv(name: str, path: str, system: str = "csv", schema=None) -> Source:
    return Source(name, system, lambda s: files.read_csv(s, path, schema))


def json_documents(name: str, path: str, system: str = "documents") -> Source:
    return Source(name, system, lambda s: files.read_documents(s, path), path.rsplit("/", 1)[-1])


def parquet(name: str, path: str, system: str = "parquet", columns=None) -> Source:
    return Source(name, system, lambda s: s.read.parquet(path).select(*(columns or ["*"])))


def database(name: str, table: str, exported: str, url: str | None = None, options: dict | None = None) -> Source:
    return Source(name, "database", lambda s: files.read_jdbc_or_csv(s, table, exported, url, options), table)


def frame(name: str, df: DataFrame, system: str = "api") -> Source:
    return Source(name, system, lambda s: df, "")


def ingest(spark: SparkSession, sources: list[Source], batch_id: str, write: Callable[[DataFrame, str], object]) -> dict[str, str]:
    """Write each source to ``bronze.<name>`` through ``write``. Absent and empty sources are skipped and reported so;
    a source that cannot be read raises. Names must differ, or one source would replace the other."""
    names = [s.name for s in sources]
    if len(set(names)) < len(names):
        raise ValueError(f"a bronze table is named twice: {sorted(n for n in names if names.count(n) > 1)}")
    report = {}
    for s in sources:
        df = s.read(spark)
        if df is None or df.isEmpty():
            report[s.name] = "skipped"
            continue
        write(cast_void(add_metadata(df, s.system, batch_id, s.file)), f"bronze.{s.name}")
        report[s.name] = "written"
    return report
