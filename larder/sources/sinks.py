"""Reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Reports never go into these folders of preserved raw data.
PROTECTED = ("data/raw",)


def write_report(df: DataFrame, path: str, kind: str = "csv", files: int = 1) -> None:
    """Write a finished report; rows go straight from the executors to storage.

    Reports are aggregates or pages, so one file is the default; pass more files for detail rows.
    The repartition keeps the work before it parallel.
    """
    if any(f"/{p}/" in f"/{path.strip('/')}/" for p in PROTECTED):
        raise ValueError(f"refusing to write a report into raw data: {path}")
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown report kind: {kind}")
    writer = df.repartition(files).write
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def neutralise(df: DataFrame) -> DataFrame:
    """Put a quote before text a spreadsheet would run as a formula."""
    text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    safe = {c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in text}
    return df.withColumns(safe) if safe else df


def safe_export(df: DataFrame, path: str) -> None:
    write_report(neutralise(df), path)
