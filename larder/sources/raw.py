"""Typed loading of raw CSV tables.

Files are read as text by Spark, checked in one distributed aggregate and then cast. Nothing is
repaired or dropped here: a value that does not read as its type, a required id that is missing
or a value outside its list stops the load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.sources import contract

BROKEN = "_broken_record"


class IngestionError(ValueError):
    """Input that does not meet the contract."""


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file (reads its first line only)."""
    try:
        return spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise IngestionError(f"missing file {path}") from error


def checked_header(spark: SparkSession, table: str, paths: Sequence[str]) -> list[str]:
    """The header of the first file, holding exactly the contract's columns.

    The other files are compared with it by the tasks that read them, not one by one from here.
    """
    if not paths or len(set(paths)) != len(paths):
        raise IngestionError(f"{table}: provide distinct input files")
    names = header(spark, paths[0])
    if len(set(names)) != len(names) or set(names) != set(contract.schema(table).fieldNames()):
        raise IngestionError(f"{table}: invalid columns {names}")
    return names


def read_text(
    spark: SparkSession, names: Sequence[str], paths: Sequence[str], quoted_lines: bool = False, header: bool = True
) -> DataFrame:
    """All columns as text, with records of the wrong shape set aside in one extra column.

    Plain files are split across tasks; ``quoted_lines`` allows line breaks inside quotes at the
    price of one task per file.
    """
    shape = StructType([*contract.text_schema(names).fields, StructField(BROKEN, StringType(), True)])
    return (
        spark.read.schema(shape)
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, escape='"',
                 enforceSchema=False, multiLine=quoted_lines, columnPruning=False)
        .csv(list(paths))
    )


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types."""
    return spark.read.options(header=True, inferSchema=True, escape='"').csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Convert a CSV folder to Parquet and read it back."""
    read_inferred(spark, source).write.parquet(target)
    return spark.read.parquet(target)


def corrupt_records(raw: DataFrame) -> DataFrame:
    """Records with the wrong number of fields or broken quoting."""
    # Spark refuses to read the set-aside column alone, so a field is named beside it.
    return raw.where(F.col(BROKEN).isNotNull() & F.coalesce(raw.columns[0], BROKEN).isNotNull())


def shape_counts(raw: DataFrame) -> DataFrame:
    """Malformed records beside all records, in one pass."""
    fields = [c for c in raw.columns if c != BROKEN]
    # Spark refuses to read the set-aside column alone, so the field counts are read with it.
    touched = F.greatest(*[F.count(c) for c in fields])
    return raw.agg(F.count(BROKEN).alias("malformed"), F.greatest(F.count(F.lit(1)), touched).alias("records"))


def _mismatch(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "string":
        return F.lit(False)
    wrong = ~value.rlike(contract.PATTERNS[kind]) | value.try_cast(kind).isNull()
    return value.isNotNull() & wrong


def type_violations(raw: DataFrame, schema: StructType) -> DataFrame:
    """One row: how many values of each column do not read as the column's type."""
    return raw.agg(*[F.count_if(_mismatch(f.name, f.dataType.simpleString())).alias(f.name) for f in schema])


def contract_violations(typed: DataFrame, ids: Sequence[str], allowed: dict[str, Sequence]) -> DataFrame:
    """One row: missing or non-positive required ids and values outside their lists."""
    checks = [F.count_if(F.col(c).isNull() | (F.col(c) <= 0)).alias(c) for c in ids]
    checks += [F.count_if(F.col(c).isNull() | ~F.col(c).isin(*v)).alias(f"enum_{c}") for c, v in allowed.items()]
    return typed.agg(*checks)


def typed_columns(raw: DataFrame, schema: StructType) -> DataFrame:
    return raw.select(
        *[
            F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def load_table(spark: SparkSession, table: str, paths: Sequence[str], quoted_lines: bool = False) -> DataFrame:
    """Load one table from distinct CSV files, or raise."""
    schema = contract.schema(table)
    names = checked_header(spark, table, paths)
    try:
        raw = read_text(spark, names, paths, quoted_lines)
    except AnalysisException as error:
        raise IngestionError(f"{table}: missing input file") from error
    typed = typed_columns(raw, schema)
    allowed = contract.ALLOWED.get(table, {})
    kinds = [F.count_if(_mismatch(f.name, f.dataType.simpleString())).alias(f"type_{f.name}") for f in schema]
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    ids = [F.count_if(casts[c].isNull() | (casts[c] <= 0)).alias(f"id_{c}") for c in contract.required_ids(table)]
    lists = [F.count_if(casts[c].isNull() | ~casts[c].isin(*v)).alias(f"enum_{c}") for c, v in allowed.items()]
    checks = raw.agg(F.count(F.lit(1)).alias("rows"), F.count(BROKEN).alias("broken"), *kinds, *ids, *lists)
    try:
        found = checks.first().asDict()
    except Exception as error:
        if "header" not in str(error):
            raise
        raise IngestionError(f"{table}: columns and column order must match across all input files") from error
    if not found["rows"]:
        raise IngestionError(f"{table}: input has a header but no records")
    if found["broken"]:
        raise IngestionError(f"{table}: {found['broken']} malformed CSV records")
    for prefix, text in (("type_", "invalid source types"), ("id_", "missing or nonpositive required IDs"),
                         ("enum_", "unsupported enums")):
        bad = {k.removeprefix(prefix): v for k, v in found.items() if k.startswith(prefix) and v}
        if bad:
            raise IngestionError(f"{table}: {text} {bad}")
    return typed


def table_shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in frames.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def ingest_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, schema text and number of input files per loaded table."""
    shapes = table_shapes(frames)
    notes = F.create_map(
        *[x for name, df in frames.items() for x in (F.lit(name), F.lit(df.schema.json()))]
    )
    parts = F.create_map(
        *[x for name, df in frames.items() for x in (F.lit(name), F.lit(len(df.inputFiles())))]
    )
    return shapes.withColumns(
        {"schema": notes[F.col("table_name")], "input_files": parts[F.col("table_name")],
         "schema_version": F.lit(contract.RAW_VERSION)}
    )


def replicate(
    df: DataFrame, copies: int, strides: dict[str, int]
) -> DataFrame:
    """``copies`` times the rows, each copy with its own key range.

    ``strides`` holds the step of the key and of every linked key, so references stay intact.
    """
    if copies < 1:
        raise ValueError("copies must be positive")
    batch = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
    moved = {key: F.col(key) + F.col("_batch") * step for key, step in strides.items()}
    return df.withColumn("_batch", batch).withColumns(moved).drop("_batch")
