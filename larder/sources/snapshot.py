"""The clean snapshot: writing, hashing, verifying and registering it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources import contract


#: Rows of a data file at most, so that a digest can hold a file's bytes in one row (below 2 GB).
ROWS_PER_FILE = 5_000_000


def write_clean(frames: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per frame."""
    for name, df in frames.items():
        df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{folder}/{name}")


def write_partitioned(sales: DataFrame, folder: str, column: str = "Location_ID", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Sales partitioned for pruning by a column; returns rows per partition.

    The rebalance hint gathers a location's rows into few files, and splits a location that
    holds a large share of all rows over several tasks.
    """
    sales.hint("rebalance", column).write.option("maxRecordsPerFile", rows_per_file).partitionBy(column).parquet(folder)
    written = sales.sparkSession.read.parquet(folder)
    return written.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def file_digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """SHA-256 and size of every data file of the named tables, computed by the executors.

    ``file`` is the path inside the table, so files of a partitioned table keep their partition folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    found = files.load([f"{folder}/{n}" for n in names])
    place = r"/([^/=]+)/((?:[^/]+=[^/]*/)*[^/]+)$"
    return found.select(
        F.regexp_extract("path", place, 1).alias("table_name"), F.regexp_extract("path", place, 2).alias("file"),
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"),
    )


def row_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows of every named table, in one query."""
    counts = None
    for name in names:
        one = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def write_manifest(spark: SparkSession, folder: str, names: list[str], version: str = contract.CLEAN_VERSION) -> None:
    """Record version, digest and size of every file and the row count of every table; every file must belong to one."""
    listing = file_digests(spark, folder, names).join(row_counts(spark, folder, names), "table_name", "left")
    known = F.coalesce("rows", F.raise_error(F.concat(F.lit("no table for file "), "table_name", F.lit("/"), "file")).cast("long"))
    listing.withColumns({"rows": known, "version": F.lit(version)}).write.json(f"{folder}/manifest")


def manifest_differences(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Files that are new, missing or altered against the manifest."""
    kept = spark.read.schema("table_name string, file string, sha256 string, bytes long, rows long, version string").json(f"{folder}/manifest")
    now = file_digests(spark, folder, names)
    same = ["table_name", "file"]
    joined = kept.alias("kept").join(now.alias("now"), same, "full_outer")
    verdict = (
        F.when(F.col("now.sha256").isNull(), "missing")
        .when(F.col("kept.sha256").isNull(), "unexpected")
        .when(F.col("kept.sha256") != F.col("now.sha256"), "altered")
        .otherwise("same")
    )
    return joined.select(*same, verdict.alias("verdict"), F.col("kept.version").alias("version"))


def verify_manifest(spark: SparkSession, folder: str, names: list[str], version: str = contract.CLEAN_VERSION) -> None:
    """Raise unless version, file set, digests and row counts all hold."""
    found = manifest_differences(spark, folder, names).agg(
        F.count_if(F.col("verdict") != "same").alias("different"),
        F.count_if(F.col("version") != version).alias("versions"),
    ).first()
    if found["versions"]:
        raise ValueError("unsupported snapshot version")
    if found["different"]:
        raise ValueError(f"snapshot hash mismatch or file set differs: {found['different']} files")
    kept = spark.read.json(f"{folder}/manifest").groupBy("table_name").agg(F.max("rows").alias("kept"))
    wrong = row_counts(spark, folder, names).join(kept, "table_name").where(F.col("rows") != F.col("kept")).select("table_name").collect()
    if wrong:
        raise ValueError(f"row counts of {sorted(r[0] for r in wrong)} differ from the manifest")


def bind(spark: SparkSession, folder: str, tables: dict[str, str] | None = None, version: str = contract.CLEAN_VERSION) -> DataFrame:
    """Register the views of a snapshot whose manifest holds: version, file set, digests and row counts, in one job.

    Returns a row per view with its table, files and rows. A view is registered only if every wanted table is whole, so a query
    never meets half a snapshot.
    """
    tables = tables or contract.CLEAN_TABLES
    names = sorted(set(tables.values()))
    kept = spark.read.schema("table_name string, file string, sha256 string, bytes long, rows long, version string").json(f"{folder}/manifest")
    per_table = kept.groupBy("table_name").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("version") != version).alias("versions"))
    differ = manifest_differences(spark, folder, names).groupBy("table_name").agg(F.count_if(F.col("verdict") != "same").alias("differ"))
    counted = row_counts(spark, folder, names).withColumnRenamed("rows", "found")
    listed = spark.createDataFrame([(n,) for n in names], "table_name string").join(per_table, "table_name", "left").join(differ, "table_name", "left").join(counted, "table_name", "left")
    state = {r["table_name"]: r for r in listed.collect()}
    wrong = [n for n, r in state.items() if r["rows"] is None or r["versions"] or r["differ"] or r["found"] != r["rows"]]
    if wrong:
        raise ValueError(f"the snapshot does not hold what its manifest says of {sorted(wrong)}")
    for view, name in tables.items():
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(view)
    return spark.createDataFrame([(v, n, state[n]["files"], state[n]["rows"]) for v, n in tables.items()], "view string, table_name string, files long, rows long")
