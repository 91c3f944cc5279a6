"""Writing tables, quarantine rows and run results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.quality import summarize_run


def _written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write once and count the rows on the way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def _files(spark: SparkSession, path: str):
    """(file system, path) of ``path`` as Hadoop sees it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _remove(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions of the table at ``path``, oldest first, with the folder of each."""
    files, target = _files(spark, f"{path.rstrip('/')}/_versions")
    names = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
    found = sorted(n.split(".") for n in names if n.count(".") == 1)
    return {int(number): f"{path.rstrip('/')}/_data/{folder}" for number, folder in found}


def current_folder(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest committed version; None before the first."""
    known = versions(spark, path)
    return known[max(known)] if known else None


def read_materialized(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The newest committed version of the table at ``path``."""
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path} has no committed version")
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


def commit(spark: SparkSession, path: str, folder: str) -> int:
    """Make ``_data/<folder>`` the current version, by one new empty file ``_versions/<number>.<folder>``.

    The file is what counts: before it is there readers see the old version, afterwards the new one, and nothing is moved or
    deleted in between. Of two writers that commit at once the one with the higher number and folder name is current.
    """
    number = max(versions(spark, path), default=0) + 1
    files, mark = _files(spark, f"{path.rstrip('/')}/_versions/{number:012d}.{folder}")
    files.create(mark, False).close()
    return number


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, mark first, then rows; returns how many went."""
    if keep < 1:
        raise ValueError("the current version stays")
    old = sorted(versions(spark, path).items())[:-keep]
    for number, folder in old:
        _remove(spark, f"{path.rstrip('/')}/_versions/{number:012d}.{folder.rsplit('/', 1)[-1]}")
        _remove(spark, folder)
    return len(old)


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Replace the table at ``path``; an empty frame is SKIPPED and leaves it alone.

    The plan runs once, into a folder of its own, which becomes the current version if rows were counted on the way. A crash
    at any point leaves the version before it readable (``read_materialized``); ``keep`` versions stay for running readers.
    """
    folder = uuid.uuid4().hex
    target = f"{path.rstrip('/')}/_data/{folder}"
    rows = _written(df, target, partition_by)
    if not rows:
        _remove(df.sparkSession, target)
        return "SKIPPED"
    commit(df.sparkSession, path, folder)
    forget_versions(df.sparkSession, path, keep)
    return "WRITTEN"


def materialize_table(df: DataFrame, name: str, staging: str) -> str:
    """The same for a catalog table over versions in ``staging``, a folder all executors share.

    A table of the same columns is pointed at the new version, one change in the catalog; other columns need a new table.
    """
    spark = df.sparkSession
    if materialize(df, staging) == "SKIPPED":
        return "SKIPPED"
    folder = current_folder(spark, staging)
    shape = lambda d: [(f.name, f.dataType) for f in d.schema.fields]
    if spark.catalog.tableExists(name) and shape(spark.table(name)) == shape(df) and _external(spark, name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(name)
    else:
        spark.read.schema(df.schema).parquet(folder).write.mode("overwrite").saveAsTable(name) if spark.catalog.tableExists(name) else spark.catalog.createTable(name, folder, "parquet")
    return "WRITTEN"


def _external(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(name).tableType == "EXTERNAL"


def copy_table(spark: SparkSession, src: str, dst: str) -> None:
    """All rows, same schema, to another path."""
    spark.read.parquet(src).write.mode("overwrite").parquet(dst)


def _replace_run(df: DataFrame, path: str, key: str) -> int:
    """Write the partition of one run, in place of what the same run wrote before; rows of other runs stay."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return seen.get["rows"]


def write_quarantine(bad: DataFrame, table_path: str, pipeline_id: str, validated_at) -> str | None:
    """Bad rows to ``<table>_quarantine`` with when and by whom, one partition per pipeline run; None without bad rows."""
    path = table_path.rstrip("/") + "_quarantine"
    marked = bad.withColumn("_validated_at", F.lit(validated_at).cast("timestamp_ntz")).withColumn("_pipeline_id", F.lit(pipeline_id))
    return path if _replace_run(marked, path, "_pipeline_id") else None


def write_results(results: DataFrame, path: str, run_id: str, at) -> None:
    """Check results and the run row in two writes, never row by row; a run that is written again replaces itself."""
    stamp = lambda df: df.withColumn("recorded_at", F.lit(at).cast("timestamp_ntz")).withColumn("run_id", F.lit(run_id))
    _replace_run(stamp(results), f"{path}/results", "run_id")
    rows = results.sparkSession.read.parquet(f"{path}/results").filter(F.col("run_id") == run_id)
    _replace_run(stamp(summarize_run(rows, ("run_id",)).drop("run_id")), f"{path}/runs", "run_id")
