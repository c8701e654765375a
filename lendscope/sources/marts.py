"""Mart sinks and sources: write, read back, and profile."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (),
         sort_within: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Create-or-replace a table as Parquet.

    Large marts are written in parallel, one file per task; ``partition_by``
    adds directory partitions (e.g. a year) for pruning on read, and
    ``sort_within`` orders rows inside each file (good min/max statistics
    for pushed-down filters) without a global sort.
    """
    w = df
    if sort_within:
        w = w.sortWithinPartitions(*sort_within)
    writer = w.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex[:12]}"


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], sort_within: Sequence[str] = ()) -> None:
    """Replace only the directory partitions that ``df`` holds (e.g. one year); the others stay as they are.

    ``df`` may read ``path`` itself: its rows are written beside it first, and
    only what is whole there replaces partitions, so a failed or repeated job
    never leaves a partition half written.
    """
    spark, staged = df.sparkSession, _beside(path, "staged")
    save(df, staged, partition_by, sort_within, mode="errorifexists")
    whole = spark.read.schema(df.schema).parquet(staged)
    (whole.sortWithinPartitions(*partition_by, *sort_within).write.mode("overwrite").partitionBy(*partition_by)
     .option("partitionOverwriteMode", "dynamic").parquet(path))
    fs, p = _fs(spark, staged)
    fs.delete(p, True)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_within: Sequence[str] = ()) -> None:
    """Create-or-replace a table that ``df`` may itself read: written beside it, then swapped by renames.

    The table of before is moved away, not deleted, until the new one is in
    place; if that fails it is moved back.
    """
    spark, staged, before = df.sparkSession, _beside(path, "staged"), _beside(path, "before")
    save(df, staged, partition_by, sort_within, mode="errorifexists")
    fs, here = _fs(spark, path)
    there, new = _fs(spark, before)[1], _fs(spark, staged)[1]
    had = fs.exists(here)
    if had and not fs.rename(here, there):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(new, here):
        if had:
            fs.rename(there, here)
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(there, True)


def save_sorted(df: DataFrame, path: str, keys: Sequence[str], files: int, spread: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write ``df`` in the order of ``keys``: files hold consecutive ranges and are sorted inside.

    No task sorts the whole table.  ``spread`` names further columns (say, a
    primary key) by which rows of one hot key may be cut over several files;
    without it they share one.
    """
    order = [*keys, *spread]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def load_mart(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored mart (schema from the Parquet footers, no inference)."""
    return spark.read.parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` (a distributed count) and ``n_columns``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))
