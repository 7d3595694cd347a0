"""Sinks: replaced tables, appended knowledge, waypoints and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace a table, or with ``by`` only the partitions that ``df`` brings, in one step (see ``tables``).

    A failed job leaves the old table, and ``df`` may read the table it replaces; ``tables.read`` reads it.
    """
    tables.replace(df, path, by)


def append_knowledge(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Append rows, never overwrite; with ``key`` rows already recorded are left out."""
    new = df
    if key:
        new = new.dropDuplicates(key)
        spark = df.sparkSession
        try:
            known = spark.read.parquet(path).select(*key)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":  # else the first write: no table yet
                raise
        else:
            new = new.join(known, key, "left_anti")
    new.write.mode("append").parquet(path)


def write_waypoints(df: DataFrame, path: str, by: str = "board_id") -> None:
    """Line and mark records as JSON, one folder per board; absent fields are left out."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_report(df: DataFrame, path: str, params: dict | None = None) -> None:
    """Verdict or metric rows with a snapshot of the parameters that led to them."""
    snapshot = F.create_map(*[F.lit(str(v)) for item in sorted((params or {}).items()) for v in item]) \
        if params else F.create_map().cast("map<string,string>")
    df.withColumn("params", snapshot).write.mode("append").parquet(path)
