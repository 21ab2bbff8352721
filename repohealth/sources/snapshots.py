"""Snapshot files: append-only JSON lines, read with tolerance for broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.functions.scalars import strict_json
from repohealth.schemas import SNAPSHOT


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of JSON line files; blank and malformed lines are skipped."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)


def append_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def parse_snapshot_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """The same for lines that are already a column."""
    ok = strict_json(F.col(text)).isNotNull()
    return lines.where(ok).withColumn("_s", F.from_json(text, SNAPSHOT)).select(*lines.columns, "_s.*")
