"""Result tables: writing module results and findings, and exporting scans as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_results(rows: DataFrame, path: str) -> None:
    """Append rows partitioned by repository.

    The rebalance brings a small repository to one file and splits a large one by size.
    """
    rows.hint("rebalance", "repo_id").write.partitionBy("repo_id").mode("append").parquet(path)


def export_documents(scans: DataFrame, modules: DataFrame, findings: DataFrame, threshold: int = 60) -> DataFrame:
    """JSON documents of every scan, one per line: the scan, its modules, its findings.

    A scan may have more findings than one document can hold, so each finding is
    a document that names its scan; together they are the scan's export.
    """
    def doc(kind: str, *cols: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))

    head = scans.select("scan_id", doc(
        "scan", F.col("scan_id"), F.col("overall_score"), F.lit(threshold).alias("threshold"),
        (F.coalesce("overall_score", F.lit(0)) >= threshold).alias("pass")).alias("doc"))
    mods = modules.select("scan_id", doc("module", F.col("scan_id"), F.col("module_id"), F.col("score"), F.col("confidence")).alias("doc"))
    found = findings.select("scan_id", doc(
        "finding", F.col("scan_id"), F.col("module_id"), F.col("severity"), F.col("file_path"), F.col("line"), F.col("message"),
        F.col("category")).alias("doc"))
    return head.unionByName(mods).unionByName(found)
