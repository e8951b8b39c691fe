"""Report sinks: flat tables to CSV, structured rows to JSON, runs to an audit table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat_csv(report: DataFrame, path: str) -> None:
    """SNK-CSV: nested columns as JSON text, a header, a file for each partition."""
    nested = [c for c, t in report.dtypes if t.startswith(("array", "map", "struct"))]
    report.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)


def json_rows(report: DataFrame, path: str) -> None:
    """SNK-JSON: one document for each row."""
    report.write.mode("overwrite").json(path)


def record_runs(runs: DataFrame, path: str) -> None:
    """SNK-PHASERUN: append run-audit rows, by phase."""
    runs.write.mode("append").partitionBy("phase").parquet(path)
