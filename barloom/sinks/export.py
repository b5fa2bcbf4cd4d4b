"""CSV export of a report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame


def export_name(title: str, day: date) -> str:
    return f"{title.replace(' ', '_')}_{day:%Y%m%d}.csv"


def export_csv(report: DataFrame, folder: str, title: str, day: date | None = None) -> str:
    """Write a report with a header line; returns the folder of its part files.

    The parts stay in the report's order and are written in parallel.
    """
    path = f"{folder.rstrip('/')}/{export_name(title, day or date.today())}"
    report.write.mode("overwrite").option("header", True).csv(path)
    return path
