"""ROI report as one multi-section CSV file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

BOM = "﻿"


def report_lines(sheets: dict[str, DataFrame]) -> DataFrame:
    """(section_no, row_no, line) of all sheets: a head, column names, rows, blank between."""
    parts = []
    for number, (name, sheet) in enumerate(sheets.items()):
        spark = sheet.sparkSession
        head = [f"{BOM if number == 0 else ''}# {name}", ",".join(sheet.columns)]
        if number:
            head.insert(0, "")
        rows = [(number, i - len(head), line) for i, line in enumerate(head)]
        parts.append(spark.createDataFrame(rows, "section_no int, row_no bigint, line string"))
        # Sheets arrive sorted, and ids grow with the partitions of a sorted result.
        cells = F.to_csv(F.struct(*[F.col(c).cast("string") for c in sheet.columns]))
        parts.append(
            sheet.select(
                F.lit(number).alias("section_no"), F.monotonically_increasing_id().alias("row_no"), cells.alias("line")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def write_roi_csv(sheets: dict[str, DataFrame], path: str) -> None:
    """Write the report as a single file: its rows are final report rows."""
    lines = report_lines(sheets).orderBy("section_no", "row_no").select("line")
    lines.coalesce(1).write.mode("overwrite").text(path, lineSep="\r\n")
