"""Reports as ordered text files: a folder per date, lines in order over its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ORDER = ("rank", "key", "ord", "line")


def write_text(lines: DataFrame, path: str, by: str = "report_date", order: Sequence[str] = ORDER) -> None:
    """Write ``line`` of every row in the order of (``by``, *``order``), as text files below ``path``/``by``=value.

    The lines are dealt out by ranges of their order, so a long report of one date is written by many tasks, and its
    files follow each other by their part numbers. A later report replaces all files of its own dates and no others.
    Line ends inside a line become blanks, and a null line is an empty one, so every row is one line.
    """
    keys = [by, *order]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    flat = F.translate(F.coalesce("line", F.lit("")), "\r\n", "  ")
    (ordered.select(by, flat.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("lineSep", "\n").partitionBy(by).text(path))


def read_text(spark: SparkSession, path: str, by: str = "report_date") -> DataFrame:
    """(``by`` as text, line_no from 1, line) of the reports below ``path``.

    A file is what one task wrote. Only its number of lines takes part in counting, so no date meets in one task.
    """
    name = F.col("_metadata.file_name")
    files = spark.read.text(path, wholetext=True).select(
        F.col(by).cast("string").alias(by), F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("_part"),
        name.alias("_file"), F.split("value", "\n").alias("_lines"))
    sizes = files.select(by, "_part", "_file", (F.size("_lines") - 1).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # every line ends with a line feed, so the last piece is empty and no line
    rows = files.select(by, "_file", F.posexplode(F.slice("_lines", 1, F.size("_lines") - 1)).alias("_at", "line"))
    return rows.join(starts, [by, "_file"]).select(by, (F.col("_start") + F.col("_at") + 1).alias("line_no"), "line")


def one_text(lines: DataFrame, by: str = "report_date", order: Sequence[str] = ORDER) -> DataFrame:
    """(``by``, text): the lines of each date joined by line feeds, for reports whose lists are all top lists."""
    return lines.groupBy(by).agg(F.expr(
        f"listagg(coalesce(line, ''), '\n') WITHIN GROUP (ORDER BY {', '.join(order)})").alias("text"))
