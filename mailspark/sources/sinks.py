"""Writing state: versioned tables, date-partitioned reports, outbox and run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailspark.schema import TABLES
from mailspark.session import pin_utc


class VersionedTable:
    """A table as a row of complete parquet versions; readers take the newest committed one.

    A version counts once its _SUCCESS mark is there, so a job that dies half-way leaves the last version in
    force, and no path is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.path, self.name = pin_utc(spark), path.rstrip("/"), name

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            label = status.getPath().getName()
            if label.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(label[2:]))
        return sorted(found)

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], TABLES[self.name])
        return self.spark.read.schema(TABLES[self.name]).parquet(f"{self.path}/v={versions[-1]}")

    def write(self, df: DataFrame) -> int:
        """Write the next version whole and return its number. A failed attempt's leftovers are overwritten."""
        version = (self._versions() or [0])[-1] + 1
        columns = [f.name for f in self.spark.createDataFrame([], TABLES[self.name]).schema]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version


def write_report(lines: DataFrame, path: str, date_column: str = "digest_date") -> None:
    """The lines of a report as a table, a folder per date: a later report of a date replaces it, other dates stay.
    ``reports.write_text`` writes the text itself."""
    ordered = lines.repartition(date_column).sortWithinPartitions(date_column, "section", "ord")
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_column)
     .parquet(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An outbox or a report in JSON lines; whoever talks to the outside reads it from here."""
    df.write.mode(mode).json(path)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """One row of the run log."""
    schema = spark.createDataFrame([], TABLES["runs"]).schema
    spark.createDataFrame([tuple(run.get(f.name) for f in schema)], schema).write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def last_run(runs: DataFrame) -> DataFrame:
    """The run with the highest id, combined per task before it travels."""
    row = F.struct(*[F.col(c) for c in runs.columns])
    return runs.agg(F.max_by(row, "id").alias("r")).select("r.*")
