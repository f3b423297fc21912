"""Small control tables that are replaced as a whole: cursors, jobs, tokens, retries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Kept:
    """A table at ``path``. A write makes a new version beside the others and then drops all but
    the one before it, so a reader meets a whole version and a writer may read what it replaces.
    A version counts once Spark has marked it as written. One writer at a time."""

    spark: SparkSession
    path: str
    schema: str

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName().removeprefix("version=")) for x in found or [])

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={versions[-1]}")

    def write(self, rows: DataFrame) -> None:
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        rows.select(*[c.split()[0] for c in self.schema.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/version={new}")
        for old in versions[:-1]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
