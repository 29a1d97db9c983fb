"""A list of versions of a table that consists of immutable folders."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folders:
    """Immutable folders under one path, and a list of versions, each naming the folders that are live.

    A version is named once its folders have been written, so readers see whole versions; older folders stay for running readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def live(self) -> list[str]:
        """The folders of the last version; none if nothing has been stored."""
        try:
            names = self.spark.read.schema("version int, folders array<string>").json(f"{self.path}/versions")
        except AnalysisException:
            return []
        return names.agg(F.max_by("folders", "version").alias("folders")).first()["folders"] or []

    def new(self) -> str:
        """A name that no other writer uses."""
        return f"part-{len(self.live()):06d}-{uuid.uuid4().hex[:8]}"

    def name(self, folders: list[str]) -> None:
        """Make these the next version's folders."""
        try:
            count = self.spark.read.text(f"{self.path}/versions").count()
        except AnalysisException:
            count = 0
        self.spark.createDataFrame([(count + 1, folders)], "version int, folders array<string>").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def paths(self, table: str) -> list[str]:
        return [f"{self.path}/{f}/{table}" for f in self.live()]

    def read(self, table: str) -> DataFrame:
        """One table of all live folders."""
        paths = self.paths(table)
        if not paths:
            raise ValueError(f"{self.path} holds nothing yet")
        return self.spark.read.parquet(*paths)
