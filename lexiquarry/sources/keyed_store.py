"""A stored table that takes upserts: rows lie in folders by their key's hash, and an upsert
rewrites the folders of its keys alone.

A folder is read, merged and written to a staging folder of the store first; then Spark's
dynamic partition overwrite puts it in place. Merging is by key and by a rule that depends on
the row held and the row that comes, so the same upsert again changes nothing. Two rows of one
key in an upsert are an error of its maker: the one that sorts first is taken.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 16


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    path: str
    key: str
    schema: str
    folders: int = FOLDERS

    def _folder(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.folders)).cast("int")

    def read(self) -> DataFrame:
        return self._stored().drop("folder")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, folder int").parquet(f"{self.path}/rows")

    def create(self, rows: DataFrame) -> None:
        """The first contents."""
        names = self._names()
        rows.select(*names, self._folder().alias("folder")).repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/rows")

    def _names(self) -> list[str]:
        return [p.split()[0] for p in self.schema.split(",")]

    def upsert(self, rows: DataFrame, rule: dict[str, Column]) -> list[int]:
        """Merges ``rows`` into the table. ``rule`` says for each column but the key what it becomes,
        by columns ``held.x`` (null in a new row) and ``new.x``; others keep what they hold, or
        take what comes where there is nothing. Rows of other keys stay. Returns the folders whose
        rows changed; no other is written."""
        names = [n for n in self._names() if n != self.key]
        new = rows.groupBy(self.key).agg(F.min(F.struct("*")).alias("new")).withColumn("folder", self._folder())
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        touched = [r[0] for r in new.select("folder").distinct().collect()]  # at most ``folders``
        held = self._stored().filter(F.col("folder").isin(touched)).select(self.key, "folder", F.struct(self.key, *names).alias("held"))
        both = held.join(new, [self.key, "folder"], "full_outer")
        have = set(rows.columns)
        become = {n: rule.get(n, F.coalesce(F.col(f"held.{n}"), F.col(f"new.{n}")) if n in have else F.col(f"held.{n}")) for n in names}
        merged = both.select(self.key, *[F.when(F.col("new").isNull(), F.col(f"held.{n}")).otherwise(become[n]).alias(n) for n in names], "folder", "held")
        differs = F.col("held").isNull() | F.lit(False)
        for n in names:
            differs = differs | ~F.col(n).eqNullSafe(F.col(f"held.{n}"))
        merged.withColumn("_differs", differs).drop("held").write.parquet(staged)
        done = self.spark.read.parquet(staged)
        changed = sorted(r[0] for r in done.filter("_differs").select("folder").distinct().collect())
        if changed:
            out = done.filter(F.col("folder").isin(changed)).select(*self._names(), "folder")
            out.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{self.path}/rows")
        return changed
