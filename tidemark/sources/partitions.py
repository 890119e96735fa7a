"""Tables kept by period, or by year, of which a refresh writes the partitions that changed and then shows all of them at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: For a table, the folder of each period's files; a period without rows has none.
Folders = dict[str, dict[str, str | None]]


class Periods:
    """Tables under one shared folder, each partitioned by one column, its `period` unless another is named.

    A version is a small file that names the folder of every table and period. Writers put new folders beside the old ones and then add the
    next version, which fails if another writer has added it meanwhile; readers take the latest. So none sees a table half
    refreshed or two tables of different refreshes, and a period that didn't change keeps its files.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType], by: str = "period"):
        self.spark, self.root, self.schemas, self.by = spark, root.rstrip("/"), schemas, by
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self._files.listStatus(where)] if self._files.exists(where) else []

    def version(self) -> int:
        """The number of the latest version; 0 before the first."""
        return max((int(n.partition(".")[0]) for n in self._names(f"{self.root}/versions") if n.endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> Folders:
        version = self.version() if version is None else version
        if not version:
            return {name: {} for name in self.schemas}
        stream = self._files.open(self._path(f"{self.root}/versions/{version}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, changed: Folders | None = None, version: int | None = None) -> DataFrame:
        """A table of the latest version or another, with the folders that a refresh has written but not shown yet."""
        folders = self.folders(version)[name] | (changed or {}).get(name, {})
        paths, schema = sorted(p for p in folders.values() if p), self.schemas[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)

    def write(self, name: str, rows: DataFrame, periods: list[str]) -> dict[str, str | None]:
        """The rows of some periods in new folders; they replace all that these periods had."""
        folder = f"{self.root}/{name}/v={uuid.uuid4().hex}"
        rows.select(*self.schemas[name].names).hint("rebalance", self.by).write.partitionBy(self.by).parquet(folder)
        written = {n.removeprefix(f"{self.by}="): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{self.by}=")}
        if strange := written.keys() - set(periods):
            raise ValueError(f"{name}: rows of periods that aren't refreshed: {sorted(strange)}")
        return {p: written.get(p) for p in periods}

    def show(self, changed: Folders, base: int) -> int:
        """The version after `base`, with the changed folders; an error if that exists by now."""
        folders = {name: {p: f for p, f in (own | changed.get(name, {})).items() if f} for name, own in self.folders(base).items()}
        draft, final = (self._path(f"{self.root}/versions/{n}") for n in (f"{uuid.uuid4().hex}.draft", f"{base + 1}.json"))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {base + 1} was written by another refresh: take its tables and refresh again")
        return base + 1

    def clean(self) -> int:
        """Removes the folders that the latest version doesn't name; how many. For when no reader is on an older one."""
        used = {f for own in self.folders().values() for f in own.values()}
        gone = 0
        for name in self.schemas:
            for version in self._names(f"{self.root}/{name}"):
                folder = f"{self.root}/{name}/{version}"
                old = [f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{self.by}=") and f"{folder}/{n}" not in used]
                for path in old:
                    self._files.delete(self._path(path), True)
                gone += len(old)
        return gone


# ---------------------------------------------------------------- by year, with a partition for all other dates

#: The partition of rows whose year has none.
DEFAULT = "default"


class Years:
    """A table of dated rows with a partition for each year that was added, and one for all other rows, which is a net and not a home."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, date: str):
        whole = StructType([*schema.fields]).add("part", "string")
        self.date, self.columns = date, schema.names
        self.tables = Periods(spark, root, {"rows": whole}, by="part")

    def years(self, version: int | None = None) -> list[str]:
        """The years that have a partition."""
        return sorted(p for p in self.tables.folders(version).get("rows", {}) if p != DEFAULT)

    def _dealt(self, rows: DataFrame, years: list[str]) -> DataFrame:
        year = F.year(self.date).cast("string")
        return rows.select(*self.columns).withColumn("part", F.when(year.isin(years), year).otherwise(DEFAULT) if years else F.lit(DEFAULT))

    def insert(self, rows: DataFrame, key: list[str]) -> list[str]:
        """Adds rows, in place of those of the same key; which partitions were written. Only partitions that new rows fall in, or that held their keys, are."""
        base, dealt = self.tables.version(), self._dealt(rows, self.years())
        old = self.tables.table("rows", version=base)
        same = old.join(rows.select(*key).distinct(), key, "left_semi")
        parts = sorted({r.part for df in (dealt, same) for r in df.select("part").distinct().collect()})
        kept = old.where(F.col("part").isin(parts)).join(rows.select(*key).distinct(), key, "left_anti")
        if parts:
            self.tables.show({"rows": self.tables.write("rows", kept.select(*self.columns, "part").unionByName(dealt), parts)}, base)
        return parts

    def add_year(self, year: int) -> int:
        """Gives a year a partition; the default one's rows of it move there, in one version, so that no reader sees them twice or not at all. How many moved.
        A year that has one already stays as it is; a year without rows has none until they come."""
        base = self.tables.version()
        if str(year) in self.years(base):
            return 0
        others = self.tables.table("rows", version=base).where(F.col("part") == DEFAULT)
        moved = others.where(F.year(self.date) == year).count()
        if moved:
            parts = [str(year), DEFAULT]
            self.tables.show({"rows": self.tables.write("rows", self._dealt(others, [str(year)]), parts)}, base)
        return moved

    def between(self, first: str, last: str) -> DataFrame:
        """Rows dated from first to last: the partitions of those years, and the default one."""
        parts = [*(str(y) for y in range(int(first[:4]), int(last[:4]) + 1)), DEFAULT]
        dated: Column = F.col(self.date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        return self.tables.table("rows").where(F.col("part").isin(parts) & dated).select(*self.columns)
