"""Derived tables stored once, in order of dependency, and read by everything after."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables of a row for each position are partitioned by period: a query of one period reads its files alone.
BY_PERIOD = ("snapshot", "change")
#: Postings are sorted by their key, so that a reader of a few of them skips the other row groups.
SORTED = {"stock_grams": "gram", "investor_grams": "gram"}
_ROOTS: dict[str, str] = {}
_FOUND: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one a temporary folder, which only a local master may have."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _ROOTS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidemark-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame as a table in the shared folder: a step of an iteration, whose lineage it cuts."""
    path = f"{shared_folder(df.sparkSession)}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables of one input folder. A table is written when it is first asked for and then read back, in this application."""

    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source = spark, source
        self.seconds: dict[str, float] = {}

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.source, name

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self._key(name) not in _FOUND:
            self.refresh(name, build)
        return self.spark.read.parquet(_FOUND[self._key(name)])

    def refresh(self, name: str, build: Callable[[], DataFrame]) -> None:
        """Writes the table anew, beside the old one, and then lets readers see it: none ever finds it half written."""
        began = time.time()
        path = f"{shared_folder(self.spark)}/derived/{name}-{uuid.uuid4().hex}"
        if name in BY_PERIOD:  # rebalanced, so that files are neither tiny nor, for a large period, one
            build().hint("rebalance", "period").write.partitionBy("period").parquet(path)
        elif name in SORTED:
            build().repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name]).write.parquet(path)
        else:
            build().hint("rebalance").write.parquet(path)
        _FOUND[self._key(name)] = path
        self.seconds[name] = time.time() - began
