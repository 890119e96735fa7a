"""The derived tables over the driver's tables, each built from those before it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators import change, clusters, effective, price, snapshot, views
from ..sources.store import Store
from .domain import Domain

#: How each stored table is built from stored ones, in order of dependency.
BUILDERS: dict[str, Callable] = {
    "snapshot": lambda t: snapshot.position_snapshot(t.effective, t.filing, t.holding),
    "published": lambda t: snapshot.filer_period(t.snapshot),
    "prices": lambda t: price.implied_price(t.snapshot),
    "verdicts": lambda t: price.judge(price.split_candidates(t.snapshot, t.prices)),
    "change": lambda t: change.position_change(t.snapshot, t.splits),
    "consensus": lambda t: views.consensus_holdings(t.snapshot),
    "flows": lambda t: views.quarter_flows(t.change),
    "summary": lambda t: views.filer_summary(t.snapshot, t.change),
    "year": lambda t: views.year_flows(t.flows, t.change),
    "feed": lambda t: views.filing_feed(t.winning, t.summary, t.change),
    "best": lambda t: views.top_holding(t.snapshot),
    "episodes": lambda t: clusters.cluster_grid(t.lines),
}


#: Tables that can be built side by side, each row of them after the one before.
LEVELS = [["snapshot", "episodes"], ["published", "prices", "consensus", "best"], ["verdicts"], ["change"], ["flows", "summary"], ["year", "feed"]]


class Derived:
    """Derived tables by name: a stored one is written when it is first read. fresh() builds one anew from stored ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.domain, self.store = spark, Domain(spark, sf_dir), Store(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise AttributeError(name)
        return self.store.table(name, lambda: BUILDERS[name](self))

    def fresh(self, name: str) -> DataFrame:
        return BUILDERS[name](self)

    def refresh(self) -> None:
        """All stored tables anew, in order."""
        for level in LEVELS:  # one thread for each, so that a table's small last tasks don't leave the cluster idle
            with ThreadPoolExecutor(len(level)) as pool:
                list(pool.map(lambda name: self.store.refresh(name, lambda: BUILDERS[name](self)), level))

    @property
    def filing(self) -> DataFrame:
        return self.domain.filing()

    @property
    def holding(self) -> DataFrame:
        return self.domain.holding()

    @property
    def filer(self) -> DataFrame:
        return self.domain.filer()

    @property
    def security(self) -> DataFrame:
        return self.domain.security()

    @property
    def lines(self) -> DataFrame:
        return self.domain.insider_line()

    @property
    def effective(self) -> DataFrame:
        return self.filing.select("filing_id", "filer_id", "cik", "period")

    @property
    def winning(self) -> DataFrame:
        return snapshot.winning_filings(self.effective, self.filing)

    @property
    def splits(self) -> DataFrame:
        """The splits that the chain has found before the changes are made."""
        return price.splits_of(self.verdicts)

    @property
    def amendments(self) -> DataFrame:
        return effective.effective_filing_by_cik(self.domain.amendment())


#: The derived tables for DuckDB, in order of dependency.
SQL = {
    "by_cik": effective.BY_CIK_SQL, "effective_filing": effective.EFFECTIVE_SQL, "snapshot": snapshot.SNAPSHOT_SQL, "filer_period": snapshot.FILER_PERIOD_SQL, "published": change.PUBLISHED_SQL,
    "price": price.PRICE_SQL, **price.SPLIT_SQL, "change": change.CHANGE_SQL, "consensus": views.CONSENSUS_SQL, "flowing": views.FLOWING_SQL, "flows": views.FLOWS_SQL, "year_flows": views.YEAR_SQL,
    "summary": views.SUMMARY_SQL, "feed": views.FEED_SQL, "counted": clusters.COUNTED_SQL,
}
