"""Incremental recomputation: which cells late filings touch, and the chain of derived tables with just those made anew."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import next_quarter, previous_quarter
from ..sources.partitions import Folders, Periods
from ..sources.store import written
from .change import position_change
from .price import implied_price, judge, split_candidates, splits_of
from .snapshot import filer_period, position_snapshot

_PAIR, _CELL = ["filer_id", "period"], ["security_id", "period"]


def following(pairs: DataFrame, published: DataFrame) -> DataFrame:
    """The next published period after each pair, whose changes are from it."""
    later = published.select("filer_id", F.col("period").alias("next"))
    return pairs.join(later, "filer_id").where("next > period").groupBy(*_PAIR).agg(F.min("next").alias("next")).select("filer_id", F.col("next").alias("period")).distinct()


def split_keys(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(security_id, period) whose split verdict the pairs can move: theirs and the next calendar quarter's."""
    return with_next_quarter(snapshot.join(pairs, _PAIR, "left_semi").select(*_CELL).distinct())


def with_next_quarter(cells: DataFrame) -> DataFrame:
    return cells.unionByName(cells.select("security_id", next_quarter(F.col("period")).alias("period"))).distinct()


def moved_splits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(security_id, period) of splits that came, went or changed their ratio."""
    ratio = lambda df, name: df.select(*_CELL, F.struct("numerator", "denominator").alias(name))
    return ratio(before, "was").join(ratio(after, "now"), _CELL, "full").where("not (was <=> now)").select(*_CELL)


def crossing(moved: DataFrame, change: DataFrame) -> DataFrame:
    """Pairs, of any filer, whose changes span a split (security_id, period) that came, went or changed."""
    at = moved.select("security_id", F.col("period").alias("split_period"))
    return change.join(at, "security_id").where("split_period > prev_period and split_period <= period").select(*_PAIR).distinct()


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The old rows outside the keys, and the new ones."""
    return old.join(keys.select(*on).distinct(), on, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _periods(*cells: DataFrame) -> list[str]:
    """The periods of some cells, a list of quarters."""
    return sorted({str(r.period) for c in cells for r in c.select("period").distinct().collect()})


def _of(rows: DataFrame, periods: Iterable[str]) -> DataFrame:
    """The rows of some periods: a filter on partitions."""
    return rows.where(F.col("period").isin([F.lit(p).cast("date") for p in periods] or [None]))


def chain_schemas(effective: DataFrame, filing: DataFrame, holding: DataFrame) -> dict:
    """The tables of the chain, in order of dependency, with their columns."""
    snapshot = position_snapshot(effective, filing, holding)
    prices = implied_price(snapshot)
    verdicts = judge(split_candidates(snapshot, prices))
    made = {"snapshot": snapshot, "published": filer_period(snapshot), "prices": prices, "verdicts": verdicts, "change": position_change(snapshot, splits_of(verdicts))}
    return {name: df.schema for name, df in made.items()}


def refresh(tables: Periods, pairs: DataFrame, effective: DataFrame, filing: DataFrame, holding: DataFrame) -> dict[str, list[str]]:
    """The chain of derived tables after filings of some (filer_id, period) pairs came, changed or went; which periods of which table were written.

    In order: the pairs' positions; the prices of securities that they held, before or after; the verdicts of those securities in the same and the
    next calendar quarters; then the changes of the pairs, of each one's next published period, and of all pairs, of any filer, whose
    changes span a split that moved. Each table rewrites the periods that have such cells, from its old rows and the new ones, beside
    the old files; all are shown together. Given again, the same pairs make the same tables, so a batch that failed may be repeated.

    effective, filing and holding are the filings as they are now; of holdings, the pairs' periods are read. All pairs on
    empty tables are a full build.
    """
    base, changed = tables.version(), Folders()
    was = lambda name: tables.table(name, version=base)
    now = lambda name: tables.table(name, changed, base)

    pairs = written(pairs.select(*_PAIR).distinct(), "pairs")
    own = _periods(pairs)
    if not own:
        return {}
    held = _of(holding, own) if "period" in holding.columns else holding
    new = position_snapshot(effective.join(pairs, _PAIR, "left_semi"), filing, held)
    changed["snapshot"] = tables.write("snapshot", replaced(_of(was("snapshot"), own), new, pairs, _PAIR), own)
    changed["published"] = tables.write("published", filer_period(_of(now("snapshot"), own)), own)

    touched = [_of(t("snapshot"), own).join(pairs, _PAIR, "left_semi").select(*_CELL) for t in (was, now)]
    cells = written(touched[0].unionByName(touched[1]).distinct(), "cells")
    new = implied_price(_of(now("snapshot"), own).join(cells, _CELL, "left_semi"))
    changed["prices"] = tables.write("prices", replaced(_of(was("prices"), own), new, cells, _CELL), own)

    judged = written(with_next_quarter(cells), "judged")
    then = _periods(judged)
    needed = judged.unionByName(judged.select("security_id", previous_quarter(F.col("period")).alias("period"))).distinct()
    read = _periods(needed)
    part = [_of(now(name), read).join(needed, _CELL, "left_semi") for name in ("snapshot", "prices")]
    new = judge(split_candidates(*part)).join(judged, _CELL, "left_semi")
    changed["verdicts"] = tables.write("verdicts", replaced(_of(was("verdicts"), then), new, judged, _CELL), then)

    moved = written(moved_splits(splits_of(_of(was("verdicts"), then)), splits_of(_of(now("verdicts"), then))), "moved")
    first = moved.agg(F.min("period")).first()[0]
    spans = was("change").where(F.col("period") >= F.lit(first))  # a filter on partitions; none pass where nothing moved
    filers = now("published").join(pairs.select("filer_id").distinct(), "filer_id", "left_semi")
    scope = written(pairs.unionByName(following(pairs, filers)).unionByName(crossing(moved, spans)).distinct(), "scope")

    published = now("published").join(scope.select("filer_id").distinct(), "filer_id", "left_semi").select(*_PAIR)
    before = F.lag("period").over(Window.partitionBy("filer_id").orderBy("period"))
    previous = published.withColumn("before", before).join(scope, _PAIR, "left_semi").where("before is not null").select("filer_id", F.col("before").alias("period"))
    read = written(scope.unionByName(previous).distinct(), "read")
    dated = _periods(scope)
    # of a filer's periods that aren't read some lie between: changes across those are dropped, the old ones stay
    new = position_change(_of(now("snapshot"), _periods(read)).join(read, _PAIR, "left_semi"), splits_of(now("verdicts"))).join(scope, _PAIR, "left_semi")
    changed["change"] = tables.write("change", replaced(_of(was("change"), dated), new, scope, _PAIR), dated)
    tables.show(changed, base)
    return {name: sorted(own) for name, own in changed.items()}
