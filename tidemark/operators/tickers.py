"""The history of securities' tickers: ranges recorded by hand, and ranges that a new ticker closes and opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

_RANGE = ["security_id", "ticker", "valid_from", "valid_to", "source"]
_FIRST, _LAST = "0001-01-01", "9999-12-31"


def _low(name: str) -> Column:
    return F.coalesce(name, F.lit(_FIRST).cast("date"))


def _high(name: str) -> Column:
    return F.coalesce(name, F.lit(_LAST).cast("date"))


def _entered(ranges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One change of each security at most: the ranges after it, and (change_id, outcome, reason, trimmed) of each."""
    new = changes.select("change_id", "security_id", F.col("ticker").alias("new_ticker"), F.col("valid_from").alias("new_from"), F.col("valid_to").alias("new_to"))
    met = ranges.join(new, "security_id", "left")
    start, end, low, high = _low("new_from"), F.col("new_to"), _low("valid_from"), _high("valid_to")
    overlaps = F.col("change_id").isNotNull() & (low < end) & (start < high)
    swallowed = overlaps & (start <= low) & (high <= end)
    unknown_start = F.col("valid_from").isNull() & (end < high)  # a start that nobody knows gives way
    cut = overlaps & ~swallowed & (low < start) & (end < high) & ~unknown_start
    keeps_head = (low < start) & ~unknown_start
    met = met.withColumns({"overlaps": overlaps, "against": F.when(swallowed, "lies wholly inside it").when(cut, "would be cut in two"), "head": keeps_head})
    by = Window.partitionBy("security_id")
    met = met.withColumn("refused", F.coalesce(F.max(F.col("against").isNotNull()).over(by), F.lit(False)))
    trims = F.col("overlaps") & ~F.col("refused")
    kept = met.select(
        "security_id", "ticker", F.when(trims & ~F.col("head"), F.col("new_to")).otherwise(F.col("valid_from")).alias("valid_from"),
        F.when(trims & F.col("head"), F.col("new_from")).otherwise(F.col("valid_to")).alias("valid_to"), "source",
    )
    found = met.where("change_id is not null").groupBy("change_id").agg(
        F.min(F.when(F.col("against").isNotNull(), F.concat_ws(" ", "ticker", "against"))).alias("reason"), F.count_if(F.col("overlaps")).alias("overlapping")
    )
    told = changes.join(found, "change_id", "left")
    told = told.withColumn("outcome", F.when(F.col("reason").isNull(), "recorded").otherwise("refused"))
    added = told.where("outcome = 'recorded'").select("security_id", "ticker", "valid_from", "valid_to", F.lit("manual").alias("source"))
    trimmed = F.when(F.col("outcome") == "recorded", F.coalesce("overlapping", F.lit(0))).otherwise(F.lit(0))
    return kept.unionByName(added), told.select("change_id", "outcome", "reason", trimmed.alias("trimmed"))


def enter_history(ranges: DataFrame, changes: DataFrame, security: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges (security_id, ticker, valid_from, valid_to, source) after changes (change_id, cusip, ticker, valid_from, valid_to), and
    what became of each change: change_id, outcome (recorded or refused), reason, trimmed (ranges).

    That a security traded under a ticker from valid_from (null: ever) until valid_to trims a range that overlaps one end to meet it, and one without a known
    start to begin after it. A range that it would swallow whole, or cut in two, refuses the change, as does an unknown CUSIP; then
    nothing changes. Changes of one security take effect in the order of their ids, each on what those before it left: as many rounds as
    the security with the most has changes, each of them for all securities at once.
    """
    known = changes.join(security.select("cusip", "security_id").dropDuplicates(["cusip"]), "cusip", "left")
    unknown = known.where("security_id is null").select("change_id", F.lit("refused").alias("outcome"), F.concat(F.lit("no security has the CUSIP "), F.coalesce("cusip", F.lit(""))).alias("reason"), F.lit(0).cast("long").alias("trimmed"))
    turns = written(known.where("security_id is not null").withColumn("turn", F.row_number().over(Window.partitionBy("security_id").orderBy("change_id"))), "changes")
    ranges, outcomes = ranges.select(*_RANGE), unknown
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        after, told = _entered(ranges, turns.where(F.col("turn") == turn))
        outcomes = outcomes.unionByName(written(told, "outcomes"))
        ranges = written(after, "ranges")
    return ranges, outcomes


def record_tickers(ranges: DataFrame, changes: DataFrame, day: str) -> DataFrame:
    """Ranges after securities took new tickers (security_id, ticker, source) on a day, with `event`: opened, renamed, replaced, or null.

    An open range under another ticker ends that day; one that began no earlier was never valid and takes the new ticker instead. The new range starts where the
    security's history ends, or has no start without any. A security whose open range has the ticker already keeps it. One change of a security
    at most; letters' case doesn't count.
    """
    on = F.lit(day).cast("date")
    new = changes.select("security_id", F.col("ticker").alias("new_ticker"), F.col("source").alias("new_source"))
    met = ranges.select(*_RANGE).join(new, "security_id", "left")
    other = F.col("valid_to").isNull() & (F.upper("ticker") != F.upper("new_ticker"))
    replaced = other & F.coalesce(F.col("valid_from") >= on, F.lit(False))
    closed = other & ~replaced
    rows = met.select(
        "security_id", F.when(replaced, F.col("new_ticker")).otherwise(F.col("ticker")).alias("ticker"), "valid_from", F.when(closed, on).otherwise(F.col("valid_to")).alias("valid_to"),
        F.when(replaced, F.col("new_source")).otherwise(F.col("source")).alias("source"), F.when(replaced, "replaced").when(closed, "closed").alias("event"),
    )
    state = rows.groupBy("security_id").agg(
        F.max("valid_to").alias("ended"), F.max(F.col("event") == "closed").alias("renamed"), F.collect_set(F.when(F.col("valid_to").isNull(), F.upper("ticker"))).alias("open")
    )
    opened = new.join(state, "security_id", "left").where(~F.coalesce(F.array_contains("open", F.upper("new_ticker")), F.lit(False)))
    opened = opened.select("security_id", F.col("new_ticker").alias("ticker"), F.col("ended").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.col("new_source").alias("source"), F.when(F.coalesce("renamed", F.lit(False)), "renamed").otherwise("opened").alias("event"))
    return rows.unionByName(opened)
