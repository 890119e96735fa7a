"""What is worth telling of a change, and which rule hears it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .change import traded_usd
from .price import looks_like_split

#: Days for which a filing is news, and changes of one filing that a user is told of.
FRESH_DAYS, MOST_CHANGES = 30, 10


def fresh_pairs(snapshot: DataFrame, filing: DataFrame, now: str) -> DataFrame:
    """filer_id, period, filed_at of published pairs without a suspect flag whose latest source filing is FRESH_DAYS old at most."""
    source = filing.select(F.col("filing_id").alias("source_filing_id"), "filed_at")
    sums = snapshot.join(source, "source_filing_id").groupBy("filer_id", "period").agg(F.max("filed_at").alias("filed_at"), F.max("suspect").alias("suspect"))
    return sums.where((F.col("filed_at") >= F.date_sub(F.lit(now).cast("date"), FRESH_DAYS)) & ~F.col("suspect")).select("filer_id", "period", "filed_at")


def not_split_unadjusted() -> Column:
    """Not an add or trim that looks like a split which nobody has found yet."""
    price = F.try_divide(F.try_divide(F.col("value_usd").cast("double"), F.col("shares").cast("double")), F.try_divide(F.col("prev_value_usd").cast("double"), F.col("prev_shares").cast("double")))
    split = F.col("action").isin("add", "trim") & ~F.col("is_split") & looks_like_split(F.col("prev_shares"), F.col("shares"), F.round(price, 10).cast("decimal(28,10)"))
    return ~F.coalesce(split, F.lit(False))


def filed_events(change: DataFrame, fresh: DataFrame, snapshot: DataFrame, filing: DataFrame) -> DataFrame:
    """That a filer has filed: of each fresh pair its positions, their value, and how many were opened, added to, trimmed and sold out, as
    change_events counts them. A pair's key is the same however often it is filed again."""
    held = snapshot.join(fresh, ["filer_id", "period"]).groupBy("filer_id", "period").agg(F.first("filed_at").alias("filed_at"), F.count("*").alias("positions"), F.sum("value_usd").alias("value_usd"))
    done = change_events(change, fresh, filing).groupBy("filer_id", "period").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("new", "add", "trim", "exit")))
    return held.join(done, ["filer_id", "period"], "left").fillna(0, ["new", "add", "trim", "exit"])


def change_events(change: DataFrame, fresh: DataFrame, filing: DataFrame) -> DataFrame:
    """Changes of fresh pairs worth telling, with `dollars`: no holds, first periods or suspect ones, none across a period that a
    suspect filing withholds, and no unadjusted add or trim that looks like a split."""
    rows = change.join(fresh, ["filer_id", "period"]).where("action <> 'hold' and not suspect and prev_period is not null")
    withheld = filing.where("parse_status = 'suspect'").groupBy("filer_id").agg(F.collect_set("period").alias("withheld"))
    rows = rows.join(withheld, "filer_id", "left").where(~F.coalesce(F.exists("withheld", lambda p: (p > F.col("prev_period")) & (p < F.col("period"))), F.lit(False)))
    return rows.where(not_split_unadjusted()).select("filer_id", "period", "security_id", "action", "filed_at", F.round(traded_usd(), 2).alias("dollars"))


def heard(events: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (rule_id, user_id, kind, target, min_value, created_at) with the events they hear.

    A rule of kind filer_change hears its filer's changes, one of stock_change its stock's: those filed no earlier than the rule was made,
    of min_value dollars or more. Of a filing a user is told of the MOST_CHANGES largest, and what was told of the filer isn't told
    of the stock again. Rules join on kind and target; a filer's or stock's events of one day are few.
    """
    loud = (F.col("created_at") <= F.col("filed_at")) & (F.col("min_value").isNull() | (F.col("dollars") >= F.col("min_value")))
    by = {kind: events.join(rules.where(F.col("kind") == kind).drop("kind").withColumnRenamed("target", key), key).where(loud) for kind, key in (("filer_change", "filer_id"), ("stock_change", "security_id"))}
    order = Window.partitionBy("user_id", "filer_id", "period").orderBy(F.coalesce("dollars", F.lit(0)).desc(), "security_id", "rule_id")
    own = by["filer_change"].withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_CHANGES).drop("place")
    cell = ["user_id", "filer_id", "period", "security_id"]
    stock = by["stock_change"].join(own.select(*cell).distinct(), cell, "left_anti")
    names = ["rule_id", "user_id", "filer_id", "period", "security_id", "action", "dollars"]
    return own.select(*names, F.lit("filer_change").alias("kind")).unionByName(stock.select(*names, F.lit("stock_change").alias("kind")))
