"""What each filer held at the end of each published period, and which periods are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, SHARES, WEIGHT, percent


def common_stock(holding: DataFrame) -> DataFrame:
    return holding.where("put_call is null and sshprnamt_type = 'SH'")


def winning_filings(effective: DataFrame, filing: DataFrame, include_suspect: bool = False) -> DataFrame:
    """Effective filings with filed_at and the period's suspect flag; one suspect filing withholds its whole period."""
    by = Window.partitionBy("filer_id", "period")
    about = filing.select("filing_id", "filed_at", (F.col("parse_status") == "suspect").alias("own"))
    found = effective.select("filing_id", "filer_id", "period").join(about, "filing_id").withColumn("suspect", F.max("own").over(by)).drop("own")
    return found if include_suspect else found.where("not suspect")


def position_snapshot(effective: DataFrame, filing: DataFrame, holding: DataFrame, include_suspect: bool = False) -> DataFrame:
    """filer_id, period, security_id, shares, value_usd, weight_pct, source_filing_id, suspect.

    Common stock of a period's winning filings, summed by security; the source is the one filed last. A weight is a
    share of the period's total, null where that is nothing.

    Lines are summed by filing and security where they meet their filings, and the sums are then dealt by filer and period, which serves both theirs and the totals. Filings are numbered in the order filed, so
    that the last one's number is found in the same hashed sums.
    """
    lines = common_stock(holding).select("filing_id", "security_id", "shares", "value_usd").repartition("filing_id")
    lines = lines.groupBy("filing_id", "security_id").agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"))
    filed = F.row_number().over(Window.partitionBy("filer_id", "period").orderBy("filed_at", "filing_id"))
    winning = winning_filings(effective, filing, include_suspect).withColumn("place", filed).drop("filed_at")
    held = lines.join(winning, "filing_id").repartition("filer_id", "period")
    cells = held.groupBy("filer_id", "period", "security_id").agg(
        F.sum("shares").cast(SHARES).alias("shares"), F.sum("value_usd").cast(MONEY).alias("value_usd"),
        F.max_by("filing_id", "place").alias("source_filing_id"), F.max("suspect").alias("suspect"),
    )
    total = F.sum("value_usd").over(Window.partitionBy("filer_id", "period"))
    return cells.withColumn("weight_pct", percent(F.col("value_usd"), total).cast(WEIGHT)).select("filer_id", "period", "security_id", "shares", "value_usd", "weight_pct", "source_filing_id", "suspect")


def filer_period(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("filer_id", "period").agg(F.max("suspect").alias("suspect"))


#: snapshot and filer_period for DuckDB. Each mapped period has one filing.
SNAPSHOT_SQL = """SELECT filer_id, period, security_id, shares, value_usd, round(value_usd::DOUBLE * 100 / nullif(sum(value_usd) OVER (PARTITION BY filer_id, period), 0)::DOUBLE, 6) AS weight_pct, source_filing_id, false AS suspect
  FROM (SELECT h.filer_id, h.period, security_id, sum(shares)::DECIMAL(20,4) AS shares, sum(value_usd)::DECIMAL(20,2) AS value_usd, max(h.filing_id) AS source_filing_id
  FROM holding h JOIN filing f USING (filing_id) WHERE put_call IS NULL AND sshprnamt_type = 'SH' AND parse_status = 'ok' GROUP BY 1, 2, 3)"""
FILER_PERIOD_SQL = "SELECT filer_id, period, false AS suspect FROM snapshot GROUP BY 1, 2"
