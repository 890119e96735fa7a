"""Which filings count: the base of each period, the additions after it, and which of a filer's CIKs speaks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Filings that have been loaded.
LOADED = ("ok", "suspect")


def countable(filing: DataFrame) -> DataFrame:
    """Loaded 13F-HR filings, and amendments of a known kind, with `whole`: does it stand for the entire period."""
    form = F.upper("form_type")
    known = F.col("parse_status").isin(*LOADED) & F.col("filer_id").isNotNull() & ((form == "13F-HR") | ((form == "13F-HR/A") & F.col("amendment_kind").isNotNull()))
    return filing.where(known).withColumn("whole", (form == "13F-HR") | F.coalesce(F.col("amendment_kind") == "restatement", F.lit(False)))


def effective_filing_by_cik(filing: DataFrame) -> DataFrame:
    """filing_id, filer_id, cik, period: per filer, CIK and period the latest whole filing and the additions filed
    after it; all additions where none is whole. Ties of time go to the greater accession number.

    One window finds the base, so filings are shuffled once and nothing is joined.
    """
    by = Window.partitionBy("filer_id", "cik", "period")
    order = F.struct("filed_at", "accession_no")
    based = countable(filing).withColumn("at", order).withColumn("base", F.max(F.when(F.col("whole"), F.col("at"))).over(by))
    return based.where(F.col("base").isNull() | (F.col("at") >= F.col("base"))).select("filing_id", "filer_id", "cik", "period")


def effective_filing(by_cik: DataFrame, filers: DataFrame, ciks: DataFrame) -> DataFrame:
    """Filers that sum keep every CIK's filings; of others the CIK of the highest priority, then the greatest CIK, keeps the
    period. filers: filer_id, overlap. ciks: filer_id, cik, priority; a CIK without a row or a priority counts as -1."""
    known = by_cik.join(filers.select("filer_id", "overlap"), "filer_id")
    ranked = known.join(ciks.select("filer_id", "cik", "priority"), ["filer_id", "cik"], "left")
    by = Window.partitionBy("filer_id", "period").orderBy(F.coalesce("priority", F.lit(-1)).desc(), F.col("cik").desc())
    return ranked.withColumn("place", F.dense_rank().over(by)).where((F.col("overlap") == "sum") | (F.col("place") == 1)).select("filing_id", "filer_id", "cik", "period")


def resolved_filings(effective: DataFrame, period: str) -> DataFrame:
    return effective.where(F.col("period") == F.lit(period).cast("date"))


BY_CIK_SQL = """SELECT filing_id, filer_id, cik, period FROM (SELECT *, max(CASE WHEN whole THEN accession_order END) OVER (PARTITION BY filer_id, cik, period) AS base FROM
  (SELECT *, form_type = '13F-HR' OR coalesce(amendment_kind = 'restatement', false) AS whole, strftime(filed_at, '%Y%m%d%H%M%S%f') || accession_no AS accession_order FROM amendment
   WHERE parse_status IN ('ok', 'suspect') AND (form_type = '13F-HR' OR amendment_kind IS NOT NULL)))
  WHERE base IS NULL OR accession_order >= base"""
EFFECTIVE_SQL = """SELECT filing_id, filer_id, cik, period FROM
  (SELECT b.*, overlap, dense_rank() OVER (PARTITION BY filer_id, period ORDER BY coalesce(priority, -1) DESC, cik DESC) AS place
   FROM by_cik b JOIN amendment_filer USING (filer_id) LEFT JOIN amendment_cik USING (filer_id, cik))
  WHERE overlap = 'sum' OR place = 1"""
