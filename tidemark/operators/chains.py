"""Form 4 amendments linked to what they amend, whichever came first, and the one filing of each chain whose lines count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: The zone of filing dates.
ZONE = "America/New_York"


def link_amendments(filing: DataFrame, owner: DataFrame) -> DataFrame:
    """filing (id, cik, form_type, filed_at, original_day) to id, amends_id and link of each 4/A: linked, no_date, not_loaded or ambiguous.

    Candidates are the issuer's Forms 4 and 4/A filed on the day that the amendment names, before it, with a common owner; of
    several the one with the same owners. All joins are on issuer and day, so a group is one issuer's filings of one day.
    """
    owners = owner.groupBy(F.col("filing_id").alias("id")).agg(F.array_sort(F.collect_set("insider_id")).alias("owners"))
    full = filing.where("form_type in ('4', '4/A')").join(owners, "id", "left")
    mine = full.where("form_type = '4/A'").select("id", "cik", F.col("original_day").alias("day"), "filed_at", "owners")
    theirs = full.select(F.col("id").alias("other"), "cik", F.to_date(F.from_utc_timestamp("filed_at", ZONE)).alias("day"), F.col("filed_at").alias("at"), F.col("owners").alias("others"))
    pairs = mine.join(theirs, ["cik", "day"]).where((F.col("id") != F.col("other")) & (F.col("at") < F.col("filed_at")) & F.arrays_overlap("owners", "others"))
    counts = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("one"), F.collect_list(F.when(F.col("owners") == F.col("others"), F.col("other"))).alias("same"))
    rows = mine.join(counts, "id", "left")
    several = F.col("n") > 1
    chosen = F.when(F.col("n") == 1, F.col("one")).when(several & (F.size("same") == 1), F.try_element_at("same", F.lit(1)))
    link = F.when(F.col("day").isNull(), "no_date").when(chosen.isNotNull(), "linked").when(several & (F.size("same") > 1), "ambiguous").otherwise("not_loaded")
    return rows.select("id", chosen.alias("amends_id"), link.alias("link"))


def chains(filing: DataFrame, links: DataFrame) -> DataFrame:
    """id, root, keeper: each filing's chain, and its latest filed (then greatest accession number) member, which keeps its lines.

    An amendment amends one earlier filing, so a chain is a tree. Only amendments whose parent is an amendment too go
    through the rounds, each of which takes every parent's parent, until none changes: rounds in the logarithm of the longest chain.
    """
    up = written(links.where("amends_id is not null").select("id", F.col("amends_id").alias("root")), "chain")
    while True:
        above = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if up.join(above, "root", "left_semi").isEmpty():
            break
        up = written(up.join(above, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "chain")
    own = filing.where("form_type in ('4', '4/A')").select("id", "filed_at", "accession_no").join(up, "id", "left").withColumn("root", F.coalesce("root", "id"))
    last = F.max(F.struct("filed_at", "accession_no", "id")).over(Window.partitionBy("root"))["id"]
    return own.select("id", "root", last.alias("keeper"))


def superseded_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines of the filings that keep theirs."""
    return lines.join(kept.where("id <> keeper").select(F.col("id").alias("filing_id")), "filing_id", "left_anti")
