"""Disclosed trades of members of Congress: lines with their dates' lags, filters, sums, and what of the reports could be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import Key

#: Days by which a trade is to be disclosed, after it and after the notification; the stored types of each type
#: asked for; the classes that should name a stock; and how many unread filings are listed.
AFTER_TRADE, AFTER_NOTIFICATION = 45, 30
TYPES = {"purchase": ["purchase"], "sale": ["sale", "partial_sale"], "partial_sale": ["partial_sale"], "exchange": ["exchange"]}
RESOLVABLE = ["equity", "stock_option", "unknown"]
MAX_UNREAD = 200


def _distinct_from(column: str, value: str) -> Column:
    return ~F.col(column).eqNullSafe(F.lit(value))


def superseded(filing: DataFrame, line: DataFrame) -> DataFrame:
    """id of each Senate report that a later amendment with a readable line restates: same filed name, same report date."""
    read = line.where("parse_status = 'parsed'").select(F.col("filing_id").alias("id")).distinct()
    senate = filing.where("chamber = 'senate'").select("id", "filed_name_id", "report_date", F.coalesce("amendment", F.lit(0)).alias("number"))
    last = senate.join(read, "id", "left_semi").groupBy("filed_name_id", "report_date").agg(F.max("number").alias("last"))
    return senate.join(last, ["filed_name_id", "report_date"]).where("last > number").select("id")


def term_at(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (member_id, chamber, transaction_date) with `term`: the member's last in that chamber to start by the day, null without one.

    A member has few terms: they come as one array for a member and chamber, so no row is paired with each of them.
    """
    own = terms.groupBy("member_id", "chamber").agg(F.array_sort(F.collect_list(F.struct("start_date", "party", "state", "district"))).alias("terms"))
    started = F.filter("terms", lambda t: t["start_date"] <= F.col("transaction_date"))
    return rows.join(own, ["member_id", "chamber"], "left").withColumn("term", F.try_element_at(started, F.lit(-1))).drop("terms")


def congress_lines(line: DataFrame, filing: DataFrame, filed_name: DataFrame, member: DataFrame, terms: DataFrame) -> DataFrame:
    """Every readable line that is neither deleted nor superseded, with its filer's member and party, state and district on the trade's day.

    Lags, deadline and days_late are of first disclosures alone: lines not marked as amended, of a report that is no amendment,
    filed on or after the trade. The deadline is AFTER_TRADE days after the trade, or AFTER_NOTIFICATION after a
    notification that isn't before it, whichever is first.
    """
    kept = filing.join(superseded(filing, line), "id", "left_anti").withColumnRenamed("id", "filing_id")
    rows = line.where((F.col("parse_status") == "parsed") & _distinct_from("filing_status", "deleted")).join(kept, "filing_id")
    named = filed_name.select(F.col("id").alias("filed_name_id"), "status", "member_id")
    about = member.select(F.col("id").alias("member_id"), "bioguide_id", F.col("full_name").alias("member_name"), F.struct("party", "state", "district").alias("now"))
    rows = term_at(rows.join(named, "filed_name_id", "left"), terms).join(about, "member_id", "left")
    first = _distinct_from("filing_status", "amended") & F.col("amendment").isNull() & (F.col("filing_date") >= F.col("transaction_date"))
    notified = F.col("notification_date") >= F.col("transaction_date")
    deadline = F.least(F.date_add("transaction_date", AFTER_TRADE), F.when(notified, F.date_add("notification_date", AFTER_NOTIFICATION)))
    rows = rows.withColumn("disclosure_deadline", F.when(first, deadline))
    return rows.withColumns({
        "member_match": F.coalesce("status", F.lit("unlinked")), "party": F.coalesce("term.party", "now.party"), "state": F.coalesce("term.state", "now.state"),
        "district": F.when(F.col("term.state").isNull(), F.col("now.district")).otherwise(F.col("term.district")),
        "notification_lag_days": F.when(notified, F.datediff("notification_date", "transaction_date")),
        "disclosure_lag_days": F.when(first, F.datediff("filing_date", "transaction_date")),
        "days_late": F.when(first, F.greatest(F.datediff("filing_date", "disclosure_deadline"), F.lit(0))),
        "amount_key": F.coalesce("amount_low", "amount_exact", F.lit(0)),
    }).withColumn("lag_key", F.coalesce("disclosure_lag_days", F.lit(-1))).drop("term", "now", "status")


def filtered(
    lines: DataFrame, bioguide_ids: list[str] | None = None, chamber: str | None = None, parties: list[str] | None = None, types: list[str] | None = None, asset_classes: list[str] | None = None,
    start: str | None = None, end: str | None = None, disclosed_start: str | None = None, disclosed_end: str | None = None, min_amount: int | None = None, late: bool | None = None,
    security_id: int | None = None, member_id: int | None = None,
) -> DataFrame:
    """Lines that pass all that is asked. A sale is a partial one too; late lines are past their deadline, others known to be within it."""
    day = lambda text: F.lit(text).cast("date")
    stored = [s for t in types or [] for s in TYPES[t]]
    tests = [
        F.col("security_id") == security_id if security_id is not None else None, F.col("member_id") == member_id if member_id is not None else None,
        F.col("bioguide_id").isin(bioguide_ids) if bioguide_ids else None, F.col("chamber") == chamber if chamber else None,
        F.lower("party").isin([p.lower() for p in parties]) if parties else None, F.col("transaction_type").isin(stored) if stored else None,
        F.col("asset_class").isin(asset_classes) if asset_classes else None, F.col("transaction_date") >= day(start) if start else None, F.col("transaction_date") <= day(end) if end else None,
        F.col("filing_date") >= day(disclosed_start) if disclosed_start else None, F.col("filing_date") <= day(disclosed_end) if disclosed_end else None,
        F.col("amount_key") >= min_amount if min_amount is not None else None, (F.col("days_late") > 0 if late else F.col("days_late") == 0) if late is not None else None,
    ]
    for test in tests:
        if test is not None:
            lines = lines.where(test)
    return lines


#: Keys of each order, for paging.page(): the sort, the trade's day, the line.
SORTS = {"disclosed": "filing_date", "traded": None, "amount": "amount_key", "lag": "lag_key"}


def sort_keys(sort: str = "disclosed", descending: bool = True) -> list[Key]:
    lead = [Key(SORTS[sort], descending)] if SORTS[sort] else []
    return [*lead, Key("transaction_date", descending), Key("id", descending)]


def summary(lines: DataFrame) -> DataFrame:
    """One row: lines, filings, members and unmatched filers, first and last trade, late lines, and lags with the lower median."""
    filer = F.coalesce(F.col("filed_name_id").cast("string"), F.concat_ws(":", "chamber", F.coalesce("last_name", F.lit("")), F.coalesce("first_name", F.lit(""))))
    return lines.agg(
        F.count("*").alias("transactions"), F.countDistinct("filing_id").alias("filings"), F.countDistinct("member_id").alias("members"),
        F.countDistinct(F.when(F.col("member_id").isNull(), filer)).alias("unmatched_filers"), F.min("transaction_date").alias("first_transaction_date"), F.max("transaction_date").alias("last_transaction_date"),
        F.count(F.when(F.col("days_late") > 0, 1)).alias("late"), F.count("disclosure_lag_days").alias("lag_known"),
        F.expr("percentile_disc(0.5) within group (order by disclosure_lag_days)").cast("long").alias("median_disclosure_lag_days"), F.max("disclosure_lag_days").alias("max_disclosure_lag_days"),
    )


def summary_by_type(lines: DataFrame) -> DataFrame:
    """For each type, partial sales among the sales: lines, open bands, and the sums of the bands' ends in whole dollars; a single open band has no upper sum."""
    kind = F.when(F.col("transaction_type") == "partial_sale", "sale").otherwise(F.col("transaction_type"))
    low, high = F.coalesce("amount_low", "amount_exact"), F.coalesce("amount_high", "amount_exact")
    open_band = F.col("amount_low").isNotNull() & F.col("amount_high").isNull()
    sums = lines.groupBy(kind.alias("type")).agg(
        F.count("*").alias("transactions"), F.count(F.when(open_band, 1)).alias("open_ended"), F.floor(F.sum(low)).alias("amount_low"), F.ceil(F.sum(high)).alias("high"),
    )
    return sums.select("type", "transactions", "open_ended", "amount_low", F.when(F.col("open_ended") == 0, F.col("high")).alias("amount_high"))


def _counts(line: DataFrame) -> DataFrame:
    """Lines of each filing: read, in review, placeholders, and read ones that should name a stock and do."""
    parsed, resolvable = F.col("parse_status") == "parsed", F.col("asset_class").isin(RESOLVABLE)
    count = lambda test: F.count(F.when(test, 1))
    return line.groupBy("filing_id").agg(
        count(parsed).alias("parsed"), count(F.col("parse_status") == "needs_review").alias("review"), count(F.col("parse_status") == "placeholder").alias("holder"),
        count(parsed & resolvable).alias("resolvable"), count(parsed & resolvable & F.col("security_id").isNotNull()).alias("resolved"),
    )


def with_reason(filing: DataFrame, line: DataFrame) -> DataFrame:
    """Filings with their counts and why none of their lines could be read: pending, unreadable or in_review; null where one was, or all were rejected."""
    full = filing.join(_counts(line).withColumnRenamed("filing_id", "id"), "id", "left").fillna(0, ["parsed", "review", "holder", "resolvable", "resolved"])
    reason = F.when(F.col("parsed") > 0, F.lit(None)).when(F.col("parser_version").isNull(), "pending").when(F.col("holder") > 0, "unreadable").when(F.col("review") > 0, "in_review")
    return full.withColumn("reason", reason)


def chamber_coverage(filing: DataFrame, line: DataFrame, filed_name: DataFrame) -> DataFrame:
    """For each chamber its filings, those read, unreadable and pending, lines in review, filers not matched, and the share of assets resolved."""
    full = with_reason(filing, line).join(filed_name.select(F.col("id").alias("filed_name_id"), "status"), "filed_name_id", "left")
    count = lambda test: F.count(F.when(test, 1))
    sums = full.groupBy("chamber").agg(
        F.count("*").alias("filings"), count(F.col("parsed") > 0).alias("filings_read"), count(F.col("reason").isin("unreadable", "in_review")).alias("filings_unreadable"),
        count(F.col("parser_version").isNull()).alias("filings_pending"), F.sum("review").alias("lines_in_review"), count(_distinct_from("status", "matched")).alias("filings_unmatched_filer"),
        F.sum("resolvable").alias("resolvable"), F.sum("resolved").alias("resolved"), F.min("filing_date").alias("first_filing_date"), F.max("filing_date").alias("latest_filing_date"),
    )
    share = F.round((F.col("resolved") * 100).cast("decimal(20,0)") / F.nullif(F.col("resolvable"), F.lit(0)).cast("decimal(20,0)"), 1)
    every = filing.sparkSession.createDataFrame([("house",), ("senate",)], "chamber string")
    counts = ["filings", "filings_read", "filings_unreadable", "filings_pending", "lines_in_review", "filings_unmatched_filer"]
    return F.broadcast(every).join(sums.withColumn("assets_resolved_pct", share).drop("resolvable", "resolved"), "chamber", "left").fillna(0, counts)


def unread_filings(filing: DataFrame, line: DataFrame, filed_name: DataFrame, member_id: int) -> DataFrame:
    """A member's filings without a line that could be read, and why, latest first."""
    own = filed_name.where(F.col("member_id") == member_id).select(F.col("id").alias("filed_name_id"))
    rows = with_reason(filing.join(own, "filed_name_id", "left_semi"), line).where("reason is not null")
    return rows.orderBy(F.col("filing_date").desc(), F.col("doc_id").desc()).limit(MAX_UNREAD).select("chamber", "doc_id", "filing_date", "reason")
