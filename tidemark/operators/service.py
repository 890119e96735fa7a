"""Queries about the service itself: runs of jobs, accounts' plans and entitlements, backfills, and windows of what a plan shows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.periods import next_quarter, quarter_end

FREE = "free"


# ---------------------------------------------------------------- runs


def recent_runs(runs: DataFrame, n: int, job: str | None = None) -> DataFrame:
    """The n runs (run_id, job_name, status, started_at, finished_at) started last, of one job or all."""
    rows = runs.where(F.col("job_name") == job) if job else runs
    return rows.orderBy(F.col("started_at").desc(), "run_id").limit(n)


def last_successes(runs: DataFrame) -> DataFrame:
    """Each job's latest successful run; of several at one time the one of the smallest id. A job without any has no row."""
    best = F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", (-F.col("run_id")).alias("r")))
    return runs.where("status = 'success'").groupBy("job_name").agg(best.alias("b")).select("job_name", "b.run_id", "b.finished_at")


def freshness(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every job with its latest success, null for one that never succeeded."""
    return jobs.select("job_name").distinct().join(last_successes(runs), "job_name", "left")


# ---------------------------------------------------------------- accounts


def accounts(users: DataFrame, subscriptions: DataFrame, overrides: DataFrame, keys: DataFrame) -> DataFrame:
    """user_id, plan, billed_plan, grandfathered_plan, override_plan, override_expires_at, last_seen_at of every account.

    users: user_id, last_seen_at. subscriptions: user_id, live, plan, grandfathered. overrides: id, user_id, live, plan, expires_at; of
    several live ones the greatest id counts. keys: user_id, last_used_at. An override comes before what is billed, else it is free.
    """
    billed = subscriptions.where("live").select("user_id", F.col("plan").alias("billed_plan"), F.col("grandfathered").alias("grandfathered_plan"))
    given = overrides.where("live").groupBy("user_id").agg(F.max(F.struct("id", "plan", "expires_at")).alias("o"))
    used = keys.groupBy("user_id").agg(F.max("last_used_at").alias("used"))
    full = users.join(billed, "user_id", "left").join(given, "user_id", "left").join(used, "user_id", "left")
    return full.select(
        "user_id", F.coalesce("o.plan", "billed_plan", F.lit(FREE)).alias("plan"), "billed_plan", "grandfathered_plan", F.col("o.plan").alias("override_plan"), F.col("o.expires_at").alias("override_expires_at"),
        F.greatest("last_seen_at", "used").alias("last_seen_at"),
    )


def plan_mix(all_accounts: DataFrame) -> DataFrame:
    return all_accounts.groupBy("plan").agg(F.count("*").alias("accounts"))


def entitlements(all_accounts: DataFrame, own: DataFrame, terms: DataFrame) -> DataFrame:
    """user_id, key, value: what each account may do. The override plan's value of a key comes first, then for subscribers their
    subscription's own value, the grandfathered plan's and the plan's, and at last the free plan's. own: user_id, key, value. terms: plan, key, value.

    Plans are a handful, so their terms are one map for each plan, and accounts meet them in broadcast joins.
    """
    maps = F.broadcast(terms.groupBy("plan").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("terms")))
    full = all_accounts.select("user_id", "override_plan", "grandfathered_plan", "billed_plan")
    for name in ("override", "grandfathered", "billed"):
        full = full.join(maps.select(F.col("plan").alias(f"{name}_plan"), F.col("terms").alias(name)), f"{name}_plan", "left")
    kept = own.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("own"))
    free = terms.where(F.col("plan") == FREE).select("key", F.col("value").alias("free"))
    full = full.join(kept, "user_id", "left").crossJoin(F.broadcast(free))  # a free plan has every key: some ten rows
    at = lambda name: F.try_element_at(F.col(name), F.col("key"))
    subscribed = F.col("billed_plan").isNotNull()
    value = F.coalesce(at("override"), F.when(subscribed, F.coalesce(at("own"), at("grandfathered"), at("billed"))), F.col("free"))
    return full.select("user_id", "key", value.alias("value"))


# ---------------------------------------------------------------- windows, meters and plans of work


def months_before(day: Column, months: int) -> Column:
    """The same day of the month so many months earlier, or its last day where it has no such day."""
    return F.add_months(day, -months)


def history_from(today: Column, quarters: int | None) -> Column:
    """The first period that a plan of so many quarters shows: null for all; for none the one after the quarter being filed."""
    current = F.when(today == quarter_end(today), today).otherwise(F.last_day(F.add_months(F.trunc(today, "quarter"), -1)))
    if quarters is None:
        return F.lit(None).cast("date")
    return next_quarter(current) if quarters == 0 else F.last_day(F.add_months(F.trunc(current, "month"), -3 * (quarters - 1)))


def quota_month(anchor: Column, today: Column) -> Column:
    """struct(start, end) of the month, counted from the anchor's day, that today lies in; a short month has its last day for it."""
    day = F.dayofmonth(anchor)
    on = lambda month: F.least(F.date_add(F.trunc(month, "month"), day - 1), F.last_day(month))
    start = F.when(on(today) <= today, on(today)).otherwise(on(F.add_months(F.trunc(today, "month"), -1)))
    return F.struct(start.alias("start"), on(F.add_months(F.trunc(start, "month"), 1)).alias("end"))


def metered(counts: DataFrame, limits: DataFrame, warn_percent: int = 80) -> DataFrame:
    """counts (account, period_start, flushed) in any order to each account's usage, the largest count seen, and whether the share
    of its limit that is warned of was reached. A late or repeated flush changes nothing."""
    used = counts.groupBy("account", "period_start").agg(F.max("flushed").alias("used"))
    return used.join(limits, "account", "left").withColumn("warned", F.coalesce(F.col("used") * 100 >= F.col("limit") * warn_percent, F.lit(False)))


def backfill_plan(queue: DataFrame, loaded: DataFrame, force: bool = False) -> DataFrame:
    """queue (accession_no, form_type, status) against loaded (accession_no): each 13F filing once with what to do: load, reload
    (loaded, but forced), or skip; and whether a queued row is done because its filing is loaded."""
    own = queue.where(F.col("form_type").startswith("13F")).select("accession_no", "status")
    full = own.join(loaded.select("accession_no", F.lit(True).alias("has")), "accession_no", "full")
    has = F.coalesce("has", F.lit(False))
    work = F.when(has, F.lit("reload" if force else "skip")).otherwise("load")
    return full.select("accession_no", "status", work.alias("work"), F.coalesce(has & (F.col("status") == "pending"), F.lit(False)).alias("mark_done"))


def table_coverage(filing: DataFrame, line: DataFrame) -> DataFrame:
    """One row over filings that were tried (parser_version or parse_error): read, in review alone, by extraction, placeholders, missing, and lines."""
    count = lambda test: F.count(F.when(test, 1))
    rows = line.groupBy("filing_id").agg(
        count(F.col("parse_status") == "parsed").alias("parsed"), count(F.col("parse_status") == "needs_review").alias("review"), count(F.col("parse_status") == "placeholder").alias("holder")
    )
    full = filing.where("parser_version is not null or parse_error is not null").join(rows.withColumnRenamed("filing_id", "id"), "id", "left")
    lines = F.col("holder") == 0
    return full.agg(
        F.count("*").alias("seen"), count(lines & (F.col("parsed") > 0)).alias("read"), count(lines & (F.col("parsed") == 0)).alias("review_only"),
        *(count((F.col("extraction") == x) & lines).alias(f"by_{x}") for x in ("text", "ocr", "html")), count(F.col("holder") > 0).alias("placeholders"),
        count(F.col("parser_version").isNull()).alias("missing"), F.coalesce(F.sum("parsed"), F.lit(0)).alias("rows_parsed"), F.coalesce(F.sum("review"), F.lit(0)).alias("rows_needs_review"),
    )


def review_queue(lines: DataFrame, size: int, offset: int) -> DataFrame:
    """Groups (key, lines, dollars) of lines that a person is to look at, the largest first; a page by its number."""
    groups = lines.groupBy("key").agg(F.count("*").alias("lines"), F.sum("dollars").alias("dollars"), F.min("id").alias("example"))
    return groups.orderBy(F.col("lines").desc(), F.coalesce("dollars", F.lit(0)).desc(), "key").offset(offset).limit(size)


def reconciled_queue(queue: DataFrame, found: DataFrame, loaded: DataFrame) -> DataFrame:
    """The queue (accession_no, status) after a crawl: newly found filings are pending, those loaded done, the rest as they were."""
    every = queue.select("accession_no", "status").unionByName(found.join(queue, "accession_no", "left_anti").select("accession_no", F.lit("pending").alias("status")))
    full = every.join(loaded.select("accession_no", F.lit(True).alias("has")), "accession_no", "left")
    return full.select("accession_no", F.when(F.col("has"), "done").otherwise(F.col("status")).alias("status"))


# ---------------------------------------------------------------- checks of reference data


def stale_cutoff(today: Column, window_days: int = 45) -> Column:
    """The oldest latest period that isn't stale: the quarter before the last one whose deadline has passed."""
    due = F.date_sub(today, window_days)
    last = F.when(due == quarter_end(due), due).otherwise(F.last_day(F.add_months(F.trunc(due, "quarter"), -1)))
    return F.last_day(F.add_months(F.trunc(last, "month"), -3))


#: Legal words that names are compared without, and the least likeness of a filer's name to ours.
LEGAL = ["inc", "llc", "lp", "llp", "ltd", "limited", "co", "corp", "corporation", "plc", "sa", "ag"]
NAME_ALIKE = 0.6


def comparable_name(name: Column) -> Column:
    """Lower case without points, other marks as spaces, legal words left out."""
    words = F.split(F.regexp_replace(F.replace(F.lower(name), F.lit("."), F.lit("")), "[^0-9a-z]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(LEGAL)), " ")


@F.pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over all letters: the longest block, then likewise on either side of it (Ratcliff and Obershelp)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def verified_investors(entries: DataFrame, filing: DataFrame, today: str) -> DataFrame:
    """entries (filer_id, cik, current, and, if there are such columns, edgar_name, display_name and manager_name) with their 13F-HR count, first
    and last period, and failures and warnings: no_13f, stale (a warning alone for a CIK that no longer files), name_mismatch (the filer's name is less than
    NAME_ALIKE like either of ours, or unknown)."""
    own = filing.where("form_type = '13F-HR'").groupBy("filer_id", "cik").agg(F.count("*").alias("filings"), F.min("period").alias("earliest"), F.max("period").alias("latest"))
    full = entries.join(own, ["filer_id", "cik"], "left").fillna(0, ["filings"])
    none, stale = F.col("filings") == 0, F.col("latest").isNull() | (F.col("latest") < stale_cutoff(F.lit(today).cast("date")))
    failure = F.when(none, "no_13f").when(stale & F.col("current"), "stale")
    columns = ["filer_id", "cik", "current", "filings", "earliest", "latest", failure.alias("failure"), F.when(~none & stale & ~F.col("current"), "stale").alias("warning")]
    if "edgar_name" not in entries.columns:
        return full.select(*columns)
    theirs = comparable_name(F.col("edgar_name"))
    alike = F.greatest(*(matching_blocks(theirs, comparable_name(F.col(c))) for c in ("display_name", "manager_name")))
    full = full.withColumn("likeness", alike)
    return full.select(*columns, F.round("likeness", 6).alias("likeness"), (F.col("likeness").isNull() | (F.col("likeness") < NAME_ALIKE)).alias("name_mismatch"))


def additions_check(lists: DataFrame, period: str, most_percent: int = 10) -> DataFrame:
    """One row: of the securities that a period's list adds, how many the quarter before had listed; plausible up to most_percent of them."""
    day = F.lit(period).cast("date")
    before = F.last_day(F.add_months(F.trunc(day, "month"), -3))
    added = lists.where((F.col("period") == day) & (F.col("status") == "added")).select("cusip").distinct()
    had = lists.where(F.col("period") == before)
    listed = had.where("status <> 'deleted'").select("cusip", F.lit(1).alias("was")).distinct()
    sums = added.join(listed, "cusip", "left").agg(F.count("*").alias("added"), F.count("was").alias("already_listed"))
    return sums.crossJoin(had.agg((F.count("*") > 0).alias("previous_imported"))).withColumn("plausible", F.col("already_listed") * 100 <= F.col("added") * most_percent)


def action_counts(change: DataFrame) -> DataFrame:
    """Rows of each action that a rebuild wrote."""
    return change.groupBy("action").agg(F.count("*").alias("rows"))


def scope_size(pairs: DataFrame) -> DataFrame:
    """One row: distinct pairs, filers and periods of a scope; none for an empty one."""
    return pairs.agg(F.countDistinct(F.struct("filer_id", "period")).alias("pairs"), F.countDistinct("filer_id").alias("filers"), F.countDistinct("period").alias("periods")).where("pairs > 0")


def of_keys(rows: DataFrame, keys: list[tuple], names: list[str]) -> DataFrame:
    """Rows of a given list of keys: the list is small, so it is broadcast to the rows."""
    listed = rows.sparkSession.createDataFrame(keys, rows.select(*names).schema)
    return rows.join(F.broadcast(listed.distinct()), names, "left_semi")


# ---------------------------------------------------------------- timeline and one filing


def timeline(
    followed: DataFrame, lines: DataFrame, change: DataFrame, feed: DataFrame, first: str, last: str, top: int = 4, filer: DataFrame | None = None, issuers: DataFrame | None = None, zone: str = "UTC"
) -> DataFrame:
    """Events of a window of days in a zone, newest first: at, id, kind, side, filer_id, security_id, insider_id, dollars.

    followed: kind (insider, stock, investor) and target. An insider's lines of every code; a stock's of codes P and S, and with issuers
    (issuer_cik, security_id) also those of its issuer that name no security; an investor's filings; of a stock's holders the `top` largest moves of each whole period, ties
    by the slug where filer is given, dated by its latest filing and only then windowed.
    """
    from .change import traded_usd

    instant = lambda day: F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    window = (F.col("at") >= instant(first)) & (F.col("at") < instant(last))
    pick = lambda kind, name: followed.where(F.col("kind") == kind).select(F.col("target").alias(name)).distinct()
    side = F.when(F.col("transaction_code").isin("P", "A", "M"), "acquire").when(F.col("transaction_code").isin("S", "G"), "dispose").otherwise("neutral")
    market = lines.where("transaction_code in ('P', 'S')")
    own = lines.join(pick("insider", "insider_id"), "insider_id", "left_semi").unionByName(market.join(pick("stock", "security_id"), "security_id", "left_semi"))
    if issuers is not None:
        of = issuers.join(pick("stock", "security_id"), "security_id", "left_semi").select("issuer_cik").distinct()
        own = own.unionByName(market.where("security_id is null").join(of, "issuer_cik", "left_semi"))
    none = lambda kind: F.lit(None).cast(kind)
    trades = own.dropDuplicates(["id"]).select(
        F.col("filed_at").cast("timestamp").alias("at"), F.concat(F.lit("4:"), F.col("id").cast("string")).alias("id"), F.lit("insider_trade").alias("kind"), side.alias("side"), none("long").alias("filer_id"),
        "security_id", "insider_id", F.col("value_usd").cast("decimal(24,2)").alias("dollars"),
    )
    filings = feed.join(pick("investor", "filer_id"), "filer_id", "left_semi").select(
        F.col("filed_at").cast("timestamp").alias("at"), F.concat(F.lit("13f:"), F.col("filing_id").cast("string")).alias("id"), F.lit("filing").alias("kind"), F.lit("neutral").alias("side"), "filer_id",
        none("long").alias("security_id"), none("long").alias("insider_id"), F.col("portfolio_value").cast("decimal(24,2)").alias("dollars"),
    )
    dated = feed.groupBy("filer_id", "period").agg(F.max("filed_at").alias("at"))
    moves = change.where("action <> 'hold' and prev_period is not null").join(pick("stock", "security_id"), "security_id", "left_semi").withColumn("dollars", F.round(traded_usd(), 2).cast("decimal(24,2)"))
    if filer is not None:
        moves = moves.join(filer.select("filer_id", "slug"), "filer_id", "left")
    order = Window.partitionBy("security_id", "period").orderBy(F.col("dollars").desc(), "filer_id" if filer is None else "slug")
    moves = moves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).join(dated, ["filer_id", "period"])
    holders = moves.select(
        F.col("at").cast("timestamp").alias("at"), F.concat_ws(":", F.lit("chg"), F.col("filer_id").cast("string"), F.col("period").cast("string"), F.col("security_id").cast("string")).alias("id"), F.lit("holder_change").alias("kind"),
        F.when(F.col("action").isin("new", "add"), "acquire").otherwise("dispose").alias("side"), "filer_id", "security_id", none("long").alias("insider_id"), "dollars",
    )
    return trades.unionByName(filings).unionByName(holders).where(window).orderBy(F.col("at").desc(), "id")


def filing_with_holdings(filing: DataFrame, holding: DataFrame, accession_no: str) -> DataFrame:
    """One filing's holdings, the largest first, each with the filing's own columns; a filing without any has one row."""
    own = filing.where(F.col("accession_no") == accession_no)
    lines = holding.select("filing_id", "security_id", "put_call", "sshprnamt_type", "shares", "value_usd")
    return own.join(lines, "filing_id", "left").orderBy(F.col("value_usd").desc_nulls_last(), "security_id", "put_call")


def watched(items: DataFrame, filer: DataFrame, summary: DataFrame, security: DataFrame, consensus: DataFrame, lines: DataFrame) -> DataFrame:
    """items (user_id, kind, target) with what a reader is shown of each: an investor's name and latest value, a stock's ticker and the
    dollars held in the latest period, an insider's last trade. An item whose target is gone has a null label."""
    latest = summary.groupBy("filer_id").agg(F.max(F.struct("period", "portfolio_value"))["portfolio_value"].cast("double").alias("figure"))
    investor = filer.join(latest, "filer_id", "left").select(F.lit("investor").alias("kind"), F.col("filer_id").alias("target"), F.col("name").alias("label"), "figure")
    held = consensus.groupBy("security_id").agg(F.max(F.struct("period", "total_value"))["total_value"].cast("double").alias("figure"))
    stock = security.join(held, "security_id", "left").select(F.lit("stock").alias("kind"), F.col("security_id").alias("target"), F.col("ticker").alias("label"), "figure")
    last = lines.groupBy("insider_id").agg(F.max(F.struct("transaction_date", "id", "value_usd")).alias("t"))
    insider = last.select(F.lit("insider").alias("kind"), F.col("insider_id").alias("target"), F.col("t.transaction_date").cast("string").alias("label"), F.col("t.value_usd").cast("double").alias("figure"))
    return items.join(investor.unionByName(stock).unionByName(insider), ["kind", "target"], "left").select("user_id", "kind", "target", "label", "figure")


def exported(rows: DataFrame, filing: DataFrame, source: str = "source_filing_id") -> DataFrame:
    """Rows for an export: every column, and where each comes from: accession number, when filed, and whether it was an amendment."""
    about = filing.select(F.col("filing_id").alias(source), "accession_no", F.to_date("filed_at").alias("filed_on"), F.upper("form_type").endswith("/A").alias("amended"))
    return rows.join(about, source, "left")


def with_source(rows: DataFrame, winning: DataFrame) -> DataFrame:
    """Rows of a filer's period with `source_filing_id`, the filing filed last of those that count for it."""
    last = winning.groupBy("filer_id", "period").agg(F.max(F.struct("filed_at", "filing_id"))["filing_id"].alias("source_filing_id"))
    return rows.join(last, ["filer_id", "period"], "left")
