"""Audits of filings and holdings, and invariants of the derived tables: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import next_quarter
from .effective import countable

#: Instant from which filings state dollars, bounds of a plausible price, and thresholds in percent.
DOLLARS_FROM = "2023-01-03 05:00:00"
PRICE_BOUNDS, CONCENTRATED, JUMP, SAME_SHARES = (0.01, 100_000), 90, 10_000, 0.5
NOTES = 25

# ---------------------------------------------------------------- guards of a filing's rows


def units_multiplier(filed_at: Column) -> Column:
    """Thousands before the change of rule, dollars since."""
    return F.when(filed_at >= F.lit(DOLLARS_FROM).cast("timestamp"), 1).otherwise(1000)


def row_problems(rows: DataFrame) -> DataFrame:
    """Rows (filing_id, cusip, shares, value_usd, sshprnamt_type) with what is wrong: price, negative, cusip; at most NOTES of each
    filing and problem are told (`place` <= NOTES), and `problems` counts all."""
    each = F.col("value_usd") / F.nullif(F.col("shares"), F.lit(0))
    odd = (F.col("sshprnamt_type") == "SH") & (F.col("value_usd") != 0) & (F.col("shares") != 0) & ~each.between(*PRICE_BOUNDS)
    checks = [("price", odd), ("negative", (F.col("shares") < 0) | (F.col("value_usd") < 0)), ("cusip", ~F.coalesce(F.col("cusip"), F.lit("")).rlike("^[A-Za-z0-9]{9}$"))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks]))
    full = rows.withColumn("problem", F.explode(found))
    by = Window.partitionBy("filing_id", "problem")
    return full.withColumns({"place": F.row_number().over(by.orderBy("cusip", "shares", "value_usd")), "problems": F.count("*").over(by)})


def cover_problems(rows: DataFrame, cover: DataFrame) -> DataFrame:
    """cover (filing_id, entries, total) against the rows: entry-count if the numbers differ, value-total if sums are over 1 % apart."""
    sums = rows.groupBy("filing_id").agg(F.count("*").alias("n"), F.sum("value_usd").alias("value"))
    full = cover.join(sums, "filing_id", "left").fillna(0, ["n"]).withColumn("value", F.coalesce("value", F.lit(0)))
    apart = F.abs(F.col("value") - F.col("total")) * 100 > F.abs("total")
    found = F.array_compact(F.array(F.when(F.col("n") != F.col("entries"), F.lit("entry-count")), F.when(apart, F.lit("value-total"))))
    return full.select("filing_id", F.explode(found).alias("problem"), "n", "entries", "value", "total")


# ---------------------------------------------------------------- audits


def suspect_periods(winning: DataFrame, filing: DataFrame) -> DataFrame:
    """Periods with a suspect filing among those that count."""
    own = filing.where("parse_status = 'suspect'").select("filing_id")
    return winning.join(own, "filing_id", "left_semi").groupBy("filer_id", "period").agg(F.count("*").alias("filings"))


def concentrated(snapshot: DataFrame, least: float = CONCENTRATED) -> DataFrame:
    return snapshot.where(F.col("weight_pct") > least).select("filer_id", "period", "security_id", "weight_pct")


def position_jumps(snapshot: DataFrame, splits: DataFrame | None = None, least: float = JUMP) -> DataFrame:
    """Positions that grew by over `least` percent from one calendar quarter to the next, but for known splits."""
    now = snapshot.select("filer_id", "security_id", "period", "shares")
    was = now.select("filer_id", "security_id", next_quarter(F.col("period")).alias("period"), F.col("shares").alias("was")).where("was > 0")
    rows = now.join(was, ["filer_id", "security_id", "period"]).where((F.col("shares") - F.col("was")) * 100 > F.col("was") * least)
    return rows if splits is None else rows.join(splits.where("numerator is not null").select("security_id", "period"), ["security_id", "period"], "left_anti")


def amendment_roles(filing: DataFrame) -> DataFrame:
    """The part each countable filing plays in its filer's, CIK's and period's portfolio, and how many originals that has."""
    by = Window.partitionBy("filer_id", "cik", "period")
    rows = countable(filing).withColumn("at", F.struct("filed_at", "accession_no"))
    rows = rows.withColumns({"base": F.max(F.when(F.col("whole"), F.col("at"))).over(by), "originals": F.sum((F.upper("form_type") == "13F-HR").cast("long")).over(by)})
    role = F.when(F.col("base").isNull(), "orphan addition").when(F.col("at") == F.col("base"), "base").when(F.col("whole"), "superseded").when(F.col("at") > F.col("base"), "addition").otherwise("covered")
    return rows.select("filing_id", "filer_id", "cik", "period", role.alias("role"), "originals", (F.col("originals") > 1).alias("duplicate_originals"))


def overlap(books: DataFrame, ciks: DataFrame) -> DataFrame:
    """books (filer_id, period, cik, security_id, put_call, sshprnamt_type, shares, value_usd): the book of each CIK of a filer and
    period against that of the primary, the one of the highest priority and then the greatest CIK.

    identical_share is the value of positions whose share counts agree within SAME_SHARES percent of the larger, over the
    union, which takes each position at its larger value. ciks: filer_id, cik, priority.
    """
    position = ["security_id", "put_call", "sshprnamt_type"]
    book = ["filer_id", "period"]
    summed = books.groupBy(*book, "cik", *position).agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value"))
    ranked = summed.select(*book, "cik").distinct().join(ciks, ["filer_id", "cik"], "left").withColumn("rank", F.struct(F.coalesce("priority", F.lit(-1)), "cik"))
    first = Window.partitionBy(*book).orderBy(F.col("rank").desc())
    pairs = ranked.select(*book, "cik", F.first("cik").over(first).alias("primary")).where("cik <> primary")
    keys = [F.coalesce(c, F.lit("")).alias(c) if c != "security_id" else F.col(c) for c in position]
    summed = summed.select(*book, "cik", *keys, "shares", "value")
    mine = pairs.join(summed.withColumnRenamed("cik", "primary"), [*book, "primary"]).select(*book, "cik", "primary", *position, F.col("shares").alias("a"), F.col("value").alias("va"))
    theirs = pairs.join(summed, [*book, "cik"]).select(*book, "cik", "primary", *position, F.col("shares").alias("b"), F.col("value").alias("vb"))
    both = mine.join(theirs, [*book, "cik", "primary", *position], "full")
    larger = F.greatest("va", "vb")
    same = F.coalesce((F.col("a") != 0) & (F.col("b") != 0) & (F.abs(F.col("a") - F.col("b")) * 1000 <= F.greatest("a", "b") * int(SAME_SHARES * 10)), F.lit(False))
    sums = both.withColumnRenamed("primary", "primary_cik").groupBy(*book, "primary_cik", "cik").agg(
        F.count("va").alias("primary_positions"), F.count("vb").alias("other_positions"), F.sum(larger).alias("union_value"), F.coalesce(F.sum(F.when(same, larger)), F.lit(0)).alias("same_value")
    )
    ratio = F.coalesce(F.col("same_value").cast("double") / F.nullif(F.col("union_value").cast("double"), F.lit(0.0)), F.lit(0.0))
    return sums.withColumn("identical_share", ratio).withColumn("verdict", F.when(ratio >= 0.9, "same book").when(ratio <= 0.1, "separate").otherwise("unclear"))


def coverage(holding: DataFrame, known: DataFrame, by: str = "period") -> DataFrame:
    """Share of rows and of value whose security is known, in percent to one place."""
    rows = holding.join(known.select("security_id").distinct().withColumn("known", F.lit(True)), "security_id", "left")
    sums = rows.groupBy(by).agg(F.count("*").alias("rows"), F.count("known").alias("known_rows"), F.sum("value_usd").alias("value"), F.sum(F.when(F.col("known"), F.col("value_usd"))).alias("known_value"))
    of = lambda a, b: F.round((F.coalesce(F.col(a), F.lit(0)) * 100 / F.nullif(F.col(b), F.lit(0))).cast("decimal(20,6)"), 1)
    return sums.select(by, "rows", "known_rows", of("known_rows", "rows").alias("rows_pct"), of("known_value", "value").alias("value_pct"))


# ---------------------------------------------------------------- invariants


def _broken(rows: DataFrame, problem: str, detail: Column) -> DataFrame:
    have = set(rows.columns)
    at = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("filer_id", "long"), ("period", "date"), ("security_id", "long"))]
    return rows.select(*at, F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))


def weights_sum_to_100(snapshot: DataFrame) -> DataFrame:
    """Each weight is rounded to six places, so a sum may be off by half a unit of the last for each position."""
    sums = snapshot.groupBy("filer_id", "period").agg(F.sum("weight_pct").alias("total"), F.count("weight_pct").alias("n"))
    return _broken(sums.where(F.abs(F.col("total") - 100) * 2_000_000 > F.col("n")), "weights", F.col("total"))


def snapshot_traces_to_filing(snapshot: DataFrame, winning: DataFrame) -> DataFrame:
    source = winning.select(F.col("filing_id").alias("source_filing_id"), "filer_id", "period")
    return _broken(snapshot.join(source, ["source_filing_id", "filer_id", "period"], "left_anti"), "source", F.col("source_filing_id"))


_CELL = ["filer_id", "period", "security_id"]


def changes_match_snapshot(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    s = snapshot.select(*_CELL, F.col("shares").alias("s"), F.col("value_usd").alias("v"), F.lit(True).alias("held"))
    both = change.select(*_CELL, "action", "shares", "value_usd").join(s, _CELL, "full")
    wrong = F.when(F.col("action").isNull(), "no change").when((F.col("action") == "exit") & F.col("held"), "exit but held").when((F.col("action") != "exit") & F.col("held").isNull(), "not held")
    wrong = wrong.when((F.col("action") != "exit") & ((F.col("shares") != F.col("s")) | (F.col("value_usd") != F.col("v"))), "figures")
    return _broken(both.withColumn("w", wrong).where("w is not null"), "snapshot", F.col("w"))


def changes_follow_previous_period(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    by = Window.partitionBy("filer_id").orderBy("period")
    published = snapshot.select("filer_id", "period").distinct().withColumn("before", F.lag("period").over(by))
    return _broken(change.join(published, ["filer_id", "period"]).where(~F.col("prev_period").eqNullSafe(F.col("before"))), "previous period", F.col("prev_period"))


def new_and_exit_rows(change: DataFrame) -> DataFrame:
    held = F.col("prev_shares").isNotNull()
    wrong = F.when((F.col("action") == "new") & held, "new but held").when((F.col("action") == "exit") & ((F.col("shares") != 0) | ~held), "exit with shares").when(~F.col("action").isin("new", "exit") & ~held, "no previous")
    return _broken(change.withColumn("w", wrong).where("w is not null"), "action", F.col("w"))


def value_deltas_add_up(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    by = Window.partitionBy("filer_id").orderBy("period")
    total = snapshot.groupBy("filer_id", "period").agg(F.sum("value_usd").alias("value"))
    moved = total.withColumn("moved", F.col("value") - F.coalesce(F.lag("value").over(by), F.lit(0)))
    deltas = change.groupBy("filer_id", "period").agg(F.sum("value_delta").alias("deltas"))
    both = moved.join(deltas, ["filer_id", "period"], "full")
    return _broken(both.where(~F.col("moved").eqNullSafe(F.col("deltas"))), "value", F.col("deltas"))


def changes_adjust_for_splits(change: DataFrame) -> DataFrame:
    before = F.col("prev_shares") * F.coalesce("numerator", F.lit(1)) / F.coalesce("denominator", F.lit(1))
    rows = change.where("action not in ('new', 'exit')")
    return _broken(rows.where(F.abs(F.col("shares") - before - F.col("shares_delta")) > 0.0001), "split", F.col("shares_delta"))


def split_changes_are_plausible(change: DataFrame) -> DataFrame:
    """A split that counts brings the position nearer to what it was; one that doesn't is in question."""
    far = lambda x: F.greatest(x, 1 / x)
    plain = (F.col("shares") / F.col("prev_shares")).cast("double")
    rows = change.where("is_split and shares > 0 and prev_shares > 0")
    return _broken(rows.where(far(plain * F.col("denominator") / F.col("numerator")) > far(plain)), "implausible split", F.col("shares_delta_pct"))


def nothing_negative(snapshot: DataFrame) -> DataFrame:
    return _broken(snapshot.where("shares < 0 or value_usd < 0 or weight_pct < 0"), "negative", F.col("value_usd"))


def prices_count_every_observation(snapshot: DataFrame, prices: DataFrame) -> DataFrame:
    seen = snapshot.where("shares > 0").groupBy("security_id", "period").agg(F.count("*").alias("n"), F.sum((F.col("value_usd") > 0).cast("long")).alias("p"))
    both = prices.join(seen, ["security_id", "period"], "full")
    return _broken(both.where(~(F.col("n").eqNullSafe(F.col("observation_count")) & F.col("p").eqNullSafe(F.col("priced_count")))), "observations", F.col("observation_count"))


def prices_are_positive(prices: DataFrame) -> DataFrame:
    return _broken(prices.where("price <= 0 or agreeing_count > priced_count or (price is null) <> (confidence is null)"), "price", F.col("price"))


def prices_are_medians(snapshot: DataFrame, prices: DataFrame) -> DataFrame:
    """A price is one of its observations, with half of them at or below and at or above it."""
    each = F.round((F.col("value_usd").cast("decimal(20,2)") / F.col("shares").cast("decimal(17,4)")).cast("decimal(30,12)"), 8)
    seen = snapshot.where("shares > 0 and value_usd > 0").withColumn("each", each).join(prices.select("security_id", "period", "price"), ["security_id", "period"])
    sums = seen.groupBy("security_id", "period").agg(
        F.count("*").alias("n"), F.sum((F.col("each") <= F.col("price")).cast("long")).alias("below"), F.sum((F.col("each") >= F.col("price")).cast("long")).alias("above"), F.first("price").alias("price")
    )
    return _broken(sums.where("below * 2 < n or above * 2 < n or below + above <= n"), "median", F.col("price"))


def views_match_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of a stored table that the live query lacks, and the other way round; repeated rows count."""
    columns = sorted(stored.columns)
    a, b = stored.select(*columns), live.select(*columns)
    mark = lambda df, name: _broken(df.withColumn("d", F.to_json(F.struct(*columns))), name, F.col("d"))
    return mark(a.exceptAll(b), "stored only").unionByName(mark(b.exceptAll(a), "live only"))


