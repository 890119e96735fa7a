"""Lists and details that readers ask for: market rankings, portfolios, owners, investors, feeds and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import deadline, quarter_end, quarters_between
from .change import traded_usd
from .paging import Key, page

_FAR = 10**22


def _day(period: str):
    return F.lit(period).cast("date")


# ---------------------------------------------------------------- market


def top_holdings(consensus: DataFrame, period: str, n: int = 50, metric: str = "value") -> DataFrame:
    first = {"value": ["total_value"], "holders": ["holder_count", "total_value"]}[metric]
    return consensus.where(F.col("period") == _day(period)).orderBy(*(F.col(c).desc() for c in first), F.col("security_id").desc()).limit(n)


def top_moves(flows: DataFrame, period: str, side: str, metric: str = "value", n: int = 50) -> DataFrame:
    """Securities most bought, sold or newly held in a period, by dollars, net dollars or count of holders; only those
    that moved in the ranking's direction. flows may be those of quarters or of years."""
    tables = {
        ("buys", "value"): ("bought", None, 1), ("buys", "net"): ("net", None, 1), ("buys", "holders"): ("buyers", "bought", 1),
        ("sells", "value"): ("sold", None, 1), ("sells", "net"): ("net", None, -1), ("sells", "holders"): ("sellers", "sold", 1), ("new", "holders"): ("new_positions", "bought", 1),
    }
    column, tie, sign = tables[side, metric]
    rows = flows.where((F.col("period") == _day(period)) & (F.col(column) * sign > 0))
    order = [F.col(column).desc() if sign > 0 else F.col(column).asc(), *([F.col(tie).desc()] if tie else []), F.col("security_id").desc()]
    return rows.orderBy(*order).limit(n)


def flows_screen(flows: DataFrame, consensus: DataFrame, period: str, direction: str | None = None, min_investors: int = 0, min_value: float = 0) -> DataFrame:
    rows = flows.where(F.col("period") == _day(period))
    if direction:
        rows = rows.where("net > 0" if direction == "buy" else "net < 0")
    held = consensus.select("period", "security_id", "holder_count", "total_value")
    full = rows.join(held, ["period", "security_id"], "left").fillna(0, ["holder_count", "total_value"])
    return full.where((F.col("holder_count") >= min_investors) & (F.col("bought") + F.col("sold") >= min_value))


def market_activity(feed: DataFrame, n: int = 20) -> DataFrame:
    return feed.orderBy(F.col("filed_at").desc(), F.col("filing_id").desc()).limit(n)


# ---------------------------------------------------------------- investors and portfolios


def investor_list(filer: DataFrame, summary: DataFrame, best: DataFrame, category: str | None = None, search: str | None = None) -> DataFrame:
    """Each filer with its latest period's figures and largest position; filters take a category or a part of the name."""
    latest = summary.groupBy("filer_id").agg(F.max(F.struct("period", "portfolio_value", "positions", "turnover")).alias("s")).select("filer_id", "s.*")
    rows = filer.where(F.col("category") == category) if category else filer
    if search:
        rows = rows.where(F.lower("name").contains(search.lower()))
    top = best.select("filer_id", "period", F.col("security_id").alias("top_security_id"), F.col("weight_pct").alias("top_weight_pct"))
    return rows.join(latest, "filer_id", "left").join(top, ["filer_id", "period"], "left")


def investor_detail(filer: DataFrame, published: DataFrame, filing: DataFrame | None = None) -> DataFrame:
    """Each filer with its first and last period and how many; with filings also `ciks`, all that it filed under, in order."""
    spans = published.groupBy("filer_id").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("*").alias("periods"))
    full = filer.join(spans, "filer_id", "left").fillna(0, ["periods"])
    if filing is None:
        return full
    return full.join(filing.groupBy("filer_id").agg(F.array_sort(F.collect_set("cik")).alias("ciks")), "filer_id", "left")


#: Sorts by name, as the columns that lead; ties go to the keys given with them, the same way.
SORTS = {
    "investors": {"value": [("portfolio_value", -1)], "positions": [("positions", -1)], "name": [("name", "")]},
    "portfolio": {"weight": [("weight_key", None)], "value": [("value_usd", None)], "shares": [("shares", None)], "change": [("change_key", None)]},
    "flows": {c: [(c, None)] for c in ("bought", "sold", "net", "net_shares", "buyers", "sellers", "new_positions", "exits", "holder_count")},
    "insiders": {"date": [("transaction_date", None)], "value": [("value_usd", -1)]},
}


def sorted_page(rows: DataFrame, listing: str, sort: str, ties: list[str], descending: bool = True, size: int = 50, position: list[object] | None = None) -> DataFrame:
    """A page of a listing by one of its SORTS; a missing value counts as the least there can be."""
    lead = [Key(c, descending, missing) for c, missing in SORTS[listing][sort]]
    return page(rows, [*lead, *(Key(c, descending) for c in ties)], size, position)


def sparkline(filer: DataFrame, summary: DataFrame, last: str, quarters: int = 8) -> DataFrame:
    """For each filer the values of so many quarters up to `last`, in order, null where it published none."""
    first = F.last_day(F.add_months(F.trunc(_day(last), "month"), -3 * (quarters - 1)))
    axis = filer.select("filer_id", F.explode(quarters_between(first, _day(last))).alias("period"))
    full = axis.join(summary.select("filer_id", "period", "portfolio_value"), ["filer_id", "period"], "left")
    return full.groupBy("filer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "portfolio_value"))), lambda s: s["portfolio_value"]).alias("values"))


def portfolio(snapshot: DataFrame, change: DataFrame, period: str, options: DataFrame | None = None) -> DataFrame:
    """Positions of a period with what changed, since when they are held, and sort keys: a missing weight counts as -1,
    a change without a percentage (a new position) as the largest, an option's as the smallest."""
    since = snapshot.groupBy("filer_id", "security_id").agg(F.min("period").alias("first_held"))
    now = snapshot.where(F.col("period") == _day(period))
    moved = change.where(F.col("period") == _day(period)).select("filer_id", "security_id", "action", "shares_delta", "shares_delta_pct")
    rows = now.join(moved, ["filer_id", "security_id"], "left").join(since, ["filer_id", "security_id"], "left").select(
        "filer_id", "security_id", F.lit(None).cast("string").alias("put_call"), "shares", "value_usd", "weight_pct", "action", "shares_delta", "shares_delta_pct", "first_held"
    )
    if options is not None:
        held = options.where((F.col("period") == _day(period)) & F.col("put_call").isNotNull() & (F.col("sshprnamt_type") == "SH"))
        held = held.groupBy("filer_id", "security_id", "put_call").agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"))
        rows = rows.unionByName(held, allowMissingColumns=True)
    change_key = F.when(F.col("action").isNull(), F.lit(f"-{_FAR}").cast("decimal(30,6)")).otherwise(F.coalesce(F.col("shares_delta_pct").cast("decimal(30,6)"), F.lit(str(_FAR)).cast("decimal(30,6)")))
    return rows.withColumns({"weight_key": F.coalesce("weight_pct", F.lit(-1).cast("decimal(9,6)")), "change_key": change_key})


def composition(snapshot: DataFrame, period: str, min_weight: float = 1.0) -> DataFrame:
    """Blocks of each portfolio: positions of min_weight or more; smaller ones as one block without a security if there are several."""
    now = snapshot.where(F.col("period") == _day(period)).withColumn("small", F.coalesce(F.col("weight_pct"), F.lit(0)) < min_weight)
    counts = now.where("small").groupBy("filer_id").agg(F.count("*").alias("smalls"))
    rows = now.join(counts, "filer_id", "left").withColumn("rolled", F.col("small") & (F.col("smalls") > 1))
    key = F.when(~F.col("rolled"), F.col("security_id"))
    return rows.groupBy("filer_id", key.alias("security_id")).agg(F.sum("value_usd").alias("value_usd"), F.sum("weight_pct").alias("weight_pct"), F.count("*").alias("positions"))


def activity(change: DataFrame, first: str, last: str, actions: tuple[str, ...] = ("new", "add", "trim", "exit")) -> DataFrame:
    rows = change.where(F.col("prev_period").isNotNull() & F.col("period").between(_day(first), _day(last)) & F.col("action").isin(*actions))
    return rows.withColumn("traded_usd", F.when(F.col("action") == "hold", F.lit(0)).otherwise(F.round(traded_usd(), 2)))


def history(summary: DataFrame) -> DataFrame:
    """Each filer's quarters from its first to its last published one, those without a report included."""
    ends = summary.groupBy("filer_id").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    axis = ends.select("filer_id", F.explode(quarters_between(F.col("a"), F.col("b"))).alias("period"))
    return axis.join(summary.select("filer_id", "period", "portfolio_value", "positions"), ["filer_id", "period"], "left")


# ---------------------------------------------------------------- stocks


def stock_owners(snapshot: DataFrame, change: DataFrame, filer: DataFrame, period: str) -> DataFrame:
    now = snapshot.where(F.col("period") == _day(period)).select("filer_id", "security_id", "shares", "value_usd", "weight_pct")
    moved = change.where(F.col("period") == _day(period)).select("filer_id", "security_id", "action", "shares_delta")
    return now.join(moved, ["filer_id", "security_id"], "left").join(filer.select("filer_id", "name"), "filer_id")


def stock_detail(consensus: DataFrame, flows: DataFrame) -> DataFrame:
    """Each security's latest period with holders, totals and flows."""
    latest = consensus.groupBy("security_id").agg(F.max("period").alias("period"))
    full = consensus.join(latest, ["security_id", "period"], "left_semi")
    return full.join(flows.select("security_id", "period", "bought", "sold", "buyers", "sellers"), ["security_id", "period"], "left")


def price_series(prices: DataFrame) -> DataFrame:
    """Each security's quarters from its first to its last with a price, those without one included."""
    known = prices.where("price is not null")
    ends = known.groupBy("security_id").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    axis = ends.select("security_id", F.explode(quarters_between(F.col("a"), F.col("b"))).alias("period"))
    return axis.join(known.select("security_id", "period", "price", "confidence"), ["security_id", "period"], "left")


def ownership_series(snapshot: DataFrame, published: DataFrame, top: int = 5) -> DataFrame:
    """security_id, period, holder, shares, value_usd of every quarter from the first in which a security was held to the last: a row for each of the holders
    that were largest when it was last held, and one without a holder for all others together.

    A holder that published nothing for the quarter has nulls, one that published without the security zeros; a quarter that nobody held the security in has nulls for the others.
    """
    totals = snapshot.groupBy("security_id", "period").agg(F.sum("shares").alias("all_shares"), F.sum("value_usd").alias("all_value"))
    ends = totals.groupBy("security_id").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    axis = ends.select("security_id", F.explode(quarters_between(F.col("a"), F.col("b"))).alias("period"))
    place = F.row_number().over(Window.partitionBy("security_id").orderBy(F.col("value_usd").desc(), "filer_id"))
    last = snapshot.join(ends.select("security_id", F.col("b").alias("period")), ["security_id", "period"], "left_semi").withColumn("place", place).where(F.col("place") <= top)
    grid = axis.join(last.select("security_id", F.col("filer_id").alias("holder")), "security_id")
    held = snapshot.select("security_id", "period", F.col("filer_id").alias("holder"), "shares", "value_usd")
    said = published.select(F.col("filer_id").alias("holder"), "period", F.lit(True).alias("said")).distinct()
    named = grid.join(held, ["security_id", "period", "holder"], "left").join(said, ["holder", "period"], "left")
    zero = lambda c: F.coalesce(c, F.when(F.col("said"), F.lit(0)))
    named = named.select("security_id", "period", "holder", zero("shares").alias("shares"), zero("value_usd").alias("value_usd"))
    sums = named.groupBy("security_id", "period").agg(F.coalesce(F.sum("shares"), F.lit(0)).alias("s"), F.coalesce(F.sum("value_usd"), F.lit(0)).alias("v"))
    others = axis.join(totals, ["security_id", "period"], "left").join(sums, ["security_id", "period"], "left")
    others = others.select("security_id", "period", F.lit(None).cast("long").alias("holder"), (F.col("all_shares") - F.coalesce("s", F.lit(0))).alias("shares"), (F.col("all_value") - F.coalesce("v", F.lit(0))).alias("value_usd"))
    return named.unionByName(others)


def ownership_history(snapshot: DataFrame, top: int = 5) -> DataFrame:
    """Shares by quarter of the holders that were largest when each security was last held, and of all others together."""
    last = snapshot.groupBy("security_id").agg(F.max("period").alias("period"))
    place = F.row_number().over(Window.partitionBy("security_id").orderBy(F.col("value_usd").desc(), "filer_id"))
    fixed = snapshot.join(last, ["security_id", "period"], "left_semi").withColumn("place", place).where(F.col("place") <= top).select("security_id", "filer_id", F.col("filer_id").alias("holder"))
    full = snapshot.join(fixed, ["security_id", "filer_id"], "left")
    return full.groupBy("security_id", "period", "holder").agg(F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"), F.count("*").alias("holders"))


# ---------------------------------------------------------------- coverage and what is due


def period_coverage(published: DataFrame, filer: DataFrame, today: str) -> DataFrame:
    """Filers reported of those tracked in each period; complete past the deadline with 95 % or more."""
    tracked = filer.agg(F.count("*").alias("tracked"))
    rows = published.groupBy("period").agg(F.countDistinct("filer_id").alias("reported")).crossJoin(F.broadcast(tracked))
    past = F.lit(today).cast("date") > deadline(F.col("period"))
    return rows.withColumn("complete", past & (F.col("reported") * 100 >= F.col("tracked") * 95))


def upcoming_filings(published: DataFrame, period: str) -> DataFrame:
    """Filers that published the quarter before and not yet this one."""
    before = published.where(F.col("period") == F.last_day(F.add_months(F.trunc(_day(period), "month"), -3))).select("filer_id")
    return before.join(published.where(F.col("period") == _day(period)).select("filer_id"), "filer_id", "left_anti").withColumn("due", deadline(_day(period)))


def filing_gaps(published: DataFrame) -> DataFrame:
    """Runs of quarters that a filer skipped between two that it published."""
    by = Window.partitionBy("filer_id").orderBy("period")
    rows = published.select("filer_id", "period").distinct().withColumn("last", F.lag("period").over(by))
    missing = F.round(F.months_between("period", "last") / 3).cast("int") - 1
    rows = rows.withColumn("missing", missing).where("missing > 0")
    return rows.select("filer_id", F.last_day(F.add_months(F.trunc("last", "month"), 3)).alias("first_missing"), quarter_end(F.add_months(F.trunc("period", "month"), -3)).alias("last_missing"), F.col("missing").cast("long").alias("quarters"))


def insider_feed(
    lines: DataFrame, codes: tuple[str, ...] = ("P", "S"), min_value: float | None = None, first: str | None = None, last: str | None = None, roles: tuple[str, ...] = (), plan: bool | None = None,
    filed_first: str | None = None, filed_last: str | None = None, insiders: list[int] | None = None, stocks: DataFrame | None = None, issuers: DataFrame | None = None,
) -> DataFrame:
    """Lines by code, role (any of them), value, trade days, plan flag, days of filing (whole UTC days, both included) and insiders.

    stocks (security_id) takes lines linked to one of them, and with issuers (issuer_cik) the unlinked lines of those too.
    """
    rows = lines.where(F.col("transaction_code").isin(*codes))
    if roles:
        held = F.lit(False)
        for r in roles:
            held = held | F.coalesce(F.col(f"is_{r}"), F.lit(False))
        rows = rows.where(held)
    tests = [
        (min_value, lambda v: F.col("value_usd") >= v), (first, lambda v: F.col("transaction_date") >= _day(v)), (last, lambda v: F.col("transaction_date") <= _day(v)), (plan, lambda v: F.col("is_10b5_1") == v),
        (filed_first, lambda v: F.col("filed_at") >= _day(v)), (filed_last, lambda v: F.col("filed_at") < F.date_add(_day(v), 1)), (insiders, lambda v: F.col("insider_id").isin(*v)),
    ]
    for on, test in tests:
        if on is not None:
            rows = rows.where(test(on))
    if stocks is None:
        return rows
    linked = rows.join(stocks.select("security_id").distinct(), "security_id", "left_semi")
    if issuers is None:
        return linked
    loose = rows.where("security_id is null").join(issuers.select("issuer_cik").distinct(), "issuer_cik", "left_semi")
    return linked.select(*rows.columns).unionByName(loose.select(*rows.columns))


def cluster_breakdown(clusters: DataFrame, lines: DataFrame) -> DataFrame:
    """Each insider's part of each episode, by its listed transactions."""
    listed = clusters.select("issuer_cik", "window_start", F.explode("transaction_ids").alias("id"))
    parts = listed.join(lines.select("id", "insider_id", "shares", "value_usd", "transaction_date", "is_director"), "id")
    return parts.groupBy("issuer_cik", "window_start", "insider_id").agg(F.count("*").alias("lines"), F.sum("shares").alias("shares"), F.sum("value_usd").alias("value_usd"), F.max("transaction_date").alias("last_bought"), F.bool_or("is_director").alias("is_director"))
