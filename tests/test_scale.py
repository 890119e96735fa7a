"""Plans that must not come back: lists of a whole cell, expanded distinct counts, sorted sums, tables built that nobody asks for."""

import re

from tidemark.operators import change, price, snapshot, views
from tidemark.plans import screens

_HELD = "filer_id long, period date, security_id long, shares decimal(20,4), value_usd decimal(20,2), weight_pct decimal(9,6), source_filing_id long, suspect boolean"


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_prices_and_splits_make_no_lists(spark):
    held = spark.createDataFrame([], _HELD)
    prices = price.implied_price(held)
    for df in (prices, price.split_candidates(held, prices)):
        assert "collect_list" not in _plan(df)


def test_median_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), ("a", 3), ("a", 2), ("b", None)], "k string, v int")
    found = price.with_median(rows, ["k"], "v", double=lambda m: m * 2)
    assert sorted({(r.k, r["median"], r.double) for r in found.collect()}, key=str) == [("a", 2, 4), ("b", None, None)] and found.count() == 6


def test_aggregates_expand_no_distinct_counts(spark):
    held = spark.createDataFrame([], _HELD)
    moves = change.position_change(held)
    flows = views.quarter_flows(moves)
    for df in (views.consensus_holdings(held), flows, views.year_flows(flows, moves)):
        assert "Expand" not in _plan(df) and "distinct" not in _plan(df, "sparkPlan").split("Generate")[0]


def test_snapshot_sums_are_hashed(spark):
    filings = spark.createDataFrame([], "filing_id long, filer_id long, cik string, period date, filed_at timestamp, parse_status string")
    lines = spark.createDataFrame([], "filing_id long, security_id long, shares decimal(20,4), value_usd decimal(20,2), put_call string, sshprnamt_type string")
    assert "SortAggregate" not in _plan(snapshot.position_snapshot(filings.select("filing_id", "filer_id", "cik", "period"), filings.select("filing_id", "filed_at", "parse_status"), lines), "sparkPlan")


def test_changes_join_by_filer_alone(spark):
    """So the window by position and the join share one shuffle."""
    joins = [line for line in _plan(change.position_change(spark.createDataFrame([], _HELD))).splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and joins[0].count("=") == 1


def test_screens_build_only_what_they_ask_for():
    class OnlyChanges:
        change = "changes"

    assert screens.tables(OnlyChanges()).change == "changes"


def test_fractions_are_tried_once_for_a_move(spark):
    moves = spark.createDataFrame([], "was decimal(20,4), shares decimal(20,4), ratio decimal(28,10)")
    found = moves.where(price.looks_like_split(moves["was"], moves["shares"], moves["ratio"]))
    assert _plan(found).count("array_min") == 1


def test_year_flows_deal_no_change_to_several_ends(spark):
    """Only the flows meet the year ends; before, so did four rows of every change."""
    moves = change.position_change(spark.createDataFrame([], _HELD))
    alone = spark.createDataFrame([], moves.schema)
    assert _plan(views.year_flows(views.quarter_flows(alone), alone)).count("Join Inner") == 1


def test_year_flows_count_a_filer_once_a_year(spark):
    import datetime
    import itertools
    import random

    r = random.Random(11)
    ends = [datetime.date(2000 + i // 4, 3 * (i % 4) + 3, (31, 30, 30, 31)[i % 4]) for i in range(13)]
    rows = [(f, e, s, r.choice(["new", "add", "trim", "exit", "hold"])) for f, s, e in itertools.product(range(6), range(3), ends) if r.random() < 0.5 and e != ends[5]]
    moves = spark.createDataFrame(
        [(f, e, s, a, ends[0]) for f, e, s, a in rows], "filer_id long, period date, security_id long, action string, prev_period date"
    ).selectExpr("*", *(f"cast(10 as {t}) {c}" for c, t in (("shares", "decimal(20,4)"), ("prev_shares", "decimal(20,4)"), ("value_usd", "decimal(20,2)"), ("prev_value_usd", "decimal(20,2)"), ("shares_delta", "decimal(20,4)"))))
    got = {(x.period, x.security_id): (x.new_positions, x.exits, x.buyers, x.sellers) for x in views.year_flows(views.quarter_flows(moves), moves).collect()}
    want, kinds = {}, (("new",), ("exit",), ("new", "add"), ("trim", "exit"))
    for end, security in itertools.product({e for _, e, _, _ in rows}, range(3)):
        year = [(f, a) for f, e, s, a in rows if s == security and ends.index(end) - 3 <= ends.index(e) <= ends.index(end)]
        if year:
            want[end, security] = tuple(len({f for f, a in year if a in kind}) for kind in kinds)
    assert got == want


def test_a_rows_splits_are_multiplied_once(spark):
    splits = spark.createDataFrame([], "security_id long, period date, numerator int, denominator int")
    assert _plan(change.position_change(spark.createDataFrame([], _HELD), splits)).count("aggregate(filter(") == 2


def test_lines_are_summed_where_they_meet_their_filings(spark):
    filings = spark.createDataFrame([], "filing_id long, filer_id long, cik string, period date, filed_at timestamp, parse_status string")
    lines = spark.createDataFrame([], "filing_id long, security_id long, shares decimal(20,4), value_usd decimal(20,2), put_call string, sshprnamt_type string")
    plan = _plan(snapshot.position_snapshot(filings.select("filing_id", "filer_id", "cik", "period"), filings.select("filing_id", "filed_at", "parse_status"), lines))
    assert "Aggregate [filing_id" in plan


def test_whole_positions_traded_are_their_value(spark):
    rows = spark.createDataFrame(
        [("new", "3", "0", "10.01", "0", "3"), ("exit", "0", "7", "0", "5.55", "-7"), ("add", "9", "6", "10.00", "1", "3"), ("new", "0", "0", "4", "0", "0"), ("hold", "5", "5", "8", "8", "0"), ("add", "6", "0", "1", "0", "6")],
        "action string, a string, b string, c string, d string, e string",
    ).selectExpr("action", "cast(a as decimal(20,4)) shares", "cast(b as decimal(20,4)) prev_shares", "cast(c as decimal(20,2)) value_usd", "cast(d as decimal(20,2)) prev_value_usd", "cast(e as decimal(20,4)) shares_delta")
    assert [str(r[0]) for r in rows.select(change.traded_usd()).collect()] == ["10.010000", "5.550000", "3.333333", "0.000000", "0.000000", "1.000000"]
    plan = _plan(rows.select(change.traded_usd()))  # whole positions have their branch, without a division
    assert re.search(r"abs\(shares_delta#\d+\) = prev_shares", plan) and re.search(r"abs\(shares_delta#\d+\) = shares", plan)
