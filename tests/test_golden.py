"""A universe worked out by hand: three filers, four quarters, twelve filings with a suspect one, a restatement and an addition."""

import datetime as dt
from decimal import Decimal

import pytest

from tidemark.operators import change, effective, price, snapshot, views

Q1, Q2, Q3, Q4 = (dt.date(2024, m, d) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31)))
PRICES = {
    "ACME": (10, 12, 15, 15), "BOLT": (20, 20, 25, 25), "CORE": (50, 40, 40, 50), "DYNA": (5, 5, 10, 10), "ECHO": (100, 100, 100, 100),
}
SECURITY = {name: i + 1 for i, name in enumerate(PRICES)} | {"BOND": 6}
FILINGS = [  # filer, period, filed, kind, held, suspect
    (1, Q1, "2024-05-10", None, "ACME 1000 BOLT 2000 CORE 1000", False), (3, Q1, "2024-05-14", None, "ACME 1000 BOLT 500 CORE 200", False),
    (1, Q2, "2024-08-09", None, "ACME 1500 BOLT 2000 DYNA 10000", False), (2, Q2, "2024-08-12", None, "ACME 2500 ECHO 700", False),
    (3, Q2, "2024-08-14", None, "ACME 1000 BOLT 1000 CORE 200", False), (1, Q3, "2024-11-08", None, "ACME 3666 BOLT 1000 CORE 500 DYNA 10001", False),
    (2, Q3, "2024-11-13", None, "ACME 2500 DYNA 4000 ECHO 700", True), (1, Q4, "2025-02-07", None, "ACME 3666 CORE 500 DYNA 10001", False),
    (2, Q4, "2025-02-11", None, "ACME 2500 BOLT 2500", False), (3, Q4, "2025-02-14", None, "ACME 800 CORE 200 ECHO 180", False),
    (2, Q3, "2025-03-03", "restatement", "ACME 2500 BOLT 500 ECHO 500", False), (1, Q4, "2025-03-10", "new_holdings", "CORE 400", False),
]


@pytest.fixture(scope="module", params=["as filed", "newest first"])
def tables(spark, request):
    filings, holdings = [], []
    for n, (filer, period, filed, kind, held, suspect) in enumerate(FILINGS, 1):
        at = dt.datetime.fromisoformat(filed + "T16:00:00")
        filings.append((n, f"{filer}-{n:06}", filer, str(filer), period, at, "13F-HR/A" if kind else "13F-HR", kind, "suspect" if suspect else "ok"))
        words = held.split()
        for name, shares in zip(words[::2], map(int, words[1::2]), strict=True):
            value = shares * PRICES[name][(period.month // 3) - 1]
            holdings.append((n, SECURITY[name], Decimal(shares), Decimal(value), "SH", None))
    holdings += [(5, SECURITY["CORE"], Decimal(100), Decimal(4000), "SH", "Call"), (5, SECURITY["BOND"], Decimal(50000), Decimal(49000), "PRN", None)]
    if request.param == "newest first":
        filings, holdings = filings[::-1], holdings[::-1]
    filing = spark.createDataFrame(filings, "filing_id long, accession_no string, filer_id long, cik string, period date, filed_at timestamp, form_type string, amendment_kind string, parse_status string")
    holding = spark.createDataFrame(holdings, "filing_id long, security_id long, shares decimal(20,4), value_usd decimal(20,2), sshprnamt_type string, put_call string")
    ciks = spark.createDataFrame([(i, "sum", str(i), 1) for i in (1, 2, 3)], "filer_id long, overlap string, cik string, priority int")
    filers = ciks.select("filer_id", "overlap")
    counted = effective.effective_filing(effective.effective_filing_by_cik(filing), filers, ciks)
    snap = snapshot.position_snapshot(counted, filing, holding)
    return filing, counted, snap, change.position_change(snap)


def test_effective_filings_leave_the_restated_one_out(tables):
    assert sorted(r.filing_id for r in tables[1].collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12]


def test_snapshot(tables):
    rows = {(r.filer_id, r.period, r.security_id): r for r in tables[2].collect()}
    assert len(rows) == 29
    core = rows[1, Q4, SECURITY["CORE"]]
    assert (core.shares, core.value_usd, core.source_filing_id) == (900, 45000, 12)
    assert rows[3, Q2, SECURITY["CORE"]].shares == 200


def test_consensus(tables):
    rows = {(r.period, r.security_id): r for r in views.consensus_holdings(tables[2]).collect()}
    r = rows[Q4, SECURITY["ACME"]]
    assert (r.holder_count, float(r.total_value), float(r.total_shares), float(r.avg_weight), float(r.median_weight), r.value_rank) == (3, 104490, 6966, 31.665, 30, 1)
    assert rows[Q2, SECURITY["ACME"]].value_rank == rows[Q2, SECURITY["BOLT"]].value_rank == 2


def test_flows(tables):
    rows = {(r.period, r.security_id): r for r in views.quarter_flows(tables[3]).collect()}
    figures = lambda q, s: tuple(float(rows[q, SECURITY[s]][c]) for c in ("bought", "sold", "net", "net_shares", "new_positions", "exits", "buyers", "sellers"))
    assert figures(Q3, "BOLT") == (12500, 25000, -12500, -500, 1, 0, 1, 1)
    assert figures(Q3, "DYNA") == (0, 0, 0, 1, 0, 0, 0, 0)
    assert figures(Q4, "ECHO") == (18000, 50000, -32000, -320, 1, 1, 1, 1)
    assert (Q1, 1) not in rows and (Q2, SECURITY["ECHO"]) not in rows


def test_summary(tables):
    rows = {(r.filer_id, r.period): r for r in views.filer_summary(tables[2], tables[3]).collect()}
    turnover = {k: None if r.turnover is None else float(r.turnover) for k, r in rows.items()}
    assert turnover == {(1, Q1): None, (1, Q2): 53, (1, Q3): 35.875, (1, Q4): 11.25, (2, Q2): None, (2, Q3): 16.25, (2, Q4): 50, (3, Q1): None, (3, Q2): 16.666667, (3, Q4): 51.25}
    assert float(rows[1, Q2].portfolio_value) == 108000


def test_prices(tables):
    rows = price.implied_price(tables[2]).collect()
    assert len(rows) == 18
    assert all(float(r.price) == list(PRICES.values())[r.security_id - 1][r.period.month // 3 - 1] for r in rows)


def test_changes_skip_the_quarter_that_was_not_published(tables):
    rows = {(r.filer_id, r.period, r.security_id): r for r in tables[3].collect()}
    assert rows[3, Q4, SECURITY["BOLT"]].action == "exit" and rows[3, Q4, SECURITY["BOLT"]].prev_period == Q2
    assert rows[1, Q3, SECURITY["DYNA"]].action == "hold"
    assert tables[3].where("action = 'exit' and period > date'2024-12-31'").isEmpty()


def test_one_window_for_lags(tables):
    plan = tables[3]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
