import datetime as dt
from decimal import Decimal
from pathlib import Path

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import change, clusters, effective, paging, price, screener


#: Evidence as (numerator, denominator, agreeing, holders, exact, price ratio), and the confidence or the reason against it.
VERDICTS = [
    ((20, 1, 21, 35, 2, "0.0326"), "high"), ((50, 1, 4, 11, 1, "0.0216"), "high"), ((10, 1, 6, 13, 0, "0.0462"), "medium"), ((3, 1, 9, 12, 0, "0.3614"), "medium"),
    ((2, 1, 2, 5, 1, "0.5486"), "medium"), ((5, 1, 2, 2, 0, "0.2682"), "low"), ((1, 10, 3, 4, 2, "10.5"), "high"), ((10, 1, 3, 3, 0, "0.04"), "medium"),
    ((10, 1, 2, 3, 0, "0.1"), "low"), ((2, 1, 4, 5, 0, "0.5"), "no holder exact to the share"),
    ((None, None, 0, 31, 0, "1.379"), "no common ratio"), ((10, 1, 1, 1, 1, "0.1"), "1 of 1 holders agree"), ((2, 3, 2, 11, 1, "1.4839"), "2 of 11 holders agree"),
    ((10, 1, 3, 3, 3, None), "no price on one side"), ((10, 1, 3, 3, 1, "0.4"), "the price moved x0.400"), ((10, 1, 3, 3, 0, "0.2323"), "the price moved x0.232"),
    ((2, 3, 7, 14, 0, "1.34"), "no holder exact to the share"), ((3, 1, 2, 5, 0, "0.4532"), "no holder exact to the share, and no majority agreeing"),
]


def test_verdicts(spark):
    schema = "i int, numerator int, denominator int, holders_agreeing int, holders int, holders_exact int, price_ratio decimal(28,10)"
    rows = spark.createDataFrame([(i, n, d, a, h, e, Decimal(p) if p else None) for i, ((n, d, a, h, e, p), _) in enumerate(VERDICTS)], schema)
    got = {r.i: r for r in price.judge(rows).collect()}
    for i, (evidence, wanted) in enumerate(VERDICTS):
        assert (got[i].confidence or got[i].reason) == wanted, evidence


def test_outliers_moved_apart_and_are_no_split(spark):
    cases = [((4, 1, 1, 5, "4.44", "0.294"), True), ((None, None, 0, 2, "0.155", "14.24"), True), ((1, 3, 1, 6, "0.35", "2"), False), ((10, 1, 3, 3, "10", "0.1"), False)]
    rows = [(i, n, d, a, h, 0, Decimal(s), Decimal(p)) for i, ((n, d, a, h, s, p), _) in enumerate(cases)]
    schema = "i int, numerator int, denominator int, holders_agreeing int, holders int, holders_exact int, shares_ratio decimal(28,6), price_ratio decimal(28,10)"
    found = {r.i for r in price.judge(spark.createDataFrame(rows, schema)).where(price.is_outlier()).collect()}
    assert found == {i for i, (_, wanted) in enumerate(cases) if wanted}


def test_one_holder_looks_like_a_split(spark):
    cases = [("100", "1000", "0.1", True), ("100", "1000", "0.5", False), ("100", "300", "0.34", True), ("100", "200", "0.5", True), ("100", "205", "0.5", False), ("100", "1000", None, True),
             ("100", "1005", None, False), ("100", "156", "0.14", True), ("0", "5", "0.1", False), ("100", "112", "1.1", False)]
    rows = spark.createDataFrame([(i, Decimal(a), Decimal(b), Decimal(p) if p else None) for i, (a, b, p, _) in enumerate(cases)], "i int, a decimal(20,4), b decimal(20,4), p decimal(28,10)")
    got = {r.i for r in rows.where(price.looks_like_split(F.col("a"), F.col("b"), F.col("p"))).collect()}
    assert got == {i for i, c in enumerate(cases) if c[3]}


def test_a_cik_without_a_priority_row_counts_last_and_stays(spark):
    by_cik = spark.createDataFrame([(1, 1, "a", 1), (2, 1, "z", 1), (3, 2, "z", 1)], "filing_id long, filer_id long, cik string, period int")
    filers = spark.createDataFrame([(1, "successor"), (2, "successor")], "filer_id long, overlap string")
    ciks = spark.createDataFrame([(1, "a", 0)], "filer_id long, cik string, priority int")
    assert sorted(r.filing_id for r in effective.effective_filing(by_cik, filers, ciks).collect()) == [1, 3]


def test_a_new_position_after_a_suspect_period_is_suspect(spark):
    d = [dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(2024, 9, 30)]
    rows = [(1, d[0], 1, True), (1, d[1], 1, False), (1, d[1], 2, False), (1, d[2], 2, False)]
    snap = spark.createDataFrame([(f, p, s, Decimal(10), Decimal(100), Decimal(50), b) for f, p, s, b in rows], "filer_id long, period date, security_id long, shares decimal(20,4), value_usd decimal(20,2), weight_pct decimal(9,6), suspect boolean")
    got = {(r.period, r.security_id, r.action): r.suspect for r in change.position_change(snap).collect()}
    assert got == {(d[0], 1, "new"): True, (d[1], 1, "hold"): True, (d[1], 2, "new"): True, (d[2], 2, "hold"): False, (d[2], 1, "exit"): False}


def test_saved_filters_are_read_through_the_vocabulary():
    saved = {"action": ["new", "add"], "min_weight": ["10"], "is_new_position": "true", "gone": 3, "net_flow": "sideways", "min_exits": "five"}
    assert screener.read_filters(saved) == ({"action": ["new", "add"], "min_weight": 10.0, "is_new_position": True}, ["gone", "net_flow", "min_exits"])
    assert len(screener.SORTS) == len(set(screener.SORTS)) == 26 and len(screener.PRESETS) == 7


def _lines(spark, offsets):
    base = dt.date(2026, 3, 2)
    rows = [(i, base + dt.timedelta(days=o), who, issuer, 1, False, "P", 100, None if i == 2 else 1000, False, None, True, False) for i, (issuer, who, o) in enumerate(offsets)]
    return spark.createDataFrame(rows, "id long, transaction_date date, insider_id long, issuer_cik string, security_id long, is_derivative boolean, transaction_code string, shares int, value_usd int, is_10b5_1 boolean, footnotes map<string,string>, is_director boolean, is_officer boolean"), base


@pytest.mark.parametrize(
    ("offsets", "least", "wanted"),
    [
        ([("a", 0, 0), ("a", 1, 9), ("a", 2, 20)], 3, [(0, 20, 3, 3)]),
        ([("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 3)], 3, []),
        ([("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 3)], 2, [(0, 3, 2, 4)]),
        ([("a", 0, 0), ("a", 1, 15), ("a", 2, 30), ("b", 0, 100), ("b", 1, 115), ("b", 2, 131)], 3, [(0, 30, 3, 3)]),
        ([("a", i, o) for i, o in enumerate((0, 10, 20, 35, 48))], 3, [(0, 48, 5, 5)]),
        ([("a", i, o) for i, o in enumerate((0, 5, 10, 40, 45, 50))], 3, [(0, 10, 3, 3), (40, 50, 3, 3)]),
    ],
)
def test_clusters(spark, offsets, least, wanted):
    lines, base = _lines(spark, offsets)
    found = clusters.insider_clusters(lines, 30, least).collect()
    assert sorted(((r.window_start - base).days, (r.window_end - base).days, r.insiders, r.lines) for r in found) == wanted


def test_grid_query_has_all_points(spark):
    import duckdb

    name, folder = "drv18_insider_clusters", "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert {r[:2] for r in got} == {(d, m) for d in (14, 30, 60, 90) for m in (2, 3, 4, 5)}


def test_pages_walk_all_rows_once(spark):
    import random

    rng = random.Random(500)
    rows = spark.createDataFrame([(i, rng.choice([None, *range(9)]), rng.choice("abc")) for i in range(200)], "id long, value int, label string").cache()
    keys = [paging.Key("value", True), paging.Key("label"), paging.Key("id")]
    seen, position = [], None
    while True:
        got = paging.page(rows, keys, 60, position).collect()
        seen += [r.id for r in got[:60]]
        if len(got) <= 60:
            break
        cursor = paging.encode_cursor([got[59].value, got[59].label, got[59].id], "value")
        position = paging.decode_cursor(cursor, "value")
    assert sorted(seen) == list(range(200)) and len(seen) == 200
    with pytest.raises(ValueError):
        paging.decode_cursor("!", "value")


def test_screener_refuses_what_it_does_not_know(spark):
    change = spark.createDataFrame([], "period date, action string")
    tables = screener.Tables(change, change, change, change)
    with pytest.raises(ValueError, match="no such filter"):
        screener.screen(tables, "2024-03-31", nonsense=1)
    with pytest.raises(ValueError, match="sectors"):
        screener.screen(tables, "2024-03-31", sector="x")


def test_periods(spark):
    row = spark.createDataFrame([(dt.date(2024, 2, 29), "2024Q3", dt.date(2024, 3, 31))], "day date, label string, period date")
    got = row.select(periods.quarter_end(F.col("day")), periods.parse_quarter(F.col("label")), periods.previous_quarter(F.col("period")), periods.next_quarter(F.col("period")), periods.quarter_label(F.col("period")), periods.deadline(F.col("period"))).first()
    assert tuple(got) == (dt.date(2024, 3, 31), dt.date(2024, 9, 30), dt.date(2023, 12, 31), dt.date(2024, 6, 30), "2024Q1", dt.date(2024, 5, 15))


def test_cluster_windows_count_without_sets(spark):
    """Windows equal those counted one by one, a line without an insider among them, and no window of the plan gathers insiders."""
    import random

    dealt = random.Random(7)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=dealt.randrange(120)), dealt.choice("ab"), dealt.choice([1, 2, 3, 4, 5, 6, None])) for i in range(60)]
    lines = spark.createDataFrame(rows, "id long, transaction_date date, issuer_cik string, insider_id long").selectExpr(
        "*", "'P' AS transaction_code", "false AS is_derivative", "true AS is_director", "false AS is_officer", "false AS is_10b5_1", "CAST(NULL AS map<string, string>) AS footnotes",
        "CAST(1 AS decimal(20,4)) AS shares", "CAST(1 AS decimal(20,2)) AS value_usd", "1L AS security_id",
    )
    grid = [(5, 2), (14, 3), (14, 4), (30, 5)]
    wanted = set()
    for days, least in grid:
        for cik in "ab":
            own = [(day, insider) for _, day, c, insider in rows if c == cik]
            spans = []
            for day in sorted({d for d, _ in own}):
                seen = [(d, i) for d, i in own if 0 <= (day - d).days <= days]
                if len({i for _, i in seen if i is not None}) >= least:
                    first = min(d for d, _ in seen)
                    if spans and first <= spans[-1][1]:
                        spans[-1] = (min(first, spans[-1][0]), day)
                    else:
                        spans.append((first, day))
            wanted |= {(days, least, cik, a, b, sum(a <= d <= b for d, _ in own), len({i for d, i in own if a <= d <= b and i is not None})) for a, b in spans}
    found = clusters.cluster_grid(lines, grid)
    assert {(r.window_days, r.min_insiders, r.issuer_cik, r.window_start, r.window_end, r.lines, r.insiders) for r in found.collect()} == wanted and wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("collect_set" in line for line in plan.splitlines() if "windowspecdefinition" in line)
