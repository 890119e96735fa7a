"""Stored screens against arriving positions, mail that is due, crawls with holes, tickers' history and candidates over time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import members, percolate, screener, tickers
from tidemark.streaming import batches

D = dt.date
Q2 = D(2026, 6, 30)


@pytest.fixture(scope="module")
def t(spark):
    filer = spark.createDataFrame([(1, "FUND-A", "fund-a", "quant"), (2, "FUND-B", "fund-b", "value")], "filer_id long, name string, slug string, category string")
    rng = random.Random(4)
    rows = []
    for f in (1, 2):
        for s in range(1, 9):
            kind = rng.choice(["new", "add", "trim", "hold", "exit"])
            shares = 0 if kind == "exit" else 100 * s
            was = {"new": None, "hold": float(shares), "add": shares * 0.7, "trim": shares * 1.37, "exit": 50.0}[kind]
            rows.append((f, Q2, s, D(2026, 3, 31), kind, float(shares), was, shares * 110.0, None if was is None else was * 100.0, float(s), s - 4.5, False, False))
    change = spark.createDataFrame(rows, "filer_id long, period date, security_id long, prev_period date, action string, shares double, prev_shares double, value_usd double, prev_value_usd double, weight_pct double, weight_delta double, is_split boolean, suspect boolean")
    consensus = spark.createDataFrame([(Q2, s, s % 4) for s in range(1, 9)], "period date, security_id long, holder_count long")
    flows = spark.createDataFrame([(Q2, s, float(s - 5), s % 3) for s in range(1, 9)], "period date, security_id long, net double, exits long")
    security = spark.createDataFrame([(s, f"S{s}" if s % 2 else None, f"ISSUER {s}", f"9999{s}Z10{s}") for s in range(1, 9)], "security_id long, ticker string, name string, cusip string")
    listed = spark.createDataFrame([("S3", "c3"), ("S5", "c5")], "ticker string, cik string")
    episodes = spark.createDataFrame([("c3", D(2026, 5, 1), D(2026, 7, 9), 8)], "issuer_cik string, window_start date, window_end date, security_id long")
    lines = spark.createDataFrame([("c5", 1, D(2026, 4, 2), 5), ("c5", 2, D(2026, 6, 2), None), ("c9", 1, D(2026, 4, 2), 6)], "issuer_cik string, insider_id long, transaction_date date, security_id long")
    return screener.Tables(change, consensus, flows, filer, episodes, lines, security, listed)


def fresh(spark, at="2026-08-10 20:00:00"):
    return spark.sql(f"SELECT explode(array(1L, 2L)) AS filer_id, DATE '2026-06-30' AS period, TIMESTAMP '{at}' AS filed_at")


SCREENS = [
    {"action": ["new"]}, {"action": ["add", "trim"], "min_value": ["300"]}, {"filer_slug": ["fund-a", "gone"]}, {"filer_category": ["value"], "min_weight": ["3"]}, {"net_flow": ["buy"], "min_holders": ["2"]}, {"min_exits": ["1"]}, {"insider_cluster": ["true"]},
    {"insider_cluster": ["false"], "weight_change": ["-1.5"]}, {"insider_buyers": ["2"]}, {"is_new_position": ["false"]}, {"added_quarters": ["1"]}, {"filer_slug": ["gone"]}, {"min_wieght": ["5"], "action": ["new"]}, {"action": ["bought"]}, {}, {"net_flow": ["x"], "min_value": ["much"]},
]


def saved(spark, screens=SCREENS):
    return spark.createDataFrame([(i, f"Screen {i}", f) for i, f in enumerate(screens)], "screen_id long, name string, filters map<string, array<string>>")


def test_every_screen_passes_what_it_passes_by_itself(spark, t):
    screens = percolate.read_screens(saved(spark), t.filer)
    got = {(r.screen_id, r.filer_id, r.security_id) for r in percolate.percolated(percolate.position_facts(t, fresh(spark)), screens).collect()}
    lost = {r.screen_id: r.ignored for r in screens.collect()}
    for i, filters in enumerate(SCREENS):
        read, gone = screener.read_filters(filters)
        slugs = [s for s in read.get("filer_slug", []) if s != "gone"]
        gone_slugs = "filer_slug" in read and len(slugs) < len(read["filer_slug"])
        if "filer_slug" in read:
            read = {k: v for k, v in read.items() if k != "filer_slug"} | ({"filer_slug": slugs} if slugs else {})
        if read.get("added_quarters") == 1:  # the vocabulary's least is 2
            wanted = {(i, r.filer_id, r.security_id) for r in t.change.where("action = 'add'").collect()}
        else:
            wanted = {(i, r.filer_id, r.security_id) for r in screener.screen(t, str(Q2), **read).collect()}
        assert {g for g in got if g[0] == i} == wanted, filters
        assert lost[i] == len(gone) + gone_slugs


def test_what_an_event_says(spark, t):
    change = t.change.where("filer_id = 1").withColumn("action", F.when(F.col("security_id") < 8, "new").otherwise("hold"))
    tables = screener.Tables(**(vars(t) | {"change": change}))
    rules = spark.sql("SELECT * FROM VALUES (1L, 10L, 0L, TIMESTAMP '2026-08-01'), (2L, 11L, 0L, TIMESTAMP '2026-08-11'), (3L, 12L, 12L, TIMESTAMP '2026-01-01') AS r(rule_id, user_id, target, created_at)")
    got = {r.rule_id: r for r in percolate.heard_screens(saved(spark), rules, tables, fresh(spark)).collect()}
    assert set(got) == {1, 3}  # the second rule is younger than the filing, and other screens have no rule
    assert got[1].title == "FUND-A: 7 positions pass “Screen 0”" and got[1].dedupe_key == "saved_filter_match:0:fund-a:2026Q2"
    assert got[1].body.startswith("In its 13F for 2026Q2: S7 (opened, $77,000), ISSUER 6 (opened, $66,000)") and got[1].body.endswith(", and 2 more.") and len(got[1].stocks) == 5
    assert got[3].body.endswith(" 1 of the filter's settings no longer applies, so it passes more than when it was saved: open it to review.")
    told = spark.createDataFrame([(got[1].dedupe_key, 10)], "dedupe_key string, user_id long")
    assert {r.rule_id for r in percolate.heard_screens(saved(spark), rules, tables, fresh(spark), told).collect()} == {3}


def test_a_split_not_yet_found_passes_nothing(spark, t):
    change = t.change.where("filer_id = 1 and security_id = 4").withColumns({"action": F.lit("add"), "prev_shares": F.lit(40.0), "shares": F.lit(400.0), "value_usd": F.lit(4000.0), "prev_value_usd": F.lit(4000.0)})
    tables = screener.Tables(**(vars(t) | {"change": change}))
    screens = percolate.read_screens(saved(spark, [{"action": ["add"]}]), t.filer)
    assert percolate.percolated(percolate.position_facts(tables, fresh(spark)), screens).count() == 0
    assert percolate.percolated(percolate.position_facts(screener.Tables(**(vars(tables) | {"change": change.withColumn("is_split", F.lit(True))})), fresh(spark)), screens).count() == 1


# ---------------------------------------------------------------- mail


def due(spark, now, items, **user):
    at = dt.datetime.fromisoformat
    waiting = spark.createDataFrame([(1, k, at(s)) for k, s in items], "user_id long, kind string, since timestamp")
    facts = {"zone": "UTC", "quiet_from": 22, "quiet_to": 7, "sent_today": 0, "digest_emails": True, "last_digest": None} | user
    users = spark.createDataFrame([(1, *facts.values())], "user_id long, zone string, quiet_from int, quiet_to int, sent_today int, digest_emails boolean, last_digest timestamp")
    return {r.action: r.items for r in batches.due_mail(waiting, users, now).collect()}


def test_mail(spark):
    two = [("instant", "2024-03-05 10:00:00"), ("instant", "2024-03-05 10:14:00")]
    assert due(spark, "2024-03-05 10:14:00", two) == {"wait": 0}
    assert due(spark, "2024-03-05 10:15:00", two) == {"batch": 2}
    assert due(spark, "2024-03-05 23:00:00", two) == {"wait": 0} and due(spark, "2024-03-06 06:59:00", two) == {"wait": 0}
    assert due(spark, "2024-03-05 10:15:00", two, sent_today=2) == {"batch": 2}
    assert due(spark, "2024-03-05 10:15:00", [*two, ("digest", "2024-03-05 09:00:00")], sent_today=2) == {"to_digest": 2}  # the last one is the digest's
    assert due(spark, "2024-02-15 10:15:00", [("instant", "2024-02-15 10:00:00")], sent_today=2) == {"to_digest": 1}  # in a filing window a season's digest is sure to come
    assert due(spark, "2024-03-05 10:15:00", [*two, ("season", "2024-03-05 09:00:00")], sent_today=2, digest_emails=False) == {"batch": 2}
    both = [*two, ("digest", "2024-03-05 09:00:00"), ("digest", "2024-03-05 19:30:00")]
    assert due(spark, "2024-03-05 20:00:00", both) == {"digest": 1, "batch": 2}
    assert due(spark, "2024-03-05 20:00:00", both, sent_today=2) == {"digest": 1, "to_digest": 2}
    assert due(spark, "2024-03-05 20:00:00", both, sent_today=3) == {"to_digest": 2}
    assert due(spark, "2024-03-05 20:00:00", both, last_digest=dt.datetime(2024, 3, 5, 19)) == {"batch": 2}
    assert due(spark, "2024-03-06 08:00:00", [("digest", "2024-03-05 09:00:00")]) == {"digest": 1}  # what the evening had no room for
    assert due(spark, "2024-03-05 20:00:00", [("season", "2024-03-05 09:00:00")], sent_today=3, digest_emails=False) == {"digest": 1}  # nothing of it is mailed
    assert due(spark, "2024-03-05 10:15:00", two, zone="Asia/Tokyo", quiet_from=19, quiet_to=20) == {"wait": 0}


# ---------------------------------------------------------------- crawls


def test_a_crawl_goes_on_from_the_first_hole(spark, tmp_path):
    days = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", D(2024, 1, 3)), ("c", D(2024, 1, 1))], "source string, first_day date")
    tries = [("a", 1, 5, 5), ("a", 2, 5, 4), ("a", 3, 5, 5), ("a", 5, 0, 0), ("b", 3, 1, 1), ("b", 4, 2, 2), ("b", 5, 2, 2), ("c", 2, 1, 1)]
    read = lambda rows: spark.createDataFrame([(s, D(2024, 1, d), n, m) for s, d, n, m in rows], "source string, day date, listed long, loaded long")
    progress = lambda rows: {r.source: tuple(r)[2:] for r in batches.crawl_progress(days, read(rows), "2024-01-05").collect()}
    assert progress(tries) == {"a": (D(2024, 1, 1), D(2024, 1, 2), 2, 2), "b": (D(2024, 1, 5), None, 0, 0), "c": (None, D(2024, 1, 1), 1, 4)}
    assert progress([*tries, ("a", 2, 5, 5)])["a"] == (D(2024, 1, 3), D(2024, 1, 4), 1, 1)  # a second try, and days after it need none

    # as a stream: a day fails on its first try, later ones are read, and the next run takes up the hole
    log, failed = str(tmp_path / "log"), []

    def run():
        done = spark.read.schema("source string, day date, listed long, loaded long").parquet(log) if (tmp_path / "log").exists() else read([])
        for r in batches.days_to_read(days.where("source = 'a'"), done, "2024-01-04").orderBy("day").collect():
            short = r.day == D(2024, 1, 2) and not failed
            if short:
                failed.append(r.day)
            spark.createDataFrame([("a", r.day, 9, 3 if short else 9)], "source string, day date, listed long, loaded long").write.mode("append").parquet(log)
        return batches.crawl_progress(days.where("source = 'a'"), spark.read.parquet(log), "2024-01-04").first()

    assert tuple(run())[2:] == (D(2024, 1, 1), D(2024, 1, 2), 2, 1) and tuple(run())[2:] == (D(2024, 1, 4), None, 0, 0)


# ---------------------------------------------------------------- tickers


def test_history_entered_by_hand(spark):
    rng = random.Random(9)
    span = lambda: sorted(rng.sample(range(1, 40), 2))
    base, days = dt.date(2000, 1, 1), dt.timedelta
    ranges, changes = {}, []
    for s in range(40):
        cuts = sorted(rng.sample(range(1, 40), rng.choice([0, 2, 4])))
        own = [[f"R{s}{a}", a, b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        if own and rng.random() < 0.5:
            own[0][1] = None
        if own and rng.random() < 0.5:
            own[-1][2] = None
        ranges[s] = own
        for k in range(rng.randint(0, 3)):
            low, high = span()
            changes.append((s * 10 + k, s if rng.random() < 0.95 else 99, f"H{s}{k}", None if rng.random() < 0.3 else low, high))
    day = lambda n: None if n is None else base + days(n)
    df = spark.createDataFrame([(s, t_, day(a), day(b), "list") for s, own in ranges.items() for t_, a, b in own], "security_id long, ticker string, valid_from date, valid_to date, source string")
    ch = spark.createDataFrame([(i, str(s), t_, day(a), day(b)) for i, s, t_, a, b in changes], "change_id long, cusip string, ticker string, valid_from date, valid_to date")
    security = spark.createDataFrame([(s, str(s)) for s in range(40)], "security_id long, cusip string")
    after, told = tickers.enter_history(df, ch, security)

    low, high = (lambda x: -1 if x is None else x), (lambda x: 999 if x is None else x)
    outcomes = {}
    for i, s, t_, a, b in sorted(changes):
        if s not in ranges:
            outcomes[i] = ("refused", 0)
            continue
        met = [r for r in ranges[s] if low(r[1]) < b and low(a) < high(r[2])]
        unknown = lambda r, b=b: r[1] is None and b < high(r[2])
        if any(low(a) <= low(r[1]) and high(r[2]) <= b or low(r[1]) < low(a) and b < high(r[2]) and not unknown(r) for r in met):
            outcomes[i] = ("refused", 0)
            continue
        for r in met:
            if low(r[1]) < low(a) and not unknown(r):
                r[2] = a
            else:
                r[1] = b
        ranges[s].append([t_, a, b])
        outcomes[i] = ("recorded", len(met))
    assert {r.change_id: (r.outcome, r.trimmed) for r in told.collect()} == outcomes and {"refused", "recorded"} == {o for o, _ in outcomes.values()}
    assert sorted((r.security_id, r.ticker, str(r.valid_from), str(r.valid_to)) for r in after.collect()) == sorted((s, t_, str(day(a)), str(day(b))) for s, own in ranges.items() for t_, a, b in own)


def test_meta_and_fb(spark):
    ranges = spark.createDataFrame([(1, "META", None, None, "list")], "security_id long, ticker string, valid_from date, valid_to date, source string")
    change = spark.createDataFrame([(1, "30303M102", "FB", D(2012, 5, 18), D(2022, 6, 9))], "change_id long, cusip string, ticker string, valid_from date, valid_to date")
    security = spark.createDataFrame([(1, "30303M102")], "security_id long, cusip string")
    after, told = tickers.enter_history(ranges, change, security)
    assert sorted(tuple(r)[1:4] for r in after.collect()) == [("FB", D(2012, 5, 18), D(2022, 6, 9)), ("META", D(2022, 6, 9), None)]
    again, refused = tickers.enter_history(after, change.withColumn("valid_to", F.lit(D(2030, 1, 1))), security)
    assert refused.first().reason == "FB lies wholly inside it" and again.count() == 2


def test_recorded_tickers(spark):
    ranges = [(1, "OLD", None, None), (2, "SAME", None, None), (3, "TODAY", D(2024, 5, 1), None), (4, "GONE", None, D(2020, 1, 1))]
    df = spark.createDataFrame([(*r, "list") for r in ranges], "security_id long, ticker string, valid_from date, valid_to date, source string")
    new = spark.createDataFrame([(1, "NEW", "x"), (2, "same", "x"), (3, "OTHER", "x"), (4, "BACK", "x"), (5, "FIRST", "x")], "security_id long, ticker string, source string")
    got = sorted(((r.security_id, r.ticker, r.valid_from, r.valid_to, r.event) for r in tickers.record_tickers(df, new, "2024-05-01").collect()), key=str)
    assert got == sorted([
        (1, "OLD", None, D(2024, 5, 1), "closed"), (1, "NEW", D(2024, 5, 1), None, "renamed"), (2, "SAME", None, None, None), (3, "OTHER", D(2024, 5, 1), None, "replaced"), (4, "GONE", None, D(2020, 1, 1), None),
        (4, "BACK", D(2020, 1, 1), None, "opened"), (5, "FIRST", None, None, "opened"),
    ], key=str)


# ---------------------------------------------------------------- candidates


def test_candidates_over_passes(spark):
    found = lambda *rows: spark.createDataFrame([(n, m, "trigram", c, ok) for n, m, c, ok in rows] or [], "name_id long, member_id long, method string, confidence double, accepted boolean")
    names = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "name_id long")
    empty = spark.createDataFrame([], "candidate_id string, name_id long, member_id long, method string, confidence double, status string, opened_at timestamp, closed_at timestamp")
    first = members.merged(empty, found((1, 10, 0.5, False), (1, 11, 0.4, False), (2, 20, 0.95, True), (3, 30, 0.5, False), (3, 31, 0.4, False), (4, 40, 0.5, False)), names, "2024-01-01")
    assert sorted((r.name_id, r.member_id, r.event) for r in first.collect()) == [(1, 10, "opened"), (1, 11, "opened"), (3, 30, "opened"), (3, 31, "opened"), (4, 40, "opened")]
    rulings = spark.createDataFrame([(3, 31, "accepted"), (4, 40, "rejected"), (1, 99, "rejected")], "name_id long, member_id long, ruling string")
    then = members.ruled(first.drop("event"), rulings, "2024-01-02")
    assert {(r.member_id, r.status) for r in then.collect()} == {(10, "pending"), (11, "pending"), (30, "superseded"), (31, "accepted"), (40, "rejected")}
    second_found = found((1, 10, 0.6, False), (2, 20, 0.5, False), (3, 30, 0.9, False), (4, 40, 0.9, False))
    second = members.merged(then, second_found, names, "2024-02-01")
    assert {(r.member_id, r.status, r.event) for r in second.collect()} == {(10, "pending", "changed"), (11, "superseded", "closed"), (30, "superseded", None), (31, "accepted", None), (40, "rejected", None), (20, "pending", "opened")}
    ids = {r.member_id: r.candidate_id for r in then.collect()}
    assert {r.member_id: r.candidate_id for r in second.where("member_id <> 20").collect()} == ids
    third = members.merged(second.drop("event"), found((1, 11, 0.7, False), (1, 10, 0.6, False)), names.where("name_id = 1"), "2024-03-01")
    assert {(r.member_id, r.status, r.event) for r in third.where("name_id = 1").collect()} == {(10, "pending", None), (11, "superseded", None), (11, "pending", "reopened")}
    assert third.where("member_id = 20").first().status == "pending"  # its name wasn't asked
    status = {r.name_id: (r.status, r.member_id, r.method) for r in members.named(second_found, second, names).collect()}
    assert status == {1: ("review", None, None), 2: ("review", None, None), 3: ("matched", 31, "manual"), 4: ("review", None, None)}
