"""Rules on names and texts: extents of trigrams, names of filers and members, trading plans, price ranges, likeness of names, kinds of assets."""

import datetime as dt
import random
import re
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import assets, text
from tidemark.operators import alike, entities, members, search, service
from tidemark.sources import filings


def walked(query, name, strict):
    """The greedy walk over lists and sets."""
    grams = lambda w: [f"  {w} "[i : i + 3] for i in range(len(w) + 1)]
    own = [grams(w) for w in re.findall("[a-z0-9]+", name.lower())]
    asked = {g for w in re.findall("[a-z0-9]+", query.lower()) for g in grams(w)}
    pieces = [g for w in own for g in w]
    firsts, lasts, n = set(), set(), 0
    for w in own:
        firsts.add(n)
        n += len(w)
        lasts.add(n - 1)
    low, best = (0 if strict else None), 0.0
    for up, g in enumerate(pieces):
        if (up not in lasts) if strict else (g not in asked):
            continue
        low = up if low is None else low
        scores = []
        for start in range(low, up + 1):
            if not strict or start in firsts:
                part = set(pieces[start : up + 1])
                scores.append((len(part & asked) / len(part | asked), -start))
        top = max(scores)
        low, best = -top[1], max(best, top[0])
    return best


def test_extents_are_those_of_the_greedy_walk(spark):
    rng = random.Random(6)
    words = ["micro", "soft", "microsoft", "corp", "two", "words", "word", "kabankala", "kabankalan", "city", "allegro", "a", "b1", "systems"]
    names = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(60)] + ["", "Two Words", "!!", "Kabakala"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    for query in ("word", "microsft", "kabankala", "micro systems", "b"):
        got = rows.select("name", text.word_similarity(query, F.col("name")).alias("w"), text.strict_word_similarity(query, F.col("name")).alias("s")).collect()
        for r in got:
            assert (r.w, r.s) == (pytest.approx(walked(query, r.name, False)), pytest.approx(walked(query, r.name, True))), (query, r.name)


@pytest.mark.parametrize(("query", "name", "word", "strict"), [("word", "two words", 0.8, 0.571429), ("Kabankala", "Kabankalan City Public Plaza", 0.9, 0.75), ("Kabankala", "Kabakala", 0.583333, 0.583333), ("Kabankala", "Kabankala", 1, 1)])
def test_extents_known_values(spark, query, name, word, strict):
    got = spark.createDataFrame([(name,)], "n string").select(text.word_similarity(query, F.col("n")), text.strict_word_similarity(query, F.col("n"))).first()
    assert tuple(got) == (pytest.approx(word, abs=1e-6), pytest.approx(strict, abs=1e-6))


def test_a_search_walks_each_text_in_one_function(spark):
    rows = spark.createDataFrame([(1, "T1", "apples", 1)], "id long, ticker string, name string, held long")
    assert "aggregate(" not in search.search_stocks(rows, "appel")._jdf.queryExecution().optimizedPlan().toString()
    assert text.extents("word", "two words") == (pytest.approx(0.8), pytest.approx(4 / 7)) and text.extents("word", None) == (0, 0)


def test_lines_with_an_equal_name_leave_the_fuzzy_join(spark):
    names = spark.createDataFrame([("Acme Widgets Inc",), ("Acme Widgits",), ("No",)], "name string")
    listed = spark.createDataFrame([(1, "ACME WIDGETS CORP", None), (2, "Other", "acme widgets")], "security_id long, name string, filed_name string")
    assert sorted(map(tuple, entities.equal_names(names, listed).collect())) == [("Acme Widgets Inc", 1, 1.0), ("Acme Widgets Inc", 2, 1.0)]


def test_likest_members_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abc", k=n))
    day, grams = dt.date, lambda f: {f"  {w} "[i : i + 3] for w in f.split() for i in range(len(w) + 1)}
    known = [(i, [(c, s, day(2021, 1, 3), day(2025, 1, 3))], [f"{word(3)} {word(5)}" for _ in range(1 + i % 2)]) for i in range(150) for c, s in [("house" if i % 3 else "senate", f"S{i % 2}")]]
    names = [(n, "house" if n % 2 else "senate", None if n % 3 else f"S{n % 2}", day(2024, 2, 1), day(2024, 3, 1), [f"{word(3)} {word(5)}"]) for n in range(40)]
    seats = "member_id int, terms array<struct<chamber:string,state:string,start_date:date,end_date:date>>, folded array<string>"
    got = members.likest_members(spark.createDataFrame(names, "name_id int, chamber string, state string, first_filed date, last_filed date, forms array<string>"), spark.createDataFrame(known, seats), spark.createDataFrame([(1, 1)], "name_id int, member_id int"))
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.name_id, []).append((-round(r.likest, 3), r.member_id))
    for n, chamber, state, *_, forms in names:
        every = [(-round(max(len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in forms for b in f), 3), m) for m, ((c, s, *_),), f in known if c == chamber and state in (None, s) and (n, m) != (1, 1)]
        assert sorted(found.get(n, [])) == sorted(x for x in every if x[0] <= -members.TRIGRAM)[: members.CANDIDATES]


def test_name_candidates_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    words = ["acme", "widget", "widgets", "river", "rivers", "blue", "bluer", "holdings", "inc", "group", "x", "é"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 5)))
    asked, listed = sorted({name() for _ in range(60)}), [(i, name(), name() if i % 2 else None) for i in range(60)]
    core = {r.n: r.c for r in spark.createDataFrame([(n,) for n in {*asked, *(n for _, *both in listed for n in both if n)}], "n string").select("n", text.core_name(F.col("n")).alias("c")).collect()}
    grams = lambda n: {f"  {w} "[i : i + 3] for w in core[n].split() for i in range(len(w) + 1)}
    alike_ = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(b) else 0
    every = {(a, i): max(alike_(a, b) for b in both if b) for a in asked for i, *both in listed if len(core[a].replace(" ", "")) >= 3}
    got = entities.name_candidates(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(listed, "security_id long, name string, filed_name string"))
    found = {(r["name"], r.security_id): r.score for r in got.collect()}
    assert found == {k: v for k, v in every.items() if v >= entities.NAME_ACCEPT} and any(v < 1 for v in found.values())


def test_names_meet_securities_of_their_size(spark):
    """A name whose size no security comes near meets none, though it shares its rarest trigrams with all; and no pair's names are taken apart again."""
    names, listed = spark.createDataFrame([("abcdefghi bdfkl",)], "name string"), spark.createDataFrame([(i, "abcdefghi", None) for i in range(200)], "security_id long, name string, filed_name string")
    plans = [f(names, listed)._jdf.queryExecution().executedPlan().toString() for f in (entities.name_candidates,)]
    suggested = spark.createDataFrame([(1, None, "abcdefghi bdfkl", None), (2, "T", "abcdefghi", None)], "security_id long, ticker string, name string, filed_name string")
    plans.append(entities.fuzzy_matches(suggested)._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        line = next(x for x in plan.splitlines() if "Join" in x and "array_intersect" in x)
        assert "class#" in line and "bit_count" in line and "regexp" not in line
    assert entities.name_candidates(names, listed).count() == 0


def test_core_names_are_worked_out_once(spark, monkeypatch):
    plans, kept = [], entities.written

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(entities, "written", written)
    lines = spark.createDataFrame([(1, "ST", "Acme Widgets Inc", "ACME", dt.date(2024, 5, 1)), (2, "ST", "Acme Widgits", None, dt.date(2024, 5, 1))], "id long, asset_type string, asset_name string, ticker string, day date")
    securities = spark.createDataFrame([(7, "ACME", "123456789", "Acme Widgets Corp", "ACME WIDGETS", None)], "security_id long, ticker string, cusip string, name string, filed_name string, delisted_by date")
    aliases = spark.createDataFrame([(7, "ACME", None, None)], "security_id long, ticker string, valid_from date, valid_to date")
    held = spark.createDataFrame([(7, 2024, Decimal(100), dt.date(2024, 3, 31))], "security_id long, year int, value decimal(20,2), last_held date")
    ruled = spark.createDataFrame([], "key string, security_id long, asset_class string")
    got = entities.resolve_assets(lines, ruled, securities, aliases, held)
    assert {(r.id, r.security_id, r.method, r.confidence) for r in got.collect()} == {(1, 7, "ticker", 1.0), (2, None, None, None)}
    share_words = "REPRESENTING"  # of the expression that only core names use
    assert {name for name, plan in plans if share_words in plan} == {"securities", "looked"} and share_words not in got._jdf.queryExecution().optimizedPlan().toString()


def test_alike_finds_what_all_pairs_have(spark):
    """Sets of several sizes, some with more trigrams than bits, and with trigrams that no known set has."""
    rng = random.Random(9)
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    base = [" ".join(word("abcdefgh", rng.choice((3, 4, 9))) for _ in range(rng.choice((1, 2, 3, 70)))) for _ in range(60)]
    near = lambda t: "".join(c if rng.random() > 0.1 else rng.choice("abxy ") for c in t)
    left, right = {i: near(rng.choice(base)) for i in range(80)}, dict(enumerate(base))
    split = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    frame = lambda d, key: spark.createDataFrame([(k, k % 2 if key == "a" else 0, v) for k, v in d.items()], f"{key} int, part int, form string").withColumn("grams", text.trigrams(F.col("form"))).where("size(grams) > 0")
    ranked = alike.ranks(frame(right, "b"))
    a, b = alike.coded(frame(left, "a"), ["a", "part"], ranked, "a_"), alike.coded(frame(right, "b"), ["b", "part"], ranked, "b_")
    for degree in (0.3, 0.75, 1.0):
        every = {(i, j): len(split(x) & split(y)) / len(split(x) | split(y)) for i, x in left.items() for j, y in right.items() if split(x) or split(y)}
        assert {(r.a, r.b): r.likeness for r in alike.alike(a.drop("part"), b.drop("part"), degree).collect()} == {k: v for k, v in every.items() if v >= degree}
        assert {(r.a, r.b) for r in alike.alike(a, b, degree, ("part",)).collect()} == {k for k, v in every.items() if v >= degree and k[0] % 2 == 0}


def test_members_are_told_apart_by_bits_in_a_compiled_join(spark, monkeypatch):
    plans, kept = [], members.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(members, "written", written)
    matched(spark)
    compared = [line for plan in plans for line in plan.splitlines() if "Join" in line and "array_intersect(a_ids" in line or "Join" in line and "array_intersect(a#" in line]
    assert len(compared) == len(members.STEPS)
    for line in compared:
        assert line.index("bit_count") < line.index("array_intersect") and "lambda" not in line and "class#" in line


def test_a_search_reads_postings_of_its_trigrams_and_finds_the_same(spark, tmp_path):
    rng = random.Random(2)
    names = [(i, f"T{i}" if i % 3 else f"T.{i}", " ".join(rng.choices(["apple", "apples", "maple", "grape", "berry inc", "snapple", "x"], k=2)), i % 5) for i in range(200)]
    rows = spark.createDataFrame(names, "id long, ticker string, name string, held long")
    search.name_postings(rows, "id", "name", "ticker").repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(str(tmp_path / "grams"))
    postings = spark.read.parquet(str(tmp_path / "grams"))
    for query in ("apple", "appel", "a", "t12", "T.1", "berry in", "zzz", "!"):
        assert search.search_stocks(rows, query, 50, postings).collect() == search.search_stocks(rows, query, 50).collect()
    plan = search.candidates(postings, "id", "apple")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


@pytest.mark.parametrize(
    ("first", "last", "key"),
    [
        ("Thomas H.", "Kean", "thomas h kean"), ("Neal Patrick MD, Facs", "Dunn", "neal patrick dunn"), ("Richard Dean Dr", "McCormick", "richard dean mccormick"), ('Charles J. "Chuck"', "Fleischmann", "charles j chuck fleischmann"),
        ("Linda T.", "Sánchez", "linda t sanchez"), ("Beto", "O'Rourke", "beto orourke"), ("Mitch", "McConnell, Jr.", "mitch mcconnell"), (None, "Boozman", "boozman"), ("Hon. Thomas H", "Kean Jr", "thomas h kean"),
    ],
)
def test_a_name_folds_to_its_key(spark, first, last, key):
    assert spark.createDataFrame([(first, last)], "a string, b string").select(text.name_key(F.col("a"), F.col("b"))).first()[0] == key


MEMBERS = [
    (1, "Thomas", "Kean", "H.", None, "Thomas H. Kean, Jr."), (2, "William", "Keating", "R.", "Bill", "William R. Keating"), (3, "Charles", "Fleischmann", "J.", "Chuck", 'Charles J. "Chuck" Fleischmann'), (4, "John", "Smith", None, None, None),
    (5, "John", "Smith", None, None, None), (6, "Linda", "Sánchez", "T.", None, "Linda T. Sánchez"), (7, "Mary", "Mack", None, None, None),
]
CASES = [  # filed, state, candidates: member, method, confidence, accepted
    ("Thomas H.", "Kean", "NJ", [(1, "exact", 1.0, True)]), ("Hon. Thomas H", "Kean Jr", "NJ", [(1, "normalised", 0.95, True)]), ('William "Bill"', "Keating", "MA", [(2, "normalised", 0.95, True)]), ("Bill", "Keating", "MA", [(2, "exact", 1.0, True)]),
    ("Chuck Dr", "Fleischmann", "TN", [(3, "normalised", 0.95, True)]), ('Charles J. "Chuck"', "Fleischmann", "TN", [(3, "exact", 1.0, True)]), ("Linda T.", "Sanchez", "CA", [(6, "normalised", 0.95, True)]),
    ("John", "Smith", "OH", [(4, "exact", 0.5, False), (5, "exact", 0.5, False)]), ("Mary", "Bono", "FL", [(7, "exact", 1.0, True)]), ("Thomas", "Kean", "CA", [(1, "exact", 0.6, False)]), ("Lynda", "Sanchex", "CA", [(6, "trigram", None, False)]), ("Q", "Zzyzx", "CA", []),
]


def matched(spark, refused=None):
    day = dt.date
    known = spark.createDataFrame([(*m, ["Bono"] if m[0] == 7 else None) for m in MEMBERS], "member_id int, first_name string, last_name string, middle_name string, nickname string, full_name string, other_last_names array<string>")
    states = dict(zip(range(1, 8), ("NJ", "MA", "TN", "OH", "OH", "CA", "FL"), strict=True))
    terms = spark.createDataFrame([(i, "house", s, day(2021, 1, 3), day(2025, 1, 3)) for i, s in states.items()], "member_id int, chamber string, state string, start_date date, end_date date")
    filed = spark.createDataFrame([(n, a, b, "house", s, day(2024, 2, 1), day(2024, 3, 1)) for n, (a, b, s, _) in enumerate(CASES)], "name_id int, first_name string, last_name string, chamber string, state string, first_filed date, last_filed date")
    return members.match_members(filed, known, terms, refused)


def test_members(spark):
    got = {}
    for r in matched(spark).collect():
        got.setdefault(r.name_id, []).append((r.member_id, r.method, r.confidence, r.accepted))
    for n, (first, last, _, wanted) in enumerate(CASES):
        found = sorted((m, how, None if how == "trigram" else c, ok) for m, how, c, ok in got.get(n, []))
        assert found == sorted(wanted), (first, last)


def test_a_refused_member_is_never_suggested(spark):
    got = matched(spark, spark.createDataFrame([(0, 1), (7, 4)], "name_id int, member_id int"))
    assert {(r.name_id, r.member_id) for r in got.collect()}.isdisjoint({(0, 1), (7, 4)})
    assert [(r.member_id, r.confidence, r.accepted) for r in got.where("name_id = 7").collect()] == [(5, 1.0, True)]


@pytest.mark.parametrize(
    ("note", "wanted"),
    [
        ("Under plan no. 3, a Rule 10b5-1 trading plan.", True), ("Sold outside of the 10b5-1 plan.", False), ("The plan no longer applies: 10b5-1.", False), ("Neither a gift; a 10b-5-1 plan.", True), ("Rule 10b-5 only.", False),
        ("Not a gift. Made by a 10b5‑1 plan.", True), ("Rule 10b5-12.", False), ("", False),
    ],
)
def test_plans(spark, note, wanted):
    assert spark.createDataFrame([(note,)], "n string").select(text.planned(F.col("n"))).first()[0] is wanted


def test_prices_and_checkboxes(spark):
    rows = [
        (1, True, ["A 10b5-1 plan."], "41.10-41.50", ""), (1, True, [], "0", "from $53.66 to $54.58"), (2, True, ["Gift."], "1,234.5", "NT$31.795 to US$1, between $9 and $3, $26.25 – $26.80"), (2, True, None, None, None), (3, False, [], "x", "none"),
    ]
    df = spark.createDataFrame(rows, "form int, checkbox boolean, footnotes array<string>, price string, cited string")
    got = [tuple(r) for r in filings.priced(filings.plan_trades(df, "form")).select("form", "is_10b5_1", "price", "price_low", "price_high").collect()]
    d = Decimal
    assert sorted(got, key=str) == sorted([(1, True, None, d("41.1"), d("41.5")), (1, False, None, d("53.66"), d("54.58")), (2, True, d("1234.5"), d("26.25"), d("26.8")), (2, True, None, None, None), (3, False, None, None, None)], key=str)


def test_likeness_is_that_of_matching_blocks(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc de", k=rng.randint(0, 25))), "".join(rng.choices("abc de", k=rng.randint(0, 25)))) for _ in range(80)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", service.matching_blocks("a", "b").alias("r"))
    for a, b, r in rows.collect():
        assert r == pytest.approx(SequenceMatcher(None, a, b).ratio())
    names = [("BRIDGEWATER ASSOCIATES, L.P.", "Bridgewater Associates LP", 1.0), ("Acme Holdings PLC", "Acme Holding Co.", None)]
    for edgar, ours, wanted in names:
        got = spark.createDataFrame([(edgar, ours)], "a string, b string").select(service.comparable_name(F.col("a")), service.comparable_name(F.col("b"))).first()
        assert SequenceMatcher(None, *got).ratio() == (wanted or pytest.approx(SequenceMatcher(None, "acme holdings", "acme holding").ratio()))


@pytest.mark.parametrize(
    ("code", "name", "ticker", "description", "wanted"),
    [
        ("OT", "Thing", None, "a call option", ("other", "other", False)), ("OT", "Bitcoin", None, None, ("crypto", "crypto", False)), ("OT", "New", "NEWT", None, ("equity", "other", True)), (None, "Thing", None, "a call option", ("stock_option", "stock_option", True)),
        ("OT", "Apple Inc", None, None, ("other", "other", False)), ("ET", "Some fund", "SPY", None, ("equity", "other", True)), ("", "iShares", None, None, ("equity", "unknown", True)), ("zz", "x", None, None, ("other", "other", False)), ("ST", "V", "VFIAX", None, ("mutual_fund", "mutual_fund", False)),
    ],
)
def test_kinds_of_assets(spark, code, name, ticker, description, wanted):
    row = spark.createDataFrame([(code, name, ticker, description)], "a string, b string, c string, d string")
    got = row.select(assets.classify(*(F.col(c) for c in "abcd")).alias("k")).select("k.*").first()
    assert (got.asset_class, got.otherwise, got.lookup) == wanted
