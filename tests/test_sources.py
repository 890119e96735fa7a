import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import lookup, quality
from tidemark.sources import filings, sinks
from tidemark.streaming import batches

TABLE = """<?xml version="1.0"?><ns1:informationTable xmlns:ns1="http://example.org/t" xmlns:xsi="http://example.org/x">
<ns1:infoTable><ns1:nameOfIssuer>ACME CO</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>11111a101</ns1:cusip><ns1:value>1,000</ns1:value>
<ns1:shrsOrPrnAmt><ns1:sshPrnamt>10</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt><ns1:putCall>call</ns1:putCall><ns1:votingAuthority><ns1:Sole>1</ns1:Sole><ns1:Shared>2</ns1:Shared><ns1:None>3</ns1:None></ns1:votingAuthority></ns1:infoTable>
<ns1:infoTable><ns1:nameOfIssuer>BAD</ns1:nameOfIssuer><ns1:cusip>2</ns1:cusip><ns1:value>x</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>5</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt></ns1:infoTable>
</ns1:informationTable>"""
COVER = """<edgarSubmission xmlns="http://example.org/c"><cik>101</cik><reportCalendarOrQuarter>03-31-2024</reportCalendarOrQuarter><filingManager><name>Alpha &amp; Co</name></filingManager>
<amendmentNo>2</amendmentNo><amendmentType>NEW HOLDINGS</amendmentType><tableEntryTotal>2</tableEntryTotal><tableValueTotal>1,000</tableValueTotal></edgarSubmission>"""
FORM = """<ownershipDocument><issuer><issuerCik>55</issuerCik><issuerName>Acme</issuerName><issuerTradingSymbol>ac-b</issuerTradingSymbol></issuer><reportingOwner><rptOwnerCik>9</rptOwnerCik><isDirector>1</isDirector></reportingOwner>
<derivativeTable><derivativeTransaction><securityTitle><value>Option</value></securityTitle><transactionDate><value>2024-01-03</value></transactionDate><transactionCode>M</transactionCode><transactionShares><value>7</value></transactionShares></derivativeTransaction></derivativeTable>
<nonDerivativeTable><nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-02</value></transactionDate><transactionCode>P</transactionCode><transactionShares><value>100</value><footnoteId id="F1"/></transactionShares>
<transactionPricePerShare><value>0</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_information_table(spark):
    rows = filings.information_tables(spark.createDataFrame([(1, TABLE), (2, None), (3, "<x/>")], "filing_id long, xml string")).orderBy("place").collect()
    assert [(r.filing_id, r.cusip, r.value, r.shares, r.put_call, r.voting_none, r.problem) for r in rows] == [(1, "11111A101", 1000, 10, "Call", 3, None), (1, "000000002", None, 5, None, None, "value")]
    assert filings.collapsed(filings.information_tables(spark.createDataFrame([(1, TABLE), (1, TABLE)], "filing_id long, xml string"))).first().value == 2000


def test_cover_page(spark):
    r = filings.cover_pages(spark.createDataFrame([(1, COVER)], "filing_id long, xml string")).first()
    assert (r.period, r.manager, r.cik, r.amendment_no, r.amendment_kind, r.entries, r.total) == (dt.date(2024, 3, 31), "Alpha & Co", "0000000101", 2, "new_holdings", 2, 1000)


def test_insider_form(spark):
    rows = filings.insider_forms(spark.createDataFrame([(1, FORM)], "filing_id long, xml string")).orderBy("line_number").collect()
    assert [(r.line_number, r.is_derivative, r.transaction_code, r.shares, r.price_per_share, r.footnote_ids, r.ticker, r.is_director) for r in rows] == [(1, False, "P", 100, None, ["F1"], "AC.B", True), (2, True, "M", 7, None, [], "AC.B", True)]


def test_an_element_is_read_once_for_all_its_texts(spark):
    assert filings.texts_of("<x:a><b> 1 </b><c><b>2<i>3</i></b><d k='u'/><d k='v'/></c></x:a>", ("b", "c/b", "a/c", "d/@k", "z")) == ["1", "23", "23", "u v", None]
    forms = spark.createDataFrame([(1, FORM)], "filing_id long, xml string")
    for rows in (filings.insider_forms(forms), filings.reporting_owners(forms), filings.cover_pages(forms), filings.collapsed(filings.information_tables(forms))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "xpath" not in plan and "from_xml" not in plan and plan.count("ArrowEvalPython") == 1


def test_lists(spark, tmp_path):
    line = f"{'11111A101'}{'*'}{'ACME CO':<30}{'COM':<27}{'ADD'}"
    (tmp_path / "list.txt").write_text(line + "\n" + line + "\nshort\n")
    assert [tuple(r) for r in filings.official_list(spark, str(tmp_path / "list.txt")).collect()] == [("11111A101", True, "ACME CO", "COM", "add")]
    (tmp_path / "form.idx").write_text("Form Type   Company Name\n-----\n4           ACME CO   INC                55      20241002    edgar/data/55/x.txt\n")
    assert [tuple(r) for r in filings.daily_index(spark, str(tmp_path / "form.idx")).collect()] == [("4", "ACME CO   INC", "0000000055", dt.date(2024, 10, 2), "edgar/data/55/x.txt")]
    recent = {"accessionNumber": ["a", "b"], "form": ["4", "13F-HR"], "filingDate": ["2024-01-02", "2024-02-01"], "reportDate": ["", "2023-12-31"], "acceptanceDateTime": ["2024-01-02T10:00:00.000Z"] * 2, "primaryDocument": ["p", "q"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "55", "filings": {"recent": recent}}))
    assert [(r.accession_no, r.period) for r in filings.submissions(spark, str(tmp_path / "s.json")).orderBy("accession_no").collect()] == [("a", None), ("b", dt.date(2023, 12, 31))]
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 5, "ticker": "BRK-B", "title": "B"}}))
    assert [tuple(r) for r in filings.company_tickers(spark, str(tmp_path / "t.json")).collect()] == [("BRK.B", "0000000005", "B")]
    (tmp_path / "l.json").write_text(json.dumps([{"id": {"bioguide": "X1"}, "name": {"first": "A", "last": "B"}, "terms": [{"type": "sen", "start": "2001-01-03", "end": "2007-01-03", "state": "OH"}]}]))
    assert [(r.member, r.chamber, r.start) for r in filings.legislators(spark, str(tmp_path / "l.json")).collect()] == [("X1", "senate", dt.date(2001, 1, 3))]


def test_csv_cells_do_not_run(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", True, Decimal("-2.50"), [1])], "a string, b boolean, c decimal(10,2), d array<int>")
    sinks.write_csv(rows, str(tmp_path / "out"))
    body = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert body.endswith(b"\r\n") and b"'=1+1,true,-2.50,[1]" in body


def test_text(spark):
    row = spark.createDataFrame([("The Acme Holdings, Inc. Class A", "Buy (BRK/B) [x]", "$1,001 - $15,000", "Over $50,000,000", "Not under a 10b5-1 plan.", "Sold. Under a Rule 10b5-1 plan; fully.", "ÉCOLE", "12 3")], "a string, b string, c string, d string, e string, f string, g string, h string")
    low, high = text.amount_band(F.col("c"))
    over = text.amount_band(F.col("d"))
    got = row.select(text.core_name(F.col("a")), text.extract_ticker(F.col("b"))["ticker"], low, high, *over, text.planned(F.col("e")), text.planned(F.col("f")), text.fold(F.col("g")), text.normal_cusip(F.col("h")), text.similarity(F.lit("word"), F.lit("words"))).first()
    assert tuple(got) == ("acme hldg", "BRK.B", 1001, 15000, 50_000_000, None, False, True, "ecole", "000000123", 4 / 7)


def test_guards(spark):
    rows = spark.createDataFrame([(1, "11111A101", 10.0, 1.0, "SH"), (1, "bad", 1.0, 10**7 * 1.0, "SH"), (1, "11111A101", -1.0, 5.0, "PRN")] + [(2, "x", 1.0, 1.0, "SH")] * 30, "filing_id long, cusip string, shares double, value_usd double, sshprnamt_type string")
    found = quality.row_problems(rows)
    assert {(r.filing_id, r.problem, r.problems) for r in found.collect()} == {(1, "price", 1), (1, "cusip", 1), (1, "negative", 1), (2, "cusip", 30)}
    cover = spark.createDataFrame([(1, 3, 1.0), (2, 31, 30.0)], "filing_id long, entries long, total double")
    assert {(r.filing_id, r.problem) for r in quality.cover_problems(rows, cover).collect()} == {(1, "value-total"), (2, "entry-count")}


def test_lookup_prefers_the_alias_of_the_day(spark):
    d = dt.date
    aliases = spark.createDataFrame([("FB", 1, None, d(2022, 6, 9)), ("FB", 2, d(2023, 1, 1), None)], "ticker string, security_id long, valid_from date, valid_to date")
    securities = spark.createDataFrame([(1, "META", "30303M102", d(2024, 3, 31)), (2, "FB", "99999X999", None)], "security_id long, ticker string, cusip string, last_held date")
    symbols = spark.createDataFrame([("fb",), ("meta",), ("30303M102",), ("none",)], "symbol string")
    got = lambda day: {r.symbol: (r.security_id, r.via) for r in lookup.lookup(symbols, aliases, securities, securities, day).collect()}
    assert got("2020-01-01") == {"fb": (1, 0), "meta": (1, 1), "30303M102": (1, 3)}
    assert got("2024-01-01")["fb"] == (2, 0)
    assert lookup.collisions(aliases).count() == 0


def test_mail_batches(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 9, m)
    items = spark.createDataFrame([("u", at(m)) for m in (0, 15, 16, 20, 40)], "user string, at timestamp")
    assert [(r.sent_at.minute, r["items"]) for r in batches.mail_batches(items, "user", "at").orderBy("sent_at").collect()] == [(15, 2), (31, 2), (55, 1)]


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = batches.daily_counts(stream, "ts").writeStream.outputMode("append").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.day, r.event_type): r.events for r in spark.table("daily").collect()}
    whole = {(r.day, r.event_type): r.events for r in batches.daily_counts(events, "ts").collect()}
    assert got and all(whole[k] == n for k, n in got.items())
    told = []
    pairs = stream.select("user_id", "ts").withColumnRenamed("user_id", "filer_id").withColumn("period", F.to_date("ts"))
    batches.on_arrival(pairs, lambda df, n: told.append(df.count()), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sum(told) == events.select("user_id", F.to_date("ts")).distinct().count()
