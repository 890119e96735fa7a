"""Queries of documents' readers and guards: documents are made from the driver's tables as text, and read back to what they were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import quality
from ..sources import filings, partitions, sinks, tables
from ..sources.store import shared_folder
from .catalog import add
from .derived import Derived

# ---------------------------------------------------------------- information tables and cover pages

_TAGS = "<ns1:infoTable><ns1:nameOfIssuer>Brand %s</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>%s</ns1:cusip><ns1:value>%s</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>%s</ns1:sshPrnamt><ns1:sshPrnamtType>%s</ns1:sshPrnamtType></ns1:shrsOrPrnAmt>%s<ns1:investmentDiscretion>SOLE</ns1:investmentDiscretion><ns1:votingAuthority><ns1:Sole>%s</ns1:Sole><ns1:Shared>0</ns1:Shared><ns1:None>0</ns1:None></ns1:votingAuthority></ns1:infoTable>"


def _tables(t: Derived) -> DataFrame:
    """A document for each filing, its holdings as entries; every 97th has no CUSIP that can be read."""
    rows = t.holding.withColumn("n", F.format_number("shares", 0))
    cusip = F.when(F.pmod(F.col("shares").cast("long") + F.col("security_id"), F.lit(29)) == 0, "not a CUSIP!").otherwise(F.col("security_id").cast("string"))
    option = F.coalesce(F.concat(F.lit("<ns1:putCall>"), F.upper("put_call"), F.lit("</ns1:putCall>")), F.lit(""))
    entry = F.format_string(_TAGS, F.col("security_id").cast("string"), cusip, F.col("value_usd").cast("string"), F.col("n"), F.col("sshprnamt_type"), option, F.col("n"))
    body = rows.select("filing_id", entry.alias("e")).groupBy("filing_id").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("b"))
    return body.select("filing_id", F.concat(F.lit('<ns1:informationTable xmlns:ns1="http://example.org/table">'), "b", F.lit("</ns1:informationTable>")).alias("xml"))


_ENTRY = "filing_id:l cusip:s issuer:s value:f shares:f sshprnamt_type:s put_call:s voting_sole:f problem:s"
_BAD = "(shares::BIGINT + security_id) % 29 = 0"
add(
    "src02_information_tables", _ENTRY,
    f"""SELECT filing_id, CASE WHEN NOT {_BAD} THEN lpad(security_id::VARCHAR, 9, '0') END AS cusip, 'Brand ' || security_id AS issuer, value_usd AS value, shares, sshprnamt_type, put_call, shares AS voting_sole,
      CASE WHEN {_BAD} THEN 'cusip' END AS problem FROM holding""",
)(lambda t: filings.information_tables(_tables(t)))
add(
    "snk03_collapsed_entries", "filing_id:l cusip:s put_call:s sshprnamt_type:s value:f shares:f issuer:s",
    f"SELECT filing_id, lpad(security_id::VARCHAR, 9, '0') AS cusip, put_call, sshprnamt_type, sum(value_usd) AS value, sum(shares) AS shares, 'Brand ' || security_id AS issuer FROM holding WHERE NOT {_BAD} GROUP BY filing_id, security_id, put_call, sshprnamt_type",
)(lambda t: filings.collapsed(filings.information_tables(_tables(t))))


def _covers(t: Derived) -> DataFrame:
    rows = t.domain.amendment()
    day = F.when(F.pmod("filing_id", F.lit(2)) == 0, F.date_format("period", "MM-dd-yyyy")).otherwise(F.col("period").cast("string"))
    kind = F.coalesce(F.concat(F.lit("<amendmentType>"), F.upper(F.replace("amendment_kind", F.lit("_"), F.lit(" "))), F.lit("</amendmentType>")), F.lit(""))
    part = '<edgarSubmission xmlns="http://example.org/cover"><cik>%s</cik><reportCalendarOrQuarter>%s</reportCalendarOrQuarter><filingManager><name>Nation %s</name></filingManager><amendmentNo>%s</amendmentNo>%s<tableEntryTotal>%s</tableEntryTotal><tableValueTotal>1,000</tableValueTotal><isConfidentialOmitted>%s</isConfidentialOmitted></edgarSubmission>'
    number = F.pmod("filing_id", F.lit(9)).cast("string")
    return rows.select("filing_id", F.format_string(part, F.col("cik"), day, F.col("filer_id").cast("string"), number, kind, number, F.when(F.pmod("filing_id", F.lit(5)) == 0, "true").otherwise("false")).alias("xml"))


add(
    "src01_cover_pages", "filing_id:l period:d manager:s cik:s amendment_no:l amendment_kind:s entries:l total:f confidential_omitted:b",
    "SELECT filing_id, period, 'Nation ' || filer_id AS manager, lpad(cik, 10, '0') AS cik, filing_id % 9 AS amendment_no, amendment_kind, filing_id % 9 AS entries, 1000 AS total, filing_id % 5 = 0 AS confidential_omitted FROM amendment",
)(lambda t: filings.cover_pages(_covers(t)))


def _forms(t: Derived) -> DataFrame:
    """An insider report for each event, with a line and a derivative one, and a second owner for every third."""
    owner = "<reportingOwner><reportingOwnerId><rptOwnerCik>%s</rptOwnerCik><rptOwnerName>Owner %s</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>%s</isDirector><isOfficer>%s</isOfficer></reportingOwnerRelationship></reportingOwner>"
    line = "<%s><securityTitle><value>Common</value></securityTitle><transactionDate><value>%s</value></transactionDate><transactionCoding><transactionCode>%s</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>%s</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts></%s>"
    ident, day, code = F.col("insider_id").cast("string"), F.col("transaction_date").cast("string"), F.col("transaction_code")
    price = F.when(F.pmod("id", F.lit(4)) == 0, "0").otherwise("12.50")
    both = F.concat(
        F.format_string(owner, ident, ident, F.col("is_director").cast("string"), F.when(F.col("is_officer"), "1").otherwise("0")),
        F.when(F.pmod("id", F.lit(3)) == 0, F.format_string(owner, F.concat(F.lit("9"), ident), F.concat(F.lit("9"), ident), F.lit("0"), F.lit("true"))).otherwise(""),
    )
    lines = F.concat(F.format_string(line, F.lit("derivativeTransaction"), day, F.lit("M"), price, F.lit("derivativeTransaction")), F.format_string(line, F.lit("nonDerivativeTransaction"), day, code, price, F.lit("nonDerivativeTransaction")))
    issuer = F.format_string("<issuer><issuerCik>%s</issuerCik><issuerName>Issuer</issuerName><issuerTradingSymbol>b/%s</issuerTradingSymbol></issuer>", F.col("issuer_cik"), F.col("issuer_cik"))
    return t.lines.select("id", F.concat(F.lit("<ownershipDocument>"), issuer, both, lines, F.lit("</ownershipDocument>")).alias("xml"))


add(
    "src03_insider_lines", "id:l issuer_cik:s ticker:s owner_cik:s line_number:l is_derivative:b transaction_date:d transaction_code:s shares:f price_per_share:f acquired:b",
    """SELECT id, lpad(issuer_cik, 10, '0') AS issuer_cik, 'B.' || issuer_cik AS ticker, lpad(insider_id::VARCHAR, 10, '0') AS owner_cik, n AS line_number, n = 2 AS is_derivative, transaction_date, CASE WHEN n = 2 THEN 'M' ELSE transaction_code END AS transaction_code,
      100 AS shares, CASE WHEN id % 4 <> 0 THEN 12.5 END AS price_per_share, true AS acquired FROM insider_line, range(1, 3) r(n)""",
)(lambda t: filings.whole_forms(filings.insider_forms(_forms(t)), "id"))
add(
    "src03_reporting_owners", "id:l owner_cik:s owner_name:s is_director:b is_officer:b",
    """SELECT id, lpad(insider_id::VARCHAR, 10, '0') AS owner_cik, 'Owner ' || insider_id AS owner_name, is_director, is_officer FROM insider_line
      UNION ALL SELECT id, lpad('9' || insider_id, 10, '0'), 'Owner 9' || insider_id, false, true FROM insider_line WHERE id % 3 = 0""",
)(lambda t: filings.reporting_owners(_forms(t)))


def _index(t: Derived) -> DataFrame:
    part = "<Member><Prefix>Hon.</Prefix><Last>%s</Last><First>F</First><Suffix /><FilingType>P</FilingType><StateDst>NY%s</StateDst><Year>%s</Year><FilingDate>%s</FilingDate>%s</Member>"
    rows = t.domain.table("orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    doc = F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("<DocID>"), F.col("k").cast("string"), F.lit("</DocID>")))
    entry = F.format_string(part, F.concat(F.lit("L"), (F.col("k") % 7).cast("string")), F.lpad((F.col("k") % 20).cast("string"), 2, "0"), F.col("y").cast("string"), F.date_format("d", "M/d/yyyy"), doc)
    return rows.select(F.pmod("k", F.lit(500)).alias("part"), entry.alias("e")).groupBy("part").agg(F.concat(F.lit("<FinancialDisclosure>"), F.array_join(F.collect_list("e"), ""), F.lit("</FinancialDisclosure>")).alias("xml"))


add(
    "src09_yearly_index", "last_name:s state:s district:l year:l filed_on:d doc_id:s problem:s",
    """SELECT 'L' || (o_orderkey % 7) AS last_name, 'NY' AS state, o_orderkey % 20 AS district, year(o_orderdate) AS year, o_orderdate::DATE AS filed_on, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey::VARCHAR END AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'doc_id' END AS problem FROM orders""",
)(lambda t: filings.yearly_index(_index(t)))

# ---------------------------------------------------------------- guards of rows as filed

_FILED = """SELECT l_orderkey AS filing_id, CASE WHEN l_partkey % 31 = 0 THEN concat('BAD-', l_partkey) ELSE lpad(CAST(l_partkey AS STRING), 9, '0') END AS cusip, CASE WHEN l_suppkey % 41 = 0 THEN -CAST(l_quantity AS DECIMAL(20,4)) ELSE CAST(l_quantity AS DECIMAL(20,4)) END AS shares,
  CAST(l_extendedprice AS DECIMAL(20,2)) * CASE WHEN l_partkey % 37 = 0 THEN 1000 ELSE 1 END AS value_usd, CASE WHEN l_linenumber = 7 THEN 'PRN' ELSE 'SH' END AS sshprnamt_type FROM lineitem"""


def _filed(t: Derived) -> DataFrame:
    return t.spark.sql(_FILED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.domain.table("lineitem"))


_FILED_SQL = {"filed": _FILED.replace("AS STRING", "AS VARCHAR")}
_PROBLEMS = """SELECT filing_id, 'price' AS problem FROM filed WHERE sshprnamt_type = 'SH' AND value_usd <> 0 AND shares <> 0 AND NOT (value_usd::DOUBLE / shares::DOUBLE BETWEEN 0.01 AND 100000)
  UNION ALL SELECT filing_id, 'negative' FROM filed WHERE shares < 0 OR value_usd < 0 UNION ALL SELECT filing_id, 'cusip' FROM filed WHERE NOT regexp_full_match(cusip, '[A-Za-z0-9]{9}')"""
for _q, _problem in (("q02_implied_price_guard", "price"), ("q05_negative_guard", "negative"), ("q06_cusip_guard", "cusip")):
    add(_q, "filing_id:l problems:l", f"SELECT filing_id, count(*) AS problems FROM ({_PROBLEMS}) WHERE problem = '{_problem}' GROUP BY 1", **_FILED_SQL)(
        lambda t, p=_problem: quality.row_problems(_filed(t)).where(F.col("problem") == p).select("filing_id", "problems").distinct()
    )
add("q06_told_problems", "filing_id:l told:l problems:l", f"SELECT filing_id, least(count(*), 25) AS told, count(*) AS problems FROM (SELECT filing_id % 40 AS filing_id, problem FROM ({_PROBLEMS})) WHERE problem = 'cusip' GROUP BY 1", **_FILED_SQL)(
    lambda t: quality.row_problems(_filed(t).withColumn("filing_id", F.pmod("filing_id", F.lit(40)))).where(f"problem = 'cusip' and place <= {quality.NOTES}").groupBy("filing_id").agg(F.count("*").alias("told"), F.max("problems").alias("problems"))
)
add("q01_units", "filing_id:l multiplier:l", "SELECT filing_id, CASE WHEN filed_at + INTERVAL 9000 DAY >= TIMESTAMP '2023-01-03 05:00:00' THEN 1 ELSE 1000 END AS multiplier FROM amendment")(
    lambda t: t.domain.amendment().select("filing_id", quality.units_multiplier(F.timestamp_seconds(F.unix_timestamp("filed_at") + 9000 * 86400)).alias("multiplier"))
)


def _cover(t: Derived) -> DataFrame:
    n = F.count("*") + F.when(F.col("filing_id") % 5 == 0, 1).otherwise(0)
    total = F.sum("value_usd") * F.when(F.col("filing_id") % 7 == 0, F.lit("1.02").cast("decimal(4,2)")).otherwise(F.lit("1.01").cast("decimal(4,2)"))
    return _filed(t).groupBy("filing_id").agg(n.alias("entries"), total.alias("total"))


for _q, _problem, _test in (("q03_entry_count", "entry-count", "filing_id % 5 = 0"), ("q04_value_total", "value-total", "abs(v - t) * 100 > abs(t)")):
    add(_q, "filing_id:l", f"SELECT filing_id FROM (SELECT filing_id, sum(value_usd) AS v, sum(value_usd) * CASE WHEN filing_id % 7 = 0 THEN 1.02 ELSE 1.01 END AS t FROM filed GROUP BY filing_id) WHERE {_test}", **_FILED_SQL)(
        lambda t, p=_problem: quality.cover_problems(_filed(t), _cover(t)).where(F.col("problem") == p)
    )


def _split_changes(t: Derived) -> DataFrame:
    """Changes with a split by rule, adjusted rightly but for one security."""
    split = F.col("action").isin("add", "trim", "hold") & (F.pmod("security_id", F.lit(5)) == 0)
    two = lambda x: F.when(split, x).cast("long")
    delta = F.when(split, F.col("shares") - F.col("prev_shares") * 2).otherwise(F.col("shares") - F.coalesce("prev_shares", F.lit(0))) + F.when(F.col("security_id") == 10, 1).otherwise(0)
    return t.change.withColumns({"numerator": two(2), "denominator": two(1), "is_split": F.coalesce(split, F.lit(False)), "shares_delta": delta})


add("q23_changes_adjust_for_splits", "filer_id:l period:d security_id:l problem:s", "SELECT filer_id, period, security_id, 'split' AS problem FROM change WHERE action NOT IN ('new', 'exit') AND security_id = 10")(lambda t: quality.changes_adjust_for_splits(_split_changes(t)))
add(
    "q24_split_changes_are_plausible", "filer_id:l period:d security_id:l problem:s",
    """SELECT filer_id, period, security_id, 'implausible split' AS problem FROM (SELECT *, shares::DOUBLE / prev_shares::DOUBLE AS r FROM change WHERE action IN ('add', 'trim', 'hold') AND security_id % 5 = 0 AND shares > 0 AND prev_shares > 0)
      WHERE greatest(r / 2, 2 / r) > greatest(r, 1 / r)""",
)(lambda t: quality.split_changes_are_plausible(_split_changes(t)))

# ---------------------------------------------------------------- text and dates


def _sql(t: Derived, table: str, query: str) -> DataFrame:
    return t.spark.sql(query.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: t.domain.table(table)})


#: Prices of orders as disclosed amounts: the band that each lies in, in words; those beyond are told as they are.
_AMOUNT = "o_totalprice * CASE o_orderkey % 7 WHEN 0 THEN 900 WHEN 1 THEN 60 WHEN 2 THEN 0.01 ELSE 1 END"
_BANDED = "CASE " + " ".join(f"WHEN amount >= {low} AND amount < {high + 1} THEN {{{i}}}" for i, (low, high) in enumerate(text.BANDS)) + " {9} END"
_IN_WORDS = _BANDED.format(*(f"'${low:,} - ${high:,}'" for low, high in text.BANDS), "WHEN amount > 50000000 THEN 'Over $50,000,000' WHEN amount < 1001 THEN concat('$', CAST(CAST(amount AS DECIMAL(20,2)) AS STRING)) ELSE 'none'")
add(
    "txt11_amount_bands", "id:l low:f high:f",
    f"""SELECT o_orderkey AS id, {_BANDED.format(*(low for low, _ in text.BANDS), "WHEN amount > 50000000 THEN 50000000 WHEN amount < 1001 THEN amount::DECIMAL(20,2)")} AS low,
      {_BANDED.format(*(high for _, high in text.BANDS), "WHEN amount < 1001 THEN amount::DECIMAL(20,2)")} AS high FROM (SELECT o_orderkey, {_AMOUNT} AS amount FROM orders)""",
)(lambda t: _sql(t, "orders", f"SELECT o_orderkey AS id, {_IN_WORDS} AS given FROM (SELECT o_orderkey, {_AMOUNT} AS amount FROM orders) x").select("id", *(c.alias(n) for c, n in zip(text.amount_band(F.col("given")), ("low", "high"), strict=True))))
add("txt12_quantities", "id:l number:f", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice::DECIMAL(20,4), 2) END AS number FROM orders")(
    lambda t: t.domain.table("orders").select(F.col("o_orderkey").alias("id"), text.quantity(F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.format_number(F.col("o_totalprice").cast("decimal(20,4)"), 2)))).alias("number"))
)
_CUSIP = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN concat('a', p_partkey, ' b') WHEN 2 THEN concat(' 12 ', p_partkey) ELSE concat('too long ', p_partkey, 'xxx') END"
add(
    "txt12_cusips", "id:l cusip:s",
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN lpad(p_partkey::VARCHAR, 9, '0') WHEN 1 THEN lpad('A' || p_partkey || 'B', 9, '0') WHEN 2 THEN lpad('12' || p_partkey, 9, '0') END AS cusip FROM part",
)(lambda t: _sql(t, "part", f"SELECT p_partkey AS id, {_CUSIP} AS given FROM part").select("id", text.normal_cusip(F.col("given")).alias("cusip")))

#: Footnotes of insider lines, whether each speaks of a plan, and the first range of prices in it, from the line's value v.
_NOTES = [
    ("'Sold under a Rule 10b5-1 plan.'", True, None), ("'These sales were not made pursuant to a Rule 10b5-1 plan.'", False, None), ("'The reporting person acted outside of the 10b5-1 plan; prices from $1.50 to $2.25.'", False, (1.5, 2.25)),
    ("'Under plan no. 3, a Rule 10b-5-1 trading plan.'", True, None), ("concat('Prices ranged from $', v, ' to $', v + 1, ', an average.')", False, ("v", "v + 1")), ("'No plan. NT$31.795 to US$1; $9.00 to $3.00.'", False, None),
    ("concat('The plan no longer applies, see Rule 10b5-1. Sold between $', v + 2, ' and $', v + 5, '.')", False, ("v + 2", "v + 5")), ("'Neither a gift nor a grant. A 10b5-1 plan.'", True, None), ("'Made under Rule 10b5-12.'", False, None),
]
_VALUE = "CAST(1 + floor(value) AS INT)"


def _noted(pick: str, what) -> str:
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {what(*n)}" for i, n in enumerate(_NOTES)) + " END"


def _lines(t: Derived) -> DataFrame:
    """Insider lines in forms of three with a footnote each; every fourth form has its checkbox set."""
    return _sql(
        t, "events",
        f"SELECT event_id AS id, CAST(floor(event_id / 3) AS BIGINT) AS form, floor(event_id / 3) % 4 = 0 AS checkbox, {_noted('event_id % 11', lambda n, *_: n)} AS note, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN concat(v, '.10-', v + 1, '.50') ELSE concat('1,0', 10 + v % 80, '.25') END AS price FROM (SELECT event_id, {_VALUE} AS v FROM events) x",
    )


_TOLD = f"SELECT event_id AS id, event_id // 3 AS form, coalesce({_noted('event_id % 11', lambda n, p, r: str(p).lower())}, false) AS told FROM events"
add(
    "txt13_plan_trades", "id:l planned:b", "SELECT id, told OR ((form % 4 = 0) AND NOT bool_or(told) OVER (PARTITION BY form)) AS planned FROM told", told=_TOLD,
)(lambda t: filings.plan_trades(_lines(t).withColumn("notes", F.array_compact(F.array("note"))), "form", texts="notes").select("id", F.col("is_10b5_1").alias("planned")))
_RANGED = lambda side: _noted("event_id % 11", lambda n, p, r: f"({r[side]})::DOUBLE" if r else "NULL")
add(
    "txt13_price_ranges", "id:l price:f price_low:f price_high:f",
    f"""SELECT event_id AS id, CASE WHEN event_id % 5 > 1 THEN 1000 + 10 + v % 80 + 0.25 END AS price, CASE WHEN event_id % 5 = 1 THEN v + 0.10 ELSE {_RANGED(0)} END AS price_low, CASE WHEN event_id % 5 = 1 THEN v + 1.50 ELSE {_RANGED(1)} END AS price_high
      FROM (SELECT event_id, {_VALUE} AS v FROM events)""",
)(lambda t: filings.priced(_lines(t), cited="note"))
add(
    "txt04_folded_texts", "doc_id:l words:l folded:s",
    "SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS folded FROM (SELECT doc_id, list_filter(string_split_regex(replace(strip_accents(replace(lower(text), 'ß', 'ss')), chr(39), ''), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)",
)(lambda t: t.domain.table("documents").where("text is not null").select("doc_id", text.folded_words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("folded")))
add(
    "txt03_periods", "day:d quarter:d label:s parsed:d before:d after:d due:d filing:b number:l",
    """SELECT DISTINCT o_orderdate::DATE AS day, q AS quarter, year(q) || 'Q' || quarter(q) AS label, q AS parsed, last_day(date_trunc('month', q) - INTERVAL 3 MONTH) AS before, last_day(date_trunc('month', q) + INTERVAL 3 MONTH) AS after, q + 45 AS due,
      month(o_orderdate) IN (2, 5, 8, 11) AND day(o_orderdate) <= 20 AS filing, year(q) * 4 + quarter(q) - 1 AS number FROM (SELECT o_orderdate, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS q FROM orders)""",
)(
    lambda t: t.domain.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("quarter", periods.quarter_end(F.col("day"))).withColumn("label", periods.quarter_label(F.col("quarter"))).select(
        "day", "quarter", "label", periods.parse_quarter(F.col("label")).alias("parsed"), periods.previous_quarter(F.col("quarter")).alias("before"), periods.next_quarter(F.col("quarter")).alias("after"),
        periods.deadline(F.col("quarter")).alias("due"), periods.in_filing_window(F.col("day")).alias("filing"), periods.quarter_index(F.col("quarter")).alias("number"),
    )
)
add("snk08_csv_lines", "line:s", """SELECT CASE WHEN s_suppkey % 3 = 0 THEN '''=' || s_suppkey ELSE '"a ""' || s_suppkey || '"", b"' END || ',' || s_acctbal::DECIMAL(12,2) || ',' || (s_suppkey % 2 = 0) AS line FROM supplier""")(
    lambda t: sinks.csv_lines(t.domain.table("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("="), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit('a "'), F.col("s_suppkey").cast("string"), F.lit('", b'))).alias("a"), F.col("s_acctbal").cast("decimal(12,2)").alias("c"), (F.col("s_suppkey") % 2 == 0).alias("b")))
)


def _reload(t: Derived) -> DataFrame:
    filing = t.filing.select("accession_no", "filing_id")
    again = filing.where("filing_id % 3 = 0").withColumn("filing_id", F.col("filing_id") + 1_000_000_000)
    return filings.loaded_once(filing, t.holding.join(filing, "filing_id").select("accession_no", "shares"), again, again.select("accession_no", F.lit(1).cast("decimal(20,4)").alias("shares")))[1]


add("snk02_loaded_once", "accession_no:s lines:l shares:f", "SELECT lpad(filing_id::VARCHAR, 20, '0') AS accession_no, CASE WHEN filing_id % 3 = 0 THEN 1 ELSE count(*) END AS lines, CASE WHEN filing_id % 3 = 0 THEN 1 ELSE sum(shares) END AS shares FROM holding GROUP BY filing_id")(
    lambda t: _reload(t).groupBy("accession_no").agg(F.count("*").alias("lines"), F.sum("shares").alias("shares"))
)
_CURATED = [{"slug": "supplier-000000003", "name": "Three", "category": "value", "ciks": ["12", "34"]}, {"slug": "new-one", "name": "New", "ciks": ["56"]}]
add(
    "src14_curated_list", "slug:s name:s category:s cik:s priority:l",
    "SELECT slug, name, category, lpad(filer_id::VARCHAR, 10, '0') AS cik, 0 AS priority FROM filer WHERE slug <> 'supplier-000000003' UNION ALL SELECT * FROM (VALUES ('supplier-000000003', 'Three', 'value', '0000000012', 0), ('supplier-000000003', 'Three', 'value', '0000000034', 1), ('new-one', 'New', NULL, '0000000056', 0)) v",
)(lambda t: filings.curated(t.spark, _CURATED, t.filer.select("slug", "name", "category", F.lpad(F.col("filer_id").cast("string"), 10, "0").alias("cik"), F.lit(0).alias("priority"))))

# ---------------------------------------------------------------- report tables and year partitions

_HEAD = "".join(f"<th>{c}</th>" for c in tables.COLUMNS)
#: Pages with a report's table put at their end; of every thirteenth a row is missing.
_ROWS = "page_id % 4 + 1"
_SHOWN = f"({_ROWS}) - CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END"


def _reports(t: Derived) -> DataFrame:
    row = "concat('<tr><td>', n, '</td><td>01/0', n, '/2024</td><td>Self</td><td>T', page_id % 50, '</td><td>', 'Asset &amp; ', page_id, '<div>Rate: ', n, '%</div></td><td>Stock</td><td>Purchase</td><td>$1,001 - $15,000</td><td>--</td></tr>')"
    return t.spark.sql(
        f"SELECT page_id, concat('<h1>Report ', page_id, '</h1><p>(', {_ROWS}, ' transactions total)</p><article>', regexp_replace(html, '(?i)</?h1[^>]*>|</?table[^>]*>|</?script[^>]*>', ' '), '</article><table><tr>{_HEAD}</tr>', array_join(transform(slice(sequence(1, 9), 1, CAST({_SHOWN} AS INT)), n -> {row}), ''), '</table>') AS html FROM {{pages}}",
        pages=t.domain.table("pages"),
    )


add(
    "src12_report_lines", "page_id:l problem:s line:l c2:s c4:s c5:s c8:s",
    f"""SELECT page_id, NULL AS problem, n AS line, '01/0' || n || '/2024' AS c2, 'T' || (page_id % 50) AS c4, 'Asset & ' || page_id || ' Rate: ' || n || '%' AS c5, '$1,001 - $15,000' AS c8 FROM pages, LATERAL (SELECT unnest(range(1, ({_ROWS} + 1)::BIGINT)) AS n) WHERE page_id % 13 <> 0 AND html IS NOT NULL
      UNION ALL SELECT page_id, ({_SHOWN}) || ' rows where the page counts ' || ({_ROWS}), NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 13 = 0 AND html IS NOT NULL""",
)(lambda t: tables.report_lines(_reports(t).where("html is not null"), "page_id"))


def _years(t: Derived) -> DataFrame:
    """Line items by the year that they were shipped in: two years are added after the first rows, more rows come then, and a year is read."""
    rows = t.domain.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("value"))
    kept = partitions.Years(t.spark, f"{shared_folder(t.spark)}/years-{uuid.uuid4().hex}", rows.schema, "day")
    kept.insert(rows.where("id % 3 <> 0"), ["id"])
    kept.add_year(1997)
    kept.add_year(1998)
    kept.insert(rows.where("id % 3 = 0"), ["id"])
    return kept.between("1997-06-01", "1998-05-31")


add(
    "snk10_year_partitions", "day:d lines:l value:f", "SELECT l_shipdate::DATE AS day, count(*) AS lines, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_shipdate BETWEEN DATE '1997-06-01' AND DATE '1998-05-31' GROUP BY 1",
)(lambda t: _years(t).groupBy("day").agg(F.count("*").alias("lines"), F.round(F.sum("value"), 2).alias("value")))
