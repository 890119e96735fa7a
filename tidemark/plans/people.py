"""Queries of entities, amendment chains and alerts over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assets import classify
from ..operators import alerts, chains, congress, entities, lookup
from .capitol import SQL as CAPITOL
from .capitol import _table as congress_table
from .capitol import _trade
from .catalog import PERIOD, add
from .derived import Derived
from .splits import LIKE_SQL

# ---------------------------------------------------------------- text that both engines read

#: Owners of orders as Forms 4: one or two each.
_OWNER = """SELECT o_orderkey AS filing_id, o_custkey % 3 AS insider_id FROM orders UNION SELECT o_orderkey, (o_custkey + 1) % 3 FROM orders WHERE o_orderkey % 4 = 0"""


def _orders(t: Derived, text: str) -> DataFrame:
    return t.spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=t.domain.table("orders"))


def _form4(t: Derived) -> DataFrame:
    rows = t.domain.table("orders").select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(50)).alias("cik"), F.when(F.col("o_orderkey") % 3 == 0, "4/A").otherwise("4").alias("form_type"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_no"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.pmod("o_orderkey", F.lit(20)) * 3600).alias("filed_at"),
        F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 7 != 0), F.date_sub(F.to_date("o_orderdate"), F.pmod("o_orderkey", F.lit(40)).cast("int"))).alias("original_day"),
    )
    return rows


_CHAIN_SQL = {
    "form4": """SELECT o_orderkey AS id, o_custkey % 50 AS cik, CASE WHEN o_orderkey % 3 = 0 THEN '4/A' ELSE '4' END AS form_type, lpad(o_orderkey::VARCHAR, 12, '0') AS accession_no,
      o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 20) AS filed_at, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN o_orderdate::DATE - (o_orderkey % 40)::INT END AS original_day FROM orders""",
    "owner": _OWNER,
    "day4": "SELECT *, timezone('America/New_York', filed_at AT TIME ZONE 'UTC')::DATE AS filed_on FROM form4",
    "own4": "SELECT filing_id AS id, list_sort(list(DISTINCT insider_id)) AS owners FROM owner GROUP BY 1",
    "cand4": """SELECT a.id, b.id AS other, x.owners = y.owners AS same FROM day4 a JOIN day4 b ON b.cik = a.cik AND b.filed_on = a.original_day AND b.filed_at < a.filed_at AND b.id <> a.id
      JOIN own4 x ON x.id = a.id JOIN own4 y ON y.id = b.id WHERE a.form_type = '4/A' AND list_has_any(x.owners, y.owners)""",
    "link4": """SELECT a.id, CASE WHEN n = 1 THEN one WHEN n > 1 AND alike = 1 THEN same_one END AS amends_id, CASE WHEN original_day IS NULL THEN 'no_date' WHEN n = 1 OR (n > 1 AND alike = 1) THEN 'linked' WHEN n > 1 AND alike > 1 THEN 'ambiguous' ELSE 'not_loaded' END AS link
      FROM form4 a LEFT JOIN (SELECT id, count(*) AS n, min(other) AS one, count(*) FILTER (same) AS alike, min(other) FILTER (same) AS same_one FROM cand4 GROUP BY 1) c USING (id) WHERE form_type = '4/A'""",
    "root4": """SELECT id, id AS root, 0 AS step FROM form4 WHERE id NOT IN (SELECT id FROM link4 WHERE amends_id IS NOT NULL) UNION ALL SELECT l.id, r.root, r.step + 1 FROM root4 r JOIN link4 l ON l.amends_id = r.id""",
}
add("str03_amendment_links", "id:l amends_id:l link:s", "SELECT * FROM link4", **_CHAIN_SQL)(lambda t: chains.link_amendments(_form4(t), _orders(t, _OWNER)))


def _chains(t: Derived) -> DataFrame:
    filing = _form4(t)
    return chains.chains(filing, chains.link_amendments(filing, _orders(t, _OWNER)))


add(
    "str03_chain_keepers", "id:l root:l keeper:l",
    "SELECT r.id, r.root, first_value(f.id) OVER (PARTITION BY root ORDER BY f.filed_at DESC, f.accession_no DESC, f.id DESC) AS keeper FROM root4 r JOIN form4 f ON f.id = r.id", **_CHAIN_SQL,
)(_chains)

# ---------------------------------------------------------------- securities

#: Line items as venue listings of parts (CUSIPs), and as entries of quarterly lists.
_MATCHES = """SELECT lpad(CAST(l_partkey AS STRING), 9, '0') AS cusip, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_linenumber = 3 THEN 'Corp' ELSE 'Equity' END AS market_sector,
  CASE WHEN l_suppkey % 5 = 0 THEN 'US' WHEN l_suppkey % 5 < 3 THEN 'UN' ELSE 'GR' END AS exchange_code, CASE WHEN l_orderkey % 11 = 0 THEN 'XABCX' WHEN l_orderkey % 6 = 0 THEN concat('T', l_partkey % 100, '/B') ELSE concat('t', l_partkey % 100) END AS ticker,
  concat('F', l_orderkey) AS figi, CASE WHEN l_suppkey % 2 = 0 THEN concat('C', l_orderkey) END AS composite_figi, CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE concat('Name ', l_partkey) END AS name FROM lineitem"""
_LISTS = """SELECT DISTINCT lpad(CAST(l_suppkey % 60 + 1 AS STRING), 9, '0') AS cusip, last_day(CAST(concat(year(l_shipdate), '-', lpad(CAST(quarter(l_shipdate) * 3 AS STRING), 2, '0'), '-01') AS DATE)) AS period,
  CASE WHEN (l_suppkey % 60 + year(l_shipdate) + quarter(l_shipdate)) % 9 < 3 THEN 'deleted' WHEN (l_suppkey + year(l_shipdate)) % 5 = 0 THEN 'added' ELSE 'listed' END AS status, concat('Issuer ', l_suppkey % 60) AS issuer_name
  FROM lineitem WHERE year(l_shipdate) < 2001 - l_suppkey % 4"""


def _lineitem(t: Derived, text: str) -> DataFrame:
    return t.spark.sql(text.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.domain.table("lineitem"))


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


_SECURITY_SQL = {"match": _duck(_MATCHES), "listed": _duck(_LISTS)}
add(
    "res05_listings", "cusip:s ticker:s figi:s",
    """SELECT cusip, replace(replace(upper(trim(any_value(symbol))), '/', '.'), '-', '.') AS ticker, arg_min(figi, (place, symbol, figi, other)) AS figi FROM
      (SELECT *, count(DISTINCT symbol) OVER (PARTITION BY cusip) AS n FROM
        (SELECT * FROM (SELECT *, count(DISTINCT symbol) OVER (PARTITION BY cusip) AS every, count(DISTINCT CASE WHEN NOT nav THEN symbol END) OVER (PARTITION BY cusip) AS trading FROM
          (SELECT cusip, place, upper(trim(ticker)) AS symbol, regexp_full_match(upper(trim(ticker)), 'X.{3}X') AS nav, CASE WHEN exchange_code = 'US' THEN figi ELSE coalesce(composite_figi, figi) END AS figi, coalesce(composite_figi, figi) AS other,
             exchange_code = 'US' AS composite, bool_or(exchange_code = 'US') OVER (PARTITION BY cusip) AS has FROM match WHERE market_sector = 'Equity' AND trim(ticker) <> '' AND exchange_code IN ('US', 'UA', 'UN', 'UQ', 'UR', 'UW', 'UP', 'UF', 'UV'))
          WHERE composite = has) WHERE every = 1 OR trading = 0 OR NOT nav)) WHERE n = 1 GROUP BY 1""", **_SECURITY_SQL,
)(lambda t: entities.choose_listing(_lineitem(t, _MATCHES)))
add(
    "res13_issuer_names", "cusip:s name:s source:s period:d",
    """SELECT cusip, coalesce(figi_name, issuer_name) AS name, CASE WHEN figi_name IS NOT NULL THEN 'openfigi' WHEN issuer_name IS NOT NULL THEN 'sec_13f_list' END AS source, CASE WHEN figi_name IS NULL THEN period END AS period
      FROM (SELECT DISTINCT lpad(p_partkey::VARCHAR, 9, '0') AS cusip FROM part) LEFT JOIN (SELECT cusip, arg_min(trim(name), place) AS figi_name FROM match WHERE trim(name) <> '' GROUP BY 1) USING (cusip)
      LEFT JOIN (SELECT cusip, max(period) AS period, arg_max(issuer_name, (period, issuer_name)) AS issuer_name FROM listed GROUP BY 1) USING (cusip)""", **_SECURITY_SQL,
)(lambda t: entities.issuer_names(t.domain.table("part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("cusip")), _lineitem(t, _MATCHES), _lineitem(t, _LISTS)))
_DELISTED = """SELECT security_id, (SELECT min(period) FROM (SELECT DISTINCT period FROM listed) p WHERE p.period > l.period) AS delisted_by
  FROM security JOIN (SELECT cusip, max(period) AS period FROM listed WHERE status <> 'deleted' GROUP BY 1) l USING (cusip)"""
add("res08_delistings", "security_id:l delisted_by:d", "SELECT * FROM delisting", **_SECURITY_SQL, delisting=_DELISTED)(lambda t: entities.delisted_by(t.security, _lineitem(t, _LISTS)))
add(
    "res08_settled_ranges", "security_id:l ticker:s valid_from:d valid_to:d",
    """SELECT b.security_id, b.ticker, coalesce((SELECT max(e.valid_to) FROM closed e WHERE e.now = e.valid_to AND upper(e.ticker) = upper(b.ticker) AND e.security_id <> b.security_id AND e.valid_to < coalesce(b.valid_to, DATE '9999-12-31')
        AND (b.valid_from IS NULL OR EXISTS (SELECT 1 FROM closed x WHERE x.now = x.valid_to AND upper(x.ticker) = upper(b.ticker) AND x.security_id <> b.security_id AND x.valid_to = b.valid_from))), b.valid_from) AS valid_from, b.valid_to FROM closed b""",
    **_SECURITY_SQL, delisting=_DELISTED,
    closed="""SELECT security_id, ticker, valid_from, now, CASE WHEN valid_to IS NULL AND now IS NOT NULL AND coalesce(valid_from < now, true) THEN now ELSE valid_to END AS valid_to FROM
      (SELECT a.security_id, a.ticker, a.valid_from, d.delisted_by AS now, CASE WHEN d.security_id IS NOT NULL AND d.delisted_by IS NULL AND a.valid_to = s.delisted_by
         AND NOT EXISTS (SELECT 1 FROM alias z WHERE z.security_id = a.security_id AND z.valid_from >= s.delisted_by) THEN NULL ELSE a.valid_to END AS valid_to
       FROM alias a LEFT JOIN delisting d ON d.security_id = a.security_id LEFT JOIN security s ON s.security_id = a.security_id)""",
)(lambda t: entities.settled_ranges(t.domain.alias(), entities.delisted_by(t.security, _lineitem(t, _LISTS)), t.security))


def _issuers(t: Derived) -> DataFrame:
    symbol = F.when(F.col("issuer_cik").cast("int") % 2 == 0, F.concat(F.lit("b."), (F.col("issuer_cik").cast("int") + 11).cast("string")))
    return t.lines.select("issuer_cik").distinct().withColumn("trading_symbol", symbol)


def _sec_tickers(t: Derived) -> DataFrame:
    """SEC's list, and a second class for every ninth issuer."""
    more = t.spark.range(0, 100, 9).select(F.concat(F.lit("B-"), (F.col("id") % 25 + 1).cast("string")).alias("ticker"), F.col("id").cast("string").alias("cik"))
    return t.domain.issuer_ticker().unionByName(more).distinct()


_SEC = "SELECT * FROM issuer_ticker UNION SELECT 'B-' || (i % 25 + 1), i::VARCHAR FROM range(0, 100, 9) r(i)"


def _found(t: Derived) -> DataFrame:
    symbols = _sec_tickers(t).select(F.translate("ticker", "-", ".").alias("symbol"))
    held = t.snapshot.groupBy("security_id").agg(F.max("period").alias("last_held"))
    return lookup.lookup(symbols, t.domain.alias(), t.security, held, "1998-06-30").select(F.col("symbol").alias("ticker"), "security_id")


add(
    "res10_issuer_links", "issuer_cik:s trading_symbol:s security_id:l link:s",
    """SELECT issuer_cik, trading_symbol, CASE WHEN n = 1 THEN one END AS security_id, CASE WHEN tickers = 0 THEN 'unlisted' WHEN n = 0 THEN 'no_security' WHEN n > 1 THEN 'ambiguous' ELSE 'linked' END AS link FROM
      (SELECT issuer_cik, trading_symbol, count(symbol) AS tickers, count(DISTINCT security_id) AS n, min(security_id) AS one FROM
        (SELECT *, bool_or(own) OVER (PARTITION BY issuer_cik) AS has FROM
          (SELECT i.*, replace(ticker, '-', '.') AS symbol, coalesce(replace(ticker, '-', '.') = upper(trading_symbol), false) AS own FROM
            (SELECT DISTINCT issuer_cik, CASE WHEN issuer_cik::INT % 2 = 0 THEN 'b.' || (issuer_cik::INT + 11) END AS trading_symbol FROM insider_line) i LEFT JOIN sec ON cik = issuer_cik)) x
        LEFT JOIN (SELECT ticker AS symbol, security_id FROM security) s USING (symbol) WHERE own OR NOT has GROUP BY 1, 2)""", sec=_SEC,
)(lambda t: entities.link_issuers(_issuers(t), _sec_tickers(t), _found(t)))
add(
    "res11_held_issuers", "cik:s",
    f"SELECT DISTINCT cik FROM issuer_ticker JOIN security ON replace(security.ticker, '.', '-') = issuer_ticker.ticker JOIN snapshot USING (security_id) WHERE period > DATE '{PERIOD}' - INTERVAL 1 YEAR AND weight_pct >= 40",
)(lambda t: entities.held_issuers(t.snapshot, t.security, t.domain.issuer_ticker(), PERIOD, 40))
_TWICE = "SELECT security_id, ticker, delisted_by FROM security UNION ALL SELECT security_id + 100, ticker, NULL FROM security WHERE security_id % 4 = 0"


def _twice(t: Derived) -> DataFrame:
    own = t.security.select("security_id", "ticker", "delisted_by")
    return own.unionByName(own.where("security_id % 4 = 0").select(F.col("security_id") + 100, "ticker", F.lit(None).cast("date").alias("delisted_by")).toDF("security_id", "ticker", "delisted_by"))


add("res12_quote_targets", "ticker:s security_id:l", "SELECT upper(ticker) AS ticker, min(security_id) AS security_id FROM twice WHERE ticker IS NOT NULL AND delisted_by IS NULL GROUP BY 1 HAVING count(*) = 1", twice=_TWICE)(lambda t: entities.quote_targets(_twice(t)))

_OLD = "SELECT s_suppkey AS security_id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('T', s_suppkey) END AS ticker, concat('F', s_suppkey) AS figi, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'openfigi' END AS source FROM supplier"
_NEW = "SELECT s_suppkey AS security_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 < 3 THEN concat('N', s_suppkey) ELSE concat('T', s_suppkey) END AS ticker, concat('F', s_suppkey) AS figi, s_name AS name, 'openfigi' AS source FROM supplier WHERE s_suppkey % 7 <> 0"


def _supplier(t: Derived, text: str) -> DataFrame:
    return t.spark.sql(text.replace("FROM supplier", "FROM {supplier}"), supplier=t.domain.table("supplier"))


add(
    "res06_merged_resolution", "security_id:l ticker:s figi:s name:s source:s changed:b",
    """SELECT o.security_id, CASE WHEN w THEN n.ticker ELSE o.ticker END AS ticker, CASE WHEN w THEN n.figi ELSE o.figi END AS figi, CASE WHEN w THEN n.name ELSE o.name END AS name, CASE WHEN w THEN n.source ELSE o.source END AS source, w AS changed
      FROM old o LEFT JOIN new n USING (security_id), LATERAL (SELECT n.security_id IS NOT NULL AND o.source IS DISTINCT FROM 'manual' AND (n.ticker IS NOT NULL OR o.ticker IS NULL)
        AND (o.ticker IS DISTINCT FROM n.ticker OR o.figi IS DISTINCT FROM n.figi OR o.name IS DISTINCT FROM n.name OR o.source IS DISTINCT FROM n.source) AS w) l""", old=_OLD, new=_NEW,
)(lambda t: entities.merged_resolution(_supplier(t, _OLD), _supplier(t, _NEW)))

_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ALIKE = f"len(list_intersect({_GRAMS.format('{0}')}, {_GRAMS.format('{1}')}))::DOUBLE / len(list_distinct(list_concat({_GRAMS.format('{0}')}, {_GRAMS.format('{1}')})))"
_NAMES = "SELECT p_partkey AS security_id, CASE WHEN p_partkey % 8 <> 0 THEN 'T' || p_partkey END AS ticker, p_name || ' ' || p_type AS name, p_type || ' ' || p_name AS filed_name FROM part WHERE p_partkey <= 160"


def _named(t: Derived) -> DataFrame:
    part = t.domain.table("part").where("p_partkey <= 160")
    both = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_name")
    return part.select(F.col("p_partkey").alias("security_id"), F.when(F.col("p_partkey") % 8 != 0, F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("ticker"), both[0].alias("name"), both[1].alias("filed_name"))


add(
    "res07_fuzzy_review", "security_id:l suggested_id:l similarity:f place:l",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY similarity DESC, suggested_id) AS place FROM (SELECT u.security_id, r.security_id AS suggested_id, greatest({_ALIKE.format("u.name", "r.name")}, {_ALIKE.format("u.filed_name", "r.name")}, {_ALIKE.format("u.name", "r.filed_name")}, {_ALIKE.format("u.filed_name", "r.filed_name")}) AS similarity
        FROM names u JOIN names r ON r.ticker IS NOT NULL AND u.ticker IS NULL) WHERE similarity >= 0.8) WHERE place <= 3""", names=_NAMES,
)(lambda t: entities.fuzzy_matches(_named(t)))

# ---------------------------------------------------------------- disclosed assets

#: Lines as filed (code, name, ticker) and the class that the rules give: if found, if not, whether a security is looked for, by name too.
_CLASSES = [
    (("ST", "Apple Inc", "AAPL"), ("equity", "equity", True, True)), (("ST", "Vanguard Fund", "VFIAX"), ("mutual_fund", "mutual_fund", False, True)), (("GS", "US Treasury Note", None), ("treasury", "treasury", False, True)),
    (("GS", "Austin ISD", None), ("municipal_bond", "municipal_bond", False, True)), (("CS", "FNMA Pool", None), ("agency_bond", "agency_bond", False, True)), (("OT", "New Thing", "NEWT"), ("equity", "other", True, False)),
    (("OT", "Bitcoin", None), ("crypto", "crypto", False, True)), (("OT", "Thing", None), ("other", "other", False, True)), (("ST", "Acme Preferred", "ACME"), ("equity", "equity", True, False)), (("ZZ", "x", None), ("other", "other", False, True)),
    ((None, "Ford 4.5% due 2030", None), ("corporate_bond", "corporate_bond", False, True)), ((None, "iShares Core ETF", None), ("equity", "unknown", True, True)), ((None, "Call option on Acme", None), ("stock_option", "stock_option", True, True)),
    ((None, "Smith Family Trust", None), ("other", "other", False, True)), ((None, "Blue River Partners IV", None), ("private", "private", False, True)), ((None, "Microsoft Corp", None), ("equity", "unknown", True, True)), (("OP", "NVDA call", "NVDA"), ("stock_option", "stock_option", True, True)),
]


_CLASS = lambda what: f"CASE p_partkey % {len(_CLASSES)} " + " ".join(f"WHEN {n} THEN {what(*c)}" for n, c in enumerate(_CLASSES)) + " END"
_OR_NULL = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).lower()


def _classified(t: Derived) -> DataFrame:
    """A line for each part, of one of the kinds; descriptions speak of options where the code is OT."""
    rows = t.domain.table("part").select(
        "p_partkey", F.expr(_CLASS(lambda given, _: _OR_NULL(given[0]))).alias("code"), F.concat("p_name", F.lit(" "), F.expr(_CLASS(lambda given, _: _OR_NULL(given[1])))).alias("name"),
        F.expr(_CLASS(lambda given, _: _OR_NULL(given[2]))).alias("ticker"), F.expr(_CLASS(lambda given, _: "'a call option'" if given[0] == "OT" else "NULL")).alias("description"),
    )
    kind = classify(F.col("code"), F.col("name"), F.col("ticker"), F.col("description"))
    return rows.select("p_partkey", kind.alias("kind")).select("p_partkey", "kind.*")


add("txt08_asset_classes", "p_partkey:l asset_class:s otherwise:s lookup:b by_name:b", "SELECT p_partkey, " + ", ".join(f"{_CLASS(lambda _, found, i=i: _OR_NULL(found[i]))} AS {n}" for i, n in enumerate(("asset_class", "otherwise", "lookup", "by_name"))) + " FROM part")(_classified)

#: Customers as securities, with names and tickers of letters that their numbers give; the second in ten had another ticker until 2022.
_CODE = "translate(substr(md5(CAST(c_custkey AS STRING)), 1, 9), '0123456789abcdef', 'bcdfghjklmnpqrst')"
_TICKER = "upper(translate(lpad(CAST(c_custkey * 7919 % 99991 AS STRING), 5, '0'), '0123456789', 'bdfklmprst'))"
_LISTED = f"SELECT c_custkey AS security_id, {_TICKER} AS ticker, lpad(CAST(c_custkey AS STRING), 9, '0') AS cusip, concat({_CODE}, ' Inc') AS name, concat({_CODE}, ' Inc Com') AS filed_name, CAST(NULL AS DATE) AS delisted_by FROM customer"
_FORMER = f"SELECT c_custkey AS security_id, concat('OLD', c_custkey) AS ticker, CAST(NULL AS DATE) AS valid_from, DATE '2022-06-09' AS valid_to FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey, {_TICKER}, CASE WHEN c_custkey % 10 = 1 THEN DATE '2022-06-09' END, NULL FROM customer"
#: A line of each kind: code, name and ticker as filed, its day, and the class, whether the security is found, the method and the confidence.
_KINDS_OF_LINES = [
    (f"'ST', concat({_CODE}, ' Inc. - Common Stock'), {_TICKER}", "2024-05-01", ("equity", True, "ticker", 1.0)), (f"'ST', concat({_CODE}, ', Inc. - Class A'), concat('OLD', c_custkey)", "2020-05-01", ("equity", True, "ticker", 1.0)),
    (f"'ST', concat({_CODE}, ' Inc'), CAST(NULL AS STRING)", "2024-05-01", ("equity", True, "name", 0.95)), (f"'GS', concat({_CODE}, ' US Treasury Note'), CAST(NULL AS STRING)", "2024-05-01", ("treasury", False, None, None)),
    ("CAST(NULL AS STRING), 'Nothing Known Here', CAST(NULL AS STRING)", "2024-05-01", ("unknown", False, None, None)), (f"'ST', concat('Mystery ', {_CODE}), CAST(NULL AS STRING)", "2024-05-01", ("equity", True, "manual", 1.0)),
    (f"'ST', 'Something Else Entirely', {_TICKER}", "2024-05-01", ("equity", True, "ticker", 0.8)), (f"CAST(NULL AS STRING), concat({_CODE}, ' Inc ', {_TICKER}), CAST(NULL AS STRING)", "2024-05-01", ("equity", True, "ticker", 0.9)),
    (f"'ST', concat({_CODE}, ' Inc'), concat('N', c_custkey)", "2024-05-01", ("equity", True, "name", 0.8)), (f"'OT', concat({_CODE}, ' thing'), CAST(NULL AS STRING)", "2024-05-01", ("other", False, None, None)),
]


def _customers(t: Derived, text: str) -> DataFrame:
    return t.spark.sql(text.replace("FROM customer", "FROM {customer}"), customer=t.domain.table("customer"))


def _resolved(t: Derived) -> DataFrame:
    lines = _customers(t, " UNION ALL ".join(f"SELECT c_custkey AS id, {what}, DATE '{day}' AS day FROM customer WHERE c_custkey % 10 = {n}" for n, (what, day, _) in enumerate(_KINDS_OF_LINES))).toDF("id", "asset_type", "asset_name", "ticker", "day")
    ruled = _customers(t, f"SELECT concat('ST||mystery ', {_CODE}) AS key, c_custkey AS security_id, 'equity' AS asset_class FROM customer WHERE c_custkey % 10 = 5")
    held = _customers(t, "SELECT c_custkey AS security_id, 2024 AS year, CAST(100 AS DECIMAL(20,2)) AS value, DATE '2024-03-31' AS last_held FROM customer")
    return entities.resolve_assets(lines, ruled, _customers(t, _LISTED), _customers(t, _FORMER), held)


add(
    "res03_resolved_assets", "id:l asset_class:s security_id:l method:s confidence:f",
    " UNION ALL ".join(f"SELECT c_custkey AS id, {_OR_NULL(kind)} AS asset_class, {'c_custkey' if found else 'NULL'} AS security_id, {_OR_NULL(how)} AS method, {_OR_NULL(sure)}::DOUBLE AS confidence FROM customer WHERE c_custkey % 10 = {n}" for n, (_, _, (kind, found, how, sure)) in enumerate(_KINDS_OF_LINES)),
)(_resolved)


def _assets(t: Derived) -> DataFrame:
    rows = _trade(t).where("parse_status = 'parsed'").join(congress_table(t, "report").select(F.col("id").alias("filing_id"), "chamber"), "filing_id")
    return rows.select("chamber", "filing_id", "asset_class", "security_id", (F.pmod("id", F.lit(10)) / 10).alias("confidence"))


add(
    "res04_asset_coverage", "chamber:s lines:l pending:l resolvable:l resolved:l low_confidence:l filings:l filings_resolved:l filings_partly:l",
    """SELECT chamber, sum(n) AS lines, 0 AS pending, sum(able) AS resolvable, sum(found) AS resolved, sum(low) AS low_confidence, count(*) FILTER (able > 0) AS filings, count(*) FILTER (able > 0 AND r = able) AS filings_resolved, count(*) FILTER (r > 0 AND r < able) AS filings_partly FROM
      (SELECT chamber, filing_id, count(*) AS n, count(*) FILTER (asset_class <> 'municipal_bond') AS able, count(*) FILTER (asset_class <> 'municipal_bond' AND security_id IS NOT NULL) AS r, count(security_id) AS found, count(security_id) FILTER (d.id % 10 < 8) AS low
       FROM dated d JOIN report r ON r.id = d.filing_id WHERE parse_status = 'parsed' GROUP BY 1, 2) GROUP BY 1""", **CAPITOL,
)(lambda t: entities.asset_coverage(_assets(t), congress.RESOLVABLE))

# ---------------------------------------------------------------- alerts

NOW = "1998-11-20"
_RULES = """SELECT id AS rule_id, id % 6 AS user_id, CASE WHEN id % 2 = 0 THEN 'filer_change' ELSE 'stock_change' END AS kind, CASE WHEN id % 2 = 0 THEN id % 40 + 1 ELSE id % 25 + 1 END AS target,
  CASE WHEN id % 3 = 0 THEN 30000 END AS min_value, CAST(concat('1998-10-', lpad(CAST(id % 28 + 1 AS STRING), 2, '0')) AS TIMESTAMP) AS created_at FROM"""


def _rules(t: Derived) -> DataFrame:
    return t.spark.sql(f"{_RULES} range(120)")


ALERT_SQL = {
    "fresh": f"SELECT s.filer_id, s.period, max(f.filed_at) AS filed_at FROM snapshot s JOIN filing f ON f.filing_id = s.source_filing_id GROUP BY 1, 2 HAVING max(f.filed_at) >= DATE '{NOW}' - 30",
    "splitlike": LIKE_SQL,
    "told": """SELECT c.filer_id, c.period, c.security_id, c.action, filed_at, round(traded, 2) AS dollars FROM flowing c JOIN fresh USING (filer_id, period)
      WHERE action <> 'hold' AND NOT EXISTS (SELECT 1 FROM filing x WHERE x.parse_status = 'suspect' AND x.filer_id = c.filer_id AND x.period > c.prev_period AND x.period < c.period)
        AND NOT (action IN ('add', 'trim') AND EXISTS (SELECT 1 FROM splitlike z WHERE NOT z.is_split AND z.filer_id = c.filer_id AND z.period = c.period AND z.security_id = c.security_id))""",
    "rule": _duck(_RULES) + " range(120) r(id)",
}
add("str10_change_events", "filer_id:l period:d security_id:l action:s dollars:f", "SELECT * FROM told", **ALERT_SQL)(lambda t: alerts.change_events(t.change, alerts.fresh_pairs(t.snapshot, t.filing, NOW), t.filing))
add(
    "str11_heard_events", "rule_id:l user_id:l filer_id:l period:d security_id:l kind:s",
    """SELECT * FROM filers UNION ALL SELECT rule_id, user_id, e.filer_id, e.period, e.security_id, 'stock_change' AS kind FROM told e JOIN rule r ON r.kind = 'stock_change' AND r.target = e.security_id
      WHERE created_at <= filed_at AND (min_value IS NULL OR dollars >= min_value) AND NOT EXISTS (SELECT 1 FROM filers f WHERE f.user_id = r.user_id AND f.filer_id = e.filer_id AND f.period = e.period AND f.security_id = e.security_id)""",
    **ALERT_SQL,
    filers="""SELECT rule_id, user_id, e.filer_id, e.period, e.security_id, 'filer_change' AS kind FROM told e JOIN rule r ON r.kind = 'filer_change' AND r.target = e.filer_id WHERE created_at <= filed_at AND (min_value IS NULL OR dollars >= min_value)
      QUALIFY row_number() OVER (PARTITION BY user_id, e.filer_id, e.period ORDER BY coalesce(dollars, 0) DESC, e.security_id, rule_id) <= 10""",
)(lambda t: alerts.heard(alerts.change_events(t.change, alerts.fresh_pairs(t.snapshot, t.filing, NOW), t.filing), _rules(t)))
