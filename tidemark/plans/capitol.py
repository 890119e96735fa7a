"""Queries of congressional disclosures over the driver's tables, and their SQL twins.

A customer is a member, each customer's orders of a year under one of two filed names are reports, line items their lines. Dates,
bands and states of reading follow from keys by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import congress, paging
from .catalog import add
from .derived import Derived

#: Members, filed names, reports and lines, once for both engines: Spark and DuckDB read the same text.
_TABLES = {
    "member": """SELECT c_custkey AS id, concat('M', c_custkey) AS bioguide_id, c_name AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'Democrat' ELSE 'Republican' END AS party,
      concat('S', c_nationkey % 10) AS state, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey % 10 END AS district FROM customer""",
    "term": """SELECT c_custkey AS member_id, CASE WHEN (c_custkey + y) % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, CAST(concat(y, '-01-03') AS DATE) AS start_date,
      CASE WHEN c_custkey % 7 = 0 THEN 'Independent' ELSE 'Democrat' END AS party, concat('T', y % 7) AS state, y % 5 AS district
      FROM customer CROSS JOIN (VALUES (1995), (1996), (1998), (2000)) t(y) WHERE c_custkey % 5 <> 0""",
    "filed_name": """SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'review' ELSE 'matched' END AS status, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey END AS member_id FROM customer""",
    "report": """SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'senate' ELSE 'house' END AS chamber, concat('D', o_orderkey) AS doc_id, CAST(o_orderdate AS DATE) AS filing_date,
      CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS filed_name_id, concat('First', o_custkey % 4) AS first_name, concat('Last', o_custkey % 9) AS last_name,
      CAST(concat(year(o_orderdate), '-06-30') AS DATE) AS report_date, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 + 1 END AS amendment, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 2 END AS parser_version FROM orders""",
    "trade": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS filing_id, CAST(l_shipdate AS DATE) AS transaction_date, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS shipped,
      l_suppkey % 30 - 5 AS told_after, CASE l_returnflag WHEN 'R' THEN 'purchase' WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'sale' ELSE 'partial_sale' END ELSE 'exchange' END AS transaction_type,
      CASE WHEN l_orderkey % 17 = 0 THEN 'placeholder' WHEN l_suppkey % 8 = 0 THEN 'needs_review' ELSE 'parsed' END AS parse_status,
      CASE WHEN l_partkey % 19 = 0 THEN 'deleted' WHEN l_partkey % 10 = 0 THEN 'amended' WHEN l_partkey % 3 = 0 THEN 'new' END AS filing_status,
      CASE l_partkey % 5 WHEN 0 THEN 'equity' WHEN 1 THEN 'stock_option' WHEN 2 THEN 'unknown' ELSE 'municipal_bond' END AS asset_class, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 25 + 1 END AS security_id,
      CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 9 * 5000 + 1 AS DECIMAL(14,2)) END AS amount_low, CASE WHEN l_suppkey % 4 = 0 OR l_suppkey % 9 = 8 THEN NULL ELSE CAST(l_suppkey % 9 * 5000 + 5000 AS DECIMAL(14,2)) END AS amount_high,
      CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS amount_exact FROM lineitem""",
}


def _table(t: Derived, name: str) -> DataFrame:
    source = {"member": "customer", "term": "customer", "filed_name": "customer", "report": "orders", "trade": "lineitem"}[name]
    return t.spark.sql(_TABLES[name].replace(f"FROM {source}", "FROM {source}"), source=t.domain.table(source))


def _trade(t: Derived) -> DataFrame:
    """Lines traded some days before their report and told to the member after."""
    rows = _table(t, "trade").join(_table(t, "report").select(F.col("id").alias("filing_id"), "filing_date"), "filing_id")
    day = F.date_sub("filing_date", (F.pmod("id", F.lit(90)) - 5).cast("int"))
    return rows.withColumn("transaction_date", day).withColumn("notification_date", F.when(F.col("shipped").isNotNull(), F.date_add(day, F.col("told_after").cast("int")))).drop("shipped", "told_after", "filing_date")


_TRADE_SQL = """SELECT t.* EXCLUDE (transaction_date, shipped, told_after), filing_date - (t.id % 90 - 5)::INT AS transaction_date,
  CASE WHEN shipped IS NOT NULL THEN filing_date - (t.id % 90 - 5)::INT + told_after::INT END AS notification_date FROM trade t JOIN report r ON r.id = t.filing_id"""
_LINES_SQL = """
  SELECT *, coalesce(disclosure_lag_days, -1) AS lag_key, CASE WHEN first THEN greatest(filing_date - disclosure_deadline, 0) END AS days_late FROM
  (SELECT *, CASE WHEN first THEN filing_date - transaction_date END AS disclosure_lag_days,
    CASE WHEN first THEN least(transaction_date + 45, CASE WHEN notification_date >= transaction_date THEN notification_date + 30 END) END AS disclosure_deadline FROM
   (SELECT l.*, r.chamber, r.doc_id, r.filing_date, r.filed_name_id, r.first_name, r.last_name, r.amendment, coalesce(n.status, 'unlinked') AS member_match, m.id AS member_id, m.bioguide_id,
      coalesce(w.party, m.party) AS party, coalesce(w.state, m.state) AS state, CASE WHEN w.state IS NULL THEN m.district ELSE w.district END AS district,
      l.filing_status IS DISTINCT FROM 'amended' AND r.amendment IS NULL AND r.filing_date >= l.transaction_date AS first, coalesce(amount_low, amount_exact, 0) AS amount_key
    FROM dated l JOIN report r ON r.id = l.filing_id LEFT JOIN filed_name n ON n.id = r.filed_name_id LEFT JOIN member m ON m.id = n.member_id
    LEFT JOIN (SELECT d.id AS line, arg_max(t.party, t.start_date) AS party, arg_max(t.state, t.start_date) AS state, arg_max(t.district, t.start_date) AS district
      FROM dated d JOIN report r ON r.id = d.filing_id JOIN filed_name n ON n.id = r.filed_name_id JOIN term t ON t.member_id = n.member_id AND t.chamber = r.chamber AND t.start_date <= d.transaction_date GROUP BY 1) w ON w.line = l.id
    WHERE l.parse_status = 'parsed' AND l.filing_status IS DISTINCT FROM 'deleted'
      AND NOT (r.chamber = 'senate' AND EXISTS (SELECT 1 FROM report z WHERE z.chamber = r.chamber AND z.filed_name_id = r.filed_name_id AND z.report_date = r.report_date
        AND coalesce(z.amendment, 0) > coalesce(r.amendment, 0) AND EXISTS (SELECT 1 FROM dated y WHERE y.filing_id = z.id AND y.parse_status = 'parsed')))))"""
SQL = {**_TABLES, "dated": _TRADE_SQL, "disclosed": _LINES_SQL}
_LINE = "id:l chamber:s member_id:l party:s state:s district:l transaction_date:d filing_date:d notification_date:d disclosure_deadline:d disclosure_lag_days:l days_late:l amount_key:f member_match:s"


def _lines(t: Derived) -> DataFrame:
    return congress.congress_lines(_trade(t), _table(t, "report"), _table(t, "filed_name"), _table(t, "member"), _table(t, "term"))


add("qry18_congress_lines", _LINE, "SELECT * FROM disclosed", **SQL)(_lines)
_FILTERS = [
    ("late_sales", {"types": ["sale"], "late": True}, "transaction_type IN ('sale', 'partial_sale') AND days_late > 0"),
    ("in_time_senate", {"chamber": "senate", "late": False, "parties": ["democrat"]}, "chamber = 'senate' AND days_late = 0 AND lower(party) = 'democrat'"),
    ("member_dates", {"bioguide_ids": ["M7", "M8", "M10"], "start": "1996-01-01", "end": "1999-12-31"}, "bioguide_id IN ('M7', 'M8', 'M10') AND transaction_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"),
    ("disclosed_large", {"disclosed_start": "1997-01-01", "disclosed_end": "1997-12-31", "min_amount": 15001, "asset_classes": ["equity"]}, "filing_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND amount_key >= 15001 AND asset_class = 'equity'"),
    ("security", {"security_id": 7, "types": ["purchase", "exchange"]}, "security_id = 7 AND transaction_type IN ('purchase', 'exchange')"),
]
for _name, _filters, _test in _FILTERS:
    add(f"qry19_congress_{_name}", _LINE, f"SELECT * FROM disclosed WHERE {_test}", **SQL)(lambda t, f=_filters: congress.filtered(_lines(t), **f))
for _sort, _column in congress.SORTS.items():
    _order = ", ".join(f"{c} DESC" for c in (_column, "transaction_date", "id") if c)
    add(f"qry19_congress_by_{_sort}", "id:l filing_date:d transaction_date:d", f"SELECT * FROM (SELECT * FROM disclosed ORDER BY {_order} LIMIT 51)", **SQL)(lambda t, s=_sort: paging.page(_lines(t), congress.sort_keys(s), 50))
add(
    "qry20_congress_summary",
    "transactions:l filings:l members:l unmatched_filers:l first_transaction_date:d last_transaction_date:d late:l lag_known:l median_disclosure_lag_days:l max_disclosure_lag_days:l",
    """SELECT count(*) AS transactions, count(DISTINCT filing_id) AS filings, count(DISTINCT member_id) AS members,
      count(DISTINCT coalesce(filed_name_id::VARCHAR, chamber || ':' || last_name || ':' || first_name)) FILTER (member_id IS NULL) AS unmatched_filers, min(transaction_date) AS first_transaction_date,
      max(transaction_date) AS last_transaction_date, count(*) FILTER (days_late > 0) AS late, count(disclosure_lag_days) AS lag_known, quantile_disc(disclosure_lag_days, 0.5) AS median_disclosure_lag_days,
      max(disclosure_lag_days) AS max_disclosure_lag_days FROM disclosed""", **SQL,
)(lambda t: congress.summary(_lines(t)))
add(
    "qry20_congress_by_type", "type:s transactions:l open_ended:l amount_low:l amount_high:l",
    """SELECT CASE WHEN transaction_type = 'partial_sale' THEN 'sale' ELSE transaction_type END AS type, count(*) AS transactions, count(*) FILTER (amount_low IS NOT NULL AND amount_high IS NULL) AS open_ended,
      floor(sum(coalesce(amount_low, amount_exact))) AS amount_low, CASE WHEN bool_or(amount_low IS NOT NULL AND amount_high IS NULL) THEN NULL ELSE ceil(sum(coalesce(amount_high, amount_exact))) END AS amount_high
      FROM disclosed WHERE asset_class <> 'unknown' OR transaction_type <> 'purchase' GROUP BY 1""", **SQL,
)(lambda t: congress.summary_by_type(_lines(t).where("asset_class <> 'unknown' or transaction_type <> 'purchase'")))
_REASON = """SELECT r.*, parsed, review, resolvable, resolved, CASE WHEN coalesce(parsed, 0) > 0 THEN NULL WHEN parser_version IS NULL THEN 'pending' WHEN coalesce(holder, 0) > 0 THEN 'unreadable' WHEN coalesce(review, 0) > 0 THEN 'in_review' END AS reason
  FROM report r LEFT JOIN (SELECT filing_id, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'needs_review') AS review, count(*) FILTER (parse_status = 'placeholder') AS holder,
    count(*) FILTER (parse_status = 'parsed' AND asset_class IN ('equity', 'stock_option', 'unknown')) AS resolvable, count(*) FILTER (parse_status = 'parsed' AND asset_class IN ('equity', 'stock_option', 'unknown') AND security_id IS NOT NULL) AS resolved
    FROM dated GROUP BY 1) c ON c.filing_id = r.id"""
add(
    "qry21_chamber_coverage",
    "chamber:s filings:l filings_read:l filings_unreadable:l filings_pending:l lines_in_review:l filings_unmatched_filer:l assets_resolved_pct:f first_filing_date:d latest_filing_date:d",
    """SELECT chamber, count(*) AS filings, count(*) FILTER (parsed > 0) AS filings_read, count(*) FILTER (reason IN ('unreadable', 'in_review')) AS filings_unreadable, count(*) FILTER (parser_version IS NULL) AS filings_pending,
      coalesce(sum(review), 0) AS lines_in_review, count(*) FILTER (status IS DISTINCT FROM 'matched') AS filings_unmatched_filer, round((sum(resolved) * 100 / sum(resolvable))::DECIMAL(20,6), 1) AS assets_resolved_pct,
      min(filing_date) AS first_filing_date, max(filing_date) AS latest_filing_date FROM reasoned r LEFT JOIN filed_name n ON n.id = r.filed_name_id GROUP BY 1""", **SQL, reasoned=_REASON,
)(lambda t: congress.chamber_coverage(_table(t, "report"), _trade(t), _table(t, "filed_name")))
add(
    "qry21_unread_filings", "chamber:s doc_id:s filing_date:d reason:s",
    "SELECT * FROM (SELECT r.chamber, doc_id, filing_date, reason FROM reasoned r JOIN filed_name n ON n.id = r.filed_name_id WHERE n.member_id = 361 AND reason IS NOT NULL ORDER BY filing_date DESC, doc_id DESC LIMIT 200)", **SQL, reasoned=_REASON,
)(lambda t: congress.unread_filings(_table(t, "report"), _trade(t), _table(t, "filed_name"), 361))
