"""Queries of published lists and indexes: files are written from the driver's tables as they are published, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import filings
from ..sources.store import shared_folder
from .catalog import add
from .derived import Derived

#: Entries of one made file.
_PER_FILE = 500


def _files(t: Derived, lines: DataFrame, name: str = "list") -> str:
    """Where files of the lines (one column) are."""
    path = f"{shared_folder(t.spark)}/lists/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _documents(t: Derived, entries: DataFrame, first: str, last: str) -> str:
    """Where files are that each hold some entries (columns part, e), joined by commas, between two brackets."""
    path = f"{shared_folder(t.spark)}/lists/{uuid.uuid4().hex}"
    whole = entries.groupBy("part").agg(F.concat(F.lit(first), F.array_join(F.sort_array(F.collect_list("e")), ","), F.lit(last)).alias("value")).select("value")
    whole.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _sql(t: Derived, table: str, query: str) -> DataFrame:
    return t.spark.sql(query.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: t.domain.table(table)})


_STATUS = "CASE p_partkey % 4 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'DELETED' ELSE '' END"
add(
    "src04_official_list", "cusip:s has_options:b name:s description:s status:s",
    "SELECT lpad(p_partkey::VARCHAR, 9, '0') AS cusip, p_partkey % 3 = 0 AS has_options, upper(p_name) AS name, 'COM ' || p_type AS description, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'del' ELSE '' END AS status FROM part WHERE p_partkey % 10 <> 7",
)(
    lambda t: filings.official_list(
        t.spark,
        _files(t, _sql(t, "part", f"SELECT concat(CASE WHEN p_partkey % 10 = 7 THEN 'not-a-one' ELSE lpad(CAST(p_partkey AS STRING), 9, '0') END, CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE ' ' END, rpad(upper(p_name), 30, ' '), rpad(concat('COM ', p_type), 27, ' '), {_STATUS}) AS line, explode(sequence(1, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END)) AS n FROM part").select("line")),
    )
)
add(
    "src05_daily_index", "form_type:s company:s cik:s filed_on:d file:s",
    "SELECT CASE o_orderkey % 3 WHEN 0 THEN '13F-HR/A' WHEN 1 THEN '4' ELSE 'SC 13G' END AS form_type, 'ACME CO  ' || o_custkey AS company, lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderdate::DATE AS filed_on, 'edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' AS file FROM orders",
)(
    lambda t: filings.daily_index(
        t.spark,
        _files(t, _sql(t, "orders", "SELECT explode(array(concat(rpad(CASE o_orderkey % 3 WHEN 0 THEN '13F-HR/A' WHEN 1 THEN '4' ELSE 'SC 13G' END, 12, ' '), rpad(concat('ACME CO  ', o_custkey), 60, ' '), rpad(CAST(o_custkey AS STRING), 12, ' '), date_format(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN 'yyyyMMdd' ELSE 'yyyy-MM-dd' END), '    edgar/data/', o_custkey, '/', o_orderkey, '.txt'), '------------', 'Form Type   Company Name')) AS line FROM orders")),
    )
)


def _listing(t: Derived) -> str:
    days = t.domain.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    named = F.when(F.dayofmonth("d") % 5 == 0, F.concat(F.lit("sitemap."), F.date_format("d", "yyyyMMdd"), F.lit(".xml"))).otherwise(F.concat(F.lit("form."), F.date_format("d", "yyyyMMdd"), F.when(F.dayofmonth("d") % 2 == 0, ".idx.gz").otherwise(".idx")))
    return _documents(t, days.select(F.date_trunc("quarter", "d").alias("part"), F.to_json(F.struct(named.alias("name"))).alias("e")), '{"directory": {"item": [', "]}}")


add("src06_published_days", "day:d", "SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE day(o_orderdate) % 5 <> 0")(lambda t: filings.published_days(t.spark, _listing(t)))

_FILED = "SELECT o_custkey, CAST(o_orderkey AS STRING) AS a, CASE o_orderkey % 3 WHEN 0 THEN '13F-HR' ELSE '4' END AS f, date_format(o_orderdate, 'yyyy-MM-dd') AS d, CASE WHEN o_orderkey % 3 = 0 THEN date_format(date_sub(o_orderdate, 40), 'yyyy-MM-dd') ELSE '' END AS r, concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00.000Z') AS x, 'p.xml' AS p FROM orders"


def _histories(t: Derived) -> str:
    rows = _sql(t, "orders", _FILED)
    one = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("a", "f", "d", "r", "x", "p"))).alias("l"))
    recent = F.struct(*(F.col(f"l.{c}").alias(n) for c, n in (("a", "accessionNumber"), ("f", "form"), ("d", "filingDate"), ("r", "reportDate"), ("x", "acceptanceDateTime"), ("p", "primaryDocument"))))
    entry = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings")))
    return _documents(t, one.select(F.floor(F.col("o_custkey") / _PER_FILE).alias("part"), entry.alias("e")), "[", "]")


add(
    "src07_submissions", "cik:s accession_no:s form_type:s filed_on:d period:d accepted_at:t document:s",
    """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession_no, CASE o_orderkey % 3 WHEN 0 THEN '13F-HR' ELSE '4' END AS form_type, o_orderdate::DATE AS filed_on, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE - 40 END AS period,
      o_orderdate::DATE + INTERVAL 10 HOUR AS accepted_at, 'p.xml' AS document FROM orders""",
)(lambda t: filings.submissions(t.spark, _histories(t)))
add(
    "src08_company_tickers", "ticker:s cik:s name:s",
    "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'T.' ELSE 'T' END || s_suppkey AS ticker, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_name AS name FROM supplier",
)(
    lambda t: filings.company_tickers(
        t.spark,
        _documents(t, _sql(t, "supplier", f"SELECT floor(s_suppkey / {_PER_FILE}) AS part, concat('\"', s_suppkey, '\": ', to_json(named_struct('cik_str', s_suppkey, 'ticker', concat(CASE WHEN s_suppkey % 2 = 0 THEN 't-' ELSE 't' END, s_suppkey), 'title', s_name))) AS e FROM supplier"), "{", "}"),
    )
)
add(
    "src13_legislators", "member:s first:s last:s chamber:s start:d until:d state:s district:s party:s",
    """SELECT 'B' || c_custkey AS member, 'F' || c_custkey AS first, c_name AS last, CASE WHEN n = 1 THEN 'house' ELSE 'senate' END AS chamber, make_date(1990 + 2 * n, 1, 3) AS start, make_date(1992 + 2 * n, 1, 3) AS until, 'S' || c_nationkey AS state,
      CASE WHEN n = 1 THEN (c_custkey % 50)::VARCHAR END AS district, 'Independent' AS party FROM customer, range(1, 4) r(n) WHERE n <= c_custkey % 3 + 1""",
)(
    lambda t: filings.legislators(
        t.spark,
        _documents(
            t,
            _sql(
                t, "customer",
                f"""SELECT floor(c_custkey / {_PER_FILE}) AS part, to_json(named_struct('id', named_struct('bioguide', concat('B', c_custkey)), 'name', named_struct('first', concat('F', c_custkey), 'last', c_name), 'terms',
                  transform(sequence(1, CAST(c_custkey % 3 + 1 AS INT)), n -> named_struct('type', CASE WHEN n = 1 THEN 'rep' ELSE 'sen' END, 'start', concat(1990 + 2 * n, '-01-03'), 'end', concat(1992 + 2 * n, '-01-03'), 'state', concat('S', c_nationkey), 'district', CASE WHEN n = 1 THEN CAST(c_custkey % 50 AS STRING) END, 'party', 'Independent')))) AS e FROM customer""",
            ), "[", "]",
        ),
    )
)
add(
    "map01_cited_footnotes", "event_id:l id:s note:s",
    """SELECT event_id, id, note FROM events, (VALUES ('F1', 1), ('F2', 2), ('F3', 3)) f(id, n), LATERAL (SELECT 'note ' || id || ' of ' || event_id AS note) WHERE n <= event_id % 4 AND (event_id % 5 <> 0 OR n <> 2)""",
)(
    lambda t: filings.cited_footnotes(
        _sql(
            t, "events",
            "SELECT event_id, map_from_arrays(array('F1', 'F2', 'F3'), transform(array('F1', 'F2', 'F3'), k -> concat('note ', k, ' of ', event_id))) AS footnotes, filter(slice(array('F1', 'F2', 'F3', 'F9'), 1, CAST(event_id % 4 AS INT)), k -> event_id % 5 <> 0 OR k <> 'F2') AS footnote_ids FROM events",
        )
    ).select("event_id", F.explode("footnotes").alias("id", "note"))
)
