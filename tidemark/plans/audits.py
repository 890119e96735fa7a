"""Queries of audits, invariants, search, text, streams' batch twins and recomputation. Invariants run on tables that are damaged
by a rule, so that they have something to find."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_ticker, similarity
from ..operators import quality, read, recompute, snapshot
from ..sources import sinks
from ..sources.partitions import Periods
from ..sources.store import shared_folder
from ..streaming import batches
from .catalog import add
from .derived import Derived

_CELLS = "filer_id:l period:d security_id:l"
_BROKEN = _CELLS + " problem:s"

add("q07_suspect_periods", "filer_id:l period:d filings:l", "SELECT filer_id, period, count(*) AS filings FROM filing WHERE parse_status = 'suspect' GROUP BY 1, 2")(
    lambda t: quality.suspect_periods(snapshot.winning_filings(t.effective, t.filing, True), t.filing)
)
add("q08_concentration", _CELLS + " weight_pct:f", "SELECT * FROM snapshot WHERE weight_pct > 50")(lambda t: quality.concentrated(t.snapshot, 50))
add(
    "q09_position_jumps", _CELLS + " shares:f was:f",
    """SELECT n.filer_id, n.period, n.security_id, n.shares, b.shares AS was FROM snapshot n JOIN snapshot b ON b.filer_id = n.filer_id AND b.security_id = n.security_id AND n.period = last_day(date_trunc('month', b.period) + INTERVAL 3 MONTH)
      WHERE b.shares > 0 AND (n.shares - b.shares) * 100 > b.shares * 500""",
)(lambda t: quality.position_jumps(t.snapshot, least=500))
add(
    "q10_filing_gaps", "filer_id:l first_missing:d last_missing:d quarters:l",
    """SELECT filer_id, last_day(date_trunc('month', last) + INTERVAL 3 MONTH) AS first_missing, last_day(date_trunc('month', period) - INTERVAL 3 MONTH) AS last_missing, date_diff('month', last, period) // 3 - 1 AS quarters
      FROM (SELECT *, lag(period) OVER (PARTITION BY filer_id ORDER BY period) AS last FROM filer_period) WHERE date_diff('month', last, period) > 3""",
)(lambda t: read.filing_gaps(t.published))
add(
    "q11_amendment_roles", "filing_id:l filer_id:l cik:s period:d role:s originals:l",
    """SELECT *, CASE WHEN base IS NULL THEN 'orphan addition' WHEN o = base THEN 'base' WHEN whole THEN 'superseded' WHEN o > base THEN 'addition' ELSE 'covered' END AS role FROM
      (SELECT *, max(CASE WHEN whole THEN o END) OVER (PARTITION BY filer_id, cik, period) AS base, count(*) FILTER (form_type = '13F-HR') OVER (PARTITION BY filer_id, cik, period) AS originals FROM
        (SELECT *, form_type = '13F-HR' OR coalesce(amendment_kind = 'restatement', false) AS whole, strftime(filed_at, '%Y%m%d%H%M%S%f') || accession_no AS o FROM amendment
         WHERE parse_status IN ('ok', 'suspect') AND (form_type = '13F-HR' OR amendment_kind IS NOT NULL)))""",
)(lambda t: quality.amendment_roles(t.domain.amendment()))


def _books(t: Derived) -> DataFrame:
    """Each order's customer as one of three CIKs of a nation, with the order's lines as positions."""
    order = t.domain.amendment().select("filing_id", "filer_id", "cik", "period")
    line = t.domain.table("lineitem").select(
        F.col("l_orderkey").alias("filing_id"), (F.col("l_partkey") % 5).alias("security_id"), F.when(F.col("l_returnflag") == "R", "Call").alias("put_call"), F.lit("SH").alias("sshprnamt_type"),
        F.col("l_quantity").cast("decimal(20,4)").alias("shares"), F.col("l_extendedprice").cast("decimal(20,2)").alias("value_usd"),
    )
    return line.join(order, "filing_id")


_BOOK_SQL = """SELECT filer_id, period, cik, l_partkey % 5 AS security_id, CASE WHEN l_returnflag = 'R' THEN 'Call' ELSE '' END AS put_call, sum(l_quantity::DECIMAL(20,4)) AS shares, sum(l_extendedprice::DECIMAL(20,2)) AS value
  FROM lineitem JOIN amendment ON filing_id = l_orderkey GROUP BY 1, 2, 3, 4, 5"""
add(
    "q12_book_overlap", "filer_id:l period:d primary_cik:s cik:s primary_positions:l other_positions:l union_value:f same_value:f verdict:s",
    """SELECT *, CASE WHEN same_value >= 0.9 * union_value THEN 'same book' WHEN same_value <= 0.1 * union_value THEN 'separate' ELSE 'unclear' END AS verdict FROM
      (SELECT filer_id, period, first AS primary_cik, cik, count(va) AS primary_positions, count(vb) AS other_positions, sum(greatest(va, vb))::DOUBLE AS union_value,
         coalesce(sum(greatest(va, vb)) FILTER (a <> 0 AND b <> 0 AND abs(a - b) <= 0.005 * greatest(a, b)), 0)::DOUBLE AS same_value
       FROM (SELECT p.*, a.security_id, a.put_call, a.shares AS a, a.value AS va, b.shares AS b, b.value AS vb FROM pairs p JOIN book a ON a.filer_id = p.filer_id AND a.period = p.period AND a.cik = p.first
               LEFT JOIN book b ON b.filer_id = p.filer_id AND b.period = p.period AND b.cik = p.cik AND b.security_id = a.security_id AND b.put_call = a.put_call
             UNION ALL SELECT p.*, b.security_id, b.put_call, NULL, NULL, b.shares, b.value FROM pairs p JOIN book b ON b.filer_id = p.filer_id AND b.period = p.period AND b.cik = p.cik
               WHERE NOT EXISTS (SELECT 1 FROM book a WHERE a.filer_id = p.filer_id AND a.period = p.period AND a.cik = p.first AND a.security_id = b.security_id AND a.put_call = b.put_call))
       GROUP BY 1, 2, 3, 4)""",
    book=_BOOK_SQL,
    pairs="""SELECT filer_id, period, cik, first FROM (SELECT filer_id, period, cik, first_value(cik) OVER (PARTITION BY filer_id, period ORDER BY coalesce(priority, -1) DESC, cik DESC) AS first
      FROM (SELECT DISTINCT filer_id, period, cik FROM book) LEFT JOIN amendment_cik USING (filer_id, cik)) WHERE cik <> first""",
)(lambda t: quality.overlap(_books(t), t.domain.amendment_cik()))
add(
    "q13_coverage", "period:d rows:l known_rows:l rows_pct:f value_pct:f",
    """SELECT period, count(*) AS rows, count(*) FILTER (k) AS known_rows, round((count(*) FILTER (k) * 100 / count(*))::DECIMAL(20,6), 1) AS rows_pct, round((coalesce(sum(value_usd) FILTER (k), 0)::DOUBLE * 100 / sum(value_usd)::DOUBLE)::DECIMAL(20,6), 1) AS value_pct
      FROM (SELECT *, security_id % 5 <> 0 AS k FROM holding) GROUP BY 1""",
)(lambda t: quality.coverage(t.holding, t.domain.security().where("security_id % 5 <> 0")))

# ---------------------------------------------------------------- invariants

def _hit():
    return F.col("security_id") == 7


add("q17_weights_sum_to_100", _BROKEN, "SELECT filer_id, period, NULL AS security_id, 'weights' AS problem FROM snapshot GROUP BY 1, 2 HAVING bool_or(security_id = 7)")(
    lambda t: quality.weights_sum_to_100(t.snapshot.withColumn("weight_pct", (F.col("weight_pct") + F.when(_hit(), 1).otherwise(0)).cast("decimal(10,6)")))
)
add("q18_snapshot_traces_to_filing", _BROKEN, "SELECT filer_id, period, security_id, 'source' AS problem FROM snapshot WHERE security_id = 7")(
    lambda t: quality.snapshot_traces_to_filing(t.snapshot.withColumn("source_filing_id", F.when(_hit(), -1).otherwise(F.col("source_filing_id"))), t.winning)
)
add("q19_changes_match_snapshot", _BROKEN, "SELECT filer_id, period, security_id, 'snapshot' AS problem FROM change WHERE security_id = 7 AND action <> 'exit'")(lambda t: quality.changes_match_snapshot(t.snapshot.where(~_hit()), t.change))
add("q20_changes_follow_previous_period", _BROKEN, "SELECT filer_id, period, security_id, 'previous period' AS problem FROM change WHERE security_id = 7 AND prev_period IS NOT NULL")(
    lambda t: quality.changes_follow_previous_period(t.snapshot, t.change.withColumn("prev_period", F.when(_hit(), F.date_sub("prev_period", 1)).otherwise(F.col("prev_period"))))
)
add("q21_new_and_exit_rows", _BROKEN, "SELECT filer_id, period, security_id, 'action' AS problem FROM change WHERE security_id = 7 AND action = 'exit'")(
    lambda t: quality.new_and_exit_rows(t.change.withColumn("shares", F.when(_hit() & (F.col("action") == "exit"), F.lit(1)).otherwise(F.col("shares"))))
)
add("q22_value_deltas_add_up", _BROKEN, "SELECT filer_id, period, NULL AS security_id, 'value' AS problem FROM change GROUP BY 1, 2 HAVING bool_or(security_id = 7)")(
    lambda t: quality.value_deltas_add_up(t.snapshot, t.change.withColumn("value_delta", F.col("value_delta") + F.when(_hit(), 1).otherwise(0)))
)
add("q25_nothing_negative", _BROKEN, "SELECT filer_id, period, security_id, 'negative' AS problem FROM snapshot WHERE shares < 10")(lambda t: quality.nothing_negative(t.snapshot.withColumn("shares", F.col("shares") - 10)))
add("q26_prices_count_every_observation", _BROKEN, "SELECT DISTINCT NULL AS filer_id, period, security_id, 'observations' AS problem FROM snapshot WHERE filer_id = 7 AND shares > 0")(
    lambda t: quality.prices_count_every_observation(t.snapshot.where("filer_id <> 7"), t.prices)
)
add("q27_prices_are_positive", _BROKEN, "SELECT NULL AS filer_id, period, security_id, 'price' AS problem FROM price WHERE security_id = 7")(lambda t: quality.prices_are_positive(t.prices.withColumn("price", F.when(_hit(), -F.col("price")).otherwise(F.col("price")))))
add("q28_prices_are_medians", _BROKEN, "SELECT NULL AS filer_id, period, security_id, 'median' AS problem FROM price WHERE security_id = 7 AND price IS NOT NULL")(
    lambda t: quality.prices_are_medians(t.snapshot, t.prices.withColumn("price", F.when(_hit(), F.col("price") * 100).otherwise(F.col("price"))))
)
add("q29_views_match_live", _BROKEN, "SELECT NULL AS filer_id, period, security_id, unnest(['stored only', 'live only']) AS problem FROM consensus WHERE security_id = 7")(
    lambda t: quality.views_match_live(t.consensus.withColumn("total_value", (F.col("total_value") + F.when(_hit(), 1).otherwise(0)).cast("decimal(20,2)")), t.consensus)
)

# ---------------------------------------------------------------- text and search

_GRAMS = lambda x: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_ASK = "small rin"
add(
    "txt05_trigram_similarity", "p_partkey:l alike:f",
    f"SELECT p_partkey, len(list_intersect({_GRAMS('p_name')}, {_GRAMS(repr(_ASK))})) / len(list_distinct(list_concat({_GRAMS('p_name')}, {_GRAMS(repr(_ASK))}))) AS alike FROM part",
)(lambda t: t.domain.table("part").select("p_partkey", similarity(F.col("p_name"), F.lit(_ASK)).alias("alike")))
add("txt02_normal_tickers", "p_brand:s ticker:s", "SELECT DISTINCT p_brand, replace(upper(trim(p_brand)), '-', '.') AS ticker FROM part")(lambda t: t.domain.table("part").select("p_brand", normal_ticker(F.col("p_brand")).alias("ticker")).distinct())
add("src12_page_titles", "page_id:l title:s", "SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '') AS title FROM pages")(
    lambda t: t.domain.table("pages").select("page_id", F.nullif(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1), F.lit("")).alias("title"))
)

# ---------------------------------------------------------------- streams' batch twins, sinks and recomputation

add(
    "str09_active_users", "day:d active_1:l active_7:l active_30:l",
    "SELECT day, " + ", ".join(f"(SELECT count(DISTINCT user_id) FROM events e WHERE e.ts::DATE BETWEEN d.day - {n - 1} AND d.day) AS active_{n}" for n in (1, 7, 30)) + " FROM (SELECT DISTINCT ts::DATE AS day FROM events) d",
)(lambda t: batches.active_users(t.domain.table("events"), "ts", "user_id"))
add("str09_daily_counts", "day:d event_type:s events:l value:f", "SELECT ts::DATE AS day, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")(
    lambda t: batches.daily_counts(t.domain.table("events"), "ts").withColumn("value", F.round("value", 4))
)
for _every, _last in (("day", "first_day"), ("week", "first_day + 6"), ("month", "last_day(first_day)")):
    add(
        f"str09_{_every}_series", "first_day:d last_day:d events:l active:l partial:b",
        f"""SELECT first_day, {_last} AS last_day, count(e.event_id) AS events, count(DISTINCT user_id) AS active, {_last} >= DATE '2024-01-29' OR count(DISTINCT d.day) < {_last} - first_day + 1 AS partial
          FROM (SELECT day, date_trunc('{_every}', day)::DATE AS first_day FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), DATE '2024-01-29', INTERVAL 1 DAY))::DATE AS day)) d LEFT JOIN events e ON e.ts::DATE = d.day GROUP BY first_day""",
    )(lambda t, every=_every: batches.activity_series(t.domain.table("events"), "ts", "user_id", every, "2024-01-29"))
add(
    "str07_over_limit", "event_id:l in_window:l",
    "SELECT * FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 2",
)(lambda t: batches.over_limit(t.domain.table("events"), "user_id", "ts", 3 * 86400, 2))
_MOMENTS = "SELECT user_id, ts, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events GROUP BY 1, 2"
_HEADS = """SELECT user_id, ts AS head FROM moment WHERE place = 1 UNION ALL
  SELECT h.user_id, (SELECT min(m.ts) FROM moment m WHERE m.user_id = h.user_id AND m.ts > h.head + INTERVAL 3 DAY) AS next FROM head h WHERE next IS NOT NULL"""
add(
    "str06_mail_batches", "user_id:l sent_at:t items:l",
    "SELECT h.user_id, head + INTERVAL 3 DAY AS sent_at, sum(n) AS items FROM head h JOIN moment m ON m.user_id = h.user_id AND m.ts BETWEEN head AND head + INTERVAL 3 DAY GROUP BY 1, 2", moment=_MOMENTS, head=_HEADS,
)(lambda t: batches.mail_batches(t.domain.table("events"), "user_id", "ts", 3 * 1440))
add("str04_first_arrivals", "user_id:l", "SELECT DISTINCT user_id FROM events")(lambda t: batches.arrivals_once(t.domain.table("events"), "user_id", "ts"))
add("snk05_latest_of_user", "user_id:l event_id:l event_type:s", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(
    lambda t: sinks.latest(t.domain.table("events"), ["user_id"], ["ts", "event_id"])
)
add("snk04_only_new", "event_id:l", "SELECT event_id FROM events WHERE event_type <> 'view'")(lambda t: sinks.only_new(t.domain.table("events"), t.domain.table("events").where("event_type = 'view'"), ["event_id"]))


def _refreshed(t: Derived, name: str) -> DataFrame:
    """A table of the chain after the filings with every fifth number came late, in two refreshes; made once for the queries that read it."""
    root = f"{shared_folder(t.spark)}/chain-{t.spark.sparkContext.applicationId}-{zlib.crc32(t.domain.dir.encode())}"
    tables = Periods(t.spark, root, recompute.chain_schemas(t.effective, t.filing, t.holding))
    number = F.pmod("filing_id", F.lit(10))
    for version, late in enumerate((number % 5 != 0, number == 0, number == 5), 1):
        if tables.version() < version:
            arrived = t.effective if version == 3 else t.effective.where(number != 5) if version == 2 else t.effective.where(late)
            recompute.refresh(tables, t.effective.where(late), arrived, t.filing, t.holding)
    return tables.table(name)


_SNAPSHOT = _CELLS + " shares:f value_usd:f weight_pct:f"
add("drv20_recomputed_snapshot", _SNAPSHOT, "SELECT * FROM snapshot")(lambda t: _refreshed(t, "snapshot"))
add("drv20_recomputed_prices", "security_id:l period:d price:f confidence:s observation_count:l agreeing_count:l", "SELECT * FROM price")(lambda t: _refreshed(t, "prices"))
add("drv20_recomputed_verdicts", "security_id:l period:d numerator:l denominator:l holders:l holders_agreeing:l shares_ratio:f price_ratio:f confidence:s", "SELECT * FROM verdict")(lambda t: _refreshed(t, "verdicts"))
add("drv20_recomputed_change", _CELLS + " prev_period:d action:s shares_delta:f value_delta:f is_split:b", "SELECT * FROM change")(lambda t: _refreshed(t, "change"))
