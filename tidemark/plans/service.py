"""Queries of the service's own tables, of the timeline, exports and reference checks, and their SQL twins. Events stand for runs, keys
and meters, customers for accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import asset_key
from ..operators import clusters, read, service
from ..operators.price import SPLIT_SQL as SPLITS
from ..sources import sinks
from .capitol import SQL as CAPITOL
from .capitol import _table as congress_table
from .capitol import _trade
from .catalog import PERIOD, add
from .derived import BUILDERS, Derived
from .people import _LISTS, _MATCHES, _duck, _lineitem

# ---------------------------------------------------------------- runs


def _runs(t: Derived) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.pmod("event_id", F.lit(7)) == 0, "running").otherwise("success")
    return t.domain.table("events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("job-"), F.pmod("user_id", F.lit(9)).cast("string")).alias("job_name"), status.alias("status"), F.col("ts").alias("started_at"), F.date_trunc("hour", "ts").alias("finished_at"))


_RUN = {"run": """SELECT event_id AS run_id, 'job-' || (user_id % 9) AS job_name, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'running' ELSE 'success' END AS status, ts AS started_at, date_trunc('hour', ts) AS finished_at FROM events"""}
add("ops07_recent_runs", "run_id:l job_name:s status:s", "SELECT * FROM (SELECT * FROM run WHERE job_name = 'job-3' ORDER BY started_at DESC, run_id LIMIT 20)", **_RUN)(lambda t: service.recent_runs(_runs(t), 20, "job-3"))
add("ops07_last_successes", "job_name:s run_id:l finished_at:t", "SELECT * FROM run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY finished_at DESC, run_id) = 1", **_RUN)(lambda t: service.last_successes(_runs(t)))
add(
    "qry26_freshness", "job_name:s run_id:l finished_at:t",
    "SELECT j.job_name, run_id, finished_at FROM (SELECT 'job-' || i AS job_name FROM range(12) r(i)) j LEFT JOIN (SELECT * FROM run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY finished_at DESC, run_id) = 1) USING (job_name)", **_RUN,
)(lambda t: service.freshness(_runs(t), t.spark.range(12).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_name"))))

# ---------------------------------------------------------------- accounts

_USERS = "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * (c_custkey % 300) END AS last_seen_at FROM customer"
_SUBS = "SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AS live, CASE WHEN c_custkey % 3 = 0 THEN 'pro' ELSE 'plus' END AS plan, CASE WHEN c_custkey % 10 = 0 THEN 'classic' END AS grandfathered FROM customer WHERE c_custkey % 2 = 0"
_GIVEN = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 3 = 0 AS live, CASE WHEN o_orderkey % 2 = 0 THEN 'pro' ELSE 'team' END AS plan, o_orderdate AS expires_at FROM orders WHERE o_orderkey % 10 = 0"
_TERMS = [("free", "history", "4"), ("free", "alerts", "1"), ("free", "exports", "0"), ("plus", "history", "12"), ("plus", "alerts", "20"), ("pro", "history", "40"), ("pro", "exports", "100"), ("classic", "alerts", "50"), ("team", "exports", "500")]
_OWN = "SELECT c_custkey AS user_id, 'alerts' AS key, CAST(c_custkey % 99 AS STRING) AS value FROM customer WHERE c_custkey % 14 = 0"


def _read(t: Derived, text: str, source: str) -> DataFrame:
    return t.spark.sql(text.replace(f"FROM {source}", "FROM {" + source + "}"), **{source: t.domain.table(source)})


def _accounts(t: Derived) -> DataFrame:
    keys = t.domain.table("events").where("event_type = 'click'").select(F.col("user_id"), F.col("ts").alias("last_used_at"))
    return service.accounts(_read(t, _USERS, "customer"), _read(t, _SUBS, "customer"), _read(t, _GIVEN, "orders"), keys)


_ACCOUNT_SQL = {
    "users": _USERS, "subs": _SUBS, "given": _GIVEN, "own_value": _duck(_OWN), "terms": f"SELECT * FROM (VALUES {', '.join(map(str, _TERMS))}) v(plan, key, value)",
    "account": """SELECT u.user_id, coalesce(o.plan, s.plan, 'free') AS plan, s.plan AS billed_plan, s.grandfathered AS grandfathered_plan, o.plan AS override_plan, o.expires_at AS override_expires_at, greatest(u.last_seen_at, k.used) AS last_seen_at
      FROM users u LEFT JOIN (SELECT * FROM subs WHERE live) s USING (user_id) LEFT JOIN (SELECT * FROM given WHERE live QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1) o USING (user_id)
      LEFT JOIN (SELECT user_id, max(ts) AS used FROM events WHERE event_type = 'click' GROUP BY 1) k USING (user_id)""",
}
add("ops01_accounts", "user_id:l plan:s billed_plan:s grandfathered_plan:s override_plan:s last_seen_at:t", "SELECT * FROM account", **_ACCOUNT_SQL)(_accounts)
add("ops06_plan_mix", "plan:s accounts:l", "SELECT plan, count(*) AS accounts FROM account GROUP BY 1", **_ACCOUNT_SQL)(lambda t: service.plan_mix(_accounts(t)))
add(
    "ops02_entitlements", "user_id:l key:s value:s",
    """SELECT a.user_id, f.key, coalesce(o.value, CASE WHEN billed_plan IS NOT NULL THEN coalesce(w.value, g.value, b.value) END, f.value) AS value FROM account a CROSS JOIN (SELECT key, value FROM terms WHERE plan = 'free') f
      LEFT JOIN terms o ON o.plan = a.override_plan AND o.key = f.key LEFT JOIN own_value w ON w.user_id = a.user_id AND w.key = f.key LEFT JOIN terms g ON g.plan = a.grandfathered_plan AND g.key = f.key
      LEFT JOIN terms b ON b.plan = a.billed_plan AND b.key = f.key""", **_ACCOUNT_SQL,
)(lambda t: service.entitlements(_accounts(t), _read(t, _OWN, "customer"), t.spark.createDataFrame(_TERMS, "plan string, key string, value string")))
add(
    "str08_metered", "account:l period_start:d used:l warned:b",
    "SELECT account, period_start, used, used * 100 >= lim * 80 AS warned FROM (SELECT user_id % 50 AS account, date_trunc('month', ts)::DATE AS period_start, max(event_id % 1000) AS used, 1000 + (user_id % 50) * 10 AS lim FROM events GROUP BY 1, 2, 4)",
)(
    lambda t: service.metered(
        t.domain.table("events").select(F.pmod("user_id", F.lit(50)).alias("account"), F.trunc("ts", "month").alias("period_start"), F.pmod("event_id", F.lit(1000)).alias("flushed")),
        t.spark.range(50).select(F.col("id").alias("account"), (F.col("id") * 10 + 1000).alias("limit")),
    )
)
_EACH = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS today, CAST(o_orderdate AS DATE) - CAST(o_custkey % 500 AS INT) AS anchor FROM orders"


def _days(t: Derived) -> DataFrame:
    rows = _read(t, _EACH, "orders")
    quota = service.quota_month(F.col("anchor"), F.col("today"))
    return rows.select("today", "anchor", service.months_before(F.col("today"), 6).alias("six"), service.history_from(F.col("today"), 8).alias("shown"), service.history_from(F.col("today"), 0).alias("none"), quota["start"].alias("first"), quota["end"].alias("last"))


_CURRENT = "CASE WHEN today = last_day(date_trunc('quarter', today) + INTERVAL 2 MONTH) THEN today ELSE (date_trunc('quarter', today) - INTERVAL 1 DAY)::DATE END"
_ON = "least((date_trunc('month', {0}) + INTERVAL 1 DAY * (day(anchor) - 1))::DATE, last_day({0}))"
add(
    "dat03_windows", "today:d anchor:d six:d shown:d none:d first:d last:d",
    f"""SELECT *, {_ON.format("(date_trunc('month', first) + INTERVAL 1 MONTH)")} AS last FROM
      (SELECT *, (today - INTERVAL 6 MONTH)::DATE AS six, last_day(date_trunc('month', {_CURRENT}) - INTERVAL 21 MONTH) AS shown, last_day(date_trunc('month', {_CURRENT}) + INTERVAL 3 MONTH) AS none,
         CASE WHEN {_ON.format("today")} <= today THEN {_ON.format("today")} ELSE {_ON.format("(date_trunc('month', today) - INTERVAL 1 MONTH)")} END AS first FROM each)""", each=_EACH,
)(_days)
add(
    "dat02_local_days", "event_id:l local_day:d starts_at:t",
    "SELECT event_id, local_day, timezone('UTC', timezone('America/New_York', local_day::TIMESTAMP)) AS starts_at FROM (SELECT event_id, timezone('America/New_York', ts AT TIME ZONE 'UTC')::DATE AS local_day FROM events)",
)(lambda t: t.domain.table("events").select("event_id", F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("local_day")).withColumn("starts_at", F.to_utc_timestamp(F.col("local_day").cast("timestamp"), "America/New_York")))

# ---------------------------------------------------------------- queues and coverage

_QUEUE = "SELECT lpad(CAST(o_orderkey AS STRING), 20, '0') AS accession_no, CASE WHEN o_orderkey % 5 = 0 THEN '4' WHEN o_orderkey % 2 = 0 THEN '13F-HR/A' ELSE '13F-HR' END AS form_type, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 4 <> 0"
_LOADED = "SELECT lpad(CAST(o_orderkey AS STRING), 20, '0') AS accession_no FROM orders WHERE o_orderkey % 4 < 2"
add(
    "ops04_backfill_plan", "accession_no:s status:s work:s mark_done:b",
    """SELECT accession_no, status, CASE WHEN l.has THEN 'skip' ELSE 'load' END AS work, coalesce(l.has AND status = 'pending', false) AS mark_done FROM (SELECT * FROM queue WHERE form_type LIKE '13F%') q FULL JOIN (SELECT *, true AS has FROM loaded) l USING (accession_no)""",
    queue=_duck(_QUEUE), loaded=_duck(_LOADED),
)(lambda t: service.backfill_plan(_read(t, _QUEUE, "orders"), _read(t, _LOADED, "orders")))
add(
    "snk06_reconciled_queue", "accession_no:s status:s",
    """SELECT accession_no, CASE WHEN accession_no IN (SELECT accession_no FROM loaded) THEN 'done' ELSE coalesce(q.status, 'pending') END AS status FROM (SELECT accession_no FROM queue UNION SELECT accession_no FROM found) LEFT JOIN queue q USING (accession_no)""",
    queue=_duck(_QUEUE), loaded=_duck(_LOADED), found="SELECT lpad(o_orderkey::VARCHAR, 20, '0') AS accession_no FROM orders WHERE o_orderkey % 6 = 0",
)(lambda t: service.reconciled_queue(_read(t, _QUEUE, "orders"), t.domain.table("orders").where("o_orderkey % 6 = 0").select(F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("accession_no")), _read(t, _LOADED, "orders")))


def _tried(t: Derived) -> DataFrame:
    extraction = F.when(F.col("id") % 3 == 0, "text").when(F.col("id") % 3 == 1, "ocr").otherwise("html")
    return congress_table(t, "report").where("chamber = 'house'").withColumns({"extraction": extraction, "parse_error": F.when(F.col("id") % 26 == 0, "no file")})


add(
    "ops05_table_coverage", "seen:l read:l review_only:l by_text:l by_ocr:l by_html:l placeholders:l missing:l rows_parsed:l rows_needs_review:l",
    """SELECT count(*) AS seen, count(*) FILTER (holder = 0 AND parsed > 0) AS read, count(*) FILTER (holder = 0 AND parsed = 0) AS review_only, count(*) FILTER (holder = 0 AND id % 3 = 0) AS by_text, count(*) FILTER (holder = 0 AND id % 3 = 1) AS by_ocr,
      count(*) FILTER (holder = 0 AND id % 3 = 2) AS by_html, count(*) FILTER (holder > 0) AS placeholders, count(*) FILTER (parser_version IS NULL) AS missing, coalesce(sum(parsed), 0) AS rows_parsed, coalesce(sum(review), 0) AS rows_needs_review
      FROM report r LEFT JOIN (SELECT filing_id, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'needs_review') AS review, count(*) FILTER (parse_status = 'placeholder') AS holder FROM dated GROUP BY 1) c ON c.filing_id = r.id
      WHERE chamber = 'house' AND (parser_version IS NOT NULL OR id % 26 = 0)""", **CAPITOL,
)(lambda t: service.table_coverage(_tried(t), _trade(t)))


def _unresolved(t: Derived) -> DataFrame:
    part = t.domain.table("part").select("p_partkey", "p_name", "p_type")
    lines = t.domain.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    key = asset_key(F.substring("p_type", 1, 2), F.lit(None).cast("string"), F.col("p_name"))
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), key.alias("key"), F.col("l_extendedprice").cast("decimal(14,2)").alias("dollars"))


add(
    "ops03_review_queue", "key:s lines:l dollars:f example:l",
    """SELECT * FROM (SELECT upper(substr(p_type, 1, 2)) || '||' || p_name AS key, count(*) AS lines, sum(l_extendedprice::DECIMAL(14,2)) AS dollars, min(l_orderkey * 10 + l_linenumber) AS example FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY 1 ORDER BY lines DESC, dollars DESC, key LIMIT 25 OFFSET 10)""",
)(lambda t: service.review_queue(_unresolved(t), 25, 10))

# ---------------------------------------------------------------- reference data


def _entries(t: Derived) -> DataFrame:
    return t.domain.amendment_cik().select("filer_id", "cik", (F.col("priority") == 2).alias("p")).select("filer_id", "cik", F.coalesce("p", F.lit(False)).alias("current"))


_EDGAR = [("upper(n_name) || ', INC.'", False), ("'The ' || n_name || ' CO'", False), ("translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01234567890123456789012345')", True), ("NULL", True)]
_NAMED = "SELECT n_nationkey AS filer_id, n_name AS display_name, 'qqqqqqqq' AS manager_name, CASE n_nationkey % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, (e, _) in enumerate(_EDGAR)) + " END AS edgar_name FROM nation"
add(
    "q15_filer_names", "filer_id:l cik:s warning:s name_mismatch:b",
    "SELECT filer_id, cik, CASE WHEN filings > 0 AND stale AND NOT current THEN 'stale' END AS warning, filer_id % 4 >= 2 AS name_mismatch FROM judged",
    judged="""SELECT filer_id, cik, coalesce(priority = 2, false) AS current, coalesce(filings, 0) AS filings, latest IS NULL OR latest < DATE '2001-03-31' AS stale FROM amendment_cik
      LEFT JOIN (SELECT filer_id, cik, count(*) AS filings, max(period) AS latest FROM amendment WHERE form_type = '13F-HR' GROUP BY 1, 2) USING (filer_id, cik)""",
)(lambda t: service.verified_investors(_entries(t).join(t.spark.sql(_NAMED.replace("FROM nation", "FROM {nation}"), nation=t.domain.table("nation")), "filer_id"), t.domain.amendment(), "2001-08-20"))
add(
    "q15_verified_investors", "filer_id:l cik:s current:b filings:l earliest:d latest:d failure:s warning:s",
    """SELECT *, CASE WHEN filings = 0 THEN 'no_13f' WHEN stale AND current THEN 'stale' END AS failure, CASE WHEN filings > 0 AND stale AND NOT current THEN 'stale' END AS warning FROM
      (SELECT filer_id, cik, coalesce(priority = 2, false) AS current, coalesce(filings, 0) AS filings, earliest, latest, latest IS NULL OR latest < DATE '2001-03-31' AS stale FROM amendment_cik
       LEFT JOIN (SELECT filer_id, cik, count(*) AS filings, min(period) AS earliest, max(period) AS latest FROM amendment WHERE form_type = '13F-HR' GROUP BY 1, 2) USING (filer_id, cik))""",
)(lambda t: service.verified_investors(_entries(t), t.domain.amendment(), "2001-08-20"))
add(
    "q16_additions_check", "added:l already_listed:l previous_imported:b plausible:b",
    f"""SELECT *, already_listed * 100 <= added * 10 AS plausible FROM (SELECT count(*) AS added, count(*) FILTER (cusip IN (SELECT cusip FROM listed WHERE period = DATE '1998-06-30' AND status <> 'deleted')) AS already_listed,
      (SELECT count(*) > 0 FROM listed WHERE period = DATE '1998-06-30') AS previous_imported FROM (SELECT DISTINCT cusip FROM listed WHERE period = DATE '{PERIOD}' AND status = 'added'))""", listed=_duck(_LISTS),
)(lambda t: service.additions_check(_lineitem(t, _LISTS), PERIOD))
add("agg16_action_counts", "action:s rows:l", "SELECT action, count(*) AS rows FROM change GROUP BY 1")(lambda t: service.action_counts(t.change))
add("agg09_scope_size", "pairs:l filers:l periods:l", "SELECT count(DISTINCT (filer_id, period)) AS pairs, count(DISTINCT filer_id) AS filers, count(DISTINCT period) AS periods FROM snapshot WHERE security_id = 7 HAVING count(*) > 0")(lambda t: service.scope_size(t.snapshot.where("security_id = 7")))
add("agg12_empty_scope", "pairs:l filers:l periods:l", "SELECT count(*) AS pairs, count(*) AS filers, count(*) AS periods FROM snapshot WHERE security_id = -1 HAVING count(*) > 0")(lambda t: service.scope_size(t.snapshot.where("security_id = -1")))
add("src18_of_keys", "filer_id:l security_id:l period:d", "SELECT filer_id, security_id, period FROM snapshot WHERE (filer_id, security_id) IN ((3, 7), (5, 11), (99999, 1))")(
    lambda t: service.of_keys(t.snapshot.select("filer_id", "security_id", "period"), [(3, 7), (5, 11), (99999, 1)], ["filer_id", "security_id"])
)
add("src15_latest_answers", "cusip:s figi:s", "SELECT cusip, arg_max(figi, (place, figi)) AS figi FROM match GROUP BY 1", match=_duck(_MATCHES))(lambda t: sinks.latest(_lineitem(t, _MATCHES), ["cusip"], ["place", "figi"]))
add("fil14_form_prefix", "filing_id:l form_type:s", "SELECT filing_id, form_type FROM amendment WHERE form_type LIKE '13F-HR/%'")(lambda t: t.domain.amendment().where(F.col("form_type").startswith("13F-HR/")))
add("fil12_shown_history", "filer_id:l period:d portfolio_value:f", "SELECT * FROM summary WHERE period >= DATE '1997-03-31' AND period <= DATE '1998-12-31'")(
    lambda t: t.summary.where((F.col("period") >= service.history_from(F.lit("1999-02-10").cast("date"), 8)) & (F.col("period") <= F.lit("1998-12-31").cast("date")))
)

# ---------------------------------------------------------------- timeline, one filing, watchlists, exports

_FOLLOWED = [("insider", 7), ("insider", 30), ("stock", 7), ("stock", 12), ("investor", 3), ("investor", 8)]


def _follow(t: Derived) -> DataFrame:
    return t.spark.createDataFrame([*_FOLLOWED, ("stock", 14)], "kind string, target long")


def _unlinked(t: Derived) -> DataFrame:
    """Insider lines, every fifth of which names no security."""
    return t.lines.withColumn("security_id", F.when(F.col("id") % 5 != 0, F.col("security_id")))


def _listed_issuers(t: Derived) -> DataFrame:
    """Issuers with the securities that SEC lists for them."""
    spelled = t.security.select("security_id", F.translate("ticker", ".", "-").alias("ticker"))
    return t.domain.issuer_ticker().select(F.col("cik").alias("issuer_cik"), "ticker").join(spelled, "ticker").select("issuer_cik", "security_id")


add(
    "qry22_timeline", "happened_at:t id:s kind:s side:s filer_id:l security_id:l insider_id:l dollars:f",
    """SELECT * FROM (
      SELECT filed_at AS happened_at, '4:' || id AS id, 'insider_trade' AS kind, CASE WHEN transaction_code IN ('P', 'A', 'M') THEN 'acquire' WHEN transaction_code IN ('S', 'G') THEN 'dispose' ELSE 'neutral' END AS side, NULL AS filer_id, linked AS security_id, insider_id, value_usd AS dollars
        FROM (SELECT *, CASE WHEN id % 5 <> 0 THEN security_id END AS linked FROM insider_line) WHERE insider_id IN (7, 30) OR (transaction_code IN ('P', 'S') AND (linked IN (7, 12, 14)
          OR linked IS NULL AND issuer_cik IN (SELECT cik FROM issuer_ticker i JOIN security s ON i.ticker = replace(s.ticker, '.', '-') WHERE s.security_id IN (7, 12, 14))))
      UNION ALL SELECT filed_on::TIMESTAMP, '13f:' || filing_id, 'filing', 'neutral', filer_id, NULL, NULL, portfolio_value FROM feed WHERE filer_id IN (3, 8)
      UNION ALL SELECT happened_at, 'chg:' || filer_id || ':' || period || ':' || security_id, 'holder_change', CASE WHEN action IN ('new', 'add') THEN 'acquire' ELSE 'dispose' END, filer_id, security_id, NULL, dollars FROM
        (SELECT * FROM (SELECT *, round(traded, 2) AS dollars FROM flowing WHERE action <> 'hold' AND security_id IN (7, 12, 14)) JOIN (SELECT filer_id, slug FROM filer) USING (filer_id) QUALIFY row_number() OVER (PARTITION BY security_id, period ORDER BY dollars DESC, slug) <= 4)
        JOIN (SELECT filer_id, period, max(filed_on)::TIMESTAMP AS happened_at FROM feed GROUP BY 1, 2) USING (filer_id, period)) WHERE happened_at >= TIMESTAMP '1998-01-01 05:00:00' AND happened_at < TIMESTAMP '2024-01-20 05:00:00'""",
)(lambda t: service.timeline(_follow(t), _unlinked(t), t.change, t.feed, "1998-01-01", "2024-01-20", filer=t.filer, issuers=_listed_issuers(t), zone="America/New_York").withColumnRenamed("at", "happened_at"))
add(
    "qry27_one_filing", "filing_id:l accession_no:s security_id:l put_call:s sshprnamt_type:s shares:f value_usd:f",
    "SELECT h.filing_id, lpad(h.filing_id::VARCHAR, 20, '0') AS accession_no, security_id, put_call, sshprnamt_type, shares, value_usd FROM holding h WHERE filing_id = 37994",
)(lambda t: service.filing_with_holdings(t.filing, t.holding, "37994".zfill(20)))
add(
    "qry29_watchlist", "user_id:l kind:s target:l label:s figure:f",
    """SELECT 1 AS user_id, i.kind, i.target, x.label, x.figure FROM (VALUES ('insider', 7), ('insider', 30), ('stock', 7), ('stock', 12), ('investor', 3), ('investor', 8), ('stock', 999)) i(kind, target) LEFT JOIN
      (SELECT 'investor' AS kind, filer_id AS target, name AS label, figure FROM filer LEFT JOIN (SELECT filer_id, arg_max(portfolio_value, period)::DOUBLE AS figure FROM summary GROUP BY 1) USING (filer_id)
       UNION ALL SELECT 'stock', security_id, ticker, figure FROM security LEFT JOIN (SELECT security_id, arg_max(total_value, period)::DOUBLE AS figure FROM consensus GROUP BY 1) USING (security_id)
       UNION ALL SELECT 'insider', insider_id, transaction_date::VARCHAR, value_usd::DOUBLE FROM insider_line QUALIFY row_number() OVER (PARTITION BY insider_id ORDER BY transaction_date DESC, id DESC, value_usd DESC) = 1) x ON x.kind = i.kind AND x.target = i.target""",
)(lambda t: service.watched(t.spark.createDataFrame([(1, *f) for f in [*_FOLLOWED, ("stock", 999)]], "user_id long, kind string, target long"), t.filer, t.summary, t.security, t.consensus, t.lines))
_SOURCE = "SELECT filer_id, period, max(filing_id) AS source_filing_id FROM filing WHERE parse_status = 'ok' GROUP BY 1, 2"
_ABOUT = "lpad(source_filing_id::VARCHAR, 20, '0') AS accession_no, filed_at::DATE AS filed_on, false AS amended"
add(
    "qry30_export_activity", "filer_id:l period:d security_id:l action:s traded_usd:f accession_no:s filed_on:d amended:b",
    f"SELECT c.*, round(traded, 2) AS traded_usd, {_ABOUT} FROM flowing c JOIN source USING (filer_id, period) JOIN filing f ON f.filing_id = source_filing_id WHERE c.period = DATE '{PERIOD}' AND action <> 'hold'", source=_SOURCE,
)(lambda t: service.exported(service.with_source(read.activity(t.change, PERIOD, PERIOD), t.winning), t.filing))
add(
    "qry30_export_owners", "filer_id:l security_id:l shares:f value_usd:f action:s name:s accession_no:s filed_on:d amended:b",
    f"SELECT s.filer_id, s.security_id, s.shares, s.value_usd, action, name, {_ABOUT} FROM snapshot s LEFT JOIN change c USING (filer_id, security_id, period) JOIN filer USING (filer_id) JOIN source ON source.filer_id = s.filer_id AND source.period = s.period JOIN filing f ON f.filing_id = source.source_filing_id WHERE s.period = DATE '{PERIOD}'".replace("lpad(source_filing_id", "lpad(source.source_filing_id"),
    source=_SOURCE,
)(lambda t: service.exported(service.with_source(read.stock_owners(t.snapshot, t.change, t.filer, PERIOD).withColumn("period", F.lit(PERIOD).cast("date")), t.winning), t.filing))
add(
    "qry30_export_flows", "period:d security_id:l bought:f sold:f net:f buyers:l sellers:l ticker:s name:s cusip:s",
    f"SELECT f.*, ticker, name, cusip FROM flows f LEFT JOIN security USING (security_id) WHERE period = DATE '{PERIOD}'",
)(lambda t: t.flows.where(F.col("period") == F.lit(PERIOD).cast("date")).join(t.security.select("security_id", "ticker", "name", "cusip"), "security_id", "left"))
add(
    "qry30_export_insiders", "id:l transaction_date:d insider_id:l transaction_code:s value_usd:f accession_no:s filed_on:d amended:b",
    "SELECT *, lpad(filing_id::VARCHAR, 20, '0') AS accession_no, filed_at::DATE AS filed_on, filing_id % 8 = 0 AS amended FROM insider_line WHERE transaction_code IN ('P', 'S')",
)(
    lambda t: service.exported(read.insider_feed(t.lines).drop("filed_at"), t.lines.select("filing_id", F.lpad(F.col("filing_id").cast("string"), 20, "0").alias("accession_no"), "filed_at", F.when(F.col("filing_id") % 8 == 0, "4/A").otherwise("4").alias("form_type")), "filing_id")
)
add(
    "qry30_export_portfolio", "filer_id:l period:d security_id:l shares:f value_usd:f weight_pct:f accession_no:s filed_on:d amended:b",
    f"SELECT s.*, lpad(source_filing_id::VARCHAR, 20, '0') AS accession_no, filed_at::DATE AS filed_on, false AS amended FROM snapshot s JOIN filing f ON f.filing_id = source_filing_id WHERE s.period = DATE '{PERIOD}'",
)(lambda t: service.exported(t.snapshot.where(F.col("period") == F.lit(PERIOD).cast("date")), t.filing))

# ---------------------------------------------------------------- stored tables


def _refreshed(t: Derived) -> DataFrame:
    """All stored tables built anew in order of dependency, with the rows of each."""
    t.refresh()
    counts = [getattr(t, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in BUILDERS]
    return reduce(DataFrame.unionByName, counts)


_STORED = {
    "snapshot": "snapshot", "published": "filer_period", "prices": "price", "verdicts": "verdict", "change": "change", "consensus": "consensus", "flows": "flows", "summary": "summary", "year": "year_flows", "feed": "feed", "best": "filer_period",
}
add(
    "snk07_refreshed_tables", "name:s rows:l",
    " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows FROM {table}" for name, table in _STORED.items()) + " UNION ALL SELECT 'episodes', count(*) FROM (" + " UNION ALL ".join(f"({clusters.clusters_sql(*g)})" for g in clusters.GRID) + ")",
    **SPLITS,
)(_refreshed)
