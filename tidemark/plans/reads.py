"""Queries of listings with their sorts, filters and pages, and of recomputation's scopes, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paging, read, recompute, screener
from ..streaming import batches
from .catalog import PERIOD, add
from .derived import Derived
from .splits import FOUND, MADE_UP, RETURNS_SQL, estimates, made_up

_AT = f"period = DATE '{PERIOD}'"
_INVESTORS = """SELECT f.filer_id, name, category, s.period, portfolio_value, positions FROM filer f LEFT JOIN (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY period DESC) = 1) s USING (filer_id)"""
for _sort, _lead in (("value", "coalesce(portfolio_value, -1)"), ("positions", "coalesce(positions, -1)"), ("name", "name")):
    add(f"qry01_investors_by_{_sort}", "filer_id:l name:s portfolio_value:f positions:l", f"SELECT * FROM ({_INVESTORS} ORDER BY {_lead} DESC, filer_id DESC LIMIT 31)")(
        lambda t, s=_sort: read.sorted_page(read.investor_list(t.filer, t.summary, t.best), "investors", s, ["filer_id"], size=30)
    )
add("qry01_investor_search", "filer_id:l name:s category:s", "SELECT filer_id, name, category FROM filer WHERE category = 'quant' AND contains(lower(name), lower('R#00000000'))")(
    lambda t: read.investor_list(t.filer, t.summary, t.best, category="quant", search="R#00000000")
)
add("qry02_investor_ciks", "filer_id:l first_period:d ciks:s", "SELECT n_nationkey::BIGINT AS filer_id, min(f.period) AS first_period, (SELECT string_agg(DISTINCT cik, ' ' ORDER BY cik) FROM amendment a WHERE a.filer_id = n_nationkey) AS ciks FROM nation LEFT JOIN filer_period f ON f.filer_id = n_nationkey GROUP BY 1, 3, n_nationkey")(
    lambda t: read.investor_detail(t.domain.amendment_filer(), t.published, t.domain.amendment()).withColumn("ciks", F.array_join("ciks", " "))
)

# ---------------------------------------------------------------- portfolios

_PORTFOLIO = f"""SELECT *, coalesce(weight_pct, -1) AS weight_key, CASE WHEN action IS NULL THEN -1e22 ELSE coalesce(shares_delta_pct, 1e22) END AS change_key FROM
  (SELECT s.filer_id, s.security_id, NULL AS put_call, s.shares, s.value_usd, s.weight_pct, c.action, c.shares_delta_pct FROM snapshot s LEFT JOIN change c USING (filer_id, security_id, period) WHERE s.{_AT}
   UNION ALL SELECT filer_id, security_id, put_call, sum(shares), sum(value_usd), NULL, NULL, NULL FROM holding WHERE {_AT} AND put_call IS NOT NULL AND sshprnamt_type = 'SH' GROUP BY 1, 2, 3)"""


def _portfolio(t: Derived) -> DataFrame:
    return read.portfolio(t.snapshot, t.change, PERIOD, t.holding)


for _sort, _lead in (("weight", "weight_key"), ("value", "value_usd"), ("shares", "shares"), ("change", "change_key")):
    for _way, _down in (("desc", True), ("asc", False)):
        add(f"qry03_portfolio_by_{_sort}_{_way}", "filer_id:l security_id:l put_call:s value_usd:f", f"SELECT * FROM (SELECT *, coalesce(put_call, '') AS option FROM ({_PORTFOLIO}) ORDER BY {_lead} {_way}, value_usd {_way}, filer_id {_way}, security_id {_way}, option {_way} LIMIT 51)")(
            lambda t, s=_sort, d=_down: read.sorted_page(_portfolio(t).withColumn("option", F.coalesce("put_call", F.lit(""))), "portfolio", s, ["value_usd", "filer_id", "security_id", "option"], d)
        )
add(
    "qry03_portfolio_actions", "filer_id:l security_id:l action:s ticker:s", f"SELECT p.*, ticker FROM ({_PORTFOLIO}) p JOIN security USING (security_id) WHERE action IN ('new', 'trim') AND contains(lower(name), 'brand 1')",
)(
    lambda t: _portfolio(t).where(F.col("action").isin("new", "trim")).join(t.security.where(F.lower("name").contains("brand 1")).select("security_id", "ticker"), "security_id")
)
_WITH = {"used_split": FOUND, "made_up": MADE_UP, "estimate": RETURNS_SQL}
_RETURNS = "implied_price:f estimated_return_pct:f return_to_last_quarter_pct:f"
add(
    "qry03_portfolio_returns", f"filer_id:l security_id:l {_RETURNS}",
    f"SELECT s.filer_id, s.security_id, e.implied_price, e.estimated_return_pct, e.return_to_last_quarter_pct FROM snapshot s LEFT JOIN estimate e USING (security_id, period) WHERE s.{_AT}", **_WITH,
)(lambda t: t.snapshot.where(F.col("period") == F.lit(PERIOD).cast("date")).select("filer_id", "security_id", "period").join(estimates(t), ["security_id", "period"], "left"))
add(
    "qry08_owners_with_returns", f"filer_id:l security_id:l name:s {_RETURNS}",
    f"SELECT s.filer_id, s.security_id, name, e.implied_price, e.estimated_return_pct, e.return_to_last_quarter_pct FROM snapshot s JOIN filer USING (filer_id) LEFT JOIN estimate e USING (security_id, period) WHERE s.{_AT} AND s.security_id = 7", **_WITH,
)(
    lambda t: read.stock_owners(t.snapshot.where("security_id = 7"), t.change, t.filer, PERIOD).join(estimates(t).where(F.col("period") == F.lit(PERIOD).cast("date")).drop("period"), "security_id", "left")
)
add(
    "qry07_stock_coverage", "security_id:l period:d holder_count:l reported:l tracked:l",
    """SELECT c.security_id, c.period, c.holder_count, reported, (SELECT count(*) FROM filer) AS tracked FROM (SELECT * FROM consensus QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY period DESC) = 1) c
      JOIN (SELECT period, count(DISTINCT filer_id) AS reported FROM filer_period GROUP BY 1) USING (period)""",
)(lambda t: read.stock_detail(t.consensus, t.flows).join(read.period_coverage(t.published, t.filer, "2002-01-10"), "period"))

# ---------------------------------------------------------------- flows, feeds

_FLOWS = f"SELECT f.*, coalesce(holder_count, 0) AS holder_count FROM flows f LEFT JOIN consensus c USING (period, security_id) WHERE {_AT}"
for _number, _sort in enumerate(read.SORTS["flows"]):
    _way = "DESC" if _number % 2 == 0 else "ASC"
    add(f"qry14_flows_by_{_sort}", "security_id:l bought:f sold:f", f"SELECT * FROM ({_FLOWS} ORDER BY {_sort} {_way}, security_id {_way} LIMIT 11)")(
        lambda t, s=_sort, d=_number % 2 == 0: read.sorted_page(read.flows_screen(t.flows, t.consensus, PERIOD), "flows", s, ["security_id"], d, 10)
    )
add("qry15_next_page", "filing_id:l filed_on:d", "SELECT * FROM (SELECT * FROM feed WHERE filed_on < DATE '2001-02-01' OR (filed_on = DATE '2001-02-01' AND filing_id < 500000) ORDER BY filed_on DESC, filing_id DESC LIMIT 21)")(
    lambda t: paging.page(t.feed.withColumn("filed_on", F.to_date("filed_at")), [paging.Key("filed_on", True), paging.Key("filing_id", True)], 20, [F.lit("2001-02-01").cast("date"), 500000])
)
add("qry13_top_buys_net_full_year", "security_id:l net:f", "SELECT * FROM (SELECT security_id, net FROM year_flows WHERE period = DATE '1995-12-31' AND net > 0 ORDER BY net DESC, security_id DESC LIMIT 10)")(lambda t: read.top_moves(t.year, "1995-12-31", "buys", "net", 10))
_LINE = "id:l transaction_date:d insider_id:l issuer_cik:s security_id:l"


def _loose(t: Derived) -> DataFrame:
    """Insider lines of which every fourth is linked to no security."""
    return t.lines.withColumn("security_id", F.when(F.pmod("id", F.lit(4)) != 0, F.col("security_id")))


def _issuers(t: Derived) -> DataFrame:
    """Issuers whose ticker SEC spells as that of security 14."""
    own = t.security.where("security_id = 14").select(F.translate("ticker", ".", "-").alias("ticker"))
    return t.domain.issuer_ticker().join(own, "ticker", "left_semi").select(F.col("cik").alias("issuer_cik"))


_LOOSE = {"loose": "SELECT * REPLACE (CASE WHEN id % 4 <> 0 THEN security_id END AS security_id) FROM insider_line"}
add("qry16_filed_window", _LINE, "SELECT * FROM loose WHERE transaction_code IN ('P', 'S') AND filed_at >= DATE '2024-01-05' AND filed_at < DATE '2024-01-08' AND insider_id IN (3, 4, 5, 6, 7)", **_LOOSE)(
    lambda t: read.insider_feed(_loose(t), filed_first="2024-01-05", filed_last="2024-01-07", insiders=[3, 4, 5, 6, 7])
)
add(
    "qry16_stock_and_issuer", _LINE,
    "SELECT * FROM loose WHERE transaction_code IN ('P', 'S') AND (security_id = 14 OR (security_id IS NULL AND issuer_cik IN (SELECT cik FROM issuer_ticker JOIN security ON replace(security.ticker, '.', '-') = issuer_ticker.ticker WHERE security_id = 14)))", **_LOOSE,
)(lambda t: read.insider_feed(_loose(t), stocks=t.security.where("security_id = 14"), issuers=_issuers(t)))
for _sort, _lead in (("date", "transaction_date"), ("value", "coalesce(value_usd, -1)")):
    add(f"qry16_feed_by_{_sort}", _LINE, f"SELECT * FROM (SELECT * FROM insider_line WHERE transaction_code IN ('P', 'S') ORDER BY {_lead} DESC, id DESC LIMIT 41)")(lambda t, s=_sort: read.sorted_page(read.insider_feed(t.lines), "insiders", s, ["id"], size=40))

# ---------------------------------------------------------------- scopes of recomputation

add(
    "set04_split_keys", "security_id:l period:d",
    "SELECT security_id, period FROM snapshot WHERE filer_id = 7 AND period = DATE '1997-03-31' UNION SELECT security_id, DATE '1997-06-30' FROM snapshot WHERE filer_id = 7 AND period = DATE '1997-03-31'",
)(lambda t: recompute.split_keys(t.spark.sql("SELECT 7L AS filer_id, DATE '1997-03-31' AS period"), t.snapshot))
add(
    "set04_crossing_pairs", "filer_id:l period:d", "SELECT DISTINCT c.filer_id, c.period FROM change c JOIN made_up s ON s.security_id = c.security_id AND s.period > c.prev_period AND s.period <= c.period WHERE s.security_id = 7", made_up=MADE_UP,
)(lambda t: recompute.crossing(made_up(t).where("security_id = 7"), t.change))
add("fil09_contains", "filer_id:l slug:s", "SELECT filer_id, slug FROM filer WHERE contains(lower(slug), '-00000001')")(lambda t: t.filer.where(F.lower("slug").contains("-00000001")))
add("scr19_saved_screen", "filer_id:l security_id:l", f"SELECT filer_id, security_id FROM change WHERE {_AT} AND prev_period IS NOT NULL AND action IN ('new', 'add') AND weight_pct >= 8")(
    lambda t: screener.screen(screener.Tables(t.change, t.consensus, t.flows, t.filer), PERIOD, **screener.read_filters({"action": ["new", "add"], "min_weight": ["8"], "sector": "x", "gone": 1})[0])
)

# ---------------------------------------------------------------- mail

_NOW = "2024-01-20 12:20:00"
_USER = "SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS zone, c_custkey % 24 AS quiet_from, (c_custkey * 7) % 24 AS quiet_to, c_custkey % 4 AS sent_today, c_custkey % 5 < 2 AS digest_emails, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2024-01-20 19:00:00' END AS last_digest FROM customer"
_SINCE = "2024-01-18 00:00:00"
add(
    "str06_due_mail", "user_id:l action:s items:l",
    """SELECT user_id, 'digest' AS action, dd + sd AS items FROM decided WHERE goes UNION ALL SELECT user_id, CASE WHEN room THEN 'batch' ELSE 'to_digest' END, instant FROM decided WHERE ripe
      UNION ALL SELECT user_id, 'wait', 0 FROM decided WHERE NOT goes AND NOT ripe""",
    item=f"SELECT user_id, ts, CASE WHEN event_type = 'view' THEN 'digest' WHEN event_type = 'error' THEN 'season' ELSE 'instant' END AS kind FROM events WHERE ts > TIMESTAMP '{_SINCE}' AND ts <= TIMESTAMP '{_NOW}'",
    clock=f"SELECT *, timezone(zone, TIMESTAMP '{_NOW}' AT TIME ZONE 'UTC') AS here, date_trunc('day', here) + CASE WHEN hour(here) >= 19 THEN INTERVAL 19 HOUR ELSE INTERVAL (-5) HOUR END AS slot FROM ({_USER})",
    tally="""SELECT user_id, any_value(here) AS here, any_value(slot) AS slot, any_value(quiet_from) AS qf, any_value(quiet_to) AS qt, any_value(sent_today) AS sent, any_value(digest_emails) AS emails, any_value(last_digest) AS last, min(ts) FILTER (kind = 'instant') AS oldest,
        count(*) FILTER (kind = 'instant') AS instant, count(*) FILTER (kind = 'digest' AND due) AS dd, count(*) FILTER (kind = 'digest' AND NOT due) AS dl, count(*) FILTER (kind = 'season' AND due) AS sd, count(*) FILTER (kind = 'season' AND NOT due) AS sl
      FROM (SELECT *, timezone(zone, ts AT TIME ZONE 'UTC') <= slot AS due FROM item JOIN clock USING (user_id)) GROUP BY 1""",
    decided=f"""SELECT *, sent + (goes AND mailed > 0)::INT + (hour(here) < 19 AND (dl + CASE WHEN goes THEN 0 ELSE dd END > 0 OR emails AND (sl + CASE WHEN goes THEN 0 ELSE sd END > 0 OR month(here) IN (2, 5, 8, 11) AND day(here) <= 20)))::INT < 3 AS room
      FROM (SELECT *, dd + CASE WHEN emails THEN sd ELSE 0 END AS mailed, NOT quiet AND dd + sd > 0 AND NOT coalesce(last >= slot, false) AND (dd + CASE WHEN emails THEN sd ELSE 0 END = 0 OR sent < 3) AS goes,
          NOT quiet AND coalesce(oldest + INTERVAL 15 MINUTE <= TIMESTAMP '{_NOW}', false) AS ripe
        FROM (SELECT *, CASE WHEN qf = qt THEN false WHEN qf > qt THEN hour(here) >= qf OR hour(here) < qt ELSE hour(here) >= qf AND hour(here) < qt END AS quiet FROM tally))""",
)(
    lambda t: batches.due_mail(
        t.domain.table("events").where(f"ts > timestamp '{_SINCE}' and ts <= timestamp '{_NOW}'").select("user_id", F.when(F.col("event_type") == "view", "digest").when(F.col("event_type") == "error", "season").otherwise("instant").alias("kind"), F.col("ts").alias("since")),
        t.spark.sql(_USER.replace("FROM customer", "FROM {customer}"), customer=t.domain.table("customer")), _NOW,
    )
)

#: Days of events as a crawl's index; what was loaded falls short on some, until a second try of some of those.
_READ = "SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS listed, count(CASE WHEN event_id % {n} <> {r} THEN 1 END) AS loaded FROM events WHERE {where} GROUP BY 1, 2"
_TRIES = " UNION ALL ".join(f"SELECT * FROM ({_READ.format(n=n, r=r, where=w)}) t{n}" for n, r, w in ((149, 3, "true"), (367, 5, "CAST(ts AS DATE) > DATE '2024-01-10'")))
_BEGUN = "SELECT event_type AS source, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1"


def _crawl(t: Derived, text: str) -> DataFrame:
    return t.spark.sql(text.replace("FROM events", "FROM {events}"), events=t.domain.table("events"))


_WHOLE = {"tries": _TRIES, "begun": _BEGUN, "axis": "SELECT source, first_day, unnest(generate_series(first_day, DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day FROM begun", "whole": "SELECT DISTINCT source, day FROM tries WHERE loaded >= listed"}
add(
    "str01_crawl_progress", "source:s first_day:d watermark:d next_day:d done_ahead:l missing:l",
    """SELECT source, first_day, CASE WHEN next_day IS NULL THEN DATE '2024-02-02' WHEN next_day > first_day THEN next_day - 1 END AS watermark, next_day, missing, (SELECT count(*) FROM whole w WHERE w.source = h.source AND w.day > next_day) AS done_ahead
      FROM (SELECT a.source, first_day, min(a.day) FILTER (w.day IS NULL) AS next_day, count(*) FILTER (w.day IS NULL) AS missing FROM axis a LEFT JOIN whole w USING (source, day) GROUP BY 1, 2) h""", **_WHOLE,
)(lambda t: batches.crawl_progress(_crawl(t, _BEGUN), _crawl(t, _TRIES), "2024-02-02"))
add("str01_days_to_read", "source:s day:d", "SELECT source, day FROM axis ANTI JOIN whole USING (source, day)", **_WHOLE)(lambda t: batches.days_to_read(_crawl(t, _BEGUN), _crawl(t, _TRIES), "2024-02-02"))
