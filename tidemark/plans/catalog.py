"""Every query by name, over the driver's tables as the domain's, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import change, clusters, effective, paging, price, read, returns, screener, views
from .derived import SQL, Derived
from .domain import oracle
from .typed import typed, typed_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The quarter that queries of a single one ask for.
PERIOD, YEAR_BEFORE = "1998-09-30", "1997-12-31"


def add(name: str, spec: str, sql: str | None = None, **more: str):
    """Register a query: a function of Derived. sql: a table expression over SQL and the domain's tables."""

    def register(build: Callable[[Derived], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: typed(build(Derived(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[name] = oracle(typed_sql(spec, sql), **(SQL | more))
        return build

    return register


_SNAPSHOT = "filer_id:l period:d security_id:l shares:f value_usd:f weight_pct:f source_filing_id:l suspect:b"
_CHANGE = "filer_id:l period:d security_id:l prev_period:d action:s shares:f prev_shares:f value_usd:f prev_value_usd:f weight_pct:f prev_weight_pct:f shares_delta:f shares_delta_pct:f value_delta:f weight_delta:f is_split:b split_ratio:f"
_CONSENSUS = "period:d security_id:l holder_count:l total_value:f total_shares:f avg_weight:f median_weight:f value_rank:l"
_FLOWS = "period:d security_id:l bought:f sold:f net:f net_shares:f new_positions:l exits:l buyers:l sellers:l"
_AT = f"period = DATE '{PERIOD}'"

# ---------------------------------------------------------------- derived tables

add("drv12_consensus_holdings", _CONSENSUS, "SELECT * FROM consensus")(lambda t: t.fresh("consensus"))
add("drv01_effective_filing_by_cik", "filing_id:l filer_id:l cik:s period:d", "SELECT * FROM by_cik")(lambda t: t.amendments)
add("drv02_effective_filing", "filing_id:l filer_id:l cik:s period:d", "SELECT * FROM effective_filing")(
    lambda t: effective.effective_filing(t.amendments, t.domain.amendment_filer(), t.domain.amendment_cik())
)
add("qry31_resolved_filings", "filing_id:l filer_id:l cik:s period:d", "SELECT * FROM effective_filing WHERE period = DATE '1996-12-31'")(
    lambda t: effective.resolved_filings(effective.effective_filing(t.amendments, t.domain.amendment_filer(), t.domain.amendment_cik()), "1996-12-31")
)
add("drv03_position_snapshot", _SNAPSHOT, "SELECT * FROM snapshot")(lambda t: t.fresh("snapshot"))
add("drv04_filer_period", "filer_id:l period:d suspect:b", "SELECT * FROM filer_period")(lambda t: t.fresh("published"))
add("drv05_implied_price", "security_id:l period:d price:f confidence:s observation_count:l priced_count:l unpriced_count:l agreeing_count:l", "SELECT * FROM price")(lambda t: t.fresh("prices"))
add("drv10_position_change", _CHANGE, "SELECT * FROM change")(lambda t: t.fresh("change").withColumn("split_ratio", F.col("numerator") / F.col("denominator")))
add("drv11_traded_usd", "filer_id:l period:d security_id:l action:s traded:f", "SELECT * FROM flowing")(lambda t: t.change.where("prev_period is not null").withColumn("traded", change.traded_usd()))
add("drv13_quarter_flows", _FLOWS, "SELECT * FROM flows")(lambda t: t.fresh("flows"))
add("drv14_filer_summary", "filer_id:l period:d portfolio_value:f positions:l top10_weight:f turnover:f", "SELECT * FROM summary")(lambda t: t.fresh("summary"))
add("drv15_year_flows", _FLOWS, "SELECT * FROM year_flows")(lambda t: t.fresh("year"))
add("drv16_filing_feed", "filing_id:l filer_id:l period:d filed_on:d portfolio_value:f positions:l top_security_id:l top_action:s top_traded:f", "SELECT * FROM feed")(
    lambda t: t.fresh("feed").withColumn("filed_on", F.to_date("filed_at"))
)

add("jon10_latest_quote_before", "security_id:l period:d close:f", "SELECT p.security_id, p.period, q.close FROM price p ASOF LEFT JOIN quote q ON q.security_id = p.security_id AND p.period >= q.date")(
    lambda t: returns.latest_before(t.prices.select("security_id", "period"), t.domain.quote(), "security_id", "period", "date", "close")
)

# ---------------------------------------------------------------- insiders

_LINE = "id:l transaction_date:d insider_id:l issuer_cik:s transaction_code:s value_usd:f"
add("drv19_counted_purchases", "id:l issuer_cik:s insider_id:l excluded:s", "SELECT * FROM counted")(lambda t: clusters.counted_purchases(t.lines))
_EPISODE = "window_days:l min_insiders:l issuer_cik:s window_start:d window_end:d insiders:l lines:l shares:f value_usd:f security_id:l"
#: Windows so short that the driver's month of events falls into several episodes.
_SHORT = [(1, 2), (3, 2), (3, 3), (7, 3)]
add("drv18_insider_clusters", _EPISODE, " UNION ALL ".join(f"({clusters.clusters_sql(*g)})" for g in clusters.GRID))(lambda t: t.fresh("episodes"))
add("drv18_short_windows", _EPISODE, " UNION ALL ".join(f"({clusters.clusters_sql(*g)})" for g in _SHORT))(lambda t: clusters.cluster_grid(t.lines, _SHORT))
add(
    "qry17_cluster_breakdown", "issuer_cik:s window_start:d insider_id:l lines:l shares:f value_usd:f last_bought:d is_director:b",
    f"""SELECT e.issuer_cik, window_start, insider_id, count(*) AS lines, sum(l.shares) AS shares, sum(l.value_usd) AS value_usd, max(transaction_date) AS last_bought, bool_or(is_director) AS is_director
      FROM (SELECT issuer_cik, window_start, unnest(transaction_ids) AS id FROM ({clusters.clusters_sql(3, 2)})) e JOIN insider_line l USING (id) GROUP BY 1, 2, 3""",
)(lambda t: read.cluster_breakdown(clusters.insider_clusters(t.lines, 3, 2), t.lines))
add("qry16_insider_feed", _LINE, "SELECT * FROM insider_line WHERE transaction_code IN ('P', 'S') AND (is_director OR is_officer) AND value_usd >= 50 AND transaction_date >= DATE '2024-01-10'")(
    lambda t: read.insider_feed(t.lines, min_value=50, first="2024-01-10", roles=("director", "officer"))
)
add("qry16_insider_feed_page", _LINE, "SELECT * FROM (SELECT * FROM insider_line WHERE transaction_code IN ('P', 'S') ORDER BY transaction_date DESC, id DESC LIMIT 51)")(
    lambda t: paging.page(read.insider_feed(t.lines), [paging.Key("transaction_date", True), paging.Key("id", True)], 50)
)

# ---------------------------------------------------------------- market, investors, portfolios, stocks

add("qry12_top_holdings", _CONSENSUS, f"SELECT * FROM consensus WHERE {_AT} ORDER BY total_value DESC, security_id DESC LIMIT 10")(lambda t: read.top_holdings(t.consensus, PERIOD, 10))
add("qry12_top_holdings_by_holders", _CONSENSUS, f"SELECT * FROM consensus WHERE {_AT} ORDER BY holder_count DESC, total_value DESC, security_id DESC LIMIT 10")(lambda t: read.top_holdings(t.consensus, PERIOD, 10, "holders"))
for _side, _metric, _where, _order in (
    ("buys", "value", "bought > 0", "bought DESC"), ("buys", "net", "net > 0", "net DESC"), ("buys", "holders", "buyers > 0", "buyers DESC, bought DESC"),
    ("sells", "value", "sold > 0", "sold DESC"), ("sells", "net", "net < 0", "net"), ("sells", "holders", "sellers > 0", "sellers DESC, sold DESC"), ("new", "holders", "new_positions > 0", "new_positions DESC, bought DESC"),
):
    for _table in ("flows", "year"):
        add(f"qry13_top_{_side}_{_metric}_{'quarter' if _table == 'flows' else 'year'}", _FLOWS, f"SELECT * FROM {'flows' if _table == 'flows' else 'year_flows'} WHERE {_AT} AND {_where} ORDER BY {_order}, security_id DESC LIMIT 10")(
            lambda t, side=_side, metric=_metric, table=_table: read.top_moves(getattr(t, table), PERIOD, side, metric, 10)
        )
add(
    "qry14_flows_screen", _FLOWS + " holder_count:l total_value:f",
    f"SELECT f.*, coalesce(holder_count, 0) AS holder_count, coalesce(total_value, 0) AS total_value FROM flows f LEFT JOIN consensus c USING (period, security_id) WHERE {_AT} AND net > 0 AND coalesce(holder_count, 0) >= 3 AND bought + sold >= 1000",
)(lambda t: read.flows_screen(t.flows, t.consensus, PERIOD, "buy", 3, 1000))
add("qry15_market_activity", "filing_id:l filer_id:l period:d portfolio_value:f", "SELECT * FROM feed ORDER BY filed_on DESC, filing_id DESC LIMIT 20")(lambda t: read.market_activity(t.feed))
add(
    "qry01_investor_list", "filer_id:l name:s category:s period:d portfolio_value:f positions:l turnover:f top_security_id:l top_weight_pct:f",
    """SELECT f.*, s.period, portfolio_value, positions, turnover, b.security_id AS top_security_id, b.weight_pct AS top_weight_pct FROM filer f
      LEFT JOIN (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY filer_id ORDER BY period DESC) = 1) s USING (filer_id)
      LEFT JOIN (SELECT * FROM snapshot QUALIFY row_number() OVER (PARTITION BY filer_id, period ORDER BY value_usd DESC, security_id) = 1) b ON b.filer_id = f.filer_id AND b.period = s.period""",
)(lambda t: read.investor_list(t.filer, t.summary, t.best))
add(
    "qry02_investor_detail", "filer_id:l name:s slug:s category:s first_period:d last_period:d periods:l",
    "SELECT f.*, min(period) AS first_period, max(period) AS last_period, count(period) AS periods FROM filer f LEFT JOIN filer_period USING (filer_id) GROUP BY ALL",
)(lambda t: read.investor_detail(t.filer, t.published))
add(
    "drv22_sparkline", "filer_id:l values:s",
    f"""SELECT filer_id, array_to_string(list(coalesce(round(portfolio_value::DOUBLE, 2)::DECIMAL(20,2)::VARCHAR, '-') ORDER BY a.period), ' ') AS values FROM
      (SELECT filer_id, last_day(DATE '{PERIOD}' - (3 * n)::INT * INTERVAL 1 MONTH) AS period FROM filer, range(8) r(n)) a LEFT JOIN summary USING (filer_id, period) GROUP BY 1""",
)(lambda t: read.sparkline(t.filer, t.summary, PERIOD).withColumn("values", F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), " ")))
_PORTFOLIO = "filer_id:l security_id:l put_call:s shares:f value_usd:f weight_pct:f action:s shares_delta:f shares_delta_pct:f first_held:d weight_key:f change_key:f"
add(
    "qry03_portfolio", _PORTFOLIO,
    f"""SELECT *, coalesce(weight_pct, -1) AS weight_key, CASE WHEN action IS NULL THEN -1e22 ELSE coalesce(shares_delta_pct, 1e22) END AS change_key FROM
      (SELECT s.filer_id, s.security_id, NULL AS put_call, s.shares, s.value_usd, s.weight_pct, c.action, c.shares_delta, c.shares_delta_pct, (SELECT min(period) FROM snapshot h WHERE h.filer_id = s.filer_id AND h.security_id = s.security_id) AS first_held
        FROM snapshot s LEFT JOIN change c USING (filer_id, security_id, period) WHERE s.{_AT}
      UNION ALL SELECT filer_id, security_id, put_call, sum(shares), sum(value_usd), NULL, NULL, NULL, NULL, NULL FROM holding WHERE {_AT} AND put_call IS NOT NULL AND sshprnamt_type = 'SH' GROUP BY 1, 2, 3)""",
)(lambda t: read.portfolio(t.snapshot, t.change, PERIOD, t.holding))
add(
    "qry04_composition", "filer_id:l security_id:l value_usd:f weight_pct:f positions:l",
    f"""SELECT filer_id, CASE WHEN small AND smalls > 1 THEN NULL ELSE security_id END AS security_id, sum(value_usd) AS value_usd, sum(weight_pct) AS weight_pct, count(*) AS positions FROM
      (SELECT *, coalesce(weight_pct, 0) < 4 AS small, count(*) FILTER (coalesce(weight_pct, 0) < 4) OVER (PARTITION BY filer_id) AS smalls FROM snapshot WHERE {_AT}) GROUP BY 1, 2""",
)(lambda t: read.composition(t.snapshot, PERIOD, 4))
add(
    "qry05_activity", "filer_id:l period:d security_id:l action:s traded_usd:f",
    f"SELECT *, round(traded, 2) AS traded_usd FROM flowing WHERE period BETWEEN DATE '{YEAR_BEFORE}' AND DATE '{PERIOD}' AND action <> 'hold'",
)(lambda t: read.activity(t.change, YEAR_BEFORE, PERIOD))
add(
    "qry06_history", "filer_id:l period:d portfolio_value:f positions:l",
    """SELECT a.filer_id, a.period, portfolio_value, positions FROM (SELECT filer_id, last_day(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 3 MONTH))::DATE) AS period FROM summary GROUP BY 1) a
      LEFT JOIN summary USING (filer_id, period)""",
)(lambda t: read.history(t.summary))
add(
    "qry07_stock_detail", _CONSENSUS + " bought:f sold:f buyers:l sellers:l",
    "SELECT c.*, bought, sold, buyers, sellers FROM consensus c LEFT JOIN flows USING (security_id, period) QUALIFY row_number() OVER (PARTITION BY c.security_id ORDER BY c.period DESC) = 1",
)(lambda t: read.stock_detail(t.consensus, t.flows))
add(
    "qry08_stock_owners", "filer_id:l security_id:l shares:f value_usd:f weight_pct:f action:s shares_delta:f name:s",
    f"SELECT s.filer_id, s.security_id, s.shares, s.value_usd, s.weight_pct, action, shares_delta, name FROM snapshot s LEFT JOIN change c USING (filer_id, security_id, period) JOIN filer USING (filer_id) WHERE s.{_AT}",
)(lambda t: read.stock_owners(t.snapshot, t.change, t.filer, PERIOD))
add(
    "drv24_ownership_history", "security_id:l period:d holder:l shares:f value_usd:f holders:l",
    """SELECT s.security_id, s.period, f.filer_id AS holder, sum(shares) AS shares, sum(value_usd) AS value_usd, count(*) AS holders FROM snapshot s LEFT JOIN
      (SELECT security_id, filer_id FROM (SELECT *, max(period) OVER (PARTITION BY security_id) AS last FROM snapshot) WHERE period = last QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY value_usd DESC, filer_id) <= 5) f USING (security_id, filer_id) GROUP BY 1, 2, 3""",
)(lambda t: read.ownership_history(t.snapshot))
add(
    "drv23_price_series", "security_id:l period:d price:f confidence:s",
    """SELECT a.security_id, a.period, price, confidence FROM (SELECT security_id, last_day(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 3 MONTH))::DATE) AS period FROM price WHERE price IS NOT NULL GROUP BY 1) a
      LEFT JOIN (SELECT * FROM price WHERE price IS NOT NULL) USING (security_id, period)""",
)(lambda t: read.price_series(t.prices))
add(
    "drv23_ownership_series", "security_id:l period:d holder:l shares:f value_usd:f",
    """SELECT n.security_id, n.period, holder, CASE WHEN s.shares IS NOT NULL THEN s.shares WHEN p.filer_id IS NOT NULL THEN 0 END AS shares, CASE WHEN s.shares IS NOT NULL THEN s.value_usd WHEN p.filer_id IS NOT NULL THEN 0 END AS value_usd
      FROM grid n LEFT JOIN snapshot s ON s.security_id = n.security_id AND s.period = n.period AND s.filer_id = holder LEFT JOIN filer_period p ON p.filer_id = holder AND p.period = n.period
      UNION ALL SELECT a.security_id, a.period, NULL, sum(s.shares) - coalesce(sum(s.shares) FILTER (l.holder IS NOT NULL), 0), sum(s.value_usd) - coalesce(sum(s.value_usd) FILTER (l.holder IS NOT NULL), 0)
      FROM axis a LEFT JOIN snapshot s USING (security_id, period) LEFT JOIN largest l ON l.security_id = s.security_id AND l.holder = s.filer_id GROUP BY 1, 2""",
    axis="SELECT security_id, last_day(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 3 MONTH))::DATE) AS period FROM snapshot GROUP BY 1",
    largest="SELECT security_id, filer_id AS holder FROM (SELECT *, max(period) OVER (PARTITION BY security_id) AS last FROM snapshot) WHERE period = last QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY value_usd DESC, filer_id) <= 5",
    grid="SELECT * FROM axis JOIN largest USING (security_id)",
)(lambda t: read.ownership_series(t.snapshot, t.published))
add("drv21_first_held", "security_id:l filer_id:l first_held:d", "SELECT security_id, filer_id, min(period) AS first_held FROM snapshot GROUP BY 1, 2")(lambda t: t.snapshot.groupBy("security_id", "filer_id").agg(F.min("period").alias("first_held")))
add(
    "qry24_period_coverage", "period:d reported:l tracked:l complete:b",
    "SELECT period, count(DISTINCT filer_id) AS reported, (SELECT count(*) FROM filer) AS tracked, DATE '2002-01-10' > period + 45 AND count(DISTINCT filer_id) * 100 >= (SELECT count(*) FROM filer) * 95 AS complete FROM filer_period GROUP BY 1",
)(lambda t: read.period_coverage(t.published, t.filer, "2002-01-10"))
add(
    "qry23_upcoming_filings", "filer_id:l due:d",
    f"SELECT filer_id, DATE '{PERIOD}' + 45 AS due FROM filer_period WHERE period = DATE '1998-06-30' AND filer_id NOT IN (SELECT filer_id FROM filer_period WHERE {_AT})",
)(lambda t: read.upcoming_filings(t.published, PERIOD))
add("qry25_latest_filing", "period:d filings:l filers:l last_filed:d", "SELECT period, count(*) AS filings, count(DISTINCT filer_id) AS filers, max(filed_at)::DATE AS last_filed FROM filing WHERE parse_status = 'ok' GROUP BY 1")(
    lambda t: t.winning.groupBy("period").agg(F.count("*").alias("filings"), F.countDistinct("filer_id").alias("filers"), F.max("filed_at").alias("last_filed"))
)
