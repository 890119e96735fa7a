"""Queries of the screener: each filter, each sort, the stored screens and paging, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, lookup, paging, screener
from .catalog import PERIOD, add
from .derived import Derived
from .splits import FOUND, RETURNS_SQL, estimates

_SCREEN = "filer_id:l period:d security_id:l action:s value_usd:f weight_pct:f"
_KEYS = "filer_id:l period:d security_id:l"
#: Days by which the driver's insider lines are put back, so that half of them lie in PERIOD's quarter.
_BACK = 9239


def _lines(t: Derived) -> DataFrame:
    return t.lines.withColumn("transaction_date", F.date_sub("transaction_date", _BACK))


class Stored:
    """screener.Tables over the stored tables: one is built when a filter or a sort first asks for it, so a screen that looks at changes alone builds no others."""

    def __init__(self, t: Derived):
        self._builders = {
            "change": lambda: t.change, "consensus": lambda: t.consensus, "flows": lambda: t.flows, "filer": lambda: t.filer, "security": lambda: t.security, "issuer_ticker": lambda: t.domain.issuer_ticker(),
            "episodes": lambda: clusters.insider_clusters(_lines(t), 30, 3), "purchases": lambda: clusters.counted_purchases(_lines(t)).where("excluded is null"),
            "estimates": lambda: estimates(t), "tickers_then": lambda: lookup.tickers_on(t.domain.alias(), PERIOD),
        }

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        return self._builders[name]()


def tables(t: Derived) -> Stored:
    return Stored(t)


_AT = f"period = DATE '{PERIOD}'"
_QUARTER = f"DATE '{PERIOD}' - INTERVAL 3 MONTH + INTERVAL 1 DAY"
_LISTED = "SELECT security_id FROM security JOIN issuer_ticker ON issuer_ticker.ticker = replace(security.ticker, '.', '-')"
SQL = {
    "bought": f"SELECT * REPLACE (transaction_date - {_BACK} AS transaction_date) FROM counted WHERE excluded IS NULL",
    "in_quarter": f"SELECT * FROM bought WHERE transaction_date BETWEEN date_trunc('quarter', DATE '{PERIOD}') AND DATE '{PERIOD}'",
    "episode": clusters.clusters_sql(30, 3).replace("counted", "bought"),
    "overlapping": f"SELECT * FROM episode WHERE window_end >= date_trunc('quarter', DATE '{PERIOD}') AND window_start <= DATE '{PERIOD}'",
    "clustered": f"SELECT security_id FROM overlapping WHERE security_id IS NOT NULL UNION {_LISTED} WHERE cik IN (SELECT issuer_cik FROM overlapping)",
    "used_split": FOUND,
    "estimate": RETURNS_SQL,
}


def _buyers(least: int) -> str:
    issuers = f"SELECT issuer_cik FROM in_quarter GROUP BY 1 HAVING count(DISTINCT insider_id) >= {least}"
    return f"SELECT security_id FROM in_quarter WHERE security_id IS NOT NULL AND issuer_cik IN ({issuers}) UNION {_LISTED} WHERE cik IN ({issuers})"


def _chain(quarters: int) -> str:
    """Adds in a row, hop by hop through the previous periods."""
    joins = "".join(
        f" JOIN change c{n} ON c{n}.filer_id = c{n - 1}.filer_id AND c{n}.security_id = c{n - 1}.security_id AND c{n}.period = c{n - 1}.prev_period AND c{n}.action = 'add'" for n in range(1, quarters)
    )
    return f"(filer_id, security_id) IN (SELECT (c0.filer_id, c0.security_id) FROM change c0{joins} WHERE c0.{_AT} AND c0.action = 'add')"


_LATER, _HELD = "prev_period IS NOT NULL", "action <> 'exit'"


def _has(table: str, test: str) -> str:
    return f"security_id IN (SELECT security_id FROM {table} x WHERE x.{_AT} AND {test})"


def test_sql(filters: dict) -> str:
    """What the twin asks of a change of the period, for filters as the vocabulary reads them."""
    words = lambda v: ", ".join(f"'{x}'" for x in v)
    tests = [_LATER if "action" in filters else _HELD]
    for name, v in filters.items():
        tests.append(
            {
                "action": lambda v: f"action IN ({words(v)})", "min_value": lambda v: f"value_usd >= {v}", "min_weight": lambda v: f"weight_pct >= {v}",
                "filer_slug": lambda v: f"filer_id IN (SELECT filer_id FROM filer WHERE slug IN ({words(v)}))", "filer_category": lambda v: f"filer_id IN (SELECT filer_id FROM filer WHERE category IN ({words(v)}))",
                "net_flow": lambda v: _has("flows", "net > 0" if v == "buy" else "net < 0"), "min_holders": lambda v: _has("consensus", f"holder_count >= {v}"), "min_exits": lambda v: _has("flows", f"exits >= {v}"),
                "added_quarters": _chain, "insider_cluster": lambda v: f"security_id {'' if v else 'NOT '}IN (SELECT security_id FROM clustered)", "insider_buyers": lambda v: f"security_id IN ({_buyers(v)})",
                "is_new_position": lambda v: f"{_LATER} AND (action = 'new') = {v}", "weight_change": lambda v: f"{_LATER} AND weight_delta {'>=' if v > 0 else '<='} {v}",
            }[name](v)
        )
    return " AND ".join(tests)


#: Name, filters, and what the SQL twin asks of a change of the period.
FILTERED = [
    ("scr01_period", {}, _HELD),
    ("scr02_action", {"action": ["exit", "trim"]}, f"{_LATER} AND action IN ('exit', 'trim')"),
    ("scr03_min_holders", {"min_holders": 37}, f"{_HELD} AND {_has('consensus', 'holder_count >= 37')}"),
    ("scr04_min_value", {"min_value": 60000}, f"{_HELD} AND value_usd >= 60000"),
    ("scr05_min_weight", {"min_weight": 5}, f"{_HELD} AND weight_pct >= 5"),
    ("scr06_weight_change", {"weight_change": -2}, f"{_HELD} AND {_LATER} AND weight_delta <= -2"),
    ("scr06_weight_change_up", {"weight_change": 2}, f"{_HELD} AND {_LATER} AND weight_delta >= 2"),
    ("scr06_weight_change_none", {"weight_change": 0}, f"{_HELD} AND {_LATER} AND weight_delta <= 0"),
    ("scr08_filer_category", {"filer_category": ["activist", "quant"]}, f"{_HELD} AND filer_id IN (SELECT filer_id FROM filer WHERE category IN ('activist', 'quant'))"),
    ("scr09_filer_slug", {"filer_slug": ["supplier-000000003", "supplier-000000007"]}, f"{_HELD} AND filer_id IN (3, 7)"),
    ("scr10_net_flow", {"net_flow": "sell"}, f"{_HELD} AND {_has('flows', 'net < 0')}"),
    ("scr11_min_exits", {"min_exits": 22}, f"{_HELD} AND {_has('flows', 'exits >= 22')}"),
    ("scr12_is_new_position", {"is_new_position": True}, f"{_HELD} AND {_LATER} AND action = 'new'"),
    ("scr13_added_quarters", {"added_quarters": 2}, f"{_HELD} AND {_chain(2)}"),
    ("scr14_insider_cluster", {"insider_cluster": True}, f"{_HELD} AND security_id IN (SELECT security_id FROM clustered)"),
    ("scr14_no_insider_cluster", {"insider_cluster": False}, f"{_HELD} AND security_id NOT IN (SELECT security_id FROM clustered)"),
    ("scr15_insider_buyers", {"insider_buyers": 8}, f"{_HELD} AND security_id IN ({_buyers(8)})"),
]
for _name, _filters, _test in FILTERED:
    add(_name, _SCREEN, f"SELECT * FROM change WHERE {_AT} AND {_test}", **SQL)(lambda t, f=_filters: screener.screen(tables(t), PERIOD, **f))

add("jon17_clustered_securities", "security_id:l", "SELECT security_id FROM clustered", **SQL)(lambda t: screener.clustered_securities(tables(t), PERIOD))
add(
    "scr17_match_counts", "positions:l stocks:l investors:l",
    f"SELECT count(*) AS positions, count(DISTINCT security_id) AS stocks, count(DISTINCT filer_id) AS investors FROM change WHERE {_AT} AND {_HELD} AND weight_pct >= 5",
)(lambda t: screener.matches(screener.screen(tables(t), PERIOD, min_weight=5)))

# ---------------------------------------------------------------- sorts

#: What the SQL twin orders by, and its joins.
_TRADED = "CASE WHEN prev_period IS NOT NULL THEN (SELECT round(traded, 2) FROM flowing f WHERE f.filer_id = c.filer_id AND f.security_id = c.security_id AND f.period = c.period) END"
_FILER, _SECURITY = " JOIN filer USING (filer_id)", " LEFT JOIN security USING (security_id)"
_ESTIMATE = " LEFT JOIN estimate e ON e.security_id = c.security_id AND e.period = c.period"
SORTED = {
    "value": ("value_usd", ""), "weight": ("c.weight_pct", ""), "weight_change": ("weight_delta", ""), "prev_period": ("prev_period", ""), "shares": ("c.shares", ""),
    "shares_delta": ("shares_delta", ""), "shares_delta_pct": ("shares_delta_pct", ""), "traded": ("round(t.traded, 2)", " LEFT JOIN flowing t ON t.filer_id = c.filer_id AND t.security_id = c.security_id AND t.period = c.period"),
    "display_name": ("filer.name", _FILER), "slug": ("slug", _FILER), "category": ("category", _FILER), "cusip": ("cusip", _SECURITY), "current_ticker": ("ticker", _SECURITY),
    "delisted_by": ("delisted_by", _SECURITY), "issuer_name": ("security.name", _SECURITY),
    "ticker": ("coalesce((SELECT arg_max(a.ticker, coalesce(a.valid_from, DATE '0001-01-01')) FROM alias a WHERE a.security_id = c.security_id AND coalesce(a.valid_from <= c.period, true) AND coalesce(a.valid_to > c.period, true)), security.ticker)", _SECURITY),
    "action": ("list_position(['exit', 'trim', 'hold', 'add', 'new'], c.action)", ""), "holder_count": ("coalesce(h.holder_count, 0)", " LEFT JOIN consensus h ON h.security_id = c.security_id AND h.period = c.period"),
    "net_value_usd": ("f.net", " LEFT JOIN flows f ON f.security_id = c.security_id AND f.period = c.period"), "price_estimate": ("e.implied_price", _ESTIMATE),
    "estimated_return_pct": ("e.estimated_return_pct", _ESTIMATE), "return_to_last_quarter_pct": ("e.return_to_last_quarter_pct", _ESTIMATE),
    "estimated_return_as_of": ("CASE WHEN e.estimated_return_pct IS NOT NULL THEN e.quote_date END", _ESTIMATE),
    "last_quarter_period": ("CASE WHEN e.return_to_last_quarter_pct IS NOT NULL THEN e.last_quarter_period END", _ESTIMATE), "is_split": ("c.is_split::INTEGER", ""), "split_ratio": ("c.split_ratio", ""),
}


def _sorted_sql(sort: str, descending: bool) -> str:
    column, joins = SORTED[sort]
    way, ties = ("DESC" if descending else "ASC"), ("DESC" if descending or sort != "value" else "ASC")
    order = f"sort_value IS NULL, sort_value {way}, value_usd {ties}, filer_id {ties}, security_id {ties}"
    return f"SELECT * FROM (SELECT c.filer_id, c.period, c.security_id, c.value_usd, {column} AS sort_value FROM change c{joins} WHERE c.{_AT} AND c.action <> 'exit') ORDER BY {order} LIMIT 51"


for _number, _sort in enumerate(screener.SORTS):
    add(f"scr16_sort_{_sort}", _KEYS, _sorted_sql(_sort, _number % 2 == 0), **SQL)(
        lambda t, sort=_sort, down=_number % 2 == 0: screener.sorted_page(tables(t), screener.screen(tables(t), PERIOD), sort, down)
    )
add(
    "srt04_decorated_page", _KEYS + " display_name:s ticker:s",
    f"SELECT p.*, filer.name AS display_name, security.ticker FROM ({_sorted_sql('value', True)}) p JOIN filer USING (filer_id) LEFT JOIN security USING (security_id)", **SQL,
)(lambda t: screener.decorated(tables(t), screener.sorted_page(tables(t), screener.screen(tables(t), PERIOD), "value")))
add(
    "srt02_next_page", _SCREEN,
    f"SELECT * FROM change WHERE {_AT} AND {_HELD} AND (value_usd < 50000 OR (value_usd = 50000 AND filer_id > 3)) ORDER BY value_usd DESC, filer_id, security_id LIMIT 51",
)(
    lambda t: paging.page(screener.screen(tables(t), PERIOD), [paging.Key("value_usd", True), paging.Key("filer_id"), paging.Key("security_id")], 50, [50000, 3, 10**9])
)
add("srt07_offset_page", _SCREEN, f"SELECT * FROM change WHERE {_AT} AND {_HELD} ORDER BY value_usd DESC, filer_id, security_id LIMIT 25 OFFSET 40")(
    lambda t: paging.offset_page(screener.screen(tables(t), PERIOD), [paging.Key("value_usd", True), paging.Key("filer_id"), paging.Key("security_id")], 25, 40)
)

# ---------------------------------------------------------------- stored screens

_PRESET_TESTS = {
    "quiet-accumulation": f"{_HELD} AND {_chain(3)}",
    "insiders-buying-what-funds-are-buying": f"{_LATER} AND action IN ('new', 'add') AND security_id IN ({_buyers(1)})",
    "most-bought": f"{_LATER} AND action IN ('new', 'add') AND {_has('flows', 'net > 0')}",
    "most-sold": f"{_LATER} AND action IN ('trim', 'exit') AND {_has('flows', 'net < 0')}",
    "brand-new-positions": f"{_HELD} AND {_LATER} AND action = 'new'",
    "everyone-sold-out": f"{_LATER} AND action = 'exit' AND {_has('flows', 'exits >= 5')}",
    "big-bets": f"{_HELD} AND weight_pct >= 10",
}
for _name, (_, _sort) in screener.PRESETS.items():
    _value = {"value": "c.value_usd", "traded": "round(t.traded, 2)", "weight": "c.weight_pct"}[_sort]
    add(
        f"scr18_preset_{_name.replace('-', '_')}", _SCREEN,
        f"""SELECT c.*, {_value} AS sort_value FROM (SELECT * FROM change WHERE {_AT} AND {_PRESET_TESTS[_name]}) c
          LEFT JOIN flowing t ON t.filer_id = c.filer_id AND t.security_id = c.security_id AND t.period = c.period
          ORDER BY sort_value IS NULL, sort_value DESC, c.value_usd DESC, c.filer_id DESC, c.security_id DESC LIMIT 51""", **SQL,
    )(lambda t, name=_name: screener.preset(tables(t), name, PERIOD))
