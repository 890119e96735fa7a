"""The screener: a closed vocabulary of filters on position changes of one period, all of which must hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .change import traded_usd
from .paging import Key, page

#: Actions a position can have.
ACTIONS = ("new", "add", "hold", "trim", "exit")


@dataclass
class Tables:
    """What filters and sorts look at: changes, aggregates by period and security, filers, insider cluster episodes (of 30 days
    and 3 insiders) and counted purchases, the securities with their tickers, SEC's list of issuers' tickers, and estimated returns."""

    change: DataFrame
    consensus: DataFrame
    flows: DataFrame
    filer: DataFrame
    episodes: DataFrame | None = None
    purchases: DataFrame | None = None
    security: DataFrame | None = None
    issuer_ticker: DataFrame | None = None
    estimates: DataFrame | None = None
    tickers_then: DataFrame | None = None


def _later(rows: DataFrame) -> DataFrame:
    return rows.where("prev_period is not null")


def _semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def _action(t: Tables, rows: DataFrame, value: list[str]) -> DataFrame:
    if unknown := set(value) - set(ACTIONS):
        raise ValueError(f"no such action: {sorted(unknown)}")
    return _later(rows).where(F.col("action").isin(*value))


def _weight_change(t: Tables, rows: DataFrame, value: float) -> DataFrame:
    return _later(rows).where(F.col("weight_delta") >= value if value > 0 else F.col("weight_delta") <= value)


def _slugs(t: Tables, rows: DataFrame, value: list[str]) -> DataFrame:
    if len(value) > 50:
        raise ValueError("more than 50 filers")
    known = t.filer.where(F.col("slug").isin(*value))
    found = {r.slug for r in known.select("slug").distinct().limit(51).collect()}
    if missing := set(value) - found:
        raise ValueError(f"no such filer: {sorted(missing)}")
    return _semi(rows, known, ["filer_id"])


def _flow(t: Tables, rows: DataFrame, value: str) -> DataFrame:
    if value not in ("buy", "sell"):
        raise ValueError("net_flow is buy or sell")
    return _semi(rows, t.flows.where("net > 0" if value == "buy" else "net < 0"), ["period", "security_id"])


def added_runs(change: DataFrame) -> DataFrame:
    """Changes with `added_quarters`: how many adds in a row, in each filer's published periods, end here."""
    by = Window.partitionBy("filer_id", "security_id").orderBy("period")
    broken = F.sum(F.when(F.col("action") == "add", 0).otherwise(1)).over(by)
    run = Window.partitionBy("filer_id", "security_id", "__run").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return change.withColumn("__run", broken).withColumn("added_quarters", F.sum(F.when(F.col("action") == "add", 1).otherwise(0)).over(run)).drop("__run")


def _added(t: Tables, rows: DataFrame, value: int) -> DataFrame:
    if not 2 <= value <= 8:
        raise ValueError("added_quarters is 2 to 8")
    return _semi(rows, added_runs(t.change).where(F.col("added_quarters") >= value), ["filer_id", "security_id", "period"])


def issuer_securities(issuers: DataFrame, security: DataFrame, issuer_ticker: DataFrame) -> DataFrame:
    """security_id of each security whose present ticker SEC lists under the CIK of one of the issuers (issuer_cik).
    SEC writes a dash where tickers here have a point."""
    spelled = security.select("security_id", F.translate("ticker", ".", "-").alias("ticker"))
    listed = issuer_ticker.join(issuers.select(F.col("issuer_cik").alias("cik")).distinct(), "cik", "left_semi")
    return spelled.join(listed.select("ticker").distinct(), "ticker", "left_semi").select("security_id")


def _of_company(t: Tables, linked: DataFrame, issuers: DataFrame) -> DataFrame:
    """Securities linked to a line or episode, and those of the issuer by the spelling of their tickers."""
    own = linked.where("security_id is not null").select("security_id")
    return own.unionByName(issuer_securities(issuers, t.security, t.issuer_ticker)).distinct()


def clustered_securities(t: Tables, period: str) -> DataFrame:
    """Securities of companies with an episode that overlaps the period's quarter."""
    end = F.lit(period).cast("date")
    episodes = t.episodes.where((F.col("window_end") >= F.trunc(end, "quarter")) & (F.col("window_start") <= end))
    return _of_company(t, episodes, episodes)


def insider_bought_securities(t: Tables, period: str, least: int) -> DataFrame:
    """Securities of companies of which so many insiders bought in the period's quarter, each counted once."""
    end = F.lit(period).cast("date")
    lines = t.purchases.where(F.col("transaction_date").between(F.trunc(end, "quarter"), end))
    issuers = lines.groupBy("issuer_cik").agg(F.countDistinct("insider_id").alias("n")).where(F.col("n") >= least)
    return _of_company(t, lines.join(issuers, "issuer_cik", "left_semi"), issuers)


def _cluster(t: Tables, rows: DataFrame, value: bool, period: str) -> DataFrame:
    return rows.join(clustered_securities(t, period), "security_id", "left_semi" if value else "left_anti")


def _sector(t: Tables, rows: DataFrame, value: object) -> DataFrame:
    raise ValueError("sectors are not available")


def _buyers(t: Tables, rows: DataFrame, value: int, period: str) -> DataFrame:
    return rows.join(insider_bought_securities(t, period, value), "security_id", "left_semi")


FILTERS: dict[str, Callable] = {
    "action": _action,
    "min_holders": lambda t, rows, v: _semi(rows, t.consensus.where(F.col("holder_count") >= v), ["period", "security_id"]),
    "min_value": lambda t, rows, v: rows.where(F.col("value_usd") >= v),
    "min_weight": lambda t, rows, v: rows.where(F.col("weight_pct") >= v),
    "weight_change": _weight_change,
    "sector": _sector,
    "filer_category": lambda t, rows, v: _semi(rows, t.filer.where(F.col("category").isin(*v)), ["filer_id"]),
    "filer_slug": _slugs,
    "net_flow": _flow,
    "min_exits": lambda t, rows, v: _semi(rows, t.flows.where(F.col("exits") >= v), ["period", "security_id"]),
    "is_new_position": lambda t, rows, v: _later(rows).where((F.col("action") == "new") == v),
    "added_quarters": _added,
    "insider_cluster": _cluster,
    "insider_buyers": _buyers,
}

#: Filters that look at the period's quarter too.
_OF_QUARTER = ("insider_cluster", "insider_buyers")

#: The stored screens, each with its filters and its sort, largest first.
PRESETS = {
    "quiet-accumulation": ({"added_quarters": 3}, "value"),
    "insiders-buying-what-funds-are-buying": ({"action": ["new", "add"], "insider_buyers": 1}, "traded"),
    "most-bought": ({"action": ["new", "add"], "net_flow": "buy"}, "traded"),
    "most-sold": ({"action": ["trim", "exit"], "net_flow": "sell"}, "traded"),
    "brand-new-positions": ({"is_new_position": True}, "value"),
    "everyone-sold-out": ({"action": ["exit"], "min_exits": 5}, "traded"),
    "big-bets": ({"min_weight": 10}, "weight"),
}


def screen(tables: Tables, period: str, **filters: object) -> DataFrame:
    """Changes of the period that pass every filter. Without `action`, exits are left out; filters on changes never pass
    a filer's first period. An unknown name or value is a ValueError.

    The period comes first, so of a stored table only its partition is read, and each filter is a predicate or a semi join.
    """
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    rows = tables.change.where(F.col("period") == F.lit(period).cast("date"))
    if "action" not in filters:
        rows = rows.where("action <> 'exit'")
    for name, value in filters.items():
        rows = FILTERS[name](tables, rows, value, *([period] if name in _OF_QUARTER else []))
    return rows


def read_filters(saved: dict[str, object]) -> tuple[dict[str, object], list[str]]:
    """Saved filters read through the vocabulary: those that can still be read, and the names of those that can't."""
    kinds = {"min_holders": int, "min_value": float, "min_weight": float, "weight_change": float, "min_exits": int, "added_quarters": int, "insider_buyers": int}
    found: dict[str, object] = {}
    lost = []
    for name, value in saved.items():
        words = value if isinstance(value, list) else [value]
        try:
            if name == "action":
                ok = bool(words) and set(words) <= set(ACTIONS)
                found |= {name: list(words)} if ok else {}
            elif name in ("filer_category", "filer_slug"):
                ok = bool(words) and all(isinstance(w, str) and w for w in words)
                found |= {name: list(words)} if ok else {}
            elif name in ("is_new_position", "insider_cluster"):
                ok = str(words[0]).lower() in ("true", "false")
                found |= {name: str(words[0]).lower() == "true"} if ok else {}
            elif name == "net_flow":
                ok = words[0] in ("buy", "sell")
                found |= {name: words[0]} if ok else {}
            else:
                ok = name in kinds
                found |= {name: kinds[name](words[0])} if ok else {}
        except (TypeError, ValueError, IndexError):
            ok = False
        if not ok:
            lost.append(name)
    return found, lost


# ---------------------------------------------------------------- sorts

#: What a sort reads besides the changes, by the name of the sort.
_RANK = {"exit": 0, "trim": 1, "hold": 2, "add": 3, "new": 4}
_PLAIN = {
    "value": "value_usd", "weight": "weight_pct", "weight_change": "weight_delta", "prev_period": "prev_period", "shares": "shares", "shares_delta": "shares_delta",
    "shares_delta_pct": "shares_delta_pct",
}
_JOINED = {
    "display_name": ("filer", "name"), "slug": ("filer", "slug"), "category": ("filer", "category"), "cusip": ("security", "cusip"), "current_ticker": ("security", "ticker"),
    "delisted_by": ("security", "delisted_by"), "issuer_name": ("security", "name"), "net_value_usd": ("flows", "net"), "price_estimate": ("estimates", "implied_price"),
    "estimated_return_pct": ("estimates", "estimated_return_pct"), "return_to_last_quarter_pct": ("estimates", "return_to_last_quarter_pct"),
}
SORTS = (
    *_PLAIN, *_JOINED, "traded", "ticker", "action", "holder_count", "estimated_return_as_of", "last_quarter_period", "is_split", "split_ratio",
)


def sort_value(t: Tables, rows: DataFrame, sort: str) -> DataFrame:
    """Rows with `sort_value`, the field that the screen is ordered by, null where a row has none."""
    if sort not in SORTS:
        raise ValueError(f"no such sort: {sort}")
    if sort in _PLAIN:
        return rows.withColumn("sort_value", F.col(_PLAIN[sort]))
    keys = {"filer": ["filer_id"], "security": ["security_id"], "flows": ["period", "security_id"], "estimates": ["period", "security_id"]}
    if sort in _JOINED:
        table, column = _JOINED[sort]
        more = getattr(t, table).select(*keys[table], F.col(column).alias("sort_value"))
        return rows.join(more, keys[table], "left")
    if sort == "traded":
        return rows.withColumn("sort_value", F.when(F.col("prev_period").isNotNull(), F.round(traded_usd(), 2)))
    if sort == "action":
        return rows.withColumn("sort_value", F.coalesce(*(F.when(F.col("action") == a, F.lit(n)) for a, n in _RANK.items())))
    if sort == "ticker":
        now, then = t.security.select("security_id", F.col("ticker").alias("now")), t.tickers_then.select("security_id", F.col("ticker").alias("then"))
        full = rows.join(now, "security_id", "left").join(then, "security_id", "left")
        return full.withColumn("sort_value", F.coalesce("then", "now")).drop("now", "then")
    if sort == "holder_count":
        held = t.consensus.select("period", "security_id", F.col("holder_count").alias("sort_value"))
        return rows.join(held, ["period", "security_id"], "left").withColumn("sort_value", F.coalesce("sort_value", F.lit(0)))
    if sort in ("estimated_return_as_of", "last_quarter_period"):
        date, figure = ("quote_date", "estimated_return_pct") if sort == "estimated_return_as_of" else ("last_quarter_period", "return_to_last_quarter_pct")
        more = t.estimates.select("period", "security_id", F.when(F.col(figure).isNotNull(), F.col(date)).alias("sort_value"))
        return rows.join(more, ["period", "security_id"], "left")
    if sort == "is_split":
        return rows.withColumn("sort_value", F.col("is_split").cast("int"))
    return rows.withColumn("sort_value", F.col("numerator") / F.col("denominator"))


def sorted_keys(sort: str, descending: bool = True) -> list[Key]:
    """The sort, then the larger position, the filer and the security. Rows without a value are last whichever way it runs;
    by value, every key runs the same way."""
    ties = descending if sort == "value" else True
    return [Key("sort_value", descending), Key("value_usd", ties), Key("filer_id", ties), Key("security_id", ties)]


def sorted_page(t: Tables, rows: DataFrame, sort: str, descending: bool = True, size: int = 50, position: list[object] | None = None) -> DataFrame:
    """A page of a screen. The limit is taken on the sort's column alone; names are joined to the page (`decorated`)."""
    return page(sort_value(t, rows, sort), sorted_keys(sort, descending), size, position)


def decorated(t: Tables, rows: DataFrame) -> DataFrame:
    """A page with the names of its filers and tickers of its securities."""
    names = t.filer.select("filer_id", F.col("name").alias("display_name"), "slug", "category")
    return rows.join(names, "filer_id", "left").join(t.security.select("security_id", "ticker"), "security_id", "left")


def preset(t: Tables, name: str, period: str, size: int = 50) -> DataFrame:
    filters, sort = PRESETS[name]
    return sorted_page(t, screen(t, period, **filters), sort, size=size)


def matches(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("positions"), F.countDistinct("security_id").alias("stocks"), F.countDistinct("filer_id").alias("investors"))
