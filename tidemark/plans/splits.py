"""Queries of splits, split-adjusted figures and returns, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change, price, returns, snapshot
from .catalog import add
from .derived import Derived

_CANDIDATE = "security_id:l period:d numerator:l denominator:l holders:l holders_agreeing:l holders_exact:l shares_ratio:f price_ratio:f"
add("drv06_split_candidates", _CANDIDATE, "SELECT * FROM candidate")(lambda t: price.split_candidates(t.snapshot, t.prices))
add("drv07_split_verdicts", _CANDIDATE + " confidence:s", "SELECT * FROM verdict")(lambda t: t.fresh("verdicts"))
add(
    "drv08_outliers", "security_id:l period:d shares_ratio:f price_ratio:f",
    """SELECT * FROM verdict WHERE confidence IS NULL AND ((shares_ratio >= 2.5 AND price_ratio * 2.5 <= 1)
      OR (shares_ratio < 1 AND 1 / shares_ratio >= 2.5 AND 1 / price_ratio * 2.5 <= 1))""",
)(lambda t: t.verdicts.where(price.is_outlier()))


def _one_holder(t: Derived) -> DataFrame:
    """Moves of single holders, with the price each reported against the one before."""
    rows = t.change.where("action in ('add', 'trim', 'hold')")
    now, then = (F.try_divide(F.col(f"{p}value_usd").cast("double"), F.col(f"{p}shares").cast("double")) for p in ("", "prev_"))
    return rows.withColumn("moved", F.round(F.try_divide(now, then), 10).cast("decimal(28,10)")).where(price.looks_like_split(F.col("prev_shares"), F.col("shares"), F.col("moved")))


#: Moves of single holders that look like splits, for DuckDB.
LIKE_SQL = f"""SELECT c.* FROM (SELECT *, round((value_usd::DOUBLE / shares::DOUBLE) / (prev_value_usd::DOUBLE / prev_shares::DOUBLE), 10) AS moved, shares::DOUBLE / prev_shares::DOUBLE AS r
        FROM change WHERE action IN ('add', 'trim', 'hold')) c
      LEFT JOIN (VALUES {price.FRACTIONS_SQL}) f(n, d) ON greatest(r * d / n, n / (r * d)) <= 1.25
      WHERE shares > 0 AND prev_shares > 0 AND (moved >= 2.5 OR moved <= 1 / 2.5 OR n IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY filer_id, period, security_id ORDER BY greatest(r * d / n, n / (r * d)) NULLS LAST) = 1
        AND (moved >= 2.5 OR moved <= 1 / 2.5 OR (moved * n / d BETWEEN 0.4 AND 1.6
          AND CASE WHEN n > d THEN (moved * n / d) * (moved * n / d) < n / d ELSE (moved * n / d) * (moved * n / d) > n / d END
          AND (abs(shares::DOUBLE * d - prev_shares::DOUBLE * n) <= d OR greatest(n / d, d / n) >= 3)))"""
add(
    "drv09_looks_like_split", "filer_id:l period:d security_id:l action:s moved:g",
    LIKE_SQL,
)(_one_holder)

#: Two-for-one splits in every eleventh quarter of a security, for the figures that splits adjust.
MADE_UP = "SELECT security_id, period, 2 AS numerator, 1 AS denominator FROM price WHERE (security_id + month(period) + year(period)) % 11 = 0"


def made_up(t: Derived) -> DataFrame:
    hit = F.pmod(F.col("security_id") + F.month("period") + F.year("period"), F.lit(11)) == 0
    return t.prices.where(hit).select("security_id", "period", F.lit(2).alias("numerator"), F.lit(1).alias("denominator"))


add(
    "drv10_split_adjusted_change", "filer_id:l period:d security_id:l action:s is_split:b shares_delta:f shares_delta_pct:f",
    """SELECT *, factor > 1 AS is_split, round(shares - prev_shares * factor, 4) AS shares_delta, round((shares - prev_shares * factor) * 100 / nullif(prev_shares * factor, 0), 6) AS shares_delta_pct,
      CASE WHEN abs(shares - prev_shares * factor) * 100 <= prev_shares * factor * 0.01 THEN 'hold' WHEN shares > prev_shares * factor THEN 'add' ELSE 'trim' END AS action
      FROM (SELECT c.filer_id, c.period, c.security_id, any_value(c.shares)::DOUBLE AS shares, any_value(c.prev_shares)::DOUBLE AS prev_shares, power(2, count(s.period)) AS factor
        FROM change c LEFT JOIN made_up s ON s.security_id = c.security_id AND s.period > c.prev_period AND s.period <= c.period WHERE c.action NOT IN ('new', 'exit') GROUP BY 1, 2, 3)""",
    made_up=MADE_UP,
)(lambda t: change.position_change(t.snapshot, made_up(t)).where("action not in ('new', 'exit')"))


def _with_suspects(t: Derived) -> DataFrame:
    return change.position_change(snapshot.position_snapshot(t.effective, t.filing, t.holding, include_suspect=True))


add(
    "drv10_suspect_changes", "filer_id:l period:d security_id:l action:s suspect:b",
    """SELECT c.*, (bad.filer_id IS NOT NULL OR before.filer_id IS NOT NULL) AS suspect FROM
        (SELECT s.filer_id, s.period, s.security_id, prev_period, CASE WHEN b.shares IS NULL THEN 'new' WHEN abs(s.shares - b.shares) * 100 <= b.shares * 0.01 THEN 'hold' WHEN s.shares > b.shares THEN 'add' ELSE 'trim' END AS action
         FROM every s JOIN periods p USING (filer_id, period) LEFT JOIN every b ON b.filer_id = s.filer_id AND b.security_id = s.security_id AND b.period = p.prev_period
         UNION ALL SELECT s.filer_id, next_period, s.security_id, s.period, 'exit' FROM every s JOIN periods p USING (filer_id, period)
         WHERE next_period IS NOT NULL AND NOT EXISTS (SELECT 1 FROM every n WHERE n.filer_id = s.filer_id AND n.security_id = s.security_id AND n.period = p.next_period)) c
      LEFT JOIN bad USING (filer_id, period) LEFT JOIN bad before ON before.filer_id = c.filer_id AND before.period = c.prev_period""",
    every="SELECT filer_id, period, security_id, sum(shares) AS shares FROM holding WHERE put_call IS NULL AND sshprnamt_type = 'SH' GROUP BY 1, 2, 3",
    periods="SELECT filer_id, period, lag(period) OVER (PARTITION BY filer_id ORDER BY period) AS prev_period, lead(period) OVER (PARTITION BY filer_id ORDER BY period) AS next_period FROM (SELECT DISTINCT filer_id, period FROM every)",
    bad="SELECT DISTINCT filer_id, period FROM filing WHERE parse_status = 'suspect'",
)(_with_suspects)
add(
    "drv25_adjusted_price", "security_id:l period:d price:f adjusted_price:f",
    """SELECT p.security_id, p.period, any_value(price) AS price, round(any_value(price) / power(2, count(s.period)), 8) AS adjusted_price
      FROM price p LEFT JOIN made_up s ON s.security_id = p.security_id AND s.period > p.period GROUP BY 1, 2""",
    made_up=MADE_UP,
)(lambda t: price.adjusted_price(t.prices, made_up(t)))

_FACTOR = "coalesce((SELECT product(numerator::DOUBLE / denominator) FROM used_split s WHERE s.security_id = p.security_id AND s.period > p.period AND s.period <= {until}), 1)"
#: The two estimated returns of every priced cell, for DuckDB, with the splits of the relation used_split.
RETURNS_SQL = f"""
  SELECT security_id, period, price AS implied_price, confidence AS price_confidence, close AS quote_close, date AS quote_date,
    CASE WHEN usable AND split_to_quote THEN round(to_quote, 10) END AS basis_split_ratio, CASE WHEN usable THEN round(price / to_quote, 8) END AS basis_price,
    CASE WHEN usable THEN round((close * to_quote / nullif(price, 0) - 1) * 100, 2) END AS estimated_return_pct,
    last_period AS last_quarter_period, last_price AS last_quarter_price, last_confidence AS last_quarter_confidence,
    CASE WHEN split_to_last THEN round(to_last, 10) END AS last_quarter_split_ratio, round((last_price * to_last / nullif(price, 0) - 1) * 100, 2) AS return_to_last_quarter_pct
  FROM (SELECT p.security_id, p.period, p.price, p.confidence, q.close, q.date, l.period AS last_period, l.price AS last_price, l.confidence AS last_confidence,
      q.date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM used_split s WHERE s.security_id = p.security_id AND s.period > q.date AND s.period <= last_day(date_trunc('quarter', q.date) + INTERVAL 2 MONTH)) AS usable,
      {_FACTOR.format(until="q.date")} AS to_quote, {_FACTOR.format(until="l.period")} AS to_last,
      EXISTS (SELECT 1 FROM used_split s WHERE s.security_id = p.security_id AND s.period > p.period AND s.period <= q.date) AS split_to_quote,
      EXISTS (SELECT 1 FROM used_split s WHERE s.security_id = p.security_id AND s.period > p.period AND s.period <= l.period) AS split_to_last
    FROM price p
    LEFT JOIN (SELECT security_id, date, close FROM quote QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY date DESC) = 1) q ON q.security_id = p.security_id AND q.date > p.period
    LEFT JOIN (SELECT security_id, period, price, confidence FROM price WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY period DESC) = 1) l
      ON l.security_id = p.security_id AND l.period > p.period)"""
#: The splits that the chain has found.
FOUND = "SELECT security_id, period, numerator, denominator FROM verdict WHERE confidence IS NOT NULL"
_RETURN = (
    "security_id:l period:d implied_price:f price_confidence:s quote_close:f quote_date:d basis_split_ratio:f basis_price:f estimated_return_pct:f "
    "last_quarter_period:d last_quarter_price:f last_quarter_confidence:s last_quarter_split_ratio:f return_to_last_quarter_pct:f"
)


def estimates(t: Derived, splits: DataFrame | None = None) -> DataFrame:
    """Returns of every priced cell, by the splits that the chain has found unless others are given."""
    return returns.estimated_return(t.prices.select("security_id", "period"), t.prices, t.domain.quote(), t.splits if splits is None else splits)


add("drv17_estimated_return", _RETURN, "SELECT * FROM estimate", used_split=FOUND, estimate=RETURNS_SQL)(estimates)
add("drv17_made_up_splits", _RETURN, "SELECT * FROM estimate", used_split=MADE_UP, estimate=RETURNS_SQL)(lambda t: estimates(t, made_up(t)))
