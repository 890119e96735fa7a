"""Changes of positions between a filer's published periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, PERCENT, SHARES, WEIGHT, divided

#: Moves within this percentage of the previous shares are holds.
HOLD_PERCENT = 0.01


def _factor(first: str, last: str, splits: str = "splits") -> tuple[Column, Column]:
    """Numerator and denominator of all splits after the first period up to the last."""
    between = F.filter(F.col(splits), lambda s: (s["period"] > F.col(first)) & (s["period"] <= F.col(last)))
    product = lambda name: F.aggregate(between, F.lit(1).cast("long"), lambda a, s: a * s[name].cast("long"))
    return product("numerator"), product("denominator")


def with_splits(rows: DataFrame, splits: DataFrame | None) -> DataFrame:
    """Each row with an array of its security's splits; one shuffle by security and no row for each split."""
    if splits is None:
        return rows.withColumn("splits", F.array().cast("array<struct<period:date,numerator:int,denominator:int>>"))
    by = splits.where("numerator is not null").groupBy("security_id").agg(F.collect_list(F.struct("period", F.col("numerator").cast("int").alias("numerator"), F.col("denominator").cast("int").alias("denominator"))).alias("splits"))
    joined = rows.join(by, "security_id", "left")
    return joined.withColumn("splits", F.coalesce("splits", F.array().cast("array<struct<period:date,numerator:int,denominator:int>>")))


_FIGURES = ("shares", "value_usd", "weight_pct")


def position_change(snapshot: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """A row for each position of a published period, and one for each that the next published period lacks (exit).

    Positions are compared with the filer's previous published period, whatever the calendar says: absent then is new,
    within HOLD_PERCENT of the split-adjusted shares is hold, else add or trim. Value and weight deltas use the
    figures as they were. An exit is dated at the filer's next period and isn't adjusted. A row is suspect if its period or the
    one before was published with a suspect filing, for a new position too.

    The snapshot is dealt once, by filer: the window by position and the join to the filer's published periods, one row with each period's
    neighbours, need no other shuffle. Each row makes its own change and, where the next period lacks it, its exit, so there is no self-join.
    """
    by_position = Window.partitionBy("filer_id", "security_id").orderBy("period")
    published = snapshot.groupBy("filer_id", "period").agg(F.max("suspect").alias("suspect"))
    dates = published.groupBy("filer_id").agg(F.array_sort(F.collect_list(F.struct("period", "suspect"))).alias("dates"))
    at = lambda i: F.get("dates", i)
    near = lambda x, i: F.struct(x["period"], F.struct(at(i - 1)["period"].alias("prev_period"), at(i - 1)["suspect"].alias("prev_suspect"), at(i + 1)["period"].alias("next_period"), at(i + 1)["suspect"].alias("next_suspect")))
    neighbours = dates.select("filer_id", F.map_from_entries(F.transform("dates", near)).alias("near"))
    last = {f"last_{c}": F.lag(c).over(by_position) for c in ("period", *_FIGURES)} | {"held_next": F.lead("period").over(by_position)}
    rows = snapshot.repartition("filer_id").withColumns(last).join(neighbours, "filer_id")
    rows = rows.withColumn("near", F.col("near")[F.col("period")]).select("*", "near.*").drop("near")
    rows = rows.withColumns({f"prev_{c}": F.when(F.col("last_period") == F.col("prev_period"), F.col(f"last_{c}")) for c in _FIGURES})
    rows = with_splits(rows, splits)
    factors = dict(zip(("top", "bottom"), _factor("prev_period", "period"), strict=True))
    rows = rows.withColumns(factors)  # columns of their own, so that a row's products are worked out once
    top, bottom = F.col("top"), F.col("bottom")
    adjusted = F.when((top == 1) & (bottom == 1), F.col("prev_shares")).otherwise(divided(F.col("prev_shares").cast("decimal(20,4)") * top.cast("decimal(8,0)"), bottom.cast("decimal(8,0)"), 4))
    is_split = F.col("prev_shares").isNotNull() & (top != bottom)
    rows = rows.withColumns({"numerator": F.when(is_split, top), "denominator": F.when(is_split, bottom), "before": adjusted.cast(SHARES)})
    delta = F.col("shares") - F.col("before")
    action = F.when(F.col("prev_shares").isNull(), "new").when(F.abs(delta) * 100 <= F.col("before") * F.lit(HOLD_PERCENT).cast("decimal(4,2)"), "hold").when(delta > 0, "add").otherwise("trim")

    def less(column: str, was: str, kind: str) -> Column:
        return (F.col(column) - F.coalesce(was, F.lit(0).cast(kind))).cast(kind)

    compared = F.struct(
        "period", "prev_period", action.alias("action"), *_FIGURES, *(f"prev_{c}" for c in _FIGURES),
        less("shares", "before", SHARES).alias("shares_delta"), divided((delta * 100).cast("decimal(24,4)"), F.col("before"), 6).cast(PERCENT).alias("shares_delta_pct"),
        less("value_usd", "prev_value_usd", MONEY).alias("value_delta"), less("weight_pct", "prev_weight_pct", WEIGHT).cast("decimal(10,6)").alias("weight_delta"),
        "numerator", "denominator", F.col("numerator").isNotNull().alias("is_split"), (F.col("suspect") | F.coalesce("prev_suspect", F.lit(False))).alias("suspect"),
    )
    exited = F.struct(
        F.col("next_period").alias("period"), F.col("period").alias("prev_period"), F.lit("exit").alias("action"),
        *(F.lit(0).cast(t).alias(c) for c, t in zip(_FIGURES, (SHARES, MONEY, WEIGHT), strict=True)), *(F.col(c).alias(f"prev_{c}") for c in _FIGURES),
        (-F.col("shares")).cast(SHARES).alias("shares_delta"), F.when(F.col("shares") != 0, F.lit(-100)).cast(PERCENT).alias("shares_delta_pct"),
        (-F.col("value_usd")).cast(MONEY).alias("value_delta"), (-F.col("weight_pct")).cast("decimal(10,6)").alias("weight_delta"),
        F.lit(None).cast("long").alias("numerator"), F.lit(None).cast("long").alias("denominator"), F.lit(False).alias("is_split"), (F.col("suspect") | F.col("next_suspect")).alias("suspect"),
    )
    gone = F.col("next_period").isNotNull() & ~F.coalesce(F.col("held_next") == F.col("next_period"), F.lit(False))
    return rows.select("filer_id", "security_id", F.explode(F.array_compact(F.array(compared, F.when(gone, exited)))).alias("c")).select("filer_id", "c.period", "security_id", *(f"c.{x}" for x in _CHANGED))


_CHANGED = [
    "prev_period", "action", "shares", "prev_shares", "value_usd", "prev_value_usd", "weight_pct", "prev_weight_pct", "shares_delta", "shares_delta_pct",
    "value_delta", "weight_delta", "numerator", "denominator", "is_split", "suspect",
]


def traded_usd() -> Column:
    """Dollars of a change: shares moved at this period's value a share, of an exit at the previous one's.

    All shares moved, as of a new position or an exit, are the whole value, and none are nothing: only the rest is multiplied and divided.
    """
    moved, kind = F.abs("shares_delta"), "decimal(24,6)"

    def at(value: str, shares: str) -> Column:
        part = moved.cast("decimal(18,4)") * F.col(value).cast("decimal(16,2)") / F.nullif(shares, F.lit(0).cast(SHARES)).cast("decimal(18,4)")
        return F.when((moved == F.col(shares)) & (moved != 0), F.col(value).cast("decimal(16,2)").cast(kind)).when(moved == 0, F.lit(0).cast(kind)).otherwise(part.cast(kind))

    return F.coalesce(F.when(F.col("action") == "exit", at("prev_value_usd", "prev_shares")).otherwise(at("value_usd", "shares")), F.lit(0).cast(kind))


#: Changes for DuckDB, by the splits among the verdicts.
_PRODUCT = "coalesce((SELECT product({side}) FROM verdict v WHERE v.confidence IS NOT NULL AND v.security_id = s.security_id AND v.period > p.prev_period AND v.period <= s.period), 1)"
CHANGE_SQL = f"""SELECT filer_id, period, security_id, prev_period,
    CASE WHEN before IS NULL THEN 'new' WHEN abs(shares - before) * 100 <= before * 0.01 THEN 'hold' WHEN shares > before THEN 'add' ELSE 'trim' END AS action,
    shares, prev_shares, value_usd, prev_value_usd, weight_pct, prev_weight_pct,
    shares - coalesce(before, 0) AS shares_delta, round((shares - before)::DOUBLE * 100 / nullif(before, 0)::DOUBLE, 6) AS shares_delta_pct,
    value_usd - coalesce(prev_value_usd, 0) AS value_delta, round(weight_pct - coalesce(prev_weight_pct, 0), 6) AS weight_delta,
    before IS NOT NULL AND numerator <> denominator AS is_split, CASE WHEN before IS NOT NULL AND numerator <> denominator THEN numerator / denominator END AS split_ratio
  FROM (SELECT *, CASE WHEN numerator = denominator THEN prev_shares ELSE round(prev_shares::DOUBLE * numerator / denominator, 4)::DECIMAL(20,4) END AS before FROM
    (SELECT s.filer_id, s.period, s.security_id, p.prev_period, s.shares, s.value_usd, s.weight_pct, b.shares AS prev_shares, b.value_usd AS prev_value_usd, b.weight_pct AS prev_weight_pct,
       {_PRODUCT.format(side="numerator")} AS numerator, {_PRODUCT.format(side="denominator")} AS denominator
     FROM snapshot s JOIN published p USING (filer_id, period) LEFT JOIN snapshot b ON b.filer_id = s.filer_id AND b.security_id = s.security_id AND b.period = p.prev_period))
  UNION ALL SELECT s.filer_id, p.next_period, s.security_id, s.period, 'exit', 0, s.shares, 0, s.value_usd, 0, s.weight_pct, -s.shares, CASE WHEN s.shares <> 0 THEN -100 END, -s.value_usd, -s.weight_pct, false, NULL
  FROM snapshot s JOIN published p USING (filer_id, period) WHERE next_period IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snapshot n WHERE n.filer_id = s.filer_id AND n.security_id = s.security_id AND n.period = p.next_period)"""
PUBLISHED_SQL = "SELECT filer_id, period, lag(period) OVER (PARTITION BY filer_id ORDER BY period) AS prev_period, lead(period) OVER (PARTITION BY filer_id ORDER BY period) AS next_period FROM filer_period"
