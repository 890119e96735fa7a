"""Market-wide aggregates of snapshots and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, SHARES, WEIGHT, divided, percent
from .change import traded_usd

#: Positions that the concentration of a portfolio counts.
TOP = 10


def consensus_holdings(snapshot: DataFrame) -> DataFrame:
    """Holders, totals, mean and median weight of each security in each period, and its rank by value. A filer has one position in a security, so rows are holders."""
    cells = snapshot.groupBy("period", "security_id").agg(
        F.count("filer_id").alias("holder_count"), F.sum("value_usd").cast(MONEY).alias("total_value"), F.sum("shares").cast(SHARES).alias("total_shares"),
        F.round(F.avg("weight_pct"), 6).cast(WEIGHT).alias("avg_weight"), F.round(F.percentile("weight_pct", 0.5).cast("decimal(18,8)"), 6).cast(WEIGHT).alias("median_weight"), F.max("suspect").alias("suspect"),
    )
    return cells.withColumn("value_rank", F.rank().over(Window.partitionBy("period").orderBy(F.col("total_value").desc())))


def _flowing(change: DataFrame) -> DataFrame:
    """Changes after a filer's first period, with the dollars they moved."""
    return change.where("prev_period is not null").withColumn("traded", traded_usd())


def quarter_flows(change: DataFrame) -> DataFrame:
    """What was bought and sold of each security, by how many, in each period; a filer's first period isn't a flow. A filer has one change of a
    security in a period, so rows are filers."""
    buy, sell = F.col("action").isin("new", "add"), F.col("action").isin("trim", "exit")
    count = lambda on: F.count(F.when(on, F.col("filer_id")))
    sums = _flowing(change).groupBy("period", "security_id").agg(
        F.coalesce(F.round(F.sum(F.when(buy, F.col("traded"))), 2), F.lit(0)).cast(MONEY).alias("bought"), F.coalesce(F.round(F.sum(F.when(sell, F.col("traded"))), 2), F.lit(0)).cast(MONEY).alias("sold"),
        F.sum("shares_delta").cast(SHARES).alias("net_shares"), count(F.col("action") == "new").alias("new_positions"), count(F.col("action") == "exit").alias("exits"),
        count(buy).alias("buyers"), count(sell).alias("sellers"),
    )
    return sums.withColumn("net", (F.col("bought") - F.col("sold")).cast(MONEY))


def year_flows(flows: DataFrame, change: DataFrame) -> DataFrame:
    """The same over the year that ends at each period with flows: sums of the quarters' rounded dollars, and filers counted once a year.

    A quarter belongs to four year ends at most, so each of the flows is dealt to its own ends and joined on equality with the ends there are. A filer counts
    from a change until its year is over or the next change of that kind comes, so the filers of a year end are a running sum of steps up and down,
    summed by security and quarter; no change is dealt to several ends.
    """
    ends = flows.select(F.col("period").alias("end")).distinct()

    def by_end(rows: DataFrame) -> DataFrame:
        steps = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.last_day(F.add_months(F.trunc("period", "month"), n * 3)))
        return rows.withColumn("end", F.explode(steps)).join(ends, "end")

    sums = by_end(flows).groupBy("end", "security_id").agg(F.sum("bought").cast(MONEY).alias("bought"), F.sum("sold").cast(MONEY).alias("sold"), F.sum("net").cast(MONEY).alias("net"), F.sum("net_shares").cast(SHARES).alias("net_shares"))
    moved = change.where("prev_period is not null and action <> 'hold'").select("period", "security_id", "filer_id", "action")
    counted = {"new_positions": ("new",), "exits": ("exit",), "buyers": ("new", "add"), "sellers": ("trim", "exit")}
    later = Window.partitionBy("filer_id", "security_id").orderBy(F.col("period").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_kind = {c: F.col("action").isin(*names) for c, names in counted.items()}
    moved = moved.withColumns({f"next_{c}": F.last(F.when(on, F.col("period")), ignorenulls=True).over(later) for c, on in is_kind.items()})
    over = F.last_day(F.add_months(F.trunc("period", "month"), 12))

    def step(end: Column, by: int, kinds: list[str]) -> Column:
        return F.struct(end.alias("end"), *(F.when(is_kind[c], by if c in kinds else 0).otherwise(0).alias(c) for c in counted))

    down = [F.when(is_kind[c], step(F.least(over, f"next_{c}"), -1, [c])) for c in counted]
    steps = moved.select("security_id", F.explode(F.array_compact(F.array(step(F.col("period"), 1, list(counted)), *down))).alias("s")).select("security_id", "s.*")
    daily = steps.groupBy("end", "security_id").agg(*(F.sum(c).alias(c) for c in counted))
    so_far = Window.partitionBy("security_id").orderBy("end")
    full = sums.withColumn("asked", F.lit(True)).join(daily, ["end", "security_id"], "full").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(so_far) for c in counted})
    return full.where("asked").drop("asked").withColumnRenamed("end", "period")


def filer_summary(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    """Value, positions, weight of the TOP largest, and turnover (half of what was traded, holds left out, against
    the previous portfolio) of each filer and period. A suspect period, or one before that changes are from, makes a row suspect."""
    largest = Window.partitionBy("filer_id", "period").orderBy(F.col("value_usd").desc(), "security_id")
    ranked = snapshot.withColumn("place", F.row_number().over(largest))
    total = ranked.groupBy("filer_id", "period").agg(
        F.sum("value_usd").cast(MONEY).alias("portfolio_value"), F.count("*").alias("positions"), F.sum(F.when(F.col("place") <= TOP, F.col("value_usd"))).cast(MONEY).alias("top_value"), F.max("suspect").alias("suspect")
    )
    moved = F.coalesce(F.sum(F.when(F.col("action") != "hold", F.col("traded"))), F.lit(0)).cast("decimal(24,6)")
    traded = _flowing(change).groupBy("filer_id", "period").agg(moved.alias("traded"), F.sum("prev_value_usd").cast(MONEY).alias("prev_value"), F.max("suspect").alias("suspect_change"))
    full = total.join(traded, ["filer_id", "period"], "left")
    return full.select(
        "filer_id", "period", "portfolio_value", "positions", percent(F.col("top_value"), F.col("portfolio_value")).cast("decimal(10,6)").alias("top10_weight"),
        divided(F.col("traded") * 50, F.col("prev_value"), 6).cast("decimal(16,6)").alias("turnover"),
        (F.col("suspect") | F.coalesce("suspect_change", F.lit(False))).alias("suspect"),
    )


def filing_feed(winning: DataFrame, summary: DataFrame, change: DataFrame) -> DataFrame:
    """A row for each filing that counts towards a published period: its portfolio and the period's largest trade
    (rounded dollars, then the greater security)."""
    trade = _flowing(change).where("action <> 'hold'").withColumn("traded", F.round("traded", 2))
    largest = trade.groupBy("filer_id", "period").agg(F.max(F.struct("traded", "security_id", "action")).alias("t"))
    full = winning.select("filing_id", "filer_id", "period", "filed_at").join(summary, ["filer_id", "period"]).join(largest, ["filer_id", "period"], "left")
    return full.select("filing_id", "filer_id", "period", "filed_at", "portfolio_value", "positions", F.col("t.security_id").alias("top_security_id"), F.col("t.action").alias("top_action"), F.col("t.traded").cast(MONEY).alias("top_traded"))


def top_holding(snapshot: DataFrame) -> DataFrame:
    """The largest position of each filer and period; ties go to the smaller security."""
    best = snapshot.groupBy("filer_id", "period").agg(F.max(F.struct("value_usd", (-F.col("security_id")).alias("s"), "weight_pct")).alias("t"))
    return best.select("filer_id", "period", (-F.col("t.s")).alias("security_id"), F.col("t.value_usd").alias("value_usd"), F.col("t.weight_pct").alias("weight_pct"))


CONSENSUS_SQL = """SELECT *, rank() OVER (PARTITION BY period ORDER BY total_value DESC) AS value_rank FROM (SELECT period, security_id, count(DISTINCT filer_id) AS holder_count, sum(value_usd)::DECIMAL(20,2) AS total_value,
  sum(shares)::DECIMAL(20,4) AS total_shares, ((2 * sum(round(weight_pct * 1000000)::HUGEINT) + count(weight_pct)) // (2 * count(weight_pct)))::DOUBLE / 1000000 AS avg_weight, round(quantile_cont(weight_pct, 0.5)::DECIMAL(18,8), 6) AS median_weight FROM snapshot GROUP BY 1, 2)"""
FLOWING_SQL = """SELECT *, round(coalesce(CASE WHEN action = 'exit' THEN abs(shares_delta)::DOUBLE * prev_value_usd::DOUBLE / nullif(prev_shares, 0)::DOUBLE ELSE abs(shares_delta)::DOUBLE * value_usd::DOUBLE / nullif(shares, 0)::DOUBLE END, 0), 6)::DECIMAL(24,6) AS traded
  FROM change WHERE prev_period IS NOT NULL"""
FLOWS_SQL = """SELECT *, round(bought - sold, 2) AS net FROM (SELECT period, security_id, round(coalesce(sum(traded) FILTER (action IN ('new', 'add')), 0), 2) AS bought, round(coalesce(sum(traded) FILTER (action IN ('trim', 'exit')), 0), 2) AS sold,
  sum(shares_delta)::DOUBLE AS net_shares, count(DISTINCT filer_id) FILTER (action = 'new') AS new_positions, count(DISTINCT filer_id) FILTER (action = 'exit') AS exits,
  count(DISTINCT filer_id) FILTER (action IN ('new', 'add')) AS buyers, count(DISTINCT filer_id) FILTER (action IN ('trim', 'exit')) AS sellers FROM flowing GROUP BY 1, 2)"""
YEAR_SQL = """SELECT e.period, security_id, bought, sold, net, net_shares, coalesce(new_positions, 0) AS new_positions, coalesce(exits, 0) AS exits, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers FROM
  (SELECT e.period, security_id, round(sum(bought), 2) AS bought, round(sum(sold), 2) AS sold, round(sum(net), 2) AS net, sum(net_shares) AS net_shares FROM (SELECT DISTINCT period FROM flows) e JOIN flows f ON f.period <= e.period AND f.period > e.period - INTERVAL 1 YEAR GROUP BY 1, 2) e
  LEFT JOIN (SELECT e.period, security_id, count(DISTINCT filer_id) FILTER (action = 'new') AS new_positions, count(DISTINCT filer_id) FILTER (action = 'exit') AS exits, count(DISTINCT filer_id) FILTER (action IN ('new', 'add')) AS buyers,
    count(DISTINCT filer_id) FILTER (action IN ('trim', 'exit')) AS sellers FROM (SELECT DISTINCT period FROM flows) e JOIN flowing f ON f.period <= e.period AND f.period > e.period - INTERVAL 1 YEAR AND action <> 'hold' GROUP BY 1, 2) c USING (period, security_id)"""
SUMMARY_SQL = """SELECT filer_id, period, portfolio_value, positions, round(top_value::DOUBLE * 100 / nullif(portfolio_value, 0)::DOUBLE, 6) AS top10_weight, round(traded::DOUBLE * 50 / nullif(prev_value, 0)::DOUBLE, 6) AS turnover FROM
  (SELECT filer_id, period, sum(value_usd)::DECIMAL(20,2) AS portfolio_value, count(*) AS positions, sum(value_usd) FILTER (place <= 10) AS top_value FROM
    (SELECT *, row_number() OVER (PARTITION BY filer_id, period ORDER BY value_usd DESC, security_id) AS place FROM snapshot) GROUP BY 1, 2)
  LEFT JOIN (SELECT filer_id, period, coalesce(sum(traded) FILTER (action <> 'hold'), 0) AS traded, sum(prev_value_usd) AS prev_value FROM flowing GROUP BY 1, 2) USING (filer_id, period)"""
FEED_SQL = """SELECT filing_id, filer_id, period, filed_at::DATE AS filed_on, portfolio_value::DOUBLE AS portfolio_value, positions, security_id AS top_security_id, action AS top_action, traded AS top_traded FROM filing JOIN summary USING (filer_id, period)
  LEFT JOIN (SELECT filer_id, period, security_id, action, round(traded, 2) AS traded FROM flowing WHERE action <> 'hold' QUALIFY row_number() OVER (PARTITION BY filer_id, period ORDER BY round(traded, 2) DESC, security_id DESC, action DESC) = 1) USING (filer_id, period)
  WHERE parse_status = 'ok'"""
