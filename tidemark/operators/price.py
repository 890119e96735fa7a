"""Prices that holdings imply, and splits that their share counts show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import PRICE
from ..functions.periods import next_quarter

#: Common forward splits as (numerator, denominator); each is looked for in reverse too.
FORWARD = [(3, 2), (2, 1), (3, 1), (4, 1), (5, 1), (10, 1), (20, 1), (25, 1), (50, 1)]
FRACTIONS = FORWARD + [(d, n) for n, d in FORWARD]
#: How near, as a factor, a ratio must lie to a fraction; holders that must agree; shares that an exact
#: holder may be off; what is an outlier; the band of price ratio times fraction; sizes from which agreement alone, and a majority, is enough.
NEAR, LEAST_AGREEING, EXACT_SHARES, OUTLIER, BAND, ANY_FROM, MAJORITY_FROM = 1.25, 2, 1, 2.5, (0.4, 1.6), 4, 3
#: Prices of holdings within this percentage of the median agree with it.
AGREE_PERCENT = 2


def implied_price(snapshot: DataFrame) -> DataFrame:
    """security_id, period, price, confidence, observation_count, priced_count, unpriced_count, agreeing_count, suspect.

    An observation is value over shares of a position with shares. The price is the discrete median of those with
    a value; positions within AGREE_PERCENT of it agree. Three that agree and are a majority make it high, two that are one
    medium, else it is low. Without any value price and confidence are null.
    """
    each = (F.col("value_usd").cast("decimal(20,2)") / F.col("shares").cast("decimal(17,4)")).cast("decimal(30,12)")
    seen = snapshot.where("shares > 0").select("security_id", "period", F.when(F.col("value_usd") > 0, each).alias("priced"), "suspect")
    seen = with_median(seen, ["security_id", "period"], "priced")
    agrees = F.abs(F.col("priced") - F.col("median")) * 100 <= F.col("median") * AGREE_PERCENT
    cells = seen.groupBy("security_id", "period").agg(
        F.max("median").alias("median"), F.count("*").alias("observation_count"), F.count("priced").alias("priced_count"), F.count_if(agrees).alias("agreeing_count"), F.max("suspect").alias("suspect"),
    ).withColumn("unpriced_count", F.col("observation_count") - F.col("priced_count"))
    majority = F.col("agreeing_count") * 2 > F.col("priced_count")
    grade = F.when((F.col("agreeing_count") >= 3) & majority, "high").when((F.col("agreeing_count") >= 2) & majority, "medium").otherwise("low")
    price = F.nullif(F.round("median", 8).cast(PRICE), F.lit(0).cast(PRICE))
    return cells.select("security_id", "period", price.alias("price"), F.when(price.isNotNull(), grade).alias("confidence"), "observation_count", "priced_count", "unpriced_count", "agreeing_count", "suspect")


def with_median(rows: DataFrame, cell: list[str], value: str, **found: Callable[[Column], Column]) -> DataFrame:
    """Rows with `median`, the lower middle of their cell's values as it is, and with what `found` makes of it, worked out once for a cell.

    A cell's rows are ordered once and stay rows, which Spark may spill, so none becomes a list, however many holders it has.
    """
    ordered = Window.partitionBy(*cell).orderBy(F.col(value).asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__place": F.row_number().over(ordered), "__count": F.count(value).over(whole)})
    middle = F.when(F.col("__place") == F.ceil(F.col("__count") / 2), F.col(value))
    rows = rows.withColumn("__middle", middle)
    return rows.withColumns({"median": F.max("__middle").over(whole), **{name: F.max(F.when(F.col("__middle").isNotNull(), make(F.col("__middle")))).over(whole) for name, make in found.items()}}).drop("__place", "__count", "__middle")


def split_candidates(snapshot: DataFrame, prices: DataFrame) -> DataFrame:
    """security_id, period, numerator, denominator, holders, holders_agreeing, holders_exact, shares_ratio, price_ratio.

    Holders are those with shares in the quarter and in the calendar quarter before. The discrete median of their ratios
    goes to the nearest of FRACTIONS, as a factor, if it lies within NEAR of it; holders within NEAR of the fraction
    agree, those at most EXACT_SHARES off are exact. Kept with LEAST_AGREEING holders or more, where that many
    agree or the median moved OUTLIER times either way.
    """
    by_position = Window.partitionBy("filer_id", "security_id").orderBy("period")
    held = snapshot.where("shares > 0").select("filer_id", "security_id", "period", "shares").withColumns({"was": F.lag("shares").over(by_position), "then": F.lag("period").over(by_position)})
    quotient = F.col("shares").cast("decimal(18,4)") / F.col("was").cast("decimal(18,4)")
    pair = held.where(F.col("period") == next_quarter(F.col("then"))).select("security_id", "period", "shares", "was", quotient.cast("decimal(28,10)").alias("ratio"))
    pair = with_median(pair, ["security_id", "period"], "ratio", near=lambda median: nearest_fraction(median.cast("double")))
    n, d = F.col("near.n"), F.col("near.d")
    scaled = F.col("ratio").cast("double") * d
    cells = pair.groupBy("security_id", "period").agg(
        F.count("*").alias("holders"), F.max("median").alias("shares_ratio"), F.max("near").alias("near"),
        F.count_if((scaled * NEAR >= n) & (scaled <= n * NEAR)).cast("int").alias("holders_agreeing"), F.count_if(_is_exact(F.col("shares"), F.col("was"), n, d)).cast("int").alias("holders_exact"),
    ).where(F.col("holders") >= LEAST_AGREEING)
    by = Window.partitionBy("security_id").orderBy("period")
    priced = prices.where("price is not null").withColumns({"last": F.lag("price").over(by), "last_period": F.lag("period").over(by)})
    moved = (F.col("price").cast("decimal(18,8)") / F.col("last").cast("decimal(18,8)")).cast("decimal(28,10)")
    priced = priced.where(F.col("period") == next_quarter(F.col("last_period"))).select("security_id", "period", moved.alias("price_ratio"))
    full = cells.join(priced, ["security_id", "period"], "left").select(
        "security_id", "period", n.alias("numerator"), d.alias("denominator"), "holders", "holders_agreeing", "holders_exact", "shares_ratio", "price_ratio"
    )
    return full.where((F.col("holders_agreeing") >= LEAST_AGREEING) | (F.col("shares_ratio") >= OUTLIER) | (F.col("shares_ratio") * OUTLIER <= 1))


def nearest_fraction(ratio: Column) -> Column:
    """struct(off, n, d) of the fraction nearest to the ratio, as a factor of one or more; null where that is over NEAR."""
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in FRACTIONS])  # folded to one literal

    def placed(f: Column) -> Column:
        scaled = ratio * f["d"] / f["n"]
        return F.struct(F.greatest(scaled, F.lit(1.0) / F.nullif(scaled, F.lit(0.0))).alias("off"), f["n"].alias("n"), f["d"].alias("d"))

    return F.array_min(F.filter(F.transform(options, placed), lambda x: x["off"] <= NEAR))


def _is_exact(shares: Column, was: Column, n: Column, d: Column) -> Column:
    return F.abs(shares.cast("double") * d - was.cast("double") * n) <= d * EXACT_SHARES


def corroborated(n: Column, d: Column, price_ratio: Column) -> Column:
    """The price ratio times the fraction, one plus the return, is in BAND and nearer one than the fraction."""
    fraction, product = n / d, price_ratio.cast("double") * n / d
    in_band = (price_ratio * n >= d * F.lit(BAND[0]).cast("decimal(3,1)")) & (price_ratio * n <= d * F.lit(BAND[1]).cast("decimal(3,1)"))
    return in_band & F.when(fraction > 1, product * product < fraction).otherwise(product * product > fraction)


def judge(candidates: DataFrame) -> DataFrame:
    """Candidates with `confidence` (high, medium, low; null where it is no split) and `reason`.

    LEAST_AGREEING holders and a third of them must agree, and the price must corroborate the ratio. Its size, the ratio
    or its reverse, then tells what else it takes: from ANY_FROM nothing, from MAJORITY_FROM an exact holder or three
    that are a majority, below that an exact holder.
    """
    n, d, agreeing, holders = (F.col(c) for c in ("numerator", "denominator", "holders_agreeing", "holders"))
    size, exact = F.greatest(n / d, d / n), F.col("holders_exact") > 0
    backed = (size >= ANY_FROM) | exact
    majority = (agreeing >= 3) & (agreeing * 2 > holders)
    moved = F.concat(F.lit("the price moved x"), F.format_string("%.3f", F.col("price_ratio").cast("double")))
    no = (
        F.when(n.isNull(), "no common ratio")
        .when((agreeing < LEAST_AGREEING) | (agreeing * 3 < holders), F.concat(agreeing.cast("string"), F.lit(" of "), holders.cast("string"), F.lit(" holders agree")))
        .when(F.col("price_ratio").isNull(), "no price on one side")
        .when(~corroborated(n, d, F.col("price_ratio")), moved)
        .when(~backed & (size < MAJORITY_FROM), "no holder exact to the share")
        .when(~backed & ~majority, "no holder exact to the share, and no majority agreeing")
    )
    grade = F.when(exact & (agreeing >= 3), "high").when(exact | (agreeing >= 3), "medium").otherwise("low")
    yes = F.when(exact & (agreeing >= 3), "an exact holder and three agreeing").when(exact | (agreeing >= 3), "an exact holder or three agreeing").otherwise("two holders agree")
    return candidates.withColumn("reason", no).withColumn("confidence", F.when(F.col("reason").isNull(), grade)).withColumn("reason", F.coalesce("reason", yes))


def is_outlier() -> Column:
    """Of verdicts: no split, yet the shares moved OUTLIER times either way and the price as far the other way."""
    shares, price = F.col("shares_ratio").cast("double"), F.col("price_ratio").cast("double")
    up = (shares >= OUTLIER) & (price * OUTLIER <= 1)
    down = (shares < 1) & (shares * OUTLIER <= 1) & (price >= OUTLIER)
    return F.coalesce(F.col("confidence").isNull() & (F.col("holders") >= LEAST_AGREEING) & (up | down), F.lit(False))


def looks_like_split(prev_shares: Column, shares: Column, price_ratio: Column) -> Column:
    """One holder's move that could be a split which nobody has found yet.

    Either the price moved OUTLIER times, or the shares moved by one of FRACTIONS that the price corroborates and that is
    exact or MAJORITY_FROM at least; without a price the shares must be exact.
    """
    wild = (price_ratio >= OUTLIER) | (price_ratio.cast("double") <= 1 / OUTLIER)

    def fits(near: Column) -> Column:
        exact = _is_exact(shares, prev_shares, near["n"], near["d"])
        size = F.greatest(near["n"] / near["d"], near["d"] / near["n"])
        return F.when(near.isNull(), False).when(price_ratio.isNull(), exact).otherwise(corroborated(near["n"], near["d"], price_ratio) & (exact | (size >= MAJORITY_FROM)))

    near = nearest_fraction(shares.cast("double") / F.nullif(prev_shares.cast("double"), F.lit(0.0)))
    found = F.when(price_ratio.isNotNull() & wild, price_ratio > 0).otherwise(F.exists(F.array(near), fits))  # bound by a lambda, so the fractions are tried once
    return F.coalesce((prev_shares > 0) & (shares > 0) & found, F.lit(False))


def splits_of(verdicts: DataFrame) -> DataFrame:
    """The verdicts that are splits."""
    return verdicts.where("confidence is not null").select("security_id", "period", "numerator", "denominator", "confidence")


def adjusted_price(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices over the product of all later splits, so that a series has one basis."""
    by = splits.where("numerator is not null").groupBy("security_id").agg(F.collect_list(F.struct("period", F.col("numerator").cast("int").alias("numerator"), F.col("denominator").cast("int").alias("denominator"))).alias("s"))
    later = F.filter(F.coalesce("s", F.array().cast("array<struct<period:date,numerator:int,denominator:int>>")), lambda x: x["period"] > F.col("period"))
    factor = F.aggregate(later, F.lit(1.0), lambda a, x: a * x["numerator"] / x["denominator"])
    return prices.join(by, "security_id", "left").select("security_id", "period", "price", F.round(F.col("price") / factor, 8).alias("adjusted_price"))


PRICE_SQL = """SELECT security_id, period, round(median, 8) AS price, CASE WHEN median IS NULL THEN NULL WHEN agreeing_count >= 3 AND agreeing_count * 2 > priced_count THEN 'high' WHEN agreeing_count >= 2 AND agreeing_count * 2 > priced_count THEN 'medium' ELSE 'low' END AS confidence,
    observation_count, priced_count, observation_count - priced_count AS unpriced_count, agreeing_count FROM
  (SELECT security_id, period, any_value(median) AS median, count(*) AS observation_count, count(*) FILTER (value_usd > 0) AS priced_count, count(*) FILTER (value_usd > 0 AND abs(each - median) * 100 <= median * 2) AS agreeing_count FROM
    (SELECT *, quantile_disc(CASE WHEN value_usd > 0 THEN each END, 0.5) OVER (PARTITION BY security_id, period) AS median FROM (SELECT *, value_usd::DOUBLE / shares::DOUBLE AS each FROM snapshot WHERE shares > 0)) GROUP BY 1, 2)"""
#: FRACTIONS and the rules of splits for DuckDB.
FRACTIONS_SQL = ", ".join(f"({n}::DOUBLE, {d}::DOUBLE)" for n, d in FRACTIONS)
#: Holders of both quarters, median ratios, nearest fractions, counts, the ratio of prices, verdicts.
SPLIT_SQL = {
    "pair": """
      SELECT n.security_id, n.period, n.shares::DOUBLE AS shares, b.shares::DOUBLE AS was, round(n.shares::DOUBLE / b.shares::DOUBLE, 10) AS ratio
      FROM snapshot n JOIN snapshot b ON b.filer_id = n.filer_id AND b.security_id = n.security_id
        AND n.period = last_day(date_trunc('month', b.period) + INTERVAL 3 MONTH)
      WHERE n.shares > 0 AND b.shares > 0""",
    "ratio": "SELECT security_id, period, count(*) AS holders, quantile_disc(ratio, 0.5) AS shares_ratio FROM pair GROUP BY 1, 2 HAVING count(*) >= 2",
    "near": f"""
      SELECT r.*, n AS numerator, d AS denominator FROM ratio r LEFT JOIN
        (SELECT security_id, period, n, d FROM ratio, (VALUES {FRACTIONS_SQL}) f(n, d)
         WHERE greatest(shares_ratio * d / n, n / (shares_ratio * d)) <= 1.25
         QUALIFY row_number() OVER (PARTITION BY security_id, period ORDER BY greatest(shares_ratio * d / n, n / (shares_ratio * d))) = 1) USING (security_id, period)""",
    "moved": """
      SELECT security_id, n.period, round(n.price::DOUBLE / b.price::DOUBLE, 10) AS price_ratio FROM price n JOIN price b USING (security_id)
      WHERE n.period = last_day(date_trunc('month', b.period) + INTERVAL 3 MONTH)""",
    "candidate": """
      SELECT * FROM
        (SELECT c.security_id, c.period, any_value(numerator) AS numerator, any_value(denominator) AS denominator, any_value(holders) AS holders, any_value(shares_ratio) AS shares_ratio,
           count(*) FILTER (ratio * denominator * 1.25 >= numerator AND ratio * denominator <= numerator * 1.25) AS holders_agreeing,
           count(*) FILTER (abs(shares * denominator - was * numerator) <= denominator) AS holders_exact
         FROM near c JOIN pair USING (security_id, period) GROUP BY 1, 2)
      LEFT JOIN moved USING (security_id, period)
      WHERE holders_agreeing >= 2 OR shares_ratio >= 2.5 OR shares_ratio * 2.5 <= 1""",
    "verdict": """
      SELECT *, CASE WHEN numerator IS NULL OR holders_agreeing < 2 OR holders_agreeing * 3 < holders OR price_ratio IS NULL THEN NULL
          WHEN NOT (product BETWEEN 0.4 AND 1.6 AND CASE WHEN fraction > 1 THEN product * product < fraction ELSE product * product > fraction END) THEN NULL
          WHEN size < 3 AND holders_exact = 0 THEN NULL
          WHEN size < 4 AND holders_exact = 0 AND NOT (holders_agreeing >= 3 AND holders_agreeing * 2 > holders) THEN NULL
          WHEN holders_exact > 0 AND holders_agreeing >= 3 THEN 'high' WHEN holders_exact > 0 OR holders_agreeing >= 3 THEN 'medium' ELSE 'low' END AS confidence
      FROM (SELECT *, numerator / denominator AS fraction, price_ratio * numerator / denominator AS product, greatest(numerator / denominator, denominator / numerator) AS size FROM candidate)""",
}
