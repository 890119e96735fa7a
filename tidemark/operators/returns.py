"""Estimated returns of positions: the price they were held at, and the latest known since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import quarter_end
from .change import with_splits


#: Columns that estimated_return adds to a cell.
COLUMNS = [
    "implied_price", "price_confidence", "price_observation_count", "quote_close", "quote_date", "basis_split_ratio", "basis_price", "estimated_return_pct",
    "last_quarter_period", "last_quarter_price", "last_quarter_confidence", "last_quarter_split_ratio", "return_to_last_quarter_pct",
]


def _ratio(last: str) -> Column:
    """The product of a row's splits after its period up to a day; null where there is none."""
    between = F.filter("splits", lambda s: (s["period"] > F.col("period")) & (s["period"] <= F.col(last)))
    return F.when(F.size(between) > 0, F.aggregate(between, F.lit(1.0), lambda a, s: a * s["numerator"] / s["denominator"]))


def estimated_return(cells: DataFrame, prices: DataFrame, quotes: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """cells (security_id, period) with COLUMNS: what a position at the period's implied price has returned since.

    There are two figures. One is to the latest quote after the period; it is null if a split of the quote's own quarter lies after
    the quote, for nobody can tell on which side of it. The other is to the latest implied price after the period. Splits
    between scale each. A missing part makes a null, never a zero.

    The latest quote and price of a security don't depend on the period, save that they must come after it, so each
    is one row for a security and joins by equality.
    """
    last_quote = quotes.groupBy("security_id").agg(F.max(F.struct("date", "close")).alias("q"))
    last_price = prices.where("price is not null").groupBy("security_id").agg(F.max(F.struct("period", "price", "confidence")).alias("l"))
    basis = prices.select("security_id", "period", F.col("price").alias("implied_price"), F.col("confidence").alias("price_confidence"), F.col("observation_count").alias("price_observation_count"), F.lit(True).alias("based"))
    full = with_splits(cells, splits).join(basis, ["security_id", "period"], "left").join(last_quote, "security_id", "left").join(last_price, "security_id", "left")
    quoted, later = F.col("based") & (F.col("q.date") > F.col("period")), F.col("based") & (F.col("l.period") > F.col("period"))
    full = full.select(
        *cells.columns, "splits", "implied_price", "price_confidence", "price_observation_count",
        F.when(quoted, F.col("q.close")).alias("quote_close"), F.when(quoted, F.col("q.date")).alias("quote_date"),
        *(F.when(later, F.col(f"l.{c}")).alias(f"last_quarter_{c}") for c in ("period", "price", "confidence")),
    )
    straddled = F.exists("splits", lambda s: (s["period"] > F.col("quote_date")) & (s["period"] <= quarter_end(F.col("quote_date"))))
    price = F.nullif(F.col("implied_price").cast("double"), F.lit(0.0))

    def since(later: str, ratio: str) -> Column:
        return F.round((F.col(later).cast("double") * F.coalesce(ratio, F.lit(1.0)) / price - 1) * 100, 2)

    full = full.withColumns({"usable": F.col("quote_date").isNotNull() & ~straddled, "to_quote": _ratio("quote_date"), "to_last": _ratio("last_quarter_period")})
    full = full.withColumns({
        "basis_split_ratio": F.when(F.col("usable"), F.round("to_quote", 10)), "basis_price": F.when(F.col("usable"), F.round(price / F.coalesce("to_quote", F.lit(1.0)), 8)),
        "estimated_return_pct": F.when(F.col("usable"), since("quote_close", "to_quote")), "last_quarter_split_ratio": F.round("to_last", 10),
        "return_to_last_quarter_pct": since("last_quarter_price", "to_last"),
    })
    return full.select(*cells.columns, *COLUMNS)


def latest_before(rows: DataFrame, events: DataFrame, key: str, at: str, when: str, value: str) -> DataFrame:
    """As-of join: each row with the latest event of its key on or before it. Both are ordered together in one
    window by key, so nothing is paired."""
    left = rows.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__value": F.lit(None).cast(events.schema[value].dataType)})
    right = events.select(key, F.col(when).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    by = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(by))
    return both.where("__kind = 1").drop("__at", "__kind", "__value")
