"""Tickers over time: which a security had on a day, which security a symbol names, and what a reader may have meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fuzzy_words, word_similarity

#: Suggestions shown, the least letters for a search by name, and the least word similarity of a name.
SUGGESTIONS, NAME_LETTERS, ALIKE = 10, 3, 0.6


def valid_on(day: Column) -> Column:
    """valid_from <= day < valid_to, nulls unbounded."""
    return F.coalesce(F.col("valid_from") <= day, F.lit(True)) & F.coalesce(F.col("valid_to") > day, F.lit(True))


def tickers_on(aliases: DataFrame, day: str) -> DataFrame:
    """security_id, ticker of every security with a range that covers the day; of several the one that began last."""
    best = F.max_by("ticker", F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), "ticker"))
    return aliases.where(valid_on(F.lit(day).cast("date"))).groupBy("security_id").agg(best.alias("ticker"))


def ticker_labels(rows: DataFrame, day: str, aliases: DataFrame, securities: DataFrame) -> DataFrame:
    """Rows (day column, security_id) with `ticker` as it was on the row's day, else the present one, current_ticker and
    delisted_by. Ranges are collected by security, a handful each, so one join serves all days."""
    ranges = aliases.groupBy("security_id").agg(F.collect_list(F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("f"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("t"), "ticker")).alias("ranges"))
    about = securities.select("security_id", F.col("ticker").alias("current_ticker"), "delisted_by")
    full = rows.join(about, "security_id", "left").join(ranges, "security_id", "left")
    covering = F.filter("ranges", lambda r: (r["f"] <= F.col(day)) & (r["t"] > F.col(day)))
    then = F.try_element_at(F.sort_array(covering, False), F.lit(1))["ticker"]
    return full.withColumn("ticker", F.coalesce(then, "current_ticker")).drop("ranges")


def lookup(symbols: DataFrame, aliases: DataFrame, securities: DataFrame, held: DataFrame, day: str) -> DataFrame:
    """symbols (symbol) to security_id and via on one day; see lookup_on()."""
    asked = symbols.select("symbol", F.lit(day).cast("date").alias("day"))
    return lookup_on(asked, aliases, securities, held).drop("day")


def lookup_on(symbols: DataFrame, aliases: DataFrame, securities: DataFrame, held: DataFrame) -> DataFrame:
    """symbols (symbol, day) to security_id and via: 0 a ticker on the day, 1 the present one, 2 one at any time, 3 the CUSIP.

    Within a tier the latest range wins, then the security last held, then the greater id. held: security_id, last_held.
    """
    far = F.lit("9999-12-31").cast("date")
    key = ["symbol", "day"]
    wanted = symbols.select(*key, F.upper("symbol").alias("key")).distinct()
    alias = aliases.select(F.upper("ticker").alias("key"), "security_id", "valid_from", "valid_to")
    named = wanted.join(alias, "key").withColumn("via", F.explode(F.when(valid_on(F.col("day")), F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(2)))))
    named = named.select(*key, "security_id", "via", F.coalesce("valid_to", far).alias("recent"))
    present = wanted.join(securities.select(F.upper("ticker").alias("key"), "security_id"), "key").select(*key, "security_id", F.lit(1).alias("via"), far.alias("recent"))
    cusip = wanted.where(F.length("key") == 9).join(securities.select(F.col("cusip").alias("key"), "security_id"), "key").select(*key, "security_id", F.lit(3).alias("via"), far.alias("recent"))
    every = named.unionByName(present).unionByName(cusip).join(held.select("security_id", "last_held"), "security_id", "left")
    order = Window.partitionBy(*key).orderBy("via", F.col("recent").desc(), F.col("last_held").desc_nulls_last(), F.col("security_id").desc())
    return every.withColumn("place", F.row_number().over(order)).where("place = 1").select(*key, "security_id", "via")


def suggestions(key: str, aliases: DataFrame, securities: DataFrame, worth: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """Securities that a symbol may have been meant for: tickers, present or former, that start with it, then names with a
    word like it. Within each the likest, then the most dollars held, then the smaller id. worth: security_id, total_value."""
    key = key.upper()
    starts = securities.select("security_id", "ticker").unionByName(aliases.select("security_id", "ticker")).where(F.upper("ticker").startswith(key))
    found = starts.select("security_id", F.lit(0).alias("via"), F.lit(1.0).alias("score"))
    if len(key) >= NAME_LETTERS:
        named = fuzzy_words(securities, "name", key).withColumn("score", word_similarity(key, F.col("name"))).where(F.col("score") >= ALIKE)
        found = found.unionByName(named.select("security_id", F.lit(1).alias("via"), "score"))
    best = found.groupBy("security_id").agg(F.min("via").alias("via"), F.max("score").alias("score"))
    full = best.join(securities, "security_id").join(worth.select("security_id", "total_value"), "security_id", "left")
    return full.orderBy("via", F.col("score").desc(), F.coalesce("total_value", F.lit(-1)).desc(), "security_id").limit(limit)


def collisions(aliases: DataFrame) -> DataFrame:
    """Pairs of securities with one ticker at once; a ticker's holders are few, so each is compared with the others of it."""
    far, early = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
    a = aliases.select(F.upper("ticker").alias("ticker"), "security_id", F.coalesce("valid_from", early).alias("f"), F.coalesce("valid_to", far).alias("t"))
    b = a.select("ticker", F.col("security_id").alias("other"), F.col("f").alias("f2"), F.col("t").alias("t2"))
    return a.join(b, "ticker").where("security_id < other and f < t2 and f2 < t").select("ticker", "security_id", "other", F.greatest("f", "f2").alias("since"), F.least("t", "t2").alias("until"))
