"""Pairs of sets of trigrams that are alike to a degree, found without a look at all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 64-bit words of a set's bits, how much longer the sets of a class are than those of the class before, and what rounding may add to a product.
WORDS, WIDER, ROUNDING = 4, 1.1, 1e-9


def ranks(sets: DataFrame) -> DataFrame:
    """g, r: the trigrams of the sets (grams) by number, the rarest first. They are made of letters, digits and space, so there are 37^3 at most, which one window can order."""
    often = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    return often.select("g", F.row_number().over(Window.orderBy("df", "g")).alias("r"))


def coded(sets: DataFrame, key: list[str], ranked: DataFrame, side: str) -> DataFrame:
    """Sets (key, grams) as `side` + t, the number of trigrams; n and ids, those that have a rank, rarest first; w0 to w3, a bit for each; and slack, how many have a bit that another has."""
    bit = F.expr("shiftleft(1L, r % 64)")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("r") / 64) % WORDS == i, bit)), F.lit(0)).alias(f"{side}w{i}") for i in range(WORDS)]
    each = sets.select(*key, F.size("grams").alias(f"{side}t"), F.explode("grams").alias("g")).join(F.broadcast(ranked), "g", "left")
    rows = each.groupBy(*key, f"{side}t").agg(F.count("r").alias(f"{side}n"), F.sort_array(F.collect_list("r")).alias(f"{side}ids"), *words)
    return rows.withColumn(f"{side}slack", F.col(f"{side}n") - sum(F.bit_count(f"{side}w{i}") for i in range(WORDS)))


def alike(asked: DataFrame, known: DataFrame, degree: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of asked (coded with side a) and known (with side b) that are equal in `on` and whose sets are alike to the degree or more, with `likeness`; a pair may come several times.

    Sets of t and u trigrams that are alike to a degree share s = ceil(degree / (1 + degree) * (t + u)), so each has one of those among all but its last s - 1. Those alone are joined, rarest first, by the
    size's class as well. A pair meets on the first trigram that it shares, with s left from there on in both; it is compared in full if the bits that both have allow for s.
    """
    share = degree / (1 + degree)
    least = lambda t, u: F.ceil(share * (t + u) - ROUNDING)
    smaller = lambda t: F.ceil(degree * t - ROUNDING)
    t, u, n = F.col("a_t"), F.col("b_t"), F.col("a_n")
    known = known.withColumn("class", F.floor(F.log(u) / math.log(WIDER)))
    sizes = F.broadcast(known.groupBy(*on, "class").agg(F.min(u).alias("low"), F.max(u).alias("high")))
    near = asked.join(sizes, list(on)) if on else asked.crossJoin(sizes)
    near = near.where((F.col("high") >= smaller(t)) & (smaller(F.col("low")) <= t))
    near = near.withColumn("first", F.slice("a_ids", F.lit(1), F.greatest(n - least(t, F.greatest("low", smaller(t))) + 1, F.lit(0)).cast("int"))).drop("low", "high")
    a = near.select("*", F.posexplode("first").alias("a_at", "g")).drop("first")
    b = known.withColumn("first", F.slice("b_ids", F.lit(1), (u - smaller(u) + 1).cast("int"))).select("*", F.posexplode("first").alias("b_at", "g")).drop("first")
    wanted = least(t, u)
    both: Column = sum(F.bit_count(F.col(f"a_w{i}").bitwiseAND(F.col(f"b_w{i}"))) for i in range(WORDS))
    pairs = a.join(b, [*on, "class", "g"]).where((n - F.col("a_at") >= wanted) & (u - F.col("b_at") >= wanted)).where(both + F.least("a_slack", "b_slack") >= wanted)
    shared = F.size(F.array_intersect("a_ids", "b_ids"))
    return pairs.where(shared >= wanted).withColumn("likeness", shared / (t + u - shared)).where(F.col("likeness") >= degree)
