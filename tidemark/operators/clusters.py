"""Clusters of insiders who buy one issuer's stock within a window of days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grid of windows and least insiders, and what marks a plan in footnotes.
GRID = [(days, least) for days in (14, 30, 60, 90) for least in (2, 3, 4, 5)]
PLAN = r"(?i)employee stock purchase plan|\bESPP\b|dividend reinvestment|\bDRIP\b"


def excluded(footnotes: str = "footnotes") -> Column:
    """Why a purchase doesn't count, in this order: derivative, role, 10b5_1, plan; null if it counts."""
    return (
        F.when(F.col("is_derivative"), "derivative").when(~(F.col("is_director") | F.col("is_officer")), "role").when(F.col("is_10b5_1"), "10b5_1")
        .when(F.coalesce(F.to_json(footnotes).rlike(PLAN), F.lit(False)), "plan")
    )


def counted_purchases(lines: DataFrame) -> DataFrame:
    """Lines with code P, with the reason that excludes each."""
    return lines.where("transaction_code = 'P'").withColumn("excluded", excluded())


def insider_clusters(lines: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """The episodes of one point of the grid; see cluster_grid()."""
    return cluster_grid(lines, [(days, least)]).drop("window_days", "min_insiders")


def cluster_grid(lines: DataFrame, grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """Episodes of each issuer for each window of days and least number of insiders: window_days, min_insiders, issuer_cik, window_start,
    window_end, insiders, lines, shares, value_usd, security_id, transaction_ids.

    A day qualifies if the window of it and the days before holds so many insiders. A window starts at its first purchase;
    one that starts after the previous qualifying day's end is a new episode, else they share a purchase. Sums cover all counted
    lines of the issuer from the start to the end. The security is that of all lines, null if they differ or one has none.

    An insider counts from a purchase until its window ends or the next purchase comes, so the insiders of a window are a running sum of
    steps up and down: no row ever holds a set of them. Steps are summed by day before they are run through, in one pass for all lengths,
    whose days qualify for all the numbers they reach; all episodes meet the lines in one join.
    """
    counted = counted_purchases(lines).where("excluded is null")
    day = F.datediff("transaction_date", F.lit("1970-01-01").cast("date"))
    own = Window.partitionBy("issuer_cik", "insider_id").orderBy("day")
    days_of = counted.select("issuer_cik", "insider_id", day.alias("day")).distinct().withColumn("again", F.lead("day").over(own))
    numbers: dict[int, list[int]] = {}
    for days, least in grid or GRID:
        numbers.setdefault(days, []).append(least)
    known = F.col("insider_id").isNotNull().cast("int")

    def steps(days: int) -> list[Column]:
        until = F.least(F.col("day") + days + 1, "again")
        length = F.lit(days).alias("window_days")
        return [F.struct(length, F.col("day"), known.alias("step"), F.lit(True).alias("bought")), F.struct(length, until.alias("day"), (-known).alias("step"), F.lit(False).alias("bought"))]

    moved = days_of.select("issuer_cik", F.explode(F.array(*(x for days in numbers for x in steps(days)))).alias("s")).select("issuer_cik", "s.*")
    daily = moved.groupBy("window_days", "issuer_cik", "day").agg(F.sum("step").alias("step"), F.max("bought").alias("bought"))
    by_day = Window.partitionBy("window_days", "issuer_cik").orderBy("day")

    def of_length(value: Callable[[int], Column]) -> Column:
        return F.coalesce(*(F.when(F.col("window_days") == days, value(days)) for days in numbers))

    first = of_length(lambda days: F.min(F.when(F.col("bought"), F.col("day"))).over(by_day.rangeBetween(-days, 0)))
    windows = daily.withColumns({"insiders": F.sum("step").over(by_day), "first": first}).where("bought")
    reached = F.explode(F.filter(of_length(lambda days: F.array(*map(F.lit, numbers[days]))), lambda n: n <= F.col("insiders")))
    dated = lambda name: F.date_add(F.lit("1970-01-01").cast("date"), F.col(name))
    ends = windows.select("window_days", reached.alias("min_insiders"), "issuer_cik", dated("day").alias("transaction_date"), dated("first").alias("start"))
    point = ["window_days", "min_insiders", "issuer_cik"]
    order = Window.partitionBy(*point).orderBy("transaction_date")
    fresh = F.coalesce((F.col("start") > F.lag("transaction_date").over(order)).cast("int"), F.lit(1))
    islands = ends.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    episodes = islands.groupBy(*point, "island").agg(F.min("start").alias("window_start"), F.max("transaction_date").alias("window_end"))
    inside = counted.join(episodes, "issuer_cik").where("transaction_date between window_start and window_end")
    one = F.when((F.count("*") == F.count("security_id")) & (F.min("security_id") == F.max("security_id")), F.min("security_id"))
    return inside.groupBy(*point, "window_start", "window_end").agg(
        F.size(F.collect_set("insider_id")).cast("long").alias("insiders"), F.count("*").alias("lines"), F.sum("shares").cast("decimal(20,4)").alias("shares"), F.sum("value_usd").cast("decimal(20,2)").alias("value_usd"),
        one.alias("security_id"), F.transform(F.array_sort(F.collect_list(F.struct("transaction_date", "id"))), lambda s: s["id"]).alias("transaction_ids"),
    )


COUNTED_SQL = """SELECT *, CASE WHEN is_derivative THEN 'derivative' WHEN NOT (is_director OR is_officer) THEN 'role' WHEN is_10b5_1 THEN '10b5_1' WHEN plan THEN 'plan' END AS excluded FROM insider_line WHERE transaction_code = 'P'"""


def clusters_sql(days: int, least: int) -> str:
    return f"""SELECT {days} AS window_days, {least} AS min_insiders, e.issuer_cik, window_start, window_end, count(DISTINCT insider_id) AS insiders, count(*) AS lines, sum(shares)::DOUBLE AS shares, sum(value_usd)::DOUBLE AS value_usd,
      CASE WHEN count(*) = count(security_id) AND min(security_id) = max(security_id) THEN min(security_id) END AS security_id, list(id ORDER BY transaction_date, id) AS transaction_ids
    FROM (SELECT issuer_cik, min(start) AS window_start, max(day) AS window_end FROM (SELECT *, sum(fresh) OVER (PARTITION BY issuer_cik ORDER BY day) AS island FROM
      (SELECT *, CASE WHEN start > lag(day) OVER (PARTITION BY issuer_cik ORDER BY day) THEN 1 WHEN lag(day) OVER (PARTITION BY issuer_cik ORDER BY day) IS NULL THEN 1 ELSE 0 END AS fresh FROM
        (SELECT a.issuer_cik, a.transaction_date AS day, min(b.transaction_date) AS start FROM (SELECT DISTINCT issuer_cik, transaction_date FROM counted WHERE excluded IS NULL) a
          JOIN counted b ON b.issuer_cik = a.issuer_cik AND b.excluded IS NULL AND b.transaction_date BETWEEN a.transaction_date - {days} AND a.transaction_date GROUP BY 1, 2 HAVING count(DISTINCT b.insider_id) >= {least})))
      GROUP BY issuer_cik, island) e JOIN counted c ON c.issuer_cik = e.issuer_cik AND c.excluded IS NULL AND c.transaction_date BETWEEN window_start AND window_end GROUP BY ALL"""
