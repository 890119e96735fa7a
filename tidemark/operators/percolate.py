"""Stored screens against arriving positions: every screen is a row of limits that joins to the positions, so one pass serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import quarter_end, quarter_label, quarters_between
from .alerts import not_split_unadjusted
from .screener import ACTIONS, Tables, added_runs

#: Positions that an event names.
NAMED = 5
#: How an event says what became of a position.
SAID = {"new": "opened", "add": "added to", "trim": "trimmed", "hold": "held", "exit": "sold out"}
#: Filters that are one number, and its type.
_NUMBERS = {"min_holders": "int", "min_value": "double", "min_weight": "double", "weight_change": "double", "min_exits": "int", "added_quarters": "int", "insider_buyers": "int"}
_KNOWN = (*_NUMBERS, "action", "filer_category", "filer_slug", "net_flow", "is_new_position", "insider_cluster")
_LIMITS = ["actions", "categories", "slugs", *_NUMBERS, "net_flow", "is_new_position", "insider_cluster"]


def read_screens(saved: DataFrame, filer: DataFrame) -> DataFrame:
    """saved (screen_id, name, filters: map of lists of strings) as the vocabulary reads now: a column for each limit, null without one, and
    `ignored`, how many of the saved filters don't read.

    What doesn't read is left out, never applied as something else. A slug that no filer has goes too, and a filter of slugs without one that is left.
    """
    value = lambda name: F.try_element_at("filters", F.lit(name))
    first = lambda name: F.try_element_at(value(name), F.lit(1))
    words = lambda name, ok: F.when((F.size(value(name)) > 0) & F.forall(value(name), ok), value(name))
    told = lambda w: F.coalesce(F.length(w) > 0, F.lit(False))
    truth = lambda name: F.when(F.lower(first(name)).isin("true", "false"), F.lower(first(name)) == "true")
    read = {
        "actions": words("action", lambda w: w.isin(*ACTIONS)), "categories": words("filer_category", told), "asked": words("filer_slug", told),
        **{name: first(name).try_cast(kind) for name, kind in _NUMBERS.items()},
        "net_flow": F.when(first("net_flow").isin("buy", "sell"), first("net_flow")), "is_new_position": truth("is_new_position"), "insider_cluster": truth("insider_cluster"),
    }
    rows = saved.select("screen_id", "name", "filters").withColumns(read)
    asked = rows.select("screen_id", F.explode("asked").alias("slug")).distinct()
    there = asked.join(filer.select("slug").distinct(), "slug", "left_semi").groupBy("screen_id").agg(F.sort_array(F.collect_list("slug")).alias("slugs"))
    rows = rows.join(there, "screen_id", "left")
    unread = [F.array_contains(F.map_keys("filters"), own) & F.col(name).isNull() for own, name in (("action", "actions"), ("filer_category", "categories"), *((n, n) for n in (*_NUMBERS, "net_flow", "is_new_position", "insider_cluster")))]
    strange = F.size(F.array_except(F.map_keys("filters"), F.array(*map(F.lit, _KNOWN))))
    gone = F.array_contains(F.map_keys("filters"), "filer_slug") & (F.col("slugs").isNull() | (F.size("slugs") < F.size(F.array_distinct("asked"))))
    ignored = strange + sum((F.coalesce(c, F.lit(False)).cast("int") for c in unread), F.coalesce(gone, F.lit(False)).cast("int"))
    return rows.select("screen_id", "name", *_LIMITS, ignored.alias("ignored"))


def position_facts(t: Tables, fresh: DataFrame) -> DataFrame:
    """The changes of fresh pairs (filer_id, period, filed_at) with all that a screen can ask of them, and none that looks like a split not yet found.

    Facts of a security in a quarter are one row each and join by equality; an insider's line or an episode is dealt to the quarters that
    it lies in.
    """
    filers = fresh.select("filer_id").distinct()
    rows = added_runs(t.change.join(filers, "filer_id", "left_semi")).join(fresh.select("filer_id", "period", "filed_at"), ["filer_id", "period"])
    rows = rows.where(not_split_unadjusted())
    rows = rows.join(t.filer.select("filer_id", "slug", "category", F.col("name").alias("filer_name")), "filer_id", "left")
    rows = rows.join(t.consensus.select("period", "security_id", "holder_count"), ["period", "security_id"], "left").join(t.flows.select("period", "security_id", "net", "exits"), ["period", "security_id"], "left")

    spelled = t.security.select("security_id", F.translate("ticker", ".", "-").alias("ticker"))
    listed = t.issuer_ticker.select(F.col("cik").alias("issuer_cik"), "ticker").join(spelled, "ticker").select("issuer_cik", "security_id")

    def by_security(issuers: DataFrame, linked: DataFrame, fact: Column) -> DataFrame:
        """issuers: issuer_cik, period, n. linked: issuer_cik, security_id, period."""
        own = linked.where("security_id is not null").distinct().join(issuers, ["issuer_cik", "period"]).select("security_id", "period", "n")
        other = listed.join(issuers, "issuer_cik").select("security_id", "period", "n")
        return own.unionByName(other).groupBy("security_id", "period").agg(fact)

    lines = t.purchases.select("issuer_cik", "security_id", "insider_id", quarter_end(F.col("transaction_date")).alias("period"))
    bought = by_security(lines.groupBy("issuer_cik", "period").agg(F.countDistinct("insider_id").alias("n")), lines.select("issuer_cik", "security_id", "period"), F.max("n").alias("buyers"))
    episodes = t.episodes.select("issuer_cik", "security_id", F.explode(quarters_between(quarter_end(F.col("window_start")), quarter_end(F.col("window_end")))).alias("period")).distinct()
    clustered = by_security(episodes.select("issuer_cik", "period", F.lit(1).alias("n")).distinct(), episodes, F.lit(True).alias("clustered"))
    rows = rows.join(bought, ["security_id", "period"], "left").join(clustered, ["security_id", "period"], "left")
    names = t.security.select("security_id", F.coalesce("ticker", "name", "cusip").alias("stock"), "cusip")
    return rows.join(names, "security_id", "left").fillna({"clustered": False, "buyers": 0, "holder_count": 0, "exits": 0})


def _passes() -> Column:
    """All of a screen's limits hold for a position; a limit that isn't set holds."""
    c = F.col
    later = c("prev_period").isNotNull()

    def limit(name: str, holds: Column) -> Column:
        return c(name).isNull() | F.coalesce(holds, F.lit(False))

    tests = [
        F.when(c("actions").isNull(), c("action") != "exit").otherwise(later & F.array_contains("actions", c("action"))),
        limit("categories", F.array_contains("categories", c("category"))), limit("slugs", F.array_contains("slugs", c("slug"))),
        limit("min_holders", c("holder_count") >= c("min_holders")), limit("min_value", c("value_usd") >= c("min_value")), limit("min_weight", c("weight_pct") >= c("min_weight")),
        limit("weight_change", later & F.when(c("weight_change") > 0, c("weight_delta") >= c("weight_change")).otherwise(c("weight_delta") <= c("weight_change"))),
        limit("min_exits", c("exits") >= c("min_exits")), limit("added_quarters", c("run") >= c("added_quarters")), limit("insider_buyers", c("buyers") >= c("insider_buyers")),
        limit("net_flow", F.when(c("net_flow") == "buy", c("net") > 0).otherwise(c("net") < 0)),
        limit("is_new_position", later & ((c("action") == "new") == c("is_new_position"))), limit("insider_cluster", c("clustered") == c("insider_cluster")),
    ]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def percolated(facts: DataFrame, screens: DataFrame) -> DataFrame:
    """Positions with each screen that they pass.

    A screen stands under what it asks of filer and action: its slugs, else its categories each with its actions, else its actions. A position
    carries the three keys of that kind that it has, so a screen that names filers meets those filers' positions only. Whoever meets is tested on all limits.
    """
    asked = F.coalesce("actions", F.array(*(F.lit(a) for a in ACTIONS if a != "exit")))
    under = (
        F.when(F.col("slugs").isNotNull(), F.transform("slugs", lambda s: F.concat(F.lit("s:"), s)))
        .when(F.col("categories").isNotNull(), F.flatten(F.transform(F.array_distinct("categories"), lambda k: F.transform(F.array_distinct(asked), lambda a: F.concat(F.lit("c:"), a, F.lit(":"), k)))))
        .otherwise(F.transform(F.array_distinct(asked), lambda a: F.concat(F.lit("a:"), a)))
    )
    posted = screens.withColumn("key", F.explode(F.array_distinct(under)))
    has = F.array(F.concat(F.lit("s:"), F.col("slug")), F.concat(F.lit("c:"), F.col("action"), F.lit(":"), F.col("category")), F.concat(F.lit("a:"), F.col("action")))
    carried = facts.withColumnRenamed("added_quarters", "run").withColumn("key", F.explode(F.array_compact(has)))
    return carried.join(posted, "key").where(_passes()).drop("key")


def said_dollars(amount: Column) -> Column:
    """$9,450, $230.4M, $1.2B."""
    return F.when(amount >= 1e9, F.format_string("$%,.1fB", amount / 1e9)).when(amount >= 1e6, F.format_string("$%,.1fM", amount / 1e6)).otherwise(F.format_string("$%,.0f", amount))


def screen_events(matched: DataFrame) -> DataFrame:
    """An event for each screen and pair with a position that passes: how many do, the NAMED largest, title, text and the key that keeps it from being told again."""
    by = Window.partitionBy("screen_id", "filer_id", "period")
    order = by.orderBy(F.col("value_usd").desc(), "cusip")
    value = F.col("value_usd").cast("double")
    what = F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair))
    one = F.concat(F.col("stock"), F.lit(" ("), what[F.col("action")], F.when(value > 0, F.concat(F.lit(", "), said_dollars(value))).otherwise(F.lit("")), F.lit(")"))
    rows = matched.withColumn("matches", F.count("*").over(by)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= NAMED)
    rows = rows.groupBy("screen_id", "filer_id", "period").agg(
        *(F.first(c).alias(c) for c in ("name", "ignored", "slug", "filer_name", "filed_at", "matches")),
        F.sort_array(F.collect_list(F.struct("place", one.alias("said"), "stock"))).alias("largest"),
    )
    period, count = quarter_label(F.col("period")), F.format_string("%,d", "matches")
    more = F.when(F.col("matches") > NAMED, F.format_string(", and %,d more", F.col("matches") - NAMED)).otherwise(F.lit(""))
    left = F.when(F.col("ignored") > 0, F.concat(F.format_string(" %d of the filter's settings no longer ", "ignored"), F.when(F.col("ignored") == 1, "applies").otherwise("apply"), F.lit(", so it passes more than when it was saved: open it to review."))).otherwise(F.lit(""))
    return rows.select(
        "screen_id", "filer_id", "period", "filed_at", "matches", "ignored", F.col("largest.stock").alias("stocks"),
        F.concat(F.lit("saved_filter_match:"), F.col("screen_id").cast("string"), F.lit(":"), "slug", F.lit(":"), period).alias("dedupe_key"),
        F.concat("filer_name", F.lit(": "), count, F.when(F.col("matches") == 1, " position passes ").otherwise(" positions pass "), F.lit("“"), "name", F.lit("”")).alias("title"),
        F.concat(F.lit("In its 13F for "), period, F.lit(": "), F.array_join("largest.said", ", "), more, F.lit("."), left).alias("body"),
    )


def heard_screens(saved: DataFrame, rules: DataFrame, t: Tables, fresh: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Events with the rules (rule_id, user_id, target: a screen, created_at) that hear them: those no younger than the filing.

    Screens without a rule aren't run. told (dedupe_key, user_id): what users have been told already.
    """
    screens = read_screens(saved.join(rules.select(F.col("target").alias("screen_id")).distinct(), "screen_id", "left_semi"), t.filer)
    events = screen_events(percolated(position_facts(t, fresh), screens))
    out = events.join(rules.select("rule_id", "user_id", F.col("target").alias("screen_id"), "created_at"), "screen_id").where("created_at <= filed_at").drop("created_at")
    return out if told is None else out.join(told.select("dedupe_key", "user_id").distinct(), ["dedupe_key", "user_id"], "left_anti")
