"""Which security or person a name or number stands for: listings, delistings, ticker ranges, issuers, fuzzy candidates and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assets import classify
from ..functions.text import asset_key, core_name, core_similarity, extract_ticker, normal_ticker, share_class, trigrams
from ..sources.store import written
from .alike import alike, coded, ranks
from .lookup import lookup_on

#: The sector and venues whose listings count, the composite among them, and fuzzy suggestions' number and least similarity.
EQUITY, COMPOSITE = "Equity", "US"
VENUES = ["UA", "UN", "UQ", "UR", "UW", "UP", "UF", "UV"]
SUGGESTED, ALIKE = 3, 0.8


def choose_listing(matches: DataFrame) -> DataFrame:
    """matches (cusip, place, market_sector, exchange_code, ticker, figi, composite_figi) to one listing (ticker, figi) of each CUSIP that has just one.

    The composite's listings, else those of other US venues. Of several tickers those of a fund's net asset value (five
    letters, X first and last) don't count; if more than one is left, the CUSIP has no row.
    """
    spelled = F.upper(F.trim("ticker"))
    equity = matches.where((F.col("market_sector") == EQUITY) & (F.trim("ticker") != "")).withColumns({"symbol": spelled, "composite": F.col("exchange_code") == COMPOSITE})
    equity = equity.where(F.col("composite") | F.col("exchange_code").isin(VENUES))
    row = F.struct("place", "symbol", "figi", F.coalesce("composite_figi", "figi").alias("other"))
    own = equity.groupBy("cusip").agg(F.collect_list(F.when(F.col("composite"), row)).alias("first"), F.collect_list(F.when(~F.col("composite"), row)).alias("second"))
    own = own.withColumn("used", F.when(F.size("first") > 0, F.col("first")).otherwise(F.col("second")))
    symbols = F.array_distinct(F.transform("used", lambda x: x["symbol"]))
    trading = F.filter(symbols, lambda s: ~s.rlike("^X.{3}X$"))
    left = F.when((F.size(symbols) > 1) & (F.size(trading) > 0), trading).otherwise(symbols)
    own = own.withColumn("left", left).where("size(left) = 1")
    chosen = F.array_min(F.filter("used", lambda x: x["symbol"] == F.element_at("left", 1)))
    return own.select("cusip", normal_ticker(chosen["symbol"]).alias("ticker"), F.when(F.size("first") > 0, chosen["figi"]).otherwise(chosen["other"]).alias("figi"))


def merged_resolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new (security_id, ticker, figi, name, source) to the securities as they are after: a person's resolution stays, a
    ticker is replaced but never taken away, and `changed` tells rows that differ from before."""
    n = new.select("security_id", F.struct("ticker", "figi", "name", "source").alias("n"))
    full = old.join(n, "security_id", "left")
    writes = F.col("n").isNotNull() & ~F.coalesce(F.col("source") == "manual", F.lit(False)) & (F.col("n.ticker").isNotNull() | F.col("ticker").isNull())
    writes = writes & ~F.struct("ticker", "figi", "name", "source").eqNullSafe(F.col("n"))
    return full.select("security_id", *(F.when(writes, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("ticker", "figi", "name", "source")), writes.alias("changed"))


def fuzzy_matches(securities: DataFrame, least: float = ALIKE, most: int = SUGGESTED) -> DataFrame:
    """For each security without a ticker up to `most` with one whose name is alike: security_id, suggested_id, similarity.

    Names are id, ticker, name, filed_name; the best of the four pairs counts. Sets of trigrams are joined by alike().
    """
    both = securities.select(F.col("security_id").alias("id"), "ticker", F.explode(F.array_distinct(F.array_compact(F.array("name", "filed_name")))).alias("n")).withColumn("grams", trigrams(F.col("n")))
    listed = both.where("ticker is not null").withColumnRenamed("id", "suggested_id")
    ranked = ranks(listed)
    asked = coded(both.where("ticker is null").withColumnRenamed("id", "security_id"), ["security_id", "n"], ranked, "a_").drop("n")
    pairs = alike(asked, coded(listed, ["suggested_id", "n"], ranked, "b_").drop("n"), least).where("security_id <> suggested_id")
    best = pairs.groupBy("security_id", "suggested_id").agg(F.max("likeness").alias("similarity"))
    order = Window.partitionBy("security_id").orderBy(F.col("similarity").desc(), "suggested_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("security_id", "suggested_id", "similarity", "place")


def delisted_by(securities: DataFrame, lists: DataFrame) -> DataFrame:
    """security_id, delisted_by: the first list after the last that has the security undeleted, null if that is the latest.
    Securities that no list has undeleted have no row. lists: cusip, period, status. There are a few lists a year, so theirs are broadcast."""
    periods = lists.select("period").distinct()
    following = periods.withColumn("next", F.lead("period").over(Window.orderBy("period")))
    last = lists.where("status <> 'deleted'").groupBy("cusip").agg(F.max("period").alias("period"))
    found = last.join(F.broadcast(following), "period").select("cusip", F.col("next").alias("delisted_by"))
    return securities.select("security_id", "cusip").join(found, "cusip").select("security_id", "delisted_by")


def settled_ranges(aliases: DataFrame, delisted: DataFrame, before: DataFrame) -> DataFrame:
    """Ticker ranges (security_id, ticker, valid_from, valid_to) after delistings: relisted securities' last ranges run on, open
    ranges of delisted ones end there, and a range of another security without a known start, or with one that a delisting gave it, takes
    the ticker over from the latest such end before its own. before: security_id, delisted_by as they were."""
    was = before.where("delisted_by is not null").select("security_id", F.col("delisted_by").alias("was"))
    now = delisted.select("security_id", F.col("delisted_by").alias("now"), F.lit(True).alias("flagged"))
    last = F.max(F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))).over(Window.partitionBy("security_id"))
    rows = aliases.join(was, "security_id", "left").join(now, "security_id", "left").withColumn("last_start", last)
    reopened = F.col("flagged") & F.col("now").isNull() & (F.col("valid_to") == F.col("was")) & (F.col("last_start") < F.col("was"))
    rows = rows.withColumn("valid_to", F.when(F.coalesce(reopened, F.lit(False)), F.lit(None).cast("date")).otherwise(F.col("valid_to")))
    ends = F.col("valid_to").isNull() & F.col("now").isNotNull() & F.coalesce(F.col("valid_from") < F.col("now"), F.lit(True))
    rows = rows.withColumns({"valid_to": F.when(ends, F.col("now")).otherwise(F.col("valid_to")), "key": F.upper("ticker")})
    ended = rows.where(F.col("now") == F.col("valid_to")).groupBy("key").agg(F.collect_set(F.struct(F.col("valid_to").alias("ended"), "security_id")).alias("ended"))
    rows = rows.join(ended, "key", "left")
    others = F.filter(F.coalesce("ended", F.array().cast("array<struct<ended:date,security_id:bigint>>")), lambda e: e["security_id"] != F.col("security_id"))
    given = F.exists(others, lambda e: e["ended"] == F.col("valid_from"))
    taken = F.array_max(F.transform(F.filter(others, lambda e: e["ended"] < F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))), lambda e: e["ended"]))
    start = F.when((F.col("valid_from").isNull() | given) & taken.isNotNull(), taken).otherwise(F.col("valid_from"))
    return rows.select("security_id", "ticker", start.alias("valid_from"), "valid_to")


def link_issuers(issuers: DataFrame, issuer_ticker: DataFrame, found: DataFrame) -> DataFrame:
    """issuers (issuer_cik, trading_symbol) to security_id and link: linked, unlisted (no ticker at SEC), no_security, or ambiguous.

    The tickers that SEC lists for the issuer, or the one of them that is the filing's own symbol; then the securities these name.
    found: ticker, security_id, as lookup() answers for the day.
    """
    own = issuers.join(issuer_ticker.select(F.col("cik").alias("issuer_cik"), normal_ticker(F.col("ticker")).alias("symbol")), "issuer_cik", "left")
    own = own.withColumn("is_own", F.coalesce(F.col("symbol") == normal_ticker(F.col("trading_symbol")), F.lit(False)))
    own = own.withColumn("has_own", F.max("is_own").over(Window.partitionBy("issuer_cik", "trading_symbol"))).where("is_own or not has_own")
    full = own.join(found.select(F.col("ticker").alias("symbol"), "security_id"), "symbol", "left")
    sums = full.groupBy("issuer_cik", "trading_symbol").agg(F.count("symbol").alias("tickers"), F.countDistinct("security_id").alias("n"), F.min("security_id").alias("one"))
    link = F.when(F.col("tickers") == 0, "unlisted").when(F.col("n") == 0, "no_security").when(F.col("n") > 1, "ambiguous").otherwise("linked")
    return sums.select("issuer_cik", "trading_symbol", F.when(link == "linked", F.col("one")).alias("security_id"), link.alias("link"))


def held_issuers(snapshot: DataFrame, securities: DataFrame, issuer_ticker: DataFrame, latest: str, min_weight: float = 0) -> DataFrame:
    """cik of each issuer with a security of min_weight or more in a portfolio of the four quarters up to the latest."""
    end = F.lit(latest).cast("date")
    held = snapshot.where((F.col("period") > F.add_months(end, -12)) & ((F.col("weight_pct") >= min_weight) if min_weight > 0 else F.lit(True))).select("security_id").distinct()
    spelled = securities.join(held, "security_id", "left_semi").select(F.translate("ticker", ".", "-").alias("ticker"))
    return issuer_ticker.join(spelled.distinct(), "ticker", "left_semi").select("cik").distinct()


def quote_targets(securities: DataFrame) -> DataFrame:
    """ticker, security_id of listed tickers that one security alone has."""
    listed = securities.where("ticker is not null and delisted_by is null").groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("n"), F.min("security_id").alias("security_id"))
    return listed.where("n = 1").select("ticker", "security_id")


def issuer_names(cusips: DataFrame, matches: DataFrame, lists: DataFrame) -> DataFrame:
    """cusip, name, source, period: the first name among its matches (place), else that of the latest 13(f) list that has it."""
    filled = F.nullif(F.trim("name"), F.lit(""))
    figi = matches.where(filled.isNotNull()).groupBy("cusip").agg(F.min(F.struct("place", filled.alias("name")))["name"].alias("figi_name"))
    listed = lists.groupBy("cusip").agg(F.max(F.struct("period", "issuer_name")).alias("l"))
    full = cusips.select("cusip").distinct().join(figi, "cusip", "left").join(listed, "cusip", "left")
    source = F.when(F.col("figi_name").isNotNull(), "openfigi").when(F.col("l").isNotNull(), "sec_13f_list")
    return full.select("cusip", F.coalesce("figi_name", "l.issuer_name").alias("name"), source.alias("source"), F.when(F.col("figi_name").isNull(), F.col("l.period")).alias("period"))


# ---------------------------------------------------------------- disclosed assets

#: The least similarity of names for a ticker, a hinted one, a name alone, and a name against a ticker that
#: disagrees; and confidences: on the day, former or hinted, disagreeing, the most of a name, and a name whose ticker is another.
TICKER_AGREES, HINT_AGREES, NAME_ACCEPT, NAME_OVERRULES = 0.35, 0.25, 0.75, 0.9
ON_THE_DAY, FORMER, DISAGREEING, NAME_CEILING, OTHER_LISTING = 1.0, 0.9, 0.8, 0.95, 0.8


def with_cores(securities: DataFrame) -> DataFrame:
    """Securities with `cores`, the core names of their name and filed name."""
    return securities.withColumn("cores", F.array_distinct(F.filter(F.array(core_name(F.col("name")), core_name(F.col("filed_name"))), lambda c: c != "")))


def _cores(names: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct names with a core of three characters or more (name, core), and the securities' cores (security_id, core), worked out here unless they are there."""
    asked = names.select("name", "core").distinct() if "core" in names.columns else names.select("name").distinct().withColumn("core", core_name(F.col("name")))
    listed = securities if "cores" in securities.columns else with_cores(securities)
    return asked.where(F.length(F.replace("core", F.lit(" "))) >= 3), listed.select("security_id", F.explode("cores").alias("core"))


def name_candidates(names: DataFrame, securities: DataFrame, least: float = NAME_ACCEPT) -> DataFrame:
    """Distinct names (name) with the securities whose name or filed name is alike: name, security_id, score. Equal core names score 1.

    Sets of trigrams are joined by alike(): a name meets only those of a size that can reach `least`."""
    asked, listed = (rows.withColumn("grams", trigrams(F.col("core"))) for rows in _cores(names, securities))
    ranked = ranks(listed)
    pairs = alike(coded(asked, ["name", "core"], ranked, "a_").drop("core"), coded(listed, ["security_id", "core"], ranked, "b_").drop("core"), least)
    return pairs.groupBy("name", "security_id").agg(F.max("likeness").alias("score"))


#: Sets of fewer trigrams than this, if they aren't equal, are less alike than 0.995, which no rounding to two places makes 1.
_WHOLE = 199


def equal_names(names: DataFrame, securities: DataFrame) -> DataFrame:
    """Distinct names (name) with the securities whose name or filed name has the same trigrams once both are core names: name, security_id, score 1. Names of
    _WHOLE trigrams or more, which others than these can be as good for, aren't answered. An equality join, however many names there are."""
    spelled = F.array_join(F.array_sort(trigrams(F.col("core"))), "|").alias("spelled")
    asked, listed = _cores(names, securities)
    asked, listed = asked.select("name", spelled).where(F.size(F.split("spelled", "[|]")) < _WHOLE), listed.select("security_id", spelled).where("spelled <> ''").distinct()
    return asked.join(listed, "spelled").select("name", "security_id", F.lit(1.0).alias("score"))


def same_listing(given: Column, ticker: Column) -> Column:
    """Equal tickers, or the given one with a V at its end, as a spin-off has before it trades."""
    return (given == ticker) | ((F.length(given) >= 4) & (given == F.concat(ticker, F.lit("V"))))


def resolve_assets(lines: DataFrame, overrides: DataFrame, securities: DataFrame, aliases: DataFrame, held: DataFrame) -> DataFrame:
    """lines (id, asset_type, asset_name, ticker, day) to id, asset_class, security_id, method, confidence.

    A person's override of the line's key comes first, then its class, which may rule a security out. A ticker, given or in the name, is
    taken if the names agree; one that disagrees stands unless a name is very close to another security. Without a ticker the likeliest
    name is taken from NAME_ACCEPT on: by score to two places, listed on the day, dollars held that year and the one before, having a
    ticker. overrides: key, security_id, asset_class. held: security_id, year, value, last_held.
    """
    kind = classify(F.col("asset_type"), F.col("asset_name"), F.col("ticker"), F.lit(None).cast("string"))
    rows = lines.repartition("id").select("id", "asset_name", "day", asset_key(F.col("asset_type"), F.col("ticker"), F.col("asset_name")).alias("key"), kind.alias("kind"), extract_ticker(F.coalesce("asset_name", F.lit("")), F.col("ticker")).alias("symbol"))
    given = overrides.select("key", F.struct(F.col("security_id").alias("security_id"), F.col("asset_class").alias("asset_class")).alias("given"))
    rows = written(rows.join(given, "key", "left"), "rows")  # read three times below
    looked = rows.where("given is null and kind.lookup").withColumn("core", core_name(F.col("asset_name")))
    securities = written(with_cores(securities.repartition("security_id")), "securities")  # core names are worked out once
    names = securities.select("security_id", F.struct("name", "filed_name", "ticker", "delisted_by", "cores").alias("about"))
    last = held.groupBy("security_id").agg(F.max("last_held").alias("last_held"))
    asked = looked.where("symbol is not null").select(F.col("symbol.ticker").alias("symbol"), "day")
    hits = lookup_on(asked, aliases, securities, last).join(names, "security_id").select(F.col("symbol").alias("s"), F.col("day").alias("d"), F.struct("security_id", "via", "about").alias("hit"))
    looked = looked.join(hits, (F.col("symbol.ticker") == F.col("s")) & (F.col("day") == F.col("d")), "left").drop("s", "d")
    likeness = F.when(F.col("asset_name").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hit.about.cores", lambda c: core_similarity(F.col("core"), c))), F.lit(0.0)))
    weak = F.col("symbol.hinted") | (F.col("hit.via") == 2)
    agrees = likeness >= F.when(F.col("symbol.hinted"), HINT_AGREES).otherwise(TICKER_AGREES)
    fits = looked.withColumns({"fits": F.coalesce(F.col("hit").isNotNull() & agrees, F.lit(False)), "against": F.coalesce(F.col("hit").isNotNull() & ~weak & ~agrees, F.lit(False)), "weak": F.coalesce(weak, F.lit(False))})
    looked = written(fits.drop("given"), "looked")  # read three times below
    # the likeliest name, for lines that need one
    needs = looked.where("not fits and kind.by_name and asset_name is not null").select("id", "asset_name", "core", "day")
    years = held.groupBy("security_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("years"))
    of_year = lambda back: F.coalesce(F.try_element_at("years", F.year("day") - back), F.lit(0).cast("decimal(20,2)"))

    def likeliest(lines: DataFrame, found: DataFrame) -> DataFrame:
        ranked = lines.join(found.withColumnRenamed("name", "asset_name"), "asset_name").join(names, "security_id").join(years, "security_id", "left")
        wanted, theirs = share_class(F.col("asset_name")), F.coalesce(share_class(F.col("about.name")), share_class(F.col("about.filed_name")))
        ranked = ranked.where(wanted.isNull() | theirs.isNull() | (wanted == theirs))  # another class of the issuer is another security
        listed = F.col("about.delisted_by").isNull() | (F.col("about.delisted_by") > F.col("day"))
        order = F.struct(F.round("score", 2), listed, (of_year(0) + of_year(1)), F.col("about.ticker").isNotNull(), -F.col("security_id"))
        return ranked.groupBy("id").agg(F.max_by(F.struct("security_id", "score", F.col("about.ticker").alias("ticker")), order).alias("best"))

    # nothing that is merely alike outdoes an equal name, so the fuzzy join is left to lines without one
    same = written(likeliest(needs, equal_names(needs.select(F.col("asset_name").alias("name"), "core"), securities)), "same")
    others = needs.join(same, "id", "left_anti")
    best = same.unionByName(likeliest(others, name_candidates(others.select(F.col("asset_name").alias("name"), "core"), securities)))
    looked = looked.join(best, "id", "left")
    overrules = F.coalesce((F.col("best.score") >= NAME_OVERRULES) & (F.col("best.security_id") != F.col("hit.security_id")), F.lit(False))
    ticker = F.when(F.col("symbol.hinted"), F.lit(None)).otherwise(F.col("symbol.ticker"))
    named = F.least(F.round("best.score", 3), F.lit(NAME_CEILING))
    elsewhere = F.coalesce(ticker.isNotNull() & F.col("best.ticker").isNotNull() & ~same_listing(ticker, F.col("best.ticker")), F.lit(False))
    answer = lambda who, how, sure: F.struct(who.alias("security_id"), F.lit(how).alias("method"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("confidence"))
    hit, name = F.col("hit.security_id"), F.col("best.security_id")
    result = (
        F.when(F.col("fits") & (F.col("hit.via") == 2), answer(hit, "former_ticker", FORMER)).when(F.col("fits") & F.col("weak"), answer(hit, "ticker", FORMER)).when(F.col("fits"), answer(hit, "ticker", ON_THE_DAY))
        .when(F.col("against") & overrules, answer(name, "name", named)).when(F.col("against"), answer(hit, "ticker", DISAGREEING))
        .when(name.isNotNull(), answer(name, "name", F.when(elsewhere, F.least(named, F.lit(OTHER_LISTING))).otherwise(named)))
    )
    done = looked.withColumn("r", result).select("id", F.when(F.col("r").isNotNull(), F.col("kind.asset_class")).otherwise(F.col("kind.otherwise")).alias("asset_class"), "r.security_id", "r.method", "r.confidence")
    plain = rows.where("given is null and not kind.lookup").select("id", F.col("kind.asset_class").alias("asset_class"), F.lit(None).cast("long").alias("security_id"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("confidence"))
    manual = rows.where("given is not null").select("id", F.coalesce("given.asset_class", "kind.asset_class").alias("asset_class"), F.col("given.security_id").alias("security_id"), F.lit("manual").alias("method"), F.when(F.col("given.security_id").isNotNull(), ON_THE_DAY).alias("confidence"))
    return done.unionByName(plain).unionByName(manual)


def asset_coverage(resolved: DataFrame, resolvable: list[str], low: float = 0.8) -> DataFrame:
    """resolved (chamber, filing_id, asset_class, security_id, confidence) to a row for each chamber: lines, those that should name a
    stock and do, those of low confidence, and filings resolved wholly or partly."""
    should, found = F.coalesce(F.col("asset_class").isin(resolvable), F.lit(False)), F.col("security_id").isNotNull()
    count = lambda test: F.count(F.when(test, 1))
    each = resolved.groupBy("chamber", "filing_id").agg(
        F.count("*").alias("lines"), count(F.col("asset_class").isNull()).alias("pending"), count(should).alias("resolvable"), count(should & found).alias("r"), count(found).alias("found"), count(found & (F.col("confidence") < low)).alias("low")
    )
    return each.groupBy("chamber").agg(
        *(F.sum(c).alias(c) for c in ("lines", "pending", "resolvable")), F.sum("found").alias("resolved"), F.sum("low").alias("low_confidence"), count(F.col("resolvable") > 0).alias("filings"),
        count((F.col("resolvable") > 0) & (F.col("r") == F.col("resolvable"))).alias("filings_resolved"), count((F.col("r") > 0) & (F.col("r") < F.col("resolvable"))).alias("filings_partly"),
    )
