"""Streams and their batch twins: late filings, deduplicated arrivals, activity series, rate limits and mail batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.periods import in_filing_window
from ..sources.store import written

#: Minutes that a batch of notices waits from its first.
WAIT = 15


def touched_pairs(filings: DataFrame) -> DataFrame:
    """The (filer_id, period) that arriving filings revise; late amendments are filings like any other."""
    return filings.where("filer_id is not null").select("filer_id", "period").distinct()


def on_arrival(filings: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream of filings that calls recompute(pairs, batch) for each micro-batch. The checkpoint is the watermark of the crawl: a batch
    that fails is given again, so recompute must replace what it wrote."""
    return filings.writeStream.foreachBatch(lambda batch, n: recompute(touched_pairs(batch), n)).option("checkpointLocation", checkpoint)


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs instants; a table as it is."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def arrivals_once(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once, for streams (state is kept while duplicates may come) and for tables."""
    return _timed(events, at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def daily_counts(events: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """Events and value by day and type; on a stream a day is given out when it can't change any more."""
    return _timed(events, at, late).groupBy(F.window(at, "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "events", "value")


def active_users(events: DataFrame, at: str, user: str, spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Distinct users of each day and of the days up to it. A user's day is dealt to the days that look back on it, so counts are plain
    grouped ones and no frame holds a set."""
    days = events.select(F.col(user).alias("user"), F.to_date(at).alias("seen")).where("user is not null").distinct()
    axis = days.select(F.col("seen").alias("day")).distinct()
    dealt = days.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(max(spans) - 1)))).withColumn("day", F.date_add("seen", F.col("ahead"))).join(F.broadcast(axis), "day")
    nearest = dealt.groupBy("day", "user").agg(F.min("ahead").alias("ahead"))
    return nearest.groupBy("day").agg(*(F.sum((F.col("ahead") < n).cast("long")).alias(f"active_{n}") for n in spans))


def activity_series(events: DataFrame, at: str, user: str, every: str, today: str) -> DataFrame:
    """first_day, last_day, events, active, partial of each day, ISO week or month (`every`) from the first event to today.

    Groups without events are there with zeros. One is partial if it isn't over, or if the events began within it.
    """
    rows = events.select(F.to_date(at).alias("day"), F.col(user).alias("user")).where(F.col("day") <= F.lit(today).cast("date"))
    axis = rows.agg(F.min("day").alias("a")).select(F.explode(F.sequence("a", F.lit(today).cast("date"))).alias("day"))
    first = F.trunc("day", every) if every != "day" else F.col("day")
    last = {"day": F.col("first_day"), "week": F.date_add("first_day", 6), "month": F.last_day("first_day")}[every]
    days = axis.groupBy(first.alias("first_day")).agg(F.count("*").alias("days")).withColumn("last_day", last)
    sums = rows.groupBy(first.alias("first_day")).agg(F.count("*").alias("events"), F.countDistinct("user").alias("active"))
    partial = (F.col("last_day") >= F.lit(today).cast("date")) | (F.col("days") < F.datediff("last_day", "first_day") + 1)
    return days.join(sums, "first_day", "left").fillna(0, ["events", "active"]).select("first_day", "last_day", "events", "active", partial.alias("partial"))


def over_limit(requests: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """Requests that come when the key had `most` others in the seconds before."""
    when = F.unix_micros(F.col(at).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("__at", when).withColumn("in_window", F.count("*").over(frame)).where(F.col("in_window") > most).drop("__at")


def mail_batches(items: DataFrame, user: str, at: str, wait: int = WAIT) -> DataFrame:
    """Each user's waiting items as batches: one is sent `wait` minutes after its first item, with all that came by then.

    Each moment points to the first one beyond its wait, where the next batch would start; batches start at the moments that
    the first one leads to. These are found by doubling the pointers' reach, in rounds in the logarithm of the
    longest row of batches, so no user's items are folded in one row.
    """
    span = wait * 60 * 1_000_000
    moments = items.select(F.col(user), F.unix_micros(F.col(at).cast("timestamp")).alias("t")).groupBy(user, "t").agg(F.count("*").alias("n"))
    by = Window.partitionBy(user).orderBy("t")
    reach = by.rangeBetween(0, span)
    rows = moments.withColumns({"place": F.row_number().over(by), "ahead": F.count("*").over(reach), "items": F.sum("n").over(reach)})
    rows = written(rows.select(user, "t", "place", (F.col("place") + F.col("ahead")).alias("next"), "items"), "moments")
    starts, jump = rows.where("place = 1").select(user, "place"), rows.select(user, "place", "next")
    while True:
        more = starts.join(jump, [user, "place"]).select(user, F.col("next").alias("place")).join(rows.select(user, "place"), [user, "place"], "left_semi").join(starts, [user, "place"], "left_anti")
        more = written(more.distinct(), "starts")
        if more.isEmpty():
            break
        starts = written(starts.unionByName(more), "starts")
        jump = written(jump.join(jump.select(user, F.col("place").alias("next"), F.col("next").alias("after")), [user, "next"]).select(user, "place", F.col("after").alias("next")), "jumps")
    return rows.join(starts, [user, "place"], "left_semi").select(user, F.timestamp_micros(F.col("t") + F.lit(span)).alias("sent_at"), "items")


#: Mails that a user gets in a day at most, and the hour of the digest, both by the user's own clock.
DAILY, DIGEST_HOUR = 3, 19


def is_quiet(hour: Column, first: Column, last: Column) -> Column:
    """Is the hour in quiet hours, which may run over midnight? Equal ends are none."""
    return F.when(first == last, False).when(first > last, (hour >= first) | (hour < last)).otherwise((hour >= first) & (hour < last))


def due_mail(waiting: DataFrame, users: DataFrame, now: str, wait: int = WAIT) -> DataFrame:
    """What goes at an instant for each user with something waiting: user_id, action (digest, batch, to_digest, wait), items; a digest and a batch
    may go at once, each a row.

    waiting: user_id, kind (instant, digest or season), since. users: user_id, zone, quiet_from and quiet_to (hours, may run over midnight), sent_today
    and, if there are such columns, digest_emails (whether season items are mailed; false without) and last_digest (the DIGEST_HOUR by the user's clock whose digest has gone).

    Nothing goes in quiet hours. The digest first: all on it that was queued by the last DIGEST_HOUR, once, if it has nothing to mail or the day has
    room. Then the batch, `wait` minutes after its oldest item, with all instant items: while today's digest is ahead and will have something to mail
    the last of the DAILY mails is its own, and a batch without room goes to the digest. Groups are counts and a minimum, so a
    user with many items is as cheap as one with few.
    """
    at = F.lit(now).cast("timestamp")
    has = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in users.columns else otherwise
    known = users.select("user_id", "zone", "quiet_from", "quiet_to", "sent_today", has("digest_emails", F.lit(False)).alias("digest_emails"), has("last_digest", F.lit(None).cast("timestamp")).alias("last_digest"))
    local = F.from_utc_timestamp(at, F.col("zone"))
    evening = F.date_trunc("day", local) + F.make_interval(hours=F.lit(DIGEST_HOUR))
    known = known.withColumns({"local": local, "slot": F.when(local >= evening, evening).otherwise(evening - F.expr("interval 1 day"))})
    rows = waiting.join(known, "user_id").withColumn("due", F.from_utc_timestamp(F.col("since").cast("timestamp"), F.col("zone")) <= F.col("slot"))
    count = lambda test: F.count_if(test)
    sums = rows.groupBy("user_id").agg(
        *(F.first(c).alias(c) for c in ("local", "slot", "quiet_from", "quiet_to", "sent_today", "digest_emails", "last_digest")), F.min(F.when(F.col("kind") == "instant", F.col("since").cast("timestamp"))).alias("oldest"),
        count(F.col("kind") == "instant").alias("instant"), *(count((F.col("kind") == k) & (F.col("due") if now_ else ~F.col("due"))).alias(f"{k}_{'due' if now_ else 'later'}") for k in ("digest", "season") for now_ in (True, False)),
    )
    c, hour = F.col, F.hour("local")
    quiet = is_quiet(hour, c("quiet_from"), c("quiet_to"))
    due, mailed = c("digest_due") + c("season_due"), c("digest_due") + F.when(c("digest_emails"), c("season_due")).otherwise(0)
    done = F.coalesce(c("last_digest") >= c("slot"), F.lit(False))
    sums = sums.withColumn("digest_goes", ~quiet & (due > 0) & ~done & ((mailed == 0) | (c("sent_today") < DAILY)))
    sent = c("sent_today") + F.when(c("digest_goes") & (mailed > 0), 1).otherwise(0)
    left = lambda kind: c(f"{kind}_later") + F.when(c("digest_goes"), 0).otherwise(c(f"{kind}_due"))
    ahead = (hour < DIGEST_HOUR) & ((left("digest") > 0) | (c("digest_emails") & ((left("season") > 0) | in_filing_window(F.to_date("local")))))
    ripe = ~quiet & F.coalesce(F.unix_timestamp("oldest") + wait * 60 <= F.unix_timestamp(at), F.lit(False))
    room = sent + ahead.cast("int") < DAILY
    action = lambda name, holds, items: F.when(holds, F.struct(F.lit(name).alias("action"), items.cast("long").alias("items")))
    acts = F.array_compact(F.array(action("digest", c("digest_goes"), due), action("batch", ripe & room, c("instant")), action("to_digest", ripe & ~room, c("instant"))))
    acts = F.when(F.size(acts) > 0, acts).otherwise(F.array(F.struct(F.lit("wait").alias("action"), F.lit(0).cast("long").alias("items"))))
    return sums.select("user_id", F.explode(acts).alias("a")).select("user_id", "a.*")


def crawl_progress(days: DataFrame, read: DataFrame, last: str) -> DataFrame:
    """How far each crawl has come: source, first_day, watermark, next_day, done_ahead, missing.

    days (source, first_day): where each crawl begins. read (source, day, listed, loaded): what a day's index listed and how much of it was loaded, a row for each
    try. A day is read when a try loaded all that it listed. The watermark is the last day before the first that isn't read, null at the very start, so a
    crawl that starts there again leaves nothing out; days after it may be done already (done_ahead) and those that aren't (missing) are all that is left.
    """
    axis = days.select("source", F.col("first_day").cast("date").alias("first_day"), F.explode(F.sequence(F.col("first_day").cast("date"), F.lit(last).cast("date"))).alias("day"))
    whole = read.where("loaded >= listed").select("source", F.col("day").cast("date").alias("day"), F.lit(True).alias("whole")).distinct()
    rows = axis.join(whole, ["source", "day"], "left").fillna(False, ["whole"])
    holes = rows.groupBy("source", "first_day").agg(F.min(F.when(~F.col("whole"), F.col("day"))).alias("next_day"), F.count_if(~F.col("whole")).alias("missing"), F.count_if("whole").alias("full"))
    mark = F.coalesce(F.date_sub("next_day", 1), F.lit(last).cast("date"))
    ahead = F.col("full") - F.datediff(mark, F.date_sub("first_day", 1))
    return holes.select("source", "first_day", F.when(mark >= F.col("first_day"), mark).alias("watermark"), "next_day", ahead.cast("long").alias("done_ahead"), "missing")


def days_to_read(days: DataFrame, read: DataFrame, last: str) -> DataFrame:
    """(source, day) still to be read, from each crawl's watermark on; what is done beyond it isn't read again."""
    axis = days.select("source", F.explode(F.sequence(F.col("first_day").cast("date"), F.lit(last).cast("date"))).alias("day"))
    return axis.join(read.where("loaded >= listed").select("source", F.col("day").cast("date").alias("day")), ["source", "day"], "left_anti")
