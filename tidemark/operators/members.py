"""Which member of Congress a filed name is, and what becomes of the candidates that a person is to choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERATIONS, QUOTED, folded_words, name_parts, trigrams
from ..sources.store import written
from .alike import alike, coded, ranks

#: Scores of an exact and a normalised fit, the factor of a member out of office, what is accepted without a person, the least similarity
#: of a candidate, how many candidates are kept, and days after a term's end for which filings still come.
EXACT, NORMALISED, OUT_OF_OFFICE, ACCEPT, TRIGRAM, CANDIDATES, GRACE = 1.0, 0.95, 0.6, 0.9, 0.3, 3, 366


def _spaced(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def in_office(chamber: str = "chamber", state: str = "state", terms: str = "terms") -> Column:
    """Does a term of the chamber, and of the state if one is given, overlap the days of the filings, with GRACE days after its end?"""
    return F.exists(terms, lambda t: (t["chamber"] == F.col(chamber)) & (F.col(state).isNull() | (t["state"] == F.col(state))) & (t["start_date"] <= F.col("last_filed")) & (F.date_add(t["end_date"], GRACE) >= F.col("first_filed")))


def known_members(member: DataFrame, terms: DataFrame) -> DataFrame:
    """Members with every way in which they are written: `spellings` that count as exact, `folded` ones, surnames, and given names that a
    filing may use alone. member: member_id, first_name, last_name, and, where there are such columns, middle_name, nickname, full_name and other_last_names."""
    has = lambda name, kind: F.col(name) if name in member.columns else F.lit(None).cast(kind)
    middle, nickname, full, others = has("middle_name", "string"), has("nickname", "string"), has("full_name", "string"), F.coalesce(has("other_last_names", "array<string>"), F.array().cast("array<string>"))
    lasts = F.concat(F.array("last_name"), others)
    firsts = F.array_compact(F.array("first_name", nickname))
    written = F.flatten(F.transform(lasts, lambda b: F.flatten(F.transform(firsts, lambda a: F.array(F.concat_ws(" ", a, b), F.concat_ws(" ", a, middle, b))))))
    plain = F.regexp_replace(F.trim(full), rf"(?i),?\s+({'|'.join(GENERATIONS)})\.?$", "")
    spellings = F.array_distinct(F.transform(F.concat(written, F.array_compact(F.array(plain))), _spaced))
    folded = F.array_distinct(F.transform(spellings, lambda s: _joined(F.filter(folded_words(F.regexp_replace(s, QUOTED, " ")), lambda w: ~w.isin(GENERATIONS)))))
    given = F.transform(F.array_compact(F.array("first_name", middle, nickname, full)), lambda n: F.try_element_at(folded_words(n), F.lit(1)))
    seats = terms.groupBy("member_id").agg(F.collect_list(F.struct("chamber", "state", "start_date", "end_date")).alias("terms"))
    rows = member.join(seats, "member_id").select(
        "member_id", "terms", spellings.alias("spellings"), folded.alias("folded"), F.transform(lasts, lambda b: _joined(folded_words(b))).alias("surnames"),
        F.filter(F.array_compact(given), lambda w: F.length(w) > 1).alias("given_names"),  # an initial fits too many
    )
    return rows


def match_members(filed: DataFrame, member: DataFrame, terms: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """filed (name_id, first_name, last_name, chamber, state, first_filed, last_filed) to candidates: name_id, member_id, method,
    confidence, accepted; CANDIDATES at most, the likeliest first.

    A member with a word of the filed surname in a surname of theirs fits exactly if they are written like that but for case and spaces; normalised if a folded form
    is one of theirs, or the surname is and a given name or nickname starts like one of theirs. Those in office share their score, and one alone
    of ACCEPT or more is accepted. If none in office fits, those out of office do with a factor, and members in office by trigrams.
    refused (name_id, member_id): what a person has ruled out.
    """
    known = written(known_members(member, terms), "known")  # read three times below
    parts = name_parts(F.col("first_name"), F.col("last_name"))
    asked = filed.repartition("name_id").withColumn("parts", parts).select(
        "name_id", "chamber", "state", "first_filed", "last_filed", F.col("parts.surname").alias("words"), _joined(F.col("parts.surname")).alias("surname"), _spaced(F.concat_ws(" ", "first_name", "last_name")).alias("spelled"),
        F.filter(F.array_distinct(F.concat(F.array(_joined(F.concat("parts.given", "parts.surname"))), F.transform("parts.nicknames", lambda n: _joined(F.concat(n, F.col("parts.surname")))))), lambda f: f != "").alias("forms"),
        F.array_compact(F.concat(F.slice("parts.given", 1, 1), F.transform("parts.nicknames", lambda n: F.try_element_at(n, F.lit(1))))).alias("firsts"),
    )
    asked = written(asked, "filed")  # read twice below
    by_word = known.withColumn("word", F.explode(F.array_distinct(F.flatten(F.transform("surnames", lambda s: F.split(s, " "))))))
    sharing = asked.withColumn("word", F.explode(F.array_distinct("words"))).join(by_word, "word").drop("word", "words").dropDuplicates(["name_id", "member_id"])
    if refused is not None:
        sharing = sharing.join(refused.select("name_id", "member_id").distinct(), ["name_id", "member_id"], "left_anti")
    alike = F.arrays_overlap("forms", "folded") | (F.array_contains("surnames", F.col("surname")) & F.arrays_overlap("firsts", "given_names"))
    method = F.when(F.array_contains("spellings", F.col("spelled")), "exact").when(F.coalesce(alike, F.lit(False)), "normalised")
    fits = sharing.withColumns({"method": method, "sits": in_office()}).where("method is not null")
    by = Window.partitionBy("name_id")
    fits = fits.withColumns({"seated": F.sum(F.col("sits").cast("int")).over(by), "all": F.count("*").over(by)}).where("sits or seated = 0")
    fits = written(fits.select("name_id", "member_id", "method", "sits", "seated", "all"), "fits")  # read twice below
    base = F.when(F.col("method") == "exact", EXACT).otherwise(NORMALISED)
    fits = fits.withColumn("confidence", F.round(F.when(F.col("sits"), base / F.col("seated")).otherwise(base * OUT_OF_OFFICE / F.col("all")), 3))
    sure = fits.select("name_id", "member_id", "method", "confidence", (F.col("sits") & (F.col("seated") == 1) & (F.col("confidence") >= ACCEPT)).alias("accepted"))

    open_names = asked.join(fits.where("sits").select("name_id").distinct(), "name_id", "left_anti").select("name_id", "chamber", "state", "first_filed", "last_filed", "forms")
    near = likest_members(open_names, known, refused)
    every = sure.unionByName(near.select("name_id", "member_id", F.lit("trigram").alias("method"), F.round("likest", 3).alias("confidence"), F.lit(False).alias("accepted")))
    order = Window.partitionBy("name_id").orderBy(F.col("confidence").desc(), "member_id", "method")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)


#: Likenesses down to which members are looked for, one after another: names that have enough of a higher one leave the later, larger searches.
STEPS = (0.5, 0.4, TRIGRAM)


def likest_members(open_names: DataFrame, known: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """name_id, member_id, likest of names (name_id, chamber, state, first_filed, last_filed, forms) and members in office of their seats, by the likest of their
    forms: all that a name has among its CANDIDATES likest, ties too.

    alike() joins sets of trigrams within the seat. A degree is high at first; a name with CANDIDATES members well above it is done.
    """
    seat = lambda t, state: F.struct(t["chamber"].alias("chamber"), state.alias("state"))
    seats = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.array(seat(t, t["state"]), seat(t, F.lit(None).cast("string"))))))
    spans = F.transform(F.filter("terms", lambda t: (t["chamber"] == F.col("seat.chamber")) & (F.col("seat.state").isNull() | (t["state"] == F.col("seat.state")))), lambda t: F.struct(t["start_date"].alias("start_date"), t["end_date"].alias("end_date")))

    def sets(rows: DataFrame, key: str, forms: str) -> DataFrame:
        return rows.select(key, F.explode(forms).alias("form")).distinct().withColumn("grams", trigrams(F.col("form"))).where("size(grams) > 0")

    theirs = written(sets(known, "member_id", "folded"), "sets")
    ranked = written(ranks(theirs), "ranks")
    asked = open_names.select("name_id", F.struct("chamber", "state").alias("seat"), "first_filed", "last_filed").join(coded(sets(open_names, "name_id", "forms"), ["name_id", "form"], ranked, "a_").drop("form"), "name_id")
    asked = written(asked, "asked")
    seated = known.select("member_id", "terms", F.explode(seats).alias("seat")).join(F.broadcast(asked.select("seat").distinct()), "seat", "left_semi").select("member_id", "seat", spans.alias("spans"))
    seated = written(seated.join(coded(theirs, ["member_id", "form"], ranked, "b_").drop("form"), "member_id"), "seated")
    found = None
    for degree in STEPS:
        near = alike(asked, seated, degree, ("seat",)).select("name_id", "member_id", "likeness", "first_filed", "last_filed", F.inline("spans"))  # no lambda, which would keep the join from being compiled
        near = near.where((F.col("start_date") <= F.col("last_filed")) & (F.date_add("end_date", GRACE) >= F.col("first_filed")))
        if refused is not None:
            near = near.join(refused.select("name_id", "member_id").distinct(), ["name_id", "member_id"], "left_anti")
        near = near.groupBy("name_id", "member_id").agg(F.max("likeness").alias("likest"))
        order = Window.partitionBy("name_id").orderBy(F.round("likest", 3).desc(), "member_id")
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES).drop("place")
        near = written(near, "near")
        # others are below the degree, and 0.001 above it no rounding to three places makes them equal
        done = near.where(F.col("likest") >= degree + 0.001).groupBy("name_id").agg(F.count("*").alias("n")).where(F.col("n") >= CANDIDATES).select("name_id")
        if degree == STEPS[-1]:
            own = near
        else:
            done = written(done, "done")
            own = near.join(done, "name_id", "left_semi")
            asked = asked.join(done, "name_id", "left_anti")
        found = own if found is None else found.unionByName(own)
    return found


# ---------------------------------------------------------------- candidates over time

#: Columns of a candidate.
_CANDIDATE = ["candidate_id", "name_id", "member_id", "method", "confidence", "status", "opened_at", "closed_at"]


def ruled(candidates: DataFrame, rulings: DataFrame, at: str) -> DataFrame:
    """Candidates after a person's rulings (name_id, member_id, ruling: accepted or rejected) on pending ones. Where one of a name is accepted, its
    other pending ones are superseded. A ruling on what isn't pending changes nothing."""
    told = rulings.where("ruling in ('accepted', 'rejected')").groupBy("name_id", "member_id").agg(F.min("ruling").alias("ruling"))
    rows = candidates.join(told, ["name_id", "member_id"], "left").withColumn("ruling", F.when(F.col("status") == "pending", F.col("ruling")))
    chosen = F.max(F.when(F.col("ruling") == "accepted", 1).otherwise(0)).over(Window.partitionBy("name_id")) == 1
    new = F.when(F.col("status") != "pending", F.col("status")).when(F.col("ruling").isNotNull(), F.col("ruling")).when(chosen, "superseded").otherwise(F.col("status"))
    rows = rows.withColumn("new", new)
    closed = F.when(F.col("new") != F.col("status"), F.lit(at).cast("timestamp")).otherwise(F.col("closed_at"))
    return rows.withColumns({"closed_at": closed, "status": F.col("new")}).select(*_CANDIDATE)


def merged(candidates: DataFrame, found: DataFrame, asked: DataFrame, at: str) -> DataFrame:
    """Candidates after a pass of match_members (`found`) over the names `asked`, with `event`: opened, reopened, changed, closed, or null.

    A name that is matched, by the pass or by a person, wants no candidates. Of another's pending ones those that are found again stay what they are, with the pass's
    method and confidence; the rest are superseded. What is found anew is opened, reopened where the pair was superseded before; a pair that a person has
    rejected never is. Names that weren't asked keep all. One join of each name's pending and wanted pairs decides it.
    """
    at_ = F.lit(at).cast("timestamp")
    of = asked.select("name_id").distinct()
    settled = candidates.where("status = 'accepted'").select("name_id").unionByName(found.where("accepted").select("name_id")).distinct()
    barred = candidates.where("status = 'rejected'").select("name_id", "member_id").distinct()
    was = candidates.where("status = 'superseded'").select("name_id", "member_id", F.lit(True).alias("before")).distinct()
    best = found.groupBy("name_id", "member_id").agg(F.max(F.struct("confidence", "method")).alias("w"))
    wanted = best.join(of, "name_id", "left_semi").join(settled, "name_id", "left_anti").join(barred, ["name_id", "member_id"], "left_anti")
    wanted = wanted.select("name_id", "member_id", F.col("w.method").alias("new_method"), F.col("w.confidence").alias("new_confidence"))
    live = (F.col("status") == "pending") & F.col("of").isNotNull()
    marked = candidates.join(of.withColumn("of", F.lit(True)), "name_id", "left")
    both = marked.where(live).drop("of").join(wanted, ["name_id", "member_id"], "full").join(was, ["name_id", "member_id"], "left")
    kept = F.col("candidate_id").isNotNull() & F.col("new_method").isNotNull()
    opened = F.col("candidate_id").isNull()
    changed = ~F.col("method").eqNullSafe(F.col("new_method")) | ~F.col("confidence").eqNullSafe(F.col("new_confidence"))
    rows = both.select(
        F.coalesce("candidate_id", F.concat_ws(":", F.col("name_id").cast("string"), F.col("member_id").cast("string"), F.lit(at))).alias("candidate_id"), "name_id", "member_id",
        F.coalesce("new_method", "method").alias("method"), F.coalesce("new_confidence", "confidence").alias("confidence"), F.when(kept | opened, "pending").otherwise("superseded").alias("status"),
        F.coalesce("opened_at", at_).alias("opened_at"), F.when(~kept & ~opened, at_).alias("closed_at"),
        F.when(opened, F.when(F.col("before"), "reopened").otherwise("opened")).when(~kept, "closed").when(changed, "changed").alias("event"),
    )
    return marked.where(~live).select(*_CANDIDATE, F.lit(None).cast("string").alias("event")).unionByName(rows)


def named(found: DataFrame, candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked name's status (matched, review or unmatched), member, method and confidence: a person's choice, else what was accepted, else the best candidate's confidence."""
    chosen = candidates.where("status = 'accepted'").groupBy("name_id").agg(F.min("member_id").alias("by_hand"))
    best = found.groupBy("name_id").agg(F.max("confidence").alias("likeliest"), F.max(F.when(F.col("accepted"), F.struct("member_id", "method", "confidence"))).alias("a"))
    rows = asked.select("name_id").distinct().join(chosen, "name_id", "left").join(best, "name_id", "left")
    status = F.when(F.col("by_hand").isNotNull() | F.col("a").isNotNull(), "matched").when(F.col("likeliest").isNotNull(), "review").otherwise("unmatched")
    hand = F.col("by_hand").isNotNull()
    return rows.select("name_id", status.alias("status"), F.coalesce("by_hand", "a.member_id").alias("member_id"), F.when(hand, "manual").otherwise(F.col("a.method")).alias("method"), F.when(~hand, F.coalesce("a.confidence", "likeliest")).alias("confidence"))
