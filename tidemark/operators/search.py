"""Search of stocks and investors by name: starts first, then what is alike."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import containment, strict_word_similarity, trigrams, word_similarity

#: What a match is worth, the least letters of a fuzzy search, and the least similarities of a candidate.
EXACT, TICKER_START, NAME_START, FUZZY_MAX, LETTERS, WORD, STRICT = 100, 90, 80, 70, 3, 0.6, 0.5


def _alike(query: str, column: Column) -> Column:
    """1 where the query is whole words of the text, else the mean of its two word similarities; null for a candidate of neither.

    A text without half the query's trigrams can reach neither bound, and its similarities aren't worked out.
    """
    bound = r"[\p{L}\p{N}_]"
    whole = f"(?i)(?<!{bound})" + r"\s+".join(re.escape(w) for w in query.split()) + f"(?!{bound})"
    word, strict = word_similarity(query, column), strict_word_similarity(query, column)
    value = F.when(column.rlike(whole), F.lit(1.0)).otherwise((word + strict) / 2)
    return F.when((containment(F.lit(query), column) >= STRICT) & ((word >= WORD) | (strict >= STRICT)), value)


def name_postings(names: DataFrame, key: str, *columns: str) -> DataFrame:
    """(gram, key): in which rows the trigrams of some columns are. Kept by gram, a search reads those of its query alone."""
    grams = F.array_distinct(F.flatten(F.transform(F.array_compact(F.array(*columns)), trigrams)))
    return names.select(F.explode(grams).alias("gram"), key).distinct()


def candidates(postings: DataFrame, key: str, query: str) -> DataFrame | None:
    """The keys of rows that a search for the query can find: with half its trigrams, or all but the one at its end, which a longer word lacks that starts
    like its last. None where it has no letters or digits, for which there are no postings."""
    grams = sorted({f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", query.lower()) for i in range(len(w) + 1)})
    if not grams:
        return None
    least = max(1, min((len(grams) + 1) // 2, len(grams) - 1))
    return postings.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)


def _near(names: DataFrame, key: str, query: str, postings: DataFrame | None) -> DataFrame:
    near = None if postings is None else candidates(postings, key, query)
    return names if near is None else names.join(near, key, "left_semi")


def search_stocks(names: DataFrame, query: str, limit: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """names (id, ticker, name, held) with a score: EXACT the ticker itself, TICKER_START and NAME_START for starts, else
    up to FUZZY_MAX. All starts score above all else, so one order serves. Ties go to what is most held, then the smaller id.
    postings: those of name and ticker by id; without them all names are looked at."""
    q = query.strip()
    starts = F.when(F.upper("ticker") == q.upper(), F.lit(float(EXACT))).when(F.lower("ticker").startswith(q.lower()), F.lit(float(TICKER_START))).when(F.lower("name").startswith(q.lower()), F.lit(float(NAME_START)))
    fuzzy = F.greatest(_alike(q, F.col("name")), _alike(q, F.col("ticker"))) * FUZZY_MAX if len(q) >= LETTERS else F.lit(None).cast("double")
    full = _near(names, "id", q, postings).withColumn("score", F.coalesce(starts, fuzzy)).where("score is not null")
    return full.orderBy(F.col("score").desc(), F.coalesce("held", F.lit(-1)).desc(), "id").limit(limit)


def search_investors(names: DataFrame, query: str, limit: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """names (slug, display_name, manager_name, held), likewise; ties go to the larger portfolio, then the name and slug. postings: those of both names by slug."""
    q = query.strip()
    starts = F.when(F.lower("display_name").startswith(q.lower()) | F.coalesce(F.lower("manager_name").startswith(q.lower()), F.lit(False)), F.lit(float(NAME_START)))
    fuzzy = F.greatest(_alike(q, F.col("display_name")), _alike(q, F.col("manager_name"))) * FUZZY_MAX if len(q) >= LETTERS else F.lit(None).cast("double")
    full = _near(names, "slug", q, postings).withColumn("score", F.coalesce(starts, fuzzy)).where("score is not null")
    return full.orderBy(F.col("score").desc(), F.coalesce("held", F.lit(-1)).desc(), "display_name", "slug").limit(limit)
