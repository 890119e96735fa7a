"""How the terms of a source diverge from those of its language and of the other sources: counts and partial sums by DuckDB within shards, merged by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, stored, utf8

#: Documents of a language that a kept term is in, ranks of terms that are reported, and the scale of shares.
LEAST_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of text that DuckDB counts at once, and rows of counts that a task gathers before it hands them on.
TEXT, HELD = 4 << 20, 2_000_000

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def _shard() -> duckdb.DuckDBPyConnection:
    """DuckDB in memory, in the one thread that a task has."""
    return duckdb.connect(config={"threads": 1})


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (n) and documents (d) of every term by language and source, of a task's documents."""
    con = _shard()
    con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")
    rows = 0
    for batch in batches:
        data, at = utf8(batch["text"])
        for i, j in pieces(at, TEXT):
            text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at[i : j + 1] - at[i]), pa.py_buffer(_LETTERS[data[at[i] : at[j]]]))
            con.register("piece", pa.table({"row": np.arange(j - i), "lang": batch["lang"].slice(i, j - i), "source": batch["source"].slice(i, j - i), "text": text}))
            rows += con.execute(
                """INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM
                     (SELECT "row", term, count(*) AS n FROM (SELECT "row", unnest(string_split(text, ' ')) AS term FROM piece) WHERE term <> '' GROUP BY "row", term)
                   JOIN (SELECT "row", lang, source FROM piece) USING ("row") GROUP BY lang, source, term"""
            ).fetchall()[0][0]
            if rows >= HELD:
                con.execute("CREATE OR REPLACE TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL")
                rows = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
                if rows >= HELD // 2:
                    yield from con.sql("SELECT * FROM held").to_arrow_reader(100_000)
                    con.execute("DELETE FROM held")
                    rows = 0
    yield from con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL").to_arrow_reader(100_000)


def _keep(least: int):
    """A shard's counts summed; of terms in `least` documents of their language a row for each source, and one without a source for the language."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches):
            con = _shard()
            con.register("rows", rows)
            con.execute("CREATE TABLE counted AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM rows GROUP BY ALL")
            con.execute("CREATE TABLE kept AS SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY ALL HAVING sum(d) >= ?", [least])
            yield from con.sql("SELECT lang, source, term, c.n FROM counted c JOIN kept USING (lang, term) UNION ALL SELECT lang, NULL, term, n FROM kept").to_arrow_reader(100_000)

    return keep


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatchReader]:
    """The batches as one stream that DuckDB reads as it goes; nothing if there are none."""
    first = next(batches, None)
    if first is not None:

        def all_of():
            yield first
            yield from batches

        yield pa.RecordBatchReader.from_batches(first.schema, all_of())


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n): occurrences of every kept term in each source that has it, and, with a null source, in the language."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = texts.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    return counts.repartition("lang", "term").mapInArrow(_keep(least), "lang string, source string, term string, n long")


# ---------------------------------------------------------------- divergence


def _share(n: str, scale: int) -> str:
    """The share as a whole number of `scale`: exact, as decimals hold it."""
    return f"1 + (cast({scale} as decimal(19,0)) * cast({n} + 1 as decimal(19,0))) div cast(total + terms as decimal(38,0))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


def _sum_up(top: int):
    """A shard's part of the sums: the greatest terms of each group (kind 0), what terms of two sources add to their pair beyond what each adds alone
    (kind 1), and how many terms of a source have which share (kind 2)."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches):
            con = _shard()
            con.register("rows", rows)
            con.execute("CREATE TABLE shares AS SELECT lang, term, source, p, zero FROM rows")
            con.execute("CREATE TABLE own AS SELECT * FROM shares WHERE source IS NOT NULL")
            both = f"{_f('a.p', 'b.p')} - {_f('a.p', 'b.zero')} - {_f('a.zero', 'b.p')} + {_f('a.zero', 'b.zero')}"
            yield from con.sql(
                f"""SELECT 0::INT AS kind, own.lang, own.source, term AS item, own.p, {_f("own.p", "l.p")}::DECIMAL(38,0) AS value FROM own JOIN (SELECT lang, term, p FROM shares WHERE source IS NULL) l USING (lang, term)
                  WHERE own.p > l.p QUALIFY row_number() OVER (PARTITION BY own.lang, own.source ORDER BY value DESC, item) <= {top}
                UNION ALL SELECT 1, a.lang, a.source, b.source, 0, sum(({both})::HUGEINT)::DECIMAL(38,0) FROM own a JOIN own b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
                UNION ALL SELECT 2, lang, source, '', p, count(*)::DECIMAL(38,0) FROM own GROUP BY lang, source, p"""
            ).to_arrow_reader(100_000)

    return sum_up


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's shares of terms are from the other sources' of its language (part `pair`, every
    other source) and which terms it has more of than the language (part `term`, ranks to `top`).

    Null lang, source and text are ''. A group without terms has its pairs; a language of one source has none; without kept terms the pairs are 0.
    Equal values rank by the item's bytes. Repeated rows count as often as they come. Other columns aren't read; an empty table gives no rows.

    Counts of a task's documents, of a shard, shares, and sums of a shard are each aggregated before they are shuffled. Pairs of sources meet only
    within a term that both have: what one source's terms add against another that lacks them depends on the shares alone and is summed by share.
    """
    spark = docs.sparkSession
    counts, _ = stored(term_counts(docs, least), "op13-terms")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    languages = counts.where("source is null").groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("terms"))
    totals = counts.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(languages.select("lang", "terms"), "lang", "left")
    sizes = sizes.unionByName(languages.select("lang", F.lit(None).cast("string").alias("source"), F.col("all").alias("total"), "terms")).fillna(0, ["total", "terms"])
    zero = F.when(F.col("terms") > 0, F.expr(_share("0L", scale))).otherwise(F.lit(1).cast("long"))
    sizes, _ = stored(sizes.withColumn("zero", zero), "op13-sizes")

    joined = counts.alias("c").join(sizes.alias("s"), F.expr("c.lang = s.lang and c.source <=> s.source"))
    shares = joined.select("c.lang", "c.source", "term", F.expr(_share("n", scale)).alias("p"), "zero")
    schema = "kind int, lang string, source string, item string, p long, value decimal(38,0)"
    sums, _ = stored(shares.repartition("lang", "term").mapInArrow(_sum_up(top), schema), "op13-sums")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = sums.where("kind = 0").select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    g = sizes.where("source is not null")
    held = sums.where("kind = 2").groupBy("lang", "source", "p").agg(F.sum("value").alias("count"))
    held = held.join(g.select("lang", "source", "zero"), ["lang", "source"])
    other = g.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    meet = held.join(other, "lang").where("source <> item")
    f = lambda p, q: f"cast((({p}) - ({q})) * (({p}) - ({q})) div ({q}) as decimal(38,0))"
    parts = [
        g.select("lang", "source", "zero", "terms").join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"cast(terms * {f('zero', 'other')} as decimal(38,0))").alias("value")),
        sums.where("kind = 1").select("lang", "source", "item", "value"),
        meet.select("lang", "source", "item", F.expr(f"cast(count * ({f('p', 'other')} - {f('zero', 'other')}) as decimal(38,0))").alias("value")),
        meet.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"cast(count * ({f('other', 'p')} - {f('other', 'zero')}) as decimal(38,0))").alias("value")),
    ]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(terms)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN (SELECT lang, term FROM k) USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM m),
l AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM k),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}
"""
