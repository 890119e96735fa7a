"""Queries of names, tickers and search, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import core_name, extract_ticker, strict_word_similarity, word_similarity
from ..operators import lookup, search
from .catalog import PERIOD, add
from .derived import Derived

_COVERS = "coalesce(a.valid_from <= {0}, true) AND coalesce(a.valid_to > {0}, true)"
add(
    "qry11_tickers_on", "security_id:l ticker:s",
    f"SELECT security_id, arg_max(ticker, coalesce(valid_from, DATE '0001-01-01')) AS ticker FROM (SELECT * FROM alias a WHERE {_COVERS.format(f'DATE {PERIOD!r}')}) GROUP BY 1",
)(lambda t: lookup.tickers_on(t.domain.alias(), PERIOD))
add(
    "qry11_ticker_labels", "filer_id:l period:d security_id:l ticker:s current_ticker:s delisted_by:d",
    f"""SELECT s.filer_id, s.period, s.security_id, s.delisted_by, s.ticker AS current_ticker,
      coalesce((SELECT arg_max(a.ticker, coalesce(a.valid_from, DATE '0001-01-01')) FROM alias a WHERE a.security_id = s.security_id AND {_COVERS.format("s.period")}), s.ticker) AS ticker
      FROM (SELECT filer_id, period, security_id, ticker, delisted_by FROM snapshot JOIN security USING (security_id)) s""",
)(lambda t: lookup.ticker_labels(t.snapshot.select("filer_id", "period", "security_id"), "period", t.domain.alias(), t.security))

_SYMBOLS = ["B.22", "b.8", "OLD.11", "old.5", "000000021", "21", "B.15", "nothing"]


def _symbols(t: Derived):
    return t.spark.createDataFrame([(s,) for s in _SYMBOLS], "symbol string")


def _last_held(t: Derived):
    return t.snapshot.groupBy("security_id").agg(F.max("period").alias("last_held"))


add(
    "qry09_lookup", "symbol:s security_id:l via:l",
    f"""SELECT symbol, security_id, via FROM
      (SELECT symbol, security_id, 0 AS via, coalesce(valid_to, DATE '9999-12-31') AS recent FROM asked JOIN alias a ON upper(ticker) = upper(symbol) WHERE {_COVERS.format("DATE '1999-06-01'")}
       UNION ALL SELECT symbol, security_id, 1, DATE '9999-12-31' FROM asked JOIN security ON upper(ticker) = upper(symbol)
       UNION ALL SELECT symbol, security_id, 2, coalesce(valid_to, DATE '9999-12-31') FROM asked JOIN alias ON upper(ticker) = upper(symbol)
       UNION ALL SELECT symbol, security_id, 3, DATE '9999-12-31' FROM asked JOIN security ON cusip = upper(symbol) WHERE length(symbol) = 9)
      LEFT JOIN (SELECT security_id, max(period) AS held FROM snapshot GROUP BY 1) USING (security_id)
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY via, recent DESC, held DESC NULLS LAST, security_id DESC) = 1""",
    asked=f"SELECT unnest({_SYMBOLS!r}) AS symbol",
)(lambda t: lookup.lookup(_symbols(t), t.domain.alias(), t.security, _last_held(t), "1999-06-01"))
add(
    "q14_ticker_collisions", "ticker:s security_id:l other:l since:d until:d",
    """SELECT upper(x.ticker) AS ticker, x.security_id, y.security_id AS other, greatest(x.f, y.f) AS since, least(x.t, y.t) AS until
      FROM (SELECT *, coalesce(valid_from, DATE '0001-01-01') AS f, coalesce(valid_to, DATE '9999-12-31') AS t FROM alias) x
      JOIN (SELECT *, coalesce(valid_from, DATE '0001-01-01') AS f, coalesce(valid_to, DATE '9999-12-31') AS t FROM alias) y
      ON upper(x.ticker) = upper(y.ticker) AND x.security_id < y.security_id AND x.f < y.t AND y.f < x.t""",
)(lambda t: lookup.collisions(t.domain.alias()))

# ---------------------------------------------------------------- trigrams: word similarity as the best of all runs

_PIECES = "list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"
_SET = f"list_distinct(flatten({_PIECES}))"


def _best(text: str, query: str, strict: bool) -> str:
    """A scalar subquery: the greedy walk's greatest Jaccard similarity of the query's trigrams to an extent of the text's, folded over the ends."""
    asked = _SET.format(repr(query))
    if strict:
        ends, starts, lower = "list_transform(range(1, len(w) + 1), lambda k: len(flatten(w[1:k])))", "list_transform(range(1, len(w) + 1), lambda k: len(flatten(w[1:k])) - len(w[k]) + 1)", "1"
    else:
        ends, starts, lower = "list_filter(range(1, len(flatten(w)) + 1), lambda k: list_contains(q, flatten(w)[k]))", "range(1, len(flatten(w)) + 1)", "coalesce(e[1], 1)"
    alike = "len(list_intersect(list_distinct(p[i:x.lower]), q))::DOUBLE / len(list_distinct(list_concat(p[i:x.lower], q)))"
    tried = f"list_max(list_transform(list_filter(s, lambda i: i >= acc.lower AND i <= x.lower), lambda i: {{'alike': {alike}, 'start': -i}}))"
    return f"""coalesce((SELECT list_reduce(list_prepend({{'lower': l, 'best': 0.0::DOUBLE}}, list_transform(e, lambda y: {{'lower': y, 'best': 0.0::DOUBLE}})),
        lambda acc, x: {{'lower': coalesce(-{tried}.start, acc.lower), 'best': greatest(acc.best, coalesce({tried}.alike, 0))}}).best
      FROM (SELECT *, ({lower})::BIGINT AS l FROM (SELECT w, q, flatten(w) AS p, {ends} AS e, {starts} AS s FROM (SELECT {_PIECES.format(text)} AS w, {asked} AS q) a) b) c), 0)"""


_ASK = "smal ring"
add(
    "txt06_word_similarity", "p_name:s word:f strict:f",
    f"SELECT p_name, {_best('p_name', _ASK, False)} AS word, {_best('p_name', _ASK, True)} AS strict FROM (SELECT DISTINCT p_name FROM part)",
)(lambda t: t.domain.table("part").select("p_name").distinct().select("p_name", word_similarity(_ASK, F.col("p_name")).alias("word"), strict_word_similarity(_ASK, F.col("p_name")).alias("strict")))


def _alike_sql(column: str, query: str) -> str:
    word, strict = _best(column, query, False), _best(column, query, True)
    return f"""CASE WHEN {word} >= 0.6 OR {strict} >= 0.5 THEN CASE WHEN regexp_matches(lower({column}), '\\b{query}\\b') THEN 1.0 ELSE ({word} + {strict}) / 2 END END"""


def _search_sql(query: str) -> str:
    return f"""SELECT id, ticker, name, score FROM (SELECT n.*, CASE WHEN upper(n.ticker) = upper('{query}') THEN 100 WHEN starts_with(lower(n.ticker), '{query}') THEN 90 WHEN starts_with(lower(n.name), '{query}') THEN 80
        ELSE 70 * u.alike END AS score FROM named n JOIN (SELECT name, {_alike_sql("name", query)} AS alike FROM (SELECT DISTINCT name FROM named)) u USING (name)) WHERE score IS NOT NULL ORDER BY score DESC, held DESC, id LIMIT 20"""


def _named(t: Derived):
    return t.domain.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("held"))


_NAMED = "SELECT p_partkey AS id, 'Q' || p_partkey AS ticker, p_name AS name, p_retailprice AS held FROM part"
for _query in ("smal rin", "q77", "ring"):
    add(f"qry28_search_{_query.replace(' ', '_')}", "id:l ticker:s name:s score:f", _search_sql(_query), named=_NAMED)(
        lambda t, q=_query: search.search_stocks(_named(t), q, postings=t.store.table("stock_grams", lambda: search.name_postings(_named(t), "id", "name", "ticker")))
    )


def _investors(t: Derived):
    """Filers under their own names, their nation as manager."""
    manager = t.domain.table("supplier").join(t.domain.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("filer_id"), F.col("n_name").alias("manager_name"))
    return t.filer.join(manager, "filer_id").select("slug", F.col("name").alias("display_name"), "manager_name", (F.col("filer_id") % 7).alias("held"))


_INVESTORS = "SELECT slug, f.name AS display_name, n_name AS manager_name, filer_id % 7 AS held FROM filer f JOIN supplier ON s_suppkey = filer_id JOIN nation ON s_nationkey = n_nationkey"
for _query in ("germny", "nation_1", "supplier#00000000"):
    _starts = f"starts_with(lower(display_name), '{_query}') OR starts_with(lower(manager_name), '{_query}')"
    add(
        f"qry28_investors_{_query.replace('#', '_')}", "slug:s display_name:s manager_name:s score:f",
        f"""SELECT slug, i.display_name, i.manager_name, CASE WHEN {_starts.replace("display_name", "i.display_name").replace("manager_name", "i.manager_name")} THEN 80 ELSE 70 * greatest(a.alike, b.alike) END AS score FROM investor i
          JOIN (SELECT display_name, {_alike_sql("display_name", _query)} AS alike FROM (SELECT DISTINCT display_name FROM investor)) a USING (display_name) JOIN (SELECT manager_name, {_alike_sql("manager_name", _query)} AS alike FROM (SELECT DISTINCT manager_name FROM investor)) b USING (manager_name)
          WHERE score IS NOT NULL ORDER BY score DESC, held DESC, display_name, slug LIMIT 20""",
        investor=_INVESTORS,
    )(lambda t, q=_query: search.search_investors(_investors(t), q, postings=t.store.table("investor_grams", lambda: search.name_postings(_investors(t), "slug", "display_name", "manager_name"))))


def _worth(t: Derived):
    """Dollars held in the latest period."""
    last = t.consensus.groupBy("security_id").agg(F.max(F.struct("period", "total_value")).alias("l")).select("security_id", "l.period", F.col("l.total_value").alias("total_value"))
    return last.join(t.consensus.agg(F.max("period").alias("period")), "period", "left_semi")


add(
    "qry10_suggestions", "security_id:l via:l score:f",
    f"""SELECT security_id, via, score FROM (SELECT security_id, min(via) AS via, max(score) AS score FROM
        (SELECT security_id, 0 AS via, 1.0 AS score FROM security WHERE starts_with(upper(ticker), 'B.1') UNION ALL SELECT security_id, 0, 1.0 FROM alias WHERE starts_with(upper(ticker), 'B.1')
         UNION ALL SELECT * FROM (SELECT security_id, 1, {_best("name", "B.1", False)} AS score FROM security) WHERE score >= 0.6) GROUP BY 1)
      LEFT JOIN (SELECT security_id, total_value FROM consensus WHERE period = (SELECT max(period) FROM consensus)) USING (security_id)
      ORDER BY via, score DESC, coalesce(total_value, -1) DESC, security_id LIMIT 10""",
)(lambda t: lookup.suggestions("B.1", t.domain.alias(), t.security, _worth(t)))

# ---------------------------------------------------------------- names as filed

#: What follows an issuer's name in the forms that are filed, with what its core name keeps of it, the ticker found, and whether that is a hint.
NAMES = [
    (" Inc. - Class A Common Stock (GOOGL)", "", "GOOGL", False), (" INC-CL A", "", None, None), (" Supply Co", " supply", None, None), (" SUPPLY COMPANY", " supply", None, None), (" INCCLA", "", None, None), (" Hathaway Inc. New (NYSE: BRK/B)", " hathaway new", "BRK.B", False),
    (" Land Trust", " land tr", None, None), ("é S.A. Sponsored ADR", "e", None, None), (" Holdings N.V.", " hldg", None, None), (" Inc AAPL", " aapl", "AAPL", True), (" Inc", "", None, None), (" International Business Machines Corp", " intl bus mach", None, None),
    (" Technologies Group Ltd", " tech grp", None, None), (" & Sons, Mfg. Ordinary Shares", " sons mfg", None, None),
]
_PICK = f"p_partkey % {len(NAMES)}"
_CASES = lambda i, none="NULL": f"CASE {_PICK} " + " ".join(f"WHEN {k} THEN {none if n[i] is None else repr(n[i])}" for k, n in enumerate(NAMES)) + " END"


def _names(t: Derived):
    """Parts as issuers, each named in one of the forms."""
    rows = t.domain.table("part").select("p_partkey", F.concat("p_name", F.expr(_CASES(0))).alias("name"))
    found = extract_ticker(F.col("name"))
    return rows.select(F.col("p_partkey").alias("id"), "name", core_name(F.col("name")).alias("core"), found["ticker"].alias("ticker"), found["hinted"].alias("hinted"))


add("txt07_core_names", "id:l name:s core:s ticker:s hinted:b", f"SELECT p_partkey AS id, p_name || {_CASES(0)} AS name, p_name || {_CASES(1)} AS core, {_CASES(2)} AS ticker, {_CASES(3)} AS hinted FROM part")(_names)
