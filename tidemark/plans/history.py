"""Queries of tickers' history, of members of Congress and of the candidates for them, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import members, tickers
from .catalog import add
from .derived import Derived


def _of(t: Derived, table: str, text: str) -> DataFrame:
    return t.spark.sql(text.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: t.domain.table(table)})


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


# ---------------------------------------------------------------- tickers

#: Parts as securities with none to three ranges, and changes of every kind to them.
_RANGES = " UNION ALL ".join(
    f"SELECT p_partkey AS security_id, concat('{name}', p_partkey) AS ticker, CAST({low} AS DATE) AS valid_from, CAST({high} AS DATE) AS valid_to, 'list' AS source FROM part WHERE p_partkey % 5 IN ({which})"
    for name, low, high, which in (
        ("A", "NULL", "NULL", "0"), ("B", "NULL", "'1998-01-01'", "1, 2"), ("C", "'1998-01-01'", "NULL", "1"), ("D", "'1998-01-01'", "'1999-01-01'", "2"), ("E", "'1999-06-01'", "NULL", "2"), ("F", "'1997-06-01'", "NULL", "4"),
    )
)
_CHANGES = " UNION ALL ".join(
    f"SELECT p_partkey * 10 + {n} AS change_id, concat('{cusip}', p_partkey) AS cusip, concat('H', p_partkey, '{n}') AS ticker, CAST({low} AS DATE) AS valid_from, CAST({high} AS DATE) AS valid_to FROM part WHERE p_partkey % 7 = {which}"
    for n, cusip, low, high, which in (
        (1, "", "NULL", "'1996-06-01'", 0), (1, "", "'1996-01-01'", "'1997-01-01'", 1), (1, "", "'1997-06-01'", "'1998-06-01'", 2), (1, "", "'1990-01-01'", "'2005-01-01'", 3), (1, "X", "NULL", "'1999-01-01'", 4),
        (1, "", "'1998-02-01'", "'1998-03-01'", 5), (1, "", "NULL", "'1995-01-01'", 6), (2, "", "'1995-01-01'", "'1998-06-01'", 6), (2, "", "'1996-06-01'", "'1999-03-01'", 0),
    )
)


def _turn(turn: int) -> dict[str, str]:
    """The ranges after the changes of one turn, and what became of these, for DuckDB."""
    low, high = "coalesce(r.valid_from, DATE '0001-01-01')", "coalesce(r.valid_to, DATE '9999-12-31')"
    start = "coalesce(c.valid_from, DATE '0001-01-01')"
    overlap = f"{low} < c.valid_to AND {start} < {high}"
    swallow = f"{start} <= {low} AND {high} <= c.valid_to"
    open_start = f"r.valid_from IS NULL AND c.valid_to < {high}"
    return {
        f"turn{turn}": f"SELECT p_partkey AS security_id, t.* FROM turns t JOIN part ON cusip = p_partkey::VARCHAR WHERE turn = {turn}",
        f"clash{turn}": f"""SELECT c.change_id, c.security_id, min(CASE WHEN {swallow} THEN r.ticker || ' lies wholly inside it' WHEN {low} < {start} AND c.valid_to < {high} AND NOT ({open_start}) THEN r.ticker || ' would be cut in two' END) AS reason, count(*) AS overlapping
          FROM turn{turn} c JOIN range{turn - 1} r ON r.security_id = c.security_id AND {overlap} GROUP BY 1, 2""",
        f"told{turn}": f"SELECT c.change_id, CASE WHEN reason IS NULL THEN 'recorded' ELSE 'refused' END AS outcome, reason, CASE WHEN reason IS NULL THEN coalesce(overlapping, 0) ELSE 0 END AS trimmed FROM turn{turn} c LEFT JOIN clash{turn} USING (change_id)",
        f"range{turn}": f"""SELECT r.security_id, r.ticker, CASE WHEN c.change_id IS NOT NULL AND {overlap} AND ({low} >= {start} OR ({open_start})) THEN c.valid_to ELSE r.valid_from END AS valid_from,
            CASE WHEN c.change_id IS NOT NULL AND {overlap} AND {low} < {start} AND NOT ({open_start}) THEN c.valid_from ELSE r.valid_to END AS valid_to, r.source
          FROM range{turn - 1} r LEFT JOIN (SELECT * FROM turn{turn} JOIN told{turn} USING (change_id) WHERE outcome = 'recorded') c USING (security_id)
          UNION ALL SELECT security_id, ticker, valid_from, valid_to, 'manual' FROM turn{turn} JOIN told{turn} USING (change_id) WHERE outcome = 'recorded'""",
    }


_HISTORY = {"range0": _duck(_RANGES), "changes": _duck(_CHANGES), "turns": "SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY change_id) AS turn FROM changes", **_turn(1), **_turn(2)}


def _entered(t: Derived) -> tuple[DataFrame, DataFrame]:
    security = t.domain.table("part").select(F.col("p_partkey").alias("security_id"), F.col("p_partkey").cast("string").alias("cusip"))
    return tickers.enter_history(_of(t, "part", _RANGES), _of(t, "part", _CHANGES), security)


add("res09_ticker_history", "security_id:l ticker:s valid_from:d valid_to:d source:s", "SELECT * FROM range2", **_HISTORY)(lambda t: _entered(t)[0])
add(
    "res09_ticker_changes", "change_id:l outcome:s reason:s trimmed:l",
    "SELECT * FROM told1 UNION ALL SELECT * FROM told2 UNION ALL SELECT change_id, 'refused', 'no security has the CUSIP ' || cusip, 0 FROM changes WHERE cusip NOT IN (SELECT p_partkey::VARCHAR FROM part)", **_HISTORY,
)(lambda t: _entered(t)[1])

_TAKEN = "SELECT p_partkey AS security_id, CASE p_partkey % 3 WHEN 0 THEN concat('a', p_partkey) WHEN 1 THEN concat('N', p_partkey) ELSE concat('C', p_partkey) END AS ticker, 'openfigi' AS source FROM part WHERE p_partkey % 4 <> 1"
add(
    "res09_recorded_tickers", "security_id:l ticker:s valid_from:d valid_to:d source:s event:s",
    """SELECT r.security_id, CASE WHEN late THEN n.ticker ELSE r.ticker END AS ticker, valid_from, CASE WHEN other AND NOT late THEN DATE '1998-01-01' ELSE valid_to END AS valid_to, CASE WHEN late THEN n.source ELSE r.source END AS source,
        CASE WHEN late THEN 'replaced' WHEN other THEN 'closed' END AS event FROM marked r LEFT JOIN taken n USING (security_id)
      UNION ALL SELECT n.security_id, n.ticker, (SELECT max(CASE WHEN other AND NOT late THEN DATE '1998-01-01' ELSE valid_to END) FROM marked m WHERE m.security_id = n.security_id), NULL, n.source,
        CASE WHEN EXISTS (SELECT 1 FROM marked m WHERE m.security_id = n.security_id AND other AND NOT late) THEN 'renamed' ELSE 'opened' END
      FROM taken n WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.security_id = n.security_id AND valid_to IS NULL AND (late OR upper(m.ticker) = upper(n.ticker)))""",
    range0=_duck(_RANGES), taken=_duck(_TAKEN),
    marked="""SELECT r.*, coalesce(r.valid_to IS NULL AND upper(r.ticker) <> upper(n.ticker), false) AS other, coalesce(r.valid_to IS NULL AND upper(r.ticker) <> upper(n.ticker) AND r.valid_from >= DATE '1998-01-01', false) AS late
      FROM range0 r LEFT JOIN taken n USING (security_id)""",
)(lambda t: tickers.record_tickers(_of(t, "part", _RANGES), _of(t, "part", _TAKEN), "1998-01-01"))

# ---------------------------------------------------------------- members

_LETTERS = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"
#: Customers as members, two to a surname, and as names that are filed: as they are, with honours, generations, nicknames and accents, misspelled, and from another state.
_MEMBERS = f"""SELECT c_custkey AS member_id, concat('K', {_LETTERS.format("c_custkey % 37")}) AS first_name, concat('O', {_LETTERS.format("CAST(floor(c_custkey / 2) AS INT) + 10")}) AS last_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'Q.' END AS middle_name, CASE WHEN c_custkey % 4 = 3 THEN concat('N', {_LETTERS.format("c_custkey % 10")}) END AS nickname, c_nationkey FROM customer"""
_TERMS = """SELECT c_custkey AS member_id, CASE WHEN c_nationkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, concat('S', c_nationkey) AS state, DATE '1985-01-03' AS start_date,
  CASE WHEN c_custkey % 9 = 0 THEN DATE '1990-01-03' ELSE DATE '2001-01-03' END AS end_date FROM customer"""
_FILED = f"""SELECT member_id AS name_id, CASE member_id % 8 WHEN 1 THEN concat('Hon. ', first_name) WHEN 3 THEN concat(first_name, ' "', coalesce(nickname, 'Zed'), '"') WHEN 4 THEN upper(first_name) WHEN 5 THEN concat(first_name, 'xq') WHEN 6 THEN coalesce(nickname, 'Zed') ELSE first_name END AS first_name,
  CASE member_id % 8 WHEN 2 THEN concat(last_name, ', Jr.') WHEN 4 THEN concat('Ó', substr(last_name, 2)) ELSE last_name END AS last_name, CASE WHEN c_nationkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber,
  CASE WHEN c_nationkey % 2 <> 0 THEN NULL WHEN member_id % 8 = 7 THEN 'S99' ELSE concat('S', c_nationkey) END AS state, DATE '1998-01-01' AS first_filed, DATE '1998-06-01' AS last_filed FROM ({_MEMBERS}) m"""
_REFUSED = "SELECT c_custkey AS name_id, c_custkey AS member_id FROM customer WHERE c_custkey % 13 = 0"


def _fold(text: str) -> str:
    return f"list_filter(string_split_regex(replace(strip_accents(lower({text})), '''', ''), '[^a-z0-9]+'), lambda w: w <> '')"


_GRAMS = "list_distinct(flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_MATCH_SQL = {
    "member": _duck(_MEMBERS), "term": _TERMS, "filed": _duck(_FILED), "refused": _REFUSED,
    "written": """SELECT member_id, unnest(list_distinct(list_filter([lower(first_name || ' ' || last_name), lower(first_name || ' ' || middle_name || ' ' || last_name), lower(nickname || ' ' || last_name), lower(nickname || ' ' || middle_name || ' ' || last_name)], lambda s: s IS NOT NULL))) AS spelling FROM member""",
    "folded": f"SELECT DISTINCT member_id, array_to_string({_fold('spelling')}, ' ') AS form FROM written",
    "given": f"SELECT DISTINCT member_id, ({_fold('x')})[1] AS word FROM (SELECT member_id, unnest([first_name, middle_name, nickname]) AS x FROM member) WHERE x IS NOT NULL AND len(({_fold('x')})[1]) > 1",
    "parts": f"""SELECT f.*, lower(first_name || ' ' || last_name) AS spelled, list_filter({_fold("regexp_replace(first_name, '\"[^\"]*\"', ' ')")}, lambda w: w NOT IN ('hon', 'jr')) AS g, {_fold("regexp_extract(first_name, '\"([^\"]*)\"', 1)")} AS nick,
      array_to_string(list_filter({_fold("last_name")}, lambda w: w <> 'jr'), ' ') AS surname FROM filed f""",
    "forms": "SELECT name_id, array_to_string(g, ' ') || ' ' || surname AS form FROM parts UNION SELECT name_id, array_to_string(nick, ' ') || ' ' || surname FROM parts WHERE len(nick) > 0",
    "office": "SELECT name_id, t.member_id FROM filed f JOIN term t ON t.chamber = f.chamber AND (f.state IS NULL OR t.state = f.state) WHERE start_date <= last_filed AND end_date + 366 >= first_filed",
    "allowed": "SELECT p.*, m.member_id FROM parts p JOIN member m ON lower(m.last_name) = surname ANTI JOIN refused r ON r.name_id = p.name_id AND r.member_id = m.member_id",
    "fit": """SELECT name_id, member_id, (name_id, member_id) IN (SELECT (name_id, member_id) FROM office) AS sits, CASE WHEN EXISTS (SELECT 1 FROM written w WHERE w.member_id = a.member_id AND spelling = spelled) THEN 'exact'
      WHEN EXISTS (SELECT 1 FROM forms x JOIN folded y ON x.form = y.form WHERE x.name_id = a.name_id AND y.member_id = a.member_id) OR EXISTS (SELECT 1 FROM given v WHERE v.member_id = a.member_id AND (v.word = g[1] OR v.word = nick[1])) THEN 'normalised' END AS method FROM allowed a""",
    "scored": "SELECT *, sum(sits::INT) OVER (PARTITION BY name_id) AS seated, count(*) OVER (PARTITION BY name_id) AS n FROM fit WHERE method IS NOT NULL",
    "sure": """SELECT name_id, member_id, method, round(CASE WHEN sits THEN b / seated ELSE b * 0.6 / n END, 3) AS confidence, sits AND seated = 1 AND round(b / seated, 3) >= 0.9 AS accepted FROM (SELECT *, CASE method WHEN 'exact' THEN 1.0 ELSE 0.95 END::DOUBLE AS b FROM scored) WHERE sits OR seated = 0""",
    "alike_": f"""SELECT name_id, member_id, max(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))) AS likest FROM
      (SELECT o.name_id, o.member_id, {_GRAMS.format("x.form")} AS a, {_GRAMS.format("y.form")} AS b FROM office o JOIN forms x USING (name_id) JOIN folded y USING (member_id)
       WHERE o.name_id NOT IN (SELECT name_id FROM scored WHERE sits) AND (o.name_id, o.member_id) NOT IN (SELECT (name_id, member_id) FROM refused)) GROUP BY 1, 2 HAVING likest >= 0.3""",
    "match": """SELECT * FROM (SELECT * FROM sure UNION ALL SELECT name_id, member_id, 'trigram', round(likest, 3), false FROM alike_) QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY confidence DESC, member_id, method) <= 3""",
}


def _matched(t: Derived) -> DataFrame:
    filed = t.spark.sql(_FILED.replace("FROM customer", "FROM {customer}"), customer=t.domain.table("customer"))
    return members.match_members(filed, _of(t, "customer", _MEMBERS), _of(t, "customer", _TERMS), _of(t, "customer", _REFUSED))


add("res01_member_matches", "name_id:l member_id:l method:s confidence:f accepted:b", "SELECT * FROM match", **_MATCH_SQL)(_matched)

#: Two passes over customers' names with a person's rulings between them: what each pass finds, by the pass's number.
_FOUND = "SELECT c_custkey AS name_id, (c_custkey * 3 + i * {step}) % 97 AS member_id, CASE WHEN i = 0 THEN 'normalised' ELSE 'trigram' END AS method, 0.9 - 0.1 * i - 0.01 * (c_custkey % {wave}) AS confidence, i = 0 AND c_custkey % {one} = 0 AS accepted FROM customer, (SELECT explode(array(0, 1, 2)) AS i) x WHERE i < c_custkey % {most}"
_FOUND_SQL = _FOUND.replace("(SELECT explode(array(0, 1, 2)) AS i) x", "(VALUES (0), (1), (2)) x(i)")
_PASSES = [{"step": 1, "wave": 3, "one": 17, "most": 4}, {"step": 2, "wave": 2, "one": 5, "most": 3}, {"step": 1, "wave": 3, "one": 19, "most": 4}]
_RULINGS = "SELECT c_custkey AS name_id, (c_custkey * 3 + 1) % 97 AS member_id, CASE WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS ruling FROM customer WHERE c_custkey % 7 = 3"
_DAYS = ["2024-01-01", "2024-02-01", "2024-03-01"]


def _lived(t: Derived) -> DataFrame:
    """Candidates after three passes; a tenth of the names isn't asked in the second, and rulings come before it."""
    empty = t.spark.createDataFrame([], "candidate_id string, name_id long, member_id long, method string, confidence double, status string, opened_at timestamp, closed_at timestamp")
    asked = t.domain.table("customer").select(F.col("c_custkey").alias("name_id"))
    now = empty
    for n, (day, numbers) in enumerate(zip(_DAYS, _PASSES, strict=True)):
        if n == 1:
            now = members.ruled(now, _of(t, "customer", _RULINGS), "2024-01-15")
        found = _of(t, "customer", _FOUND.format(**numbers)).withColumn("confidence", F.round(F.col("confidence").cast("double"), 3))
        now = members.merged(now.drop("event"), found, asked.where("name_id % 10 <> 0") if n == 1 else asked, day)
    return now


def _pass_sql(n: int) -> dict[str, str]:
    """The candidates after pass n, from those before it (r{n}), for DuckDB."""
    day = f"TIMESTAMP '{_DAYS[n]}'"
    asked = "c_custkey % 10 <> 0" if n == 1 else "true"
    return {
        f"found{n}": f"SELECT name_id, member_id, arg_max(method, (confidence, method)) AS method, round(max(confidence)::DOUBLE, 3) AS confidence, bool_or(accepted) AS accepted FROM ({_FOUND_SQL.format(**_PASSES[n])}) GROUP BY 1, 2",
        f"asked{n}": f"SELECT c_custkey AS name_id FROM customer WHERE {asked}",
        f"wanted{n}": f"""SELECT f.* FROM found{n} f JOIN asked{n} USING (name_id) WHERE name_id NOT IN (SELECT name_id FROM r{n} WHERE status = 'accepted' UNION SELECT name_id FROM found{n} WHERE accepted)
          AND (name_id, member_id) NOT IN (SELECT (name_id, member_id) FROM r{n} WHERE status = 'rejected')""",
        f"p{n}": f"""SELECT *, NULL::VARCHAR AS event FROM r{n} r WHERE NOT (status = 'pending' AND name_id IN (SELECT name_id FROM asked{n}))
          UNION ALL SELECT coalesce(r.candidate_id, w.name_id || ':' || w.member_id || ':{_DAYS[n]}'), coalesce(r.name_id, w.name_id), coalesce(r.member_id, w.member_id), coalesce(w.method, r.method), coalesce(w.confidence, r.confidence),
            CASE WHEN w.name_id IS NULL THEN 'superseded' ELSE 'pending' END, coalesce(r.opened_at, {day}), CASE WHEN w.name_id IS NULL THEN {day} END,
            CASE WHEN r.name_id IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM r{n} o WHERE o.status = 'superseded' AND o.name_id = w.name_id AND o.member_id = w.member_id) THEN 'reopened' ELSE 'opened' END
              WHEN w.name_id IS NULL THEN 'closed' WHEN r.method IS DISTINCT FROM w.method OR r.confidence IS DISTINCT FROM w.confidence THEN 'changed' END
          FROM (SELECT * FROM r{n} WHERE status = 'pending' AND name_id IN (SELECT name_id FROM asked{n})) r FULL JOIN wanted{n} w ON w.name_id = r.name_id AND w.member_id = r.member_id""",
    }


_LIFE_SQL = {
    "r0": "SELECT NULL::VARCHAR AS candidate_id, NULL::BIGINT AS name_id, NULL::BIGINT AS member_id, NULL::VARCHAR AS method, NULL::DOUBLE AS confidence, NULL::VARCHAR AS status, NULL::TIMESTAMP AS opened_at, NULL::TIMESTAMP AS closed_at WHERE false",
    **_pass_sql(0), "ruling": _RULINGS,
    "r1": """SELECT candidate_id, name_id, member_id, method, confidence, CASE WHEN status <> 'pending' THEN status WHEN ruling IS NOT NULL THEN ruling WHEN chosen THEN 'superseded' ELSE status END AS status, opened_at,
        CASE WHEN status = 'pending' AND (ruling IS NOT NULL OR chosen) THEN TIMESTAMP '2024-01-15' ELSE closed_at END AS closed_at
      FROM (SELECT p.*, ruling, coalesce(bool_or(ruling = 'accepted' AND status = 'pending') OVER (PARTITION BY p.name_id), false) AS chosen FROM p0 p LEFT JOIN ruling r ON r.name_id = p.name_id AND r.member_id = p.member_id)""",
    **_pass_sql(1), "r2": "SELECT * EXCLUDE (event) FROM p1", **_pass_sql(2),
}
add("res02_candidates", "candidate_id:s name_id:l member_id:l method:s confidence:f status:s opened_at:t closed_at:t event:s", "SELECT * FROM p2", **_LIFE_SQL)(_lived)
