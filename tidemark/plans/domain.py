"""The driver's tables as the domain's: filers, securities, filings and holdings.

A supplier is a filer, a part's brand a security, a line item a holding in the quarter it shipped in. A filer's holdings
of a quarter are one filing, suspect by a rule on its number. Orders give amendments to choose among, events insider
lines and prices quotes. SQL holds the same definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY, SHARES
from ..functions.periods import quarter_end, quarter_index

#: Investor categories, dealt by nation.
CATEGORIES = ["value", "activist", "quant", "macro", "growth", "multi_strategy"]


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def filer(self) -> DataFrame:
        category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("s_nationkey") % 6 + 1).cast("int"))
        return self.table("supplier").select(F.col("s_suppkey").alias("filer_id"), F.col("s_name").alias("name"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), category.alias("category"))

    def security(self) -> DataFrame:
        """A brand, with a ticker that has a point; every ninth is delisted."""
        ident = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long")
        brands = self.table("part").select(ident.alias("security_id")).distinct()
        number = F.col("security_id").cast("string")
        return brands.select(
            "security_id", F.concat(F.lit("B."), number).alias("ticker"), F.lpad(number, 9, "0").alias("cusip"), F.concat(F.lit("Brand "), number, F.lit(" Inc")).alias("name"),
            F.when(F.col("security_id") % 9 == 0, F.lit("1999-06-30").cast("date")).alias("delisted_by"),
        )

    def alias(self) -> DataFrame:
        """Tickers of securities over time: a former one until 1998, then the present one; every seventh also has its neighbour's from 1999."""
        day = lambda text: F.lit(text).cast("date")
        number = F.col("security_id").cast("string")
        ranges = [
            F.struct(F.concat(F.lit("OLD."), number).alias("ticker"), day(None).alias("valid_from"), day("1998-01-01").alias("valid_to"), F.lit(True).alias("has")),
            F.struct(F.col("ticker"), day("1998-01-01").alias("valid_from"), day(None).alias("valid_to"), F.lit(True).alias("has")),
            F.struct(F.concat(F.lit("B."), (F.col("security_id") + 1).cast("string")).alias("ticker"), day("1999-01-01").alias("valid_from"), day(None).alias("valid_to"), (F.col("security_id") % 7 == 0).alias("has")),
        ]
        return self.security().select("security_id", F.explode(F.array(*ranges)).alias("a")).where("a.has").select("security_id", "a.ticker", "a.valid_from", "a.valid_to")

    def issuer_ticker(self) -> DataFrame:
        """SEC's list: every third issuer of a hundred with the ticker of one security, spelled with a dash."""
        cik = F.col("id").cast("string")
        return self.spark.range(0, 100, 3).select(F.concat(F.lit("B-"), (F.col("id") + 11).cast("string")).alias("ticker"), cik.alias("cik"))

    def _lines(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long").alias("security_id"))
        line = self.table("lineitem").select("l_partkey", F.col("l_suppkey").alias("filer_id"), quarter_end(F.col("l_shipdate").cast("date")).alias("period"), "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey"))

    def holding(self) -> DataFrame:
        return self._lines().select(
            (F.col("filer_id") * 10000 + quarter_index(F.col("period"))).alias("filing_id"), "filer_id", "security_id", "period",
            F.col("l_quantity").cast(SHARES).alias("shares"), F.col("l_extendedprice").cast(MONEY).alias("value_usd"),
            F.when(F.col("l_linenumber") == 7, "PRN").otherwise("SH").alias("sshprnamt_type"), F.when(F.col("l_returnflag") == "R", "Call").alias("put_call"),
        )

    def filing(self) -> DataFrame:
        """A filing for each filer and quarter of the holdings."""
        line = self.table("lineitem").select(F.col("l_suppkey").alias("filer_id"), quarter_end(F.col("l_shipdate").cast("date")).alias("period")).distinct()
        number = F.col("filer_id") * 10000 + quarter_index(F.col("period"))
        return line.select(
            number.alias("filing_id"), F.lpad(number.cast("string"), 20, "0").alias("accession_no"), "filer_id", F.col("filer_id").cast("string").alias("cik"), "period",
            F.date_add("period", (F.pmod("filer_id", F.lit(30)) + 15).cast("int")).cast("timestamp").alias("filed_at"), F.lit("13F-HR").alias("form_type"),
            F.lit(None).cast("string").alias("amendment_kind"), F.when(F.pmod(number, F.lit(17)) == 0, "suspect").otherwise("ok").alias("parse_status"),
        )

    def amendment(self) -> DataFrame:
        """Orders as filings of nations under many CIKs, so that a quarter has several to choose among."""
        rank = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("filing_id"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("accession_no"), F.col("c_nationkey").cast("long").alias("filer_id"),
            F.pmod("o_custkey", F.lit(3)).cast("string").alias("cik"), quarter_end(F.col("o_orderdate").cast("date")).alias("period"), F.col("o_orderdate").alias("filed_at"),
            F.when(rank.isin("1", "2"), "13F-HR").otherwise("13F-HR/A").alias("form_type"), F.when(rank == "3", "restatement").when(rank == "4", "new_holdings").alias("amendment_kind"),
            F.when(F.col("o_orderstatus") == "P", "suspect").otherwise("ok").alias("parse_status"),
        )

    def amendment_filer(self) -> DataFrame:
        """Nations as filers; even ones sum their CIKs, odd ones are succeeded by them."""
        overlap = F.when(F.col("n_nationkey") % 2 == 0, "sum").otherwise("successor")
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("filer_id"), overlap.alias("overlap"))

    def amendment_cik(self) -> DataFrame:
        """Nations' CIKs with priorities: CIK 2 has none, and every fifth nation has no row for its CIK 1."""
        each = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("cik"), F.lit(p).cast("int").alias("priority")) for i, p in ((0, 1), (1, 2), (2, None))]))
        rows = self.table("nation").select(F.col("n_nationkey").cast("long").alias("filer_id"), each.alias("x")).select("filer_id", "x.*")
        return rows.where("not (cik = '1' and filer_id % 5 = 0)")

    def insider_line(self) -> DataFrame:
        day = F.to_date("ts")
        return self.table("events").select(
            F.col("event_id").alias("id"), day.alias("transaction_date"), F.col("event_id").alias("filing_id"), F.col("user_id").alias("insider_id"),
            F.get_json_object("props", "$.k").alias("issuer_cik"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(25)).alias("security_id"),
            (F.pmod("event_id", F.lit(11)) == 0).alias("is_derivative"), F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "error", "A").when(F.col("event_type") == "signup", "G").otherwise("S").alias("transaction_code"),
            F.lit(100).cast(SHARES).alias("shares"), F.when(F.pmod("event_id", F.lit(13)) != 0, F.col("value").cast(MONEY)).alias("value_usd"),
            (F.pmod("event_id", F.lit(19)) == 0).alias("is_10b5_1"), F.when(F.pmod("event_id", F.lit(23)) == 0, F.create_map(F.lit("F1"), F.lit("Bought under the Employee Stock Purchase Plan."))).alias("footnotes"),
            (F.pmod("user_id", F.lit(7)) != 0).alias("is_director"), (F.pmod("user_id", F.lit(14)) == 0).alias("is_officer"), F.col("ts").alias("filed_at"),
        )

    def quote(self) -> DataFrame:
        lines = self._lines().select("security_id", F.to_date(F.date_add("period", F.pmod("l_partkey", F.lit(60)).cast("int"))).alias("date"), F.col("l_extendedprice").cast(MONEY).alias("v"), F.col("l_quantity").cast(SHARES).alias("q"))
        return lines.groupBy("security_id", "date").agg(F.round(F.sum("v").cast("double") / F.sum("q").cast("double"), 8).cast("decimal(20,8)").alias("close"))


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "filer": f"SELECT s_suppkey::BIGINT AS filer_id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, ({CATEGORIES!r})[s_nationkey % 6 + 1] AS category FROM supplier",
    "security": """SELECT security_id, 'B.' || security_id AS ticker, lpad(security_id::VARCHAR, 9, '0') AS cusip, 'Brand ' || security_id || ' Inc' AS name,
      CASE WHEN security_id % 9 = 0 THEN DATE '1999-06-30' END AS delisted_by FROM (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS security_id FROM part)""",
    "alias": """SELECT security_id, 'OLD.' || security_id AS ticker, NULL::DATE AS valid_from, DATE '1998-01-01' AS valid_to FROM security
      UNION ALL SELECT security_id, ticker, DATE '1998-01-01', NULL FROM security
      UNION ALL SELECT security_id, 'B.' || (security_id + 1), DATE '1999-01-01', NULL FROM security WHERE security_id % 7 = 0""",
    "issuer_ticker": "SELECT 'B-' || (i + 11) AS ticker, i::VARCHAR AS cik FROM range(0, 100, 3) r(i)",
    "lines_": """SELECT l_partkey, l_suppkey::BIGINT AS filer_id, last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE AS period, regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS security_id,
      l_quantity::DECIMAL(20,4) AS q, l_extendedprice::DECIMAL(20,2) AS v, l_returnflag, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "holding": """SELECT filer_id * 10000 + year(period) * 4 + quarter(period) - 1 AS filing_id, filer_id, security_id, period, q AS shares, v AS value_usd,
      CASE WHEN l_linenumber = 7 THEN 'PRN' ELSE 'SH' END AS sshprnamt_type, CASE WHEN l_returnflag = 'R' THEN 'Call' END AS put_call FROM lines_""",
    "filing": """SELECT DISTINCT filer_id * 10000 + year(period) * 4 + quarter(period) - 1 AS filing_id, filer_id, period, period + ((filer_id % 30) + 15)::INT AS filed_at,
      CASE WHEN (filer_id * 10000 + year(period) * 4 + quarter(period) - 1) % 17 = 0 THEN 'suspect' ELSE 'ok' END AS parse_status FROM lines_""",
    "amendment": """SELECT o_orderkey::BIGINT AS filing_id, lpad(o_orderkey::VARCHAR, 20, '0') AS accession_no, c_nationkey::BIGINT AS filer_id, (o_custkey % 3)::VARCHAR AS cik,
      last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE AS period, o_orderdate AS filed_at, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN '13F-HR' ELSE '13F-HR/A' END AS form_type,
      CASE o_orderpriority[1] WHEN '3' THEN 'restatement' WHEN '4' THEN 'new_holdings' END AS amendment_kind, CASE WHEN o_orderstatus = 'P' THEN 'suspect' ELSE 'ok' END AS parse_status
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "amendment_filer": "SELECT n_nationkey::BIGINT AS filer_id, CASE WHEN n_nationkey % 2 = 0 THEN 'sum' ELSE 'successor' END AS overlap FROM nation",
    "amendment_cik": """SELECT n_nationkey::BIGINT AS filer_id, cik, priority FROM nation, (VALUES ('0', 1), ('1', 2), ('2', NULL)) c(cik, priority)
      WHERE NOT (cik = '1' AND n_nationkey % 5 = 0)""",
    "insider_line": """SELECT event_id::BIGINT AS id, ts::DATE AS transaction_date, event_id::BIGINT AS filing_id, user_id::BIGINT AS insider_id, json_extract_string(props, '$.k') AS issuer_cik,
      json_extract_string(props, '$.k')::BIGINT % 25 AS security_id, event_id % 11 = 0 AS is_derivative,
      CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'A' WHEN 'signup' THEN 'G' ELSE 'S' END AS transaction_code, 100::DECIMAL(20,4) AS shares,
      CASE WHEN event_id % 13 <> 0 THEN value::DECIMAL(20,2) END AS value_usd, event_id % 19 = 0 AS is_10b5_1, event_id % 23 = 0 AS plan, user_id % 7 <> 0 AS is_director, user_id % 14 = 0 AS is_officer, ts AS filed_at
      FROM events""",
    "quote": """SELECT security_id, period + (l_partkey % 60)::INT AS date, round(sum(v)::DOUBLE / sum(q)::DOUBLE, 8) AS close FROM lines_ GROUP BY 1, 2""",
}


def oracle(query: str, **more: str) -> str:
    """A DuckDB query over the domain's tables and further named expressions."""
    parts = [f"{name} AS ({text})" for name, text in (SQL | more).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query
