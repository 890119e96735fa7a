"""Filed documents and published lists as tables, by Spark's own text, JSON and XPath functions."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_cusip, normal_ticker, put_call, quantity, planned, price_range


def texts_of(fragment: str, paths: tuple[str, ...]) -> list[str | None]:
    """The text of the first element at each path, a tag or parent/tag anywhere in the fragment, as XPath's string() gives it without outer space, and all values at a
    path to an attribute (tag/@name), each with a space after it. Prefixes of tags don't count."""
    lasts = {p.rpartition("/")[2] for p in paths}
    found: dict[str, list[str]] = {}
    above: list[str] = []
    reading: list[tuple[int, str]] = []

    def start(tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rpartition(":")[2]
        for name, value in attributes.items():
            if (path := f"{tag}/@{name}") in paths:
                found.setdefault(path, []).append(f"{value} ")
        if tag in lasts:
            for path in (tag, f"{above[-1]}/{tag}") if above else (tag,):
                if path in paths and path not in found:
                    found[path] = []
                    reading.append((len(above), path))
        above.append(tag)

    def end(_: str) -> None:
        above.pop()
        while reading and reading[-1][0] == len(above):
            reading.pop()

    def characters(data: str) -> None:
        for _, path in reading:
            found[path].append(data)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(fragment, True)
    return ["".join(found[p]).strip() if p in found else None for p in paths]


def _elements(xml: str, tag: str, paths: tuple[str, ...], broken: bool = False) -> Column:
    """For each element of a tag, with any prefix, the texts at some paths, as arrays in their order: a document is searched once and each of its elements read once.
    An element that isn't XML is an error, or has nulls alone where `broken` ones may come. The function is called non-deterministic so that no filter reads all once more."""
    name = rf"(?:[A-Za-z0-9_]+:)?{tag}"
    whole = re.compile(rf"<{name}(?:\s[^>]*)?(?<!/)>.*?</{name}>", re.S)

    def texts(fragment: str) -> list[str | None]:
        try:
            return texts_of(fragment, paths)
        except expat.ExpatError:
            if not broken:
                raise
            return [None] * len(paths)

    def read(documents: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else [texts(m.group()) for m in whole.finditer(d)] for d in documents], dtype=object)

    read.__annotations__ = {"documents": pd.Series, "return": pd.Series}  # as types, for Spark reads them
    return F.pandas_udf(read, "array<array<string>>").asNondeterministic()(xml)


def _text(texts: str, paths: tuple[str, ...], path: str) -> Column:
    """One of the texts that were read; null if there is none."""
    return F.nullif(F.get(texts, F.lit(paths.index(path))), F.lit(""))


def _fragments(xml: str, tag: str) -> Column:
    """The elements of a tag, with any namespace prefix, as one fragment each. Prefixes are taken away, which XPath could not resolve."""
    plain = F.regexp_replace(F.regexp_replace(F.col(xml), r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"\s(?:xmlns|xsi)(?::[A-Za-z0-9_]+)?=(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_extract_all(plain, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


def _day(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("MM-dd-yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


_COVER = ("amendmentType", "reportCalendarOrQuarter", "filingManager/name", "cik", "amendmentNo", "tableEntryTotal", "tableValueTotal", "isConfidentialOmitted")


def cover_pages(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Cover pages of quarterly reports: period, manager, CIK of ten digits, amendment number and kind, stated entries and total."""
    text = lambda path: _text("__t", _COVER, path)
    kind = F.upper(text("amendmentType"))
    return documents.withColumn("__t", _elements(xml, "edgarSubmission", _COVER)).withColumn("__t", F.get("__t", F.lit(0))).select(
        *[c for c in documents.columns if c != xml], _day(text("reportCalendarOrQuarter")).alias("period"), text("filingManager/name").alias("manager"), F.lpad(text("cik"), 10, "0").alias("cik"),
        text("amendmentNo").try_cast("int").alias("amendment_no"), F.when(kind == "RESTATEMENT", "restatement").when(kind == "NEW HOLDINGS", "new_holdings").alias("amendment_kind"),
        quantity(text("tableEntryTotal")).cast("long").alias("entries"), quantity(text("tableValueTotal")).alias("total"),
        F.lower(text("isConfidentialOmitted")).isin("true", "1").alias("confidential_omitted"),
    )


#: What an entry of an information table holds.
_ENTRY = (
    "infoTable/nameOfIssuer", "infoTable/titleOfClass", "infoTable/cusip", "infoTable/value", "shrsOrPrnAmt/sshPrnamt", "shrsOrPrnAmt/sshPrnamtType", "infoTable/putCall", "infoTable/investmentDiscretion",
    "votingAuthority/Sole", "votingAuthority/Shared", "votingAuthority/None",
)


def information_tables(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each entry; `problem` names what keeps one from being read, and the others stay."""
    rows = documents.select(*[c for c in documents.columns if c != xml], _elements(xml, "infoTable", _ENTRY, broken=True).alias("__e"))
    rows = rows.select("*", F.posexplode("__e").alias("place", "__t")).drop("__e")
    text = lambda path: _text("__t", _ENTRY, path)
    rows = rows.withColumns({
        "cusip": normal_cusip(text("infoTable/cusip")), "issuer": text("infoTable/nameOfIssuer"), "title": text("infoTable/titleOfClass"), "value": quantity(text("infoTable/value")), "shares": quantity(text("shrsOrPrnAmt/sshPrnamt")),
        "sshprnamt_type": F.upper(text("shrsOrPrnAmt/sshPrnamtType")), "put_call": put_call(text("infoTable/putCall")), "discretion": text("infoTable/investmentDiscretion"),
        "voting_sole": quantity(text("votingAuthority/Sole")), "voting_shared": quantity(text("votingAuthority/Shared")), "voting_none": quantity(text("votingAuthority/None")),
    })
    wrong = F.when(F.col("cusip").isNull(), "cusip").when(F.col("value").isNull(), "value").when(F.col("shares").isNull(), "shares").when(~F.coalesce(F.col("sshprnamt_type").isin("SH", "PRN"), F.lit(False)), "type")
    return rows.withColumn("problem", wrong).drop("__t")


def collapsed(rows: DataFrame) -> DataFrame:
    """Entries of one filing, CUSIP, option and type as one: figures summed, nulls left out, descriptions from the first."""
    first = F.min_by(F.struct("issuer", "title", "discretion"), "place").alias("d")
    return rows.where("problem is null").groupBy("filing_id", "cusip", "put_call", "sshprnamt_type").agg(*(F.sum(c).alias(c) for c in ("value", "shares", "voting_sole", "voting_shared", "voting_none")), first).select("*", "d.*").drop("d")


_ROLES = (("Director", "director"), ("Officer", "officer"), ("TenPercentOwner", "ten_percent_owner"), ("Other", "other"))
_FORM = ("issuerCik", "issuerName", "issuerTradingSymbol", "rptOwnerCik", *(f"is{r}" for r, _ in _ROLES))
_LINE = ("securityTitle/value", "transactionDate/value", "transactionCode", "transactionShares/value", "transactionPricePerShare/value", "transactionAcquiredDisposedCode/value", "footnoteId/@id")
_OWNER = ("rptOwnerCik", "rptOwnerName", "officerTitle", *(f"is{r}" for r, _ in _ROLES))


def _roles(paths: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(_text("__t", paths, f"is{r}").isin("1", "true"), F.lit(False)).alias(f"is_{n}") for r, n in _ROLES]


def insider_forms(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Transaction lines of insider reports: those without derivatives first, then derivatives, numbered from 1. A price of 0 is null."""
    keep = [c for c in documents.columns if c != xml]
    parts = {"__t": ("ownershipDocument", _FORM), "__n": ("nonDerivativeTransaction", _LINE), "__o": ("derivativeTransaction", _LINE)}
    whole = documents.select(*keep, *(_elements(xml, *p).alias(n) for n, p in parts.items())).withColumn("__t", F.get("__t", F.lit(0)))
    form = lambda path: _text("__t", _FORM, path)
    about = whole.select(
        *keep, F.lpad(form("issuerCik"), 10, "0").alias("issuer_cik"), form("issuerName").alias("issuer_name"), normal_ticker(form("issuerTradingSymbol")).alias("ticker"),
        F.lpad(form("rptOwnerCik"), 10, "0").alias("owner_cik"), *_roles(_FORM),
        F.concat(F.transform("__n", lambda x: F.struct(F.lit(False).alias("is_derivative"), x.alias("t"))), F.transform("__o", lambda x: F.struct(F.lit(True).alias("is_derivative"), x.alias("t")))).alias("__l"),
    )
    lines = about.select("*", F.posexplode("__l").alias("n", "l")).drop("__l").withColumn("__t", F.col("l.t"))
    line = lambda path: _text("__t", _LINE, path)
    return lines.withColumns({
        "line_number": F.col("n") + 1, "is_derivative": F.col("l.is_derivative"), "security_title": line("securityTitle/value"), "transaction_date": _day(line("transactionDate/value")), "transaction_code": line("transactionCode"),
        "shares": quantity(line("transactionShares/value")), "price_per_share": F.nullif(line("transactionPricePerShare/value").try_cast("decimal(20,8)"), F.lit(0).cast("decimal(20,8)")),
        "acquired": line("transactionAcquiredDisposedCode/value") == "A", "footnote_ids": F.array_distinct(F.filter(F.split(F.coalesce(F.get("__t", F.lit(len(_LINE) - 1)), F.lit("")), " "), lambda i: i != "")),
    }).drop("n", "l", "__t")


def reporting_owners(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Every reporting owner of insider reports, joint filers too, with their roles and the title of an officer."""
    keep = [c for c in documents.columns if c != xml]
    rows = documents.select(*keep, _elements(xml, "reportingOwner", _OWNER).alias("__e")).select(*keep, F.explode("__e").alias("__t"))
    owner = lambda path: _text("__t", _OWNER, path)
    return rows.select(*keep, F.lpad(owner("rptOwnerCik"), 10, "0").alias("owner_cik"), owner("rptOwnerName").alias("owner_name"), *_roles(_OWNER), owner("officerTitle").alias("officer_title"))


def whole_forms(lines: DataFrame, key: str) -> DataFrame:
    """Lines of the reports of which every line has its code and date: one bad line fails its document. One window over a report's lines, so that documents are read once."""
    bad = F.max(F.col("transaction_code").isNull() | F.col("transaction_date").isNull()).over(Window.partitionBy(key))
    return lines.withColumn("__bad", bad).where(~F.col("__bad") | F.col(key).isNull()).drop("__bad")


def cited_footnotes(rows: DataFrame, ids: str = "footnote_ids", texts: str = "footnotes") -> DataFrame:
    """A line's own footnotes: those of the document's map that the line cites."""
    return rows.withColumn(texts, F.map_filter(texts, lambda k, _: F.array_contains(ids, k)))


def priced(rows: DataFrame, raw: str = "price", cited: str = "cited") -> DataFrame:
    """Lines with price, price_low and price_high, from the price as filed and the footnotes that it cites.

    A price of 0 is none. One that is a range itself is no single price; the range is otherwise the first in the footnotes that is one.
    """
    given = F.col(raw)
    number = F.regexp_replace(F.trim(given), ",", "").try_cast("decimal(20,8)")
    own = F.when(number.isNull() & given.isNotNull(), price_range(F.when(given.contains("$"), given).otherwise(F.concat(F.lit("$"), F.trim(given)))))
    found = F.coalesce(own, price_range(F.coalesce(F.col(cited), F.lit(""))))
    return rows.withColumns({"price_low": found["low"], "price_high": found["high"], raw: F.when(number > 0, number)})


def plan_trades(rows: DataFrame, form: str, checkbox: str = "checkbox", texts: str = "footnotes") -> DataFrame:
    """Lines with is_10b5_1: one of a line's own footnotes (a list) says that it was under a plan; where none of a form's lines has such a footnote, its checkbox holds for
    all of them, for it can't say which it means."""
    told = F.coalesce(F.exists(texts, planned), F.lit(False))
    any_told = F.max(F.col("is_10b5_1")).over(Window.partitionBy(form))
    return rows.withColumn("is_10b5_1", told).withColumn("is_10b5_1", F.col("is_10b5_1") | (F.coalesce(checkbox, F.lit(False)) & ~any_told))


# ---------------------------------------------------------------- lists and indexes


def official_list(spark: SparkSession, path: str) -> DataFrame:
    """The official list of securities, 80 columns wide: CUSIP, option flag, name, description, status; repeated lines once."""
    at = lambda a, n: F.trim(F.substring("value", a, n))
    rows = spark.read.text(path).where(F.length(F.rtrim("value")) >= 40)
    return rows.select(at(1, 9).alias("cusip"), (at(10, 1) == "*").alias("has_options"), at(11, 30).alias("name"), at(41, 27).alias("description"), F.lower(at(68, 3)).alias("status")).where(F.col("cusip").rlike("^[A-Z0-9]{9}$")).distinct()


def daily_index(spark: SparkSession, path: str) -> DataFrame:
    """Form, company, CIK, day and file of each line below the index's rule of dashes."""
    pattern = r"^(\S.*?)\s{2,}(.*?)\s{2,}(\d+)\s+(\d{8}|\d{4}-\d{2}-\d{2})\s+(edgar/\S+)\s*$"
    part = lambda n: F.regexp_extract("value", pattern, n)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(part(1).alias("form_type"), part(2).alias("company"), F.lpad(part(3), 10, "0").alias("cik"), F.to_date(F.regexp_replace(part(4), "-", ""), "yyyyMMdd").alias("filed_on"), part(5).alias("file"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings of a company's history file, whose columns are parallel arrays."""
    fields = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument"]
    recent = ", ".join(f"{f}: array<string>" for f in fields)
    rows = spark.read.schema(f"cik string, filings struct<recent: struct<{recent}>>").option("multiLine", True).json(path)
    each = rows.select("cik", F.explode(F.arrays_zip(*(F.col(f"filings.recent.{f}").alias(f) for f in fields))).alias("f"))
    return each.select(F.lpad("cik", 10, "0").alias("cik"), F.col("f.accessionNumber").alias("accession_no"), F.col("f.form").alias("form_type"), F.to_date("f.filingDate").alias("filed_on"), F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("period"), F.try_to_timestamp("f.acceptanceDateTime").alias("accepted_at"), F.col("f.primaryDocument").alias("document"))


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """Tickers by company, from a file with one object whose values are the rows."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("r"))
    return rows.select(normal_ticker(F.col("r.ticker")).alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), F.col("r.title").alias("name"))


def legislators(spark: SparkSession, path: str) -> DataFrame:
    """A row for each term of each member."""
    schema = "id struct<bioguide: string>, name struct<first: string, last: string, official_full: string>, terms array<struct<type: string, start: string, `end`: string, state: string, district: string, party: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("id.bioguide").alias("member"), F.col("name.first").alias("first"), F.col("name.last").alias("last"), F.explode("terms").alias("t"))
    return rows.select("member", "first", "last", F.when(F.col("t.type") == "sen", "senate").otherwise("house").alias("chamber"), F.to_date("t.start").alias("start"), F.to_date("t.end").alias("until"), "t.state", "t.district", "t.party")


def published_days(spark: SparkSession, path: str) -> DataFrame:
    """Days of a quarter's listing (JSON of a directory's items) that have a form index."""
    rows = spark.read.schema("directory struct<item: array<struct<name: string>>>").option("multiLine", True).json(path).select(F.explode("directory.item.name").alias("name"))
    return rows.select(F.try_to_timestamp(F.regexp_extract("name", r"^form\.([0-9]{8})\.idx(?:\.gz)?$", 1), F.lit("yyyyMMdd")).cast("date").alias("day")).where("day is not null").distinct()


def overflow_pages(spark: SparkSession, path: str) -> DataFrame:
    """Filings of a history's further pages, each one object of parallel arrays; the page's file has the CIK in its name."""
    fields = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]
    rows = spark.read.schema(", ".join(f"{f} array<string>" for f in fields)).option("multiLine", True).json(path).withColumn("cik", F.regexp_extract(F.input_file_name(), r"CIK([0-9]{10})", 1))
    each = rows.select("cik", F.explode(F.arrays_zip(*fields)).alias("f"))
    return each.select("cik", F.col("f.accessionNumber").alias("accession_no"), F.col("f.form").alias("form_type"), F.to_date("f.filingDate").alias("filed_on"), F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("period"), F.col("f.primaryDocument").alias("document"))


def yearly_index(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Members' entries of a yearly disclosure index: names, type of filing, state and district, year, day and document; `problem` marks
    entries without a document or a day, and the others stay."""
    keep = [c for c in documents.columns if c != xml]
    rows = documents.select(*keep, F.explode(_fragments(xml, "Member")).alias("__x"))
    entry = F.from_xml("__x", "Prefix string, Last string, First string, Suffix string, FilingType string, StateDst string, Year int, FilingDate string, DocID string", {"rowTag": "Member"})
    rows = rows.withColumn("__e", entry)
    day = F.try_to_timestamp("__e.FilingDate", F.lit("M/d/yyyy")).cast("date")
    return rows.select(
        *keep, F.col("__e.Last").alias("last_name"), F.col("__e.First").alias("first_name"), F.col("__e.Suffix").alias("suffix"), F.col("__e.FilingType").alias("filing_type"), F.substring("__e.StateDst", 1, 2).alias("state"),
        F.substring("__e.StateDst", 3, 2).try_cast("int").alias("district"), F.col("__e.Year").alias("year"), day.alias("filed_on"), F.col("__e.DocID").alias("doc_id"),
        F.when(F.col("__e.DocID").isNull(), "doc_id").when(day.isNull(), "filed_on").alias("problem"),
    )


def curated(spark: SparkSession, entries: list[dict], present: DataFrame | None = None) -> DataFrame:
    """A curated list of investors (slug, name, category, ciks) as filers and CIKs: a row for each CIK, later ones with the higher priority.
    Entries replace those of their slug among the present rows, whose others stay. The list is written by hand, so small."""
    rows = [(e["slug"], e["name"], e.get("category"), cik.zfill(10), n) for e in entries for n, cik in enumerate(e.get("ciks", []))]
    new = spark.createDataFrame(rows, "slug string, name string, category string, cik string, priority int")
    return new if present is None else present.join(F.broadcast(new.select("slug").distinct()), "slug", "left_anti").select(*new.columns).unionByName(new)


def loaded_once(filing: DataFrame, holding: DataFrame, new_filing: DataFrame, new_holding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings and holdings after a load: a filing loaded again replaces itself by its accession number, its holdings with it."""
    key = ["accession_no"]
    return (
        filing.join(new_filing.select(*key), key, "left_anti").unionByName(new_filing.dropDuplicates(key)),
        holding.join(new_filing.select(*key), key, "left_anti").unionByName(new_holding),
    )
