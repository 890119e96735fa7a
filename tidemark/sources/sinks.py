"""Writing: replacing a scope, inserting once, latest of a key, and spreadsheets' CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rewrite just the partitions that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def only_new(rows: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't present yet, each key once."""
    return rows.dropDuplicates(key).join(present.select(*key), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order, whole."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def csv_cell(column: Column, kind: str) -> Column:
    """Text of a CSV cell: decimals plain, booleans true or false, JSON with its keys in order, and a quote before what a spreadsheet would run."""
    if kind.startswith(("array", "struct", "map")):
        return _guarded(F.to_json(F.parse_json(F.to_json(column))))
    if kind.startswith("decimal"):
        return F.regexp_replace(F.format_string("%s", column.cast("string")), "^0E-?[0-9]+$", "0")
    return _guarded(column) if kind == "string" else column.cast("string")


def _guarded(text: Column) -> Column:
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    """One CSV line for each row, as write_csv() writes it."""
    cells = [csv_cell(F.col(c), t) for c, t in rows.dtypes]
    quoted = [F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in cells]
    return rows.select(F.concat_ws(",", *quoted).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with CRLF line ends and a header each."""
    cells = rows.select(*(csv_cell(F.col(c), t).alias(c) for c, t in rows.dtypes))
    cells.write.option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def csv_text(rows: DataFrame, about: dict[str, str]):
    """The lines of one CSV for a reader: a byte order mark, a block of # lines about it, the header and the rows, streamed one partition after another."""
    yield "\ufeff" + "".join(f"# {k}: {v}\r\n" for k, v in about.items())
    yield ",".join(rows.columns) + "\r\n"
    for r in csv_lines(rows).toLocalIterator():
        yield r.line + "\r\n"
