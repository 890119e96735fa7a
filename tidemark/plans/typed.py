"""One list of columns and types that a query and its SQL twin both end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that doubles keep.
PLACES = 8
_TYPES = {"l": "bigint", "d": "date", "s": "string", "f": "double", "g": "double", "b": "boolean", "t": "timestamp"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def typed(df: DataFrame, spec: str) -> DataFrame:
    """The columns of a spec like "filer_id:l period:d total:f", cast; f is a rounded double, g one as it is, a a column left alone."""

    def cast(name: str, kind: str) -> Column:
        if kind == "a":
            return F.col(name)
        column = F.col(name).cast(_TYPES[kind])
        return (F.round(column, PLACES) if kind == "f" else column).alias(name)

    return df.select(*(cast(*c) for c in _columns(spec)))


def typed_sql(spec: str, source: str) -> str:
    """The same for DuckDB, from a table expression."""

    def cast(name: str, kind: str) -> str:
        if kind == "a":
            return name
        text = f"CAST({name} AS {_TYPES[kind].replace('string', 'varchar')})"
        return f"round({text}, {PLACES}) AS {name}" if kind == "f" else f"{text} AS {name}"

    return f"SELECT {', '.join(cast(*c) for c in _columns(spec))} FROM ({source})"
