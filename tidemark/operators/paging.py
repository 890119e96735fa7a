"""Keyset pages: total orders, continuing after a position, and cursors."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A sort column; a value that is missing counts as `missing`, or comes last if that is None."""

    name: str
    descending: bool = False
    missing: object = None

    def column(self) -> Column:
        return F.col(self.name) if self.missing is None else F.coalesce(self.name, F.lit(self.missing))

    def order(self) -> Column:
        return self.column().desc_nulls_last() if self.descending else self.column().asc_nulls_last()


def after(keys: list[Key], position: list[object]) -> Column:
    """Rows that come after a position: beyond it in the first key, or level there and after it in the rest."""
    found, level = F.lit(False), F.lit(True)
    for key, value in zip(keys, position, strict=True):
        column = key.column()
        beyond = F.lit(False) if value is None else (F.coalesce(column < F.lit(value) if key.descending else column > F.lit(value), F.lit(False)) | column.isNull())
        found = found | (level & beyond)
        level = level & column.eqNullSafe(F.lit(value))
    return found


def page(rows: DataFrame, keys: list[Key], size: int, position: list[object] | None = None) -> DataFrame:
    """The next `size` rows and one more, which tells that there is a further page. Limit before joining names to them."""
    if position is not None:
        rows = rows.where(after(keys, position))
    return rows.orderBy(*(k.order() for k in keys)).limit(size + 1)


def encode_cursor(values: list[object], sort: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "k": values, "a": sort}, default=str, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str) -> list[object]:
    try:
        value = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if value["v"] != 1 or value["a"] != sort:
            raise ValueError("a cursor of another query")
        return value["k"]
    except (KeyError, TypeError, UnicodeDecodeError) as error:
        raise ValueError("not a cursor") from error


def offset_page(rows: DataFrame, keys: list[Key], size: int, offset: int) -> DataFrame:
    """A page by its number, for short queues that people leaf through; keyset pages don't slow down with depth."""
    return rows.orderBy(*(k.order() for k in keys)).offset(offset).limit(size)
