"""Report tables in filed HTML: their rows, read by a small state machine over tags, with checks that the page is still the shape it was."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a report's table of transactions, and the line that counts them.
COLUMNS = ["#", "Transaction Date", "Owner", "Ticker", "Asset Name", "Asset Type", "Type", "Amount", "Comment"]
TOTAL = r"\(\s*([0-9]+)\s+transactions?\s+total\s*\)"
#: Letters of a page that the reader is given at once.
_PIECE = 1 << 16


class _Reader(HTMLParser):
    """Headings, tables (headers, rows of cells) and text of a page. Cells of a table within a cell are text of the outer one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.headings: list[str] = []
        self.tables: list[tuple[list[str], list[list[str]]]] = []
        self.text: list[str] = []
        self.depth, self.skip, self.cell, self.into = 0, 0, None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "h1":
            self.headings.append("")
            self.into = "h1"
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append(([], []))
        elif self.depth == 1 and tag == "tr":
            self.cell = None
            self.tables[-1][1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            self.cell = (tag, [])
        self._space()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "h1":
            self.into = None
        elif tag == "table":
            if self.depth == 1:
                self._close()
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()
        self._space()

    def _space(self):
        """A tag parts words."""
        if self.into:
            self.headings[-1] += " "
        if self.cell:
            self.cell[1].append(" ")
        self.text.append(" ")

    def handle_data(self, data):
        if self.skip:
            return
        if self.into:
            self.headings[-1] += data
        if self.cell:
            self.cell[1].append(data)
        self.text.append(data)

    def _close(self):
        if self.cell and self.tables:
            tag, parts = self.cell
            words = " ".join("".join(parts).split())
            header, rows = self.tables[-1]
            if tag == "th":
                header.append(words)
            elif rows:
                rows[-1].append(words)
            else:
                rows.append([words])
        self.cell = None


def _read(columns: list[str]):
    schema = pa.schema([("key", pa.string()), ("problem", pa.string()), ("line", pa.int32()), ("cells", pa.list_(pa.string())), ("heading", pa.string())])
    total_line = re.compile(TOTAL, re.IGNORECASE)

    def page(html: str) -> tuple[str | None, str | None, list[list[str]]]:
        reader = _Reader()
        for a in range(0, len(html), _PIECE):
            reader.feed(html[a : a + _PIECE])
        reader.close()
        headings = [" ".join(h.split()) for h in reader.headings]
        if len(headings) != 1:
            return f"{len(headings)} h1 headings", None, []
        totals = [int(m[1]) for m in total_line.finditer(" ".join("".join(reader.text).split()))]
        if len(totals) != 1:
            return "not one line that counts the transactions", headings[0], []
        found = [rows for header, rows in reader.tables if header == columns]
        if not found and not totals[0]:
            return None, headings[0], []
        if len(found) != 1:
            return f"{len(found)} tables with the columns", headings[0], []
        rows = [r for r in found[0] if r]
        if bad := [len(r) for r in rows if len(r) != len(columns)]:
            return f"a row of {bad[0]} cells", headings[0], []
        if len(rows) != totals[0]:
            return f"{len(rows)} rows where the page counts {totals[0]}", headings[0], []
        if sorted(r[0] for r in rows) != sorted(str(n) for n in range(1, len(rows) + 1)):
            return "the # column isn't 1 to the total", headings[0], []
        return None, headings[0], sorted(rows, key=lambda r: int(r[0]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch["key"].to_pylist(), batch["html"], strict=True):
                problem, heading, rows = page(html.as_py() or "")
                lines = [{"key": key, "problem": problem, "line": int(r[0]), "cells": r, "heading": heading} for r in rows] or [{"key": key, "problem": problem, "line": None, "cells": None, "heading": heading}]
                yield pa.RecordBatch.from_pylist(lines, schema)

    return read


def report_lines(pages: DataFrame, key: str, html: str = "html", columns: list[str] | None = None) -> DataFrame:
    """key, heading, problem, line and a column c1, c2, ... for each of `columns`: a row for each line of each page's table, one without a line for a page that lists
    none or has a problem.

    A page has one h1, one line that counts its transactions, and one table with just these columns, whose rows have as many cells, are as many as the line says, and
    are numbered from 1. Anything else is drift: a `problem` that says what. Pages are read one at a time in a task.
    """
    columns = COLUMNS if columns is None else columns
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInArrow(_read(columns), "key string, problem string, line int, cells array<string>, heading string")
    return rows.select(F.col("key").cast(kind).alias(key), "heading", "problem", "line", *(F.get("cells", i).alias(f"c{i + 1}") for i in range(len(columns))))


def undrifted(lines: DataFrame, key: str) -> DataFrame:
    """The lines; a page with a problem fails the query, with its key."""
    told = F.concat(F.lit("report "), F.col(key).cast("string"), F.lit(": "), F.col("problem"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(told).cast("int")).otherwise(F.col("line"))
    return lines.withColumn("line", checked).drop("problem")
