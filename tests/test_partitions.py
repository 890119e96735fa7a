"""Year partitions with their default one, and report tables in HTML."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from tidemark.sources.partitions import Years
from tidemark.sources.tables import COLUMNS, report_lines, undrifted

D = dt.date


def test_a_year_that_is_added_takes_its_rows_from_the_default(spark, tmp_path):
    rows = [(i, D(2020 + i % 5, 1 + i % 12, 3), i * 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, day date, value double")
    kept = Years(spark, str(tmp_path), df.schema, "day")
    text = lambda x: sorted(map(tuple, x.collect()))
    assert kept.insert(df.where("id < 50"), ["id"]) == ["default"] and kept.years() == []
    before = kept.tables.folders()["rows"]
    assert kept.add_year(2022) == 10 and kept.years() == ["2022"] and kept.add_year(2022) == 0 and kept.add_year(2031) == 0
    after = kept.tables.folders()["rows"]
    assert set(after) == {"2022", "default"} and after["default"] != before["default"]
    assert text(kept.between("2000-01-01", "2040-01-01")) == sorted(rows[:50])  # each row once
    assert {r.day.year for r in kept.tables.table("rows").where("part = 'default'").collect()} == {2020, 2021, 2023, 2024}
    assert text(kept.tables.table("rows", version=1).drop("part")) == sorted(rows[:50])  # a reader of the version before

    kept.add_year(2023)
    files = kept.tables.folders()["rows"]
    assert kept.insert(df.where("id >= 50 and year(day) = 2022"), ["id"]) == ["2022"]  # the others keep their files
    assert {p for p, f in kept.tables.folders()["rows"].items() if files.get(p) != f} == {"2022"}
    moved = spark.createDataFrame([(2, D(2023, 5, 5), 9.0)], df.schema)  # was dated 2022
    assert kept.insert(moved, ["id"]) == ["2022", "2023"] and text(kept.between("2023-05-05", "2023-05-05")) == [(2, D(2023, 5, 5), 9.0)]
    plan = kept.between("2022-02-01", "2022-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    assert kept.tables.clean() > 0 and len(text(kept.between("2000-01-01", "2040-01-01"))) == 50 + 2


HEAD = "".join(f"<th> {c} </th>" for c in COLUMNS)


def page(rows, total=None, head=HEAD, h1="<h1>Periodic Report<br>for 2024</h1>"):
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<!doctype html><html>{h1}<script>var x = '<table><h1>';</script><p>({len(rows) if total is None else total} transactions total)</p><table><tr><td>menu</td></tr></table><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def line(n, asset="A &amp; B<div>Rate: <b>5%</b></div>"):
    return [n, "01/02/2024", "Self", "--", asset, "Stock", "Purchase", "$1,001 - $15,000", "--"]


def test_report_tables(spark):
    pages = {
        1: page([line(2), line(1, "X<table><tr><td>inner</td></tr></table>")]), 2: page([]), 3: page([], total=0, head="<th>Other</th>"), 4: page([line(1)], total=2), 5: page([line(1)[:8]]), 6: page([line(1), line(3)]), 7: page([line(1)], head=HEAD.replace("Owner", "Filer")),
        8: page([line(1)], h1=""), 9: "", 10: None, 11: page([line(1)]).replace("transactions total", "lines"), 12: page([line(i) for i in range(1, 3001)]), 13: page([line(1)]).replace("</td>", "").replace("</tr>", ""),
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {}
    for r in report_lines(df, "page_id").collect():
        got.setdefault(r.page_id, []).append(r)
    assert [(r.line, r.c5, r.c8, r.heading) for r in sorted(got[1], key=lambda r: r.line)] == [(1, "X inner", "$1,001 - $15,000", "Periodic Report for 2024"), (2, "A & B Rate: 5%", "$1,001 - $15,000", "Periodic Report for 2024")]
    assert len(got[12]) == 3000 and {r.problem for r in got[12]} == {None}
    told = {k: v[0].problem for k, v in got.items() if v[0].line is None}
    assert told == {
        2: None, 3: None, 4: "1 rows where the page counts 2", 5: "a row of 8 cells", 6: "the # column isn't 1 to the total", 7: "0 tables with the columns", 8: "0 h1 headings", 9: "0 h1 headings", 10: "0 h1 headings",
        11: "not one line that counts the transactions",
    }
    assert [(r.line, r.c9) for r in got[13]] == [(1, "--")]
    assert undrifted(report_lines(df.where("page_id < 4"), "page_id"), "page_id").count() == 4
    with pytest.raises(PySparkException, match="report 4: 1 rows"):
        undrifted(report_lines(df, "page_id"), "page_id").collect()
