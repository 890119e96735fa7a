"""The chain refreshed filing by filing against building everything, which files a refresh leaves alone, and the same on a stream."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_golden import FILINGS, PRICES, Q1, Q2, Q3, Q4, SECURITY
from tidemark.operators import change, effective, price, recompute, snapshot
from tidemark.sources.partitions import Periods
from tidemark.streaming import batches

FILING = "filing_id long, accession_no string, filer_id long, cik string, period date, filed_at timestamp, form_type string, amendment_kind string, parse_status string"
HOLDING = "filing_id long, security_id long, shares decimal(20,4), value_usd decimal(20,2), sshprnamt_type string, put_call string, period date"
#: A security that splits two for one in the third quarter, which three filers show; one of them files late and moves the split.
SPLIT = [(n, q, f"{day}", None, f"FOLD {shares}", False) for n in (11, 12, 13) for q, day, shares in ((Q1, "2024-05-01", 100 * n), (Q2, "2024-08-01", 100 * n), (Q3, "2024-11-01", 200 * n), (Q4, "2025-02-01", 200 * n))]
PRICES = PRICES | {"FOLD": (40, 40, 20, 20)}
SECURITY = SECURITY | {"FOLD": 7}


def rows():
    filings, holdings = [], []
    for n, (filer, period, filed, kind, held, suspect) in enumerate(FILINGS + SPLIT, 1):
        at = dt.datetime.fromisoformat(filed + "T16:00:00")
        filings.append((n, f"{filer}-{n:06}", filer, str(filer), period, at, "13F-HR/A" if kind else "13F-HR", kind, "suspect" if suspect else "ok"))
        words = held.split()
        for name, shares in zip(words[::2], map(int, words[1::2]), strict=True):
            holdings.append((n, SECURITY[name], Decimal(shares), Decimal(shares * PRICES[name][period.month // 3 - 1]), "SH", None, period))
    return filings, holdings


def chain(effective_, filing, holding):
    snap = snapshot.position_snapshot(effective_, filing, holding)
    prices = price.implied_price(snap)
    verdicts = price.judge(price.split_candidates(snap, prices))
    return {"snapshot": snap, "published": snapshot.filer_period(snap), "prices": prices, "verdicts": verdicts, "change": change.position_change(snap, price.splits_of(verdicts))}


def counted(filing):
    spark = filing.sparkSession
    ciks = spark.createDataFrame([(i, "sum", str(i), 1) for i in (1, 2, 3, 11, 12, 13)], "filer_id long, overlap string, cik string, priority int")
    return effective.effective_filing(effective.effective_filing_by_cik(filing), ciks.select("filer_id", "overlap"), ciks)


def text(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    filings, holdings = rows()
    filing, holding = spark.createDataFrame(filings, FILING), spark.createDataFrame(holdings, HOLDING)
    return filing, holding, {name: text(df) for name, df in chain(counted(filing), filing, holding).items()}, filings


def store(spark, root, filing, holding):
    return Periods(spark, str(root), recompute.chain_schemas(counted(filing), filing, holding))


@pytest.mark.parametrize("order", ["newest first", "shuffled"])
def test_any_order_of_filings_makes_the_full_build(spark, tables, tmp_path, order):
    filing, holding, wanted, filings = tables
    numbers = [f[0] for f in sorted(filings, key=lambda f: f[5])]
    if order == "newest first":
        numbers.reverse()
    elif order == "shuffled":
        random.Random(13).shuffle(numbers)
    kept = store(spark, tmp_path, filing, holding)
    for a in range(0, len(numbers), 12):  # twelve filings at a time
        here, new = filing.where(F.col("filing_id").isin(numbers[: a + 12])), filing.where(F.col("filing_id").isin(numbers[a : a + 12]))
        recompute.refresh(kept, batches.touched_pairs(new), counted(here), here, holding)
    for name, rows_ in wanted.items():
        assert text(kept.table(name)) == rows_, name
    assert any("'is_split', True" in r for r in wanted["change"])


def test_a_refresh_writes_the_periods_it_moves_and_no_others(spark, tables, tmp_path):
    filing, holding, wanted, _ = tables
    kept = store(spark, tmp_path, filing, holding)
    early = filing.where("filing_id <> 8")  # filer 1, fourth quarter
    recompute.refresh(kept, batches.touched_pairs(early), counted(early), early, holding)
    before = kept.folders()
    wrote = recompute.refresh(kept, batches.touched_pairs(filing.where("filing_id = 8")), counted(filing), filing, holding)
    after = kept.folders()
    assert wrote == {"snapshot": [str(Q4)], "published": [str(Q4)], "prices": [str(Q4)], "verdicts": [str(Q4), "2025-03-31"], "change": [str(Q4)]}
    for name, folders in after.items():
        assert {p for p in folders if folders[p] != before[name].get(p)} <= set(wrote[name])
        assert str(Q1) not in folders or folders[str(Q1)] == before[name][str(Q1)]
    assert {name: text(kept.table(name)) for name in wanted} == wanted
    assert text(kept.table("change", version=1)) != wanted["change"]  # a reader of the version before still has it
    again = recompute.refresh(kept, batches.touched_pairs(filing.where("filing_id = 8")), counted(filing), filing, holding)
    assert again == wrote and text(kept.table("change")) == wanted["change"]
    assert kept.clean() > 0 and text(kept.table("change")) == wanted["change"]


def test_a_split_that_moves_rebuilds_the_changes_across_it(spark, tables, tmp_path):
    filing, holding, wanted, filings = tables
    kept = store(spark, tmp_path, filing, holding)
    late = [f[0] for f in filings if f[2] in (12, 13) and f[4] == Q3]  # without them nobody can tell the split
    early = filing.where(~F.col("filing_id").isin(late))
    recompute.refresh(kept, batches.touched_pairs(early), counted(early), early, holding)
    first = kept.table("change").where("filer_id = 11 and period = '2024-09-30'").first()
    assert (first.action, first.is_split) == ("add", False)
    recompute.refresh(kept, batches.touched_pairs(filing.where(F.col("filing_id").isin(late))), counted(filing), filing, holding)
    then = kept.table("change").where("filer_id = 11 and period = '2024-09-30'").first()
    assert (then.action, then.is_split) == ("hold", True)
    assert {name: text(kept.table(name)) for name in wanted} == wanted


def test_two_refreshes_at_once_do_not_both_show(spark, tables, tmp_path):
    filing, holding, *_ = tables
    kept = store(spark, tmp_path, filing, holding)
    kept.show({}, 0)
    with pytest.raises(RuntimeError, match="version 1"):
        kept.show({}, 0)
    assert kept.version() == 1


def test_a_stream_of_filings_keeps_the_tables(spark, tables, tmp_path):
    filing, holding, wanted, filings = tables
    kept = store(spark, tmp_path / "tables", filing, holding)
    arrived = tmp_path / "arrived"
    schema = filing.schema

    def run():
        def refresh(pairs, n):
            here = spark.read.schema(schema).parquet(str(arrived))
            recompute.refresh(kept, pairs, counted(here), here, holding)

        batches.on_arrival(spark.readStream.schema(schema).parquet(str(arrived)), refresh, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    for part in (0, 1):
        filing.where(F.col("filing_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(arrived))
        run()
    assert kept.version() >= 2 and {name: text(kept.table(name)) for name in wanted} == wanted
