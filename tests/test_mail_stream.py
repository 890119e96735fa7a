"""Mail as a stream with timers: waits, quiet hours, the day's cap, digests; and the same batches as the table form."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import batches, mail

SCHEMA = "user_id long, kind string, since timestamp, zone string, quiet_from int, quiet_to int"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def sent(spark, where, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA.replace("since timestamp", "since string")).withColumn("since", F.col("since").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{where}/in")
        time.sleep(1.1)  # files are taken by the second that they were written in
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    mail.mail_stream(source).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.user_id, str(r.at), r.action, r["items"]) for r in spark.read.parquet(f"{where}/out").collect())


def test_timers_send_what_is_due(rocks, tmp_path):
    tick = lambda day: (99, "instant", f"2024-03-{day:02} 12:00:00", "UTC", 0, 0)
    files = [
        [(1, "instant", "2024-03-05 10:00:00", "UTC", 22, 7), (1, "instant", "2024-03-05 10:10:00", "UTC", 22, 7), (2, "instant", "2024-03-05 21:55:00", "UTC", 22, 7), (3, "digest", "2024-03-05 09:00:00", "America/New_York", 23, 6),
         *((4, "instant", f"2024-03-05 0{h}:30:00", "UTC", 0, 0) for h in range(1, 6)), (5, "digest", "2024-03-05 08:00:00", "UTC", 0, 0), *((5, "instant", f"2024-03-05 0{h}:30:00", "UTC", 0, 0) for h in (1, 2, 3))],
        *([tick(day)] for day in range(6, 11)),
    ]
    got = [r for r in sent(rocks, tmp_path, files) if r[0] != 99]
    assert got == [
        (1, "2024-03-05 10:15:00", "batch", 2), (2, "2024-03-06 07:00:00", "batch", 1), (3, "2024-03-06 00:00:00", "digest", 1),
        (4, "2024-03-05 01:45:00", "batch", 1), (4, "2024-03-05 02:45:00", "batch", 1), (4, "2024-03-05 03:45:00", "batch", 1), (4, "2024-03-05 04:45:00", "to_digest", 1), (4, "2024-03-05 05:45:00", "to_digest", 1), (4, "2024-03-06 00:00:00", "digest", 2),
        (5, "2024-03-05 01:45:00", "batch", 1), (5, "2024-03-05 02:45:00", "batch", 1), (5, "2024-03-05 03:45:00", "to_digest", 1), (5, "2024-03-05 19:00:00", "digest", 2),
    ]


def test_batches_are_those_of_the_table_form(rocks, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(u, "instant", str(start + dt.timedelta(days=d, minutes=m)), "UTC", 0, 0) for u in range(8) for d in range(4) for m in sorted(rng.sample([0, 5, 14, 15, 16, 300, 312], rng.randint(1, 5)))]
    table = rocks.createDataFrame([(r[0], dt.datetime.fromisoformat(r[2])) for r in rows], "user_id long, ts timestamp")
    wanted = sorted((r.user_id, str(r.sent_at), "batch", r["items"]) for r in batches.mail_batches(table, "user_id", "ts").collect())
    late = [[(99, "instant", f"2024-01-{day:02} 00:00:00", "UTC", 0, 0)] for day in (9, 10)]
    got = [r for r in sent(rocks, tmp_path, [rows, *late]) if r[0] != 99]
    assert [(u, at, items) for u, at, _, items in got] == [(u, at, items) for u, at, _, items in wanted]
