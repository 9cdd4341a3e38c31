"""Day panes of a stream: late rows, bounded state, upsert, batch answer."""
import datetime as dt
import os
import time

from pyspark.sql import functions as F

from riskgraph.streaming import jobs as ST

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def write_days(spark, folder, batches):
    """A file for each batch of (day, user, type), older files first."""
    n = 0
    for i, rows in enumerate(batches):
        data = [(n + k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=3), u, t) for k, (d, u, t) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and f not in seen:
                seen.add(f)
                os.utime(os.path.join(folder, f), (time.time() - 1000 + i * 60,) * 2)


seen: set[str] = set()


def test_late_rows_and_state(spark, tmp_path):
    """A row later than the watermark is dropped, one within it counts; passed days leave the state."""
    folder = str(tmp_path / "events")
    write_days(spark, folder, [
        [(0, 1, "view"), (0, 1, "error"), (1, 2, "view")],
        [(20, 1, "purchase")],                       # puts the watermark at day 10; late rows are told one batch later
        [(15, 2, "error")],                          # in time
        [(60, 1, "view"), (0, 1, "view")],           # day 0 is too late
        [(61, 1, "view")],
    ])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    panes, seen_ = ST.stream_panes(ST.read_stream(spark, folder, SCHEMA, 1), "user_id", "ts", "10 days")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    got = {(r.day, r.entity_id): (r.exams, r.pests) for r in panes.collect()}
    assert got == {(day(0), 1): (2, 1), (day(1), 2): (1, 0), (day(20), 1): (1, 1), (day(15), 2): (1, 1), (day(60), 1): (1, 0), (day(61), 1): (1, 0)}
    assert seen_["late"] == 1 and seen_["state"] <= 2


def test_batches_give_the_batch_answer(spark, tmp_path):
    """A day that goes on over several batches is replaced, and windows add up to a plain aggregation."""
    folder = str(tmp_path / "events")
    rows = [[(d % 7 + b, u, "error" if (d + u) % 3 == 0 else "view") for d in range(40) for u in (1, 2)] for b in range(3)]
    write_days(spark, folder, rows)
    got = {(r.window_start, r.entity_id): (r.exams, r.pests, r.window_end) for r in
           ST.stream_trailing_counts(spark, folder, SCHEMA, days=5, files_per_batch=1).collect()}
    expected = {}
    for d, u, t in sum(rows, []):
        for back in range(5):
            start = dt.datetime(2024, 1, 1) + dt.timedelta(days=d - back)
            e, p, _ = expected.get((start, u), (0, 0, None))
            expected[start, u] = (e + 1, p + (t == "error"), start + dt.timedelta(days=5))
    assert got == expected


def test_replayed_epoch_leaves_no_row_twice(spark, tmp_path):
    sink = ST.epoch_sink(str(tmp_path / "t"))
    batch = spark.range(5).select(F.col("id").alias("x"))
    sink(batch, 3)
    sink(batch, 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
