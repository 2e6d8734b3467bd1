import time

import pytest

from netloom.streaming import events
from netloom.streaming.progress import Progress


def until(found, seconds=60):
    end = time.monotonic() + seconds
    while not found() and time.monotonic() < end:
        time.sleep(0.2)
    return found()


def test_batches_rows_and_the_end_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    progress = Progress(spark).watch()
    try:
        out = events.drain(events.stream(spark, f"{tmp_path}/in/*", files_each=2), f"{tmp_path}/out")
        assert out.count() == 30
        assert until(lambda: progress.events().where("event = 'ended' AND error IS NULL").count() == 1)
        seen = progress.events()
        assert seen.where("event = 'started'").count() == 1
        assert seen.where("event = 'progress'").agg({"rows": "sum"}).first()[0] == 30 and seen.where("rows > 0").select("batch").distinct().count() == 2
    finally:
        progress.close()


def test_a_failed_stream_ends_with_its_error_and_old_events_go(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    progress = Progress(spark, most=2).watch()
    try:
        with pytest.raises(Exception, match="too bad"):
            events.drain(events.stream(spark, f"{tmp_path}/in").selectExpr("raise_error('too bad') AS id"), f"{tmp_path}/out")
        assert until(lambda: progress.events().where("event = 'ended' AND error LIKE '%too bad%'").count() == 1)
        assert progress.events().count() <= 2
    finally:
        progress.close()
