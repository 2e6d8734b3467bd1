"""The rolling budget of a stream, over several batches, against plain sums."""

import random

from pyspark.sql import functions as F

from netloom.streaming import budget, events

SCHEMA = "k string, ts timestamp, n bigint, value double"
HOUR = 3_600_000_000


def test_budget_of_batches_out_of_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), 60 * r.randrange(60 * 12), n, None if n % 11 == 0 else float(r.randrange(100))) for n in range(160)]
    rows += [("a", 600, 160, 1.0), ("a", 600, 161, 2.0), ("c", 0, 162, None), ("c", 60 * 60, 163, 5.0), ("c", 60 * 60 + 1, 164, None)]
    rows.sort(key=lambda x: x[1] + r.randrange(1200))  # late by up to 20 minutes
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ts")).alias("ts")
    for i in range(4):
        part = rows[i * 45 : (i + 1) * 45]
        spark.createDataFrame(part, "k string, ts bigint, n bigint, value double").select("k", at, "n", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", None, 999, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.stream(spark, str(tmp_path / "in"), files_each=1)
    out = budget.spent(stream, str(tmp_path / "out"), "k", "ts", "n", "value", span=HOUR, late="1 hour")
    want = {}
    for k, t, n, _ in rows:
        near = [v for k2, t2, _, v in rows if k2 == k and t - 3600 <= t2 <= t and v is not None]
        want[n] = (k, sum(near) if near else None)
    assert {x["id"]: (x["k"], x["spent"]) for x in out.collect()} == want
    assert out.count() == len(rows)
    # another run over the same path has nothing to add
    assert budget.spent(stream, str(tmp_path / "out"), "k", "ts", "n", "value", span=HOUR, late="1 hour").count() == len(rows)


def test_budget_of_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert budget.spent(events.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), "k", "ts", "n", "value").count() == 0


def test_many_keys_share_the_state_of_a_group(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(budget.Rolling):
        def handleInputRows(self, key, rows, timerValues):
            (calls / f"{key[0]}_{key[1]}").touch()
            return super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(budget, "Rolling", Counted)
    spark.range(600).select(F.when(F.col("id") % 7 > 0, F.col("id") % 300 + 2**60).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.col("id").alias("n"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = budget.spent(events.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), "k", "ts", "n", "value", span=HOUR, late="1 hour").collect()
    key = lambda n: n % 300 + 2**60 if n % 7 else None
    assert {r["id"]: (r["k"], r["spent"]) for r in out} == {n: (key(n), float(sum(key(m) == key(n) for m in range(n + 1)))) for n in range(600)}
    assert len(list(calls.iterdir())) <= 3 * budget.GROUPS
