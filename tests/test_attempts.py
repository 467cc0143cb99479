"""Lifetime figures of retailers: replays, repeated attempts, cut logs and restarts."""

import datetime as dt
import random

from larkspur.operators.history import record_observations
from larkspur.streaming.attempts import LOG, TOTALS, LifetimeYield, merge_attempts

SCHEMA = "domain string, wid string, run string, outcome string, n_listings int, ts timestamp"
T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], LOG), spark.createDataFrame([], TOTALS)


def test_what_counts(spark):
    first = [
        ("a.com", "1", "r1", "success", 3, T(1)), ("a.com", "2", "r1", "blocked", 0, T(2)), ("a.com", "3", "r1", "timeout_network", 0, T(9)), ("a.com", None, "r1", "success", 0, T(3)),
        ("a.com", "1", "r1", "success", 3, T(1)), ("b.com", "1", "r1", "success", 1, None), (None, "1", "r1", "success", 1, T(1)), ("", "1", "r1", "success", 1, T(1)),
    ]
    log, totals = merge_attempts(*empty(spark), spark.createDataFrame(first, SCHEMA))
    assert rows_of(totals) == [("a.com", 1, T(1), T(1), T(3))]
    assert {(r["wid"], r["kind"]) for r in log.collect()} == {("1", "found"), ("2", "blocked"), ("", "empty")}
    again = merge_attempts(log, totals, spark.createDataFrame(first, SCHEMA))
    assert (rows_of(again[0]), rows_of(again[1])) == (rows_of(log), rows_of(totals))
    # a found item that is tried again in its run and isn't there any more, one that now is, and an older try
    later = [("a.com", " 1", "r1", "no_match", 0, T(5)), ("a.com", "2", "r1", "unavailable", 2, T(6)), ("a.com", "2", "r1", "no_match", 0, T(1)), ("a.com", "1", "r2", "success", 1, T(7))]
    log, totals = merge_attempts(log, totals, spark.createDataFrame(later, SCHEMA))
    assert rows_of(totals) == [("a.com", 2, T(1), T(7), T(7))]
    assert merge_attempts(*empty(spark), spark.createDataFrame([], SCHEMA))[1].count() == 0


def test_totals_outlive_the_log(spark):
    rng = random.Random(4)
    rows = [("a.com", str(i), "r", rng.choice(["success", "no_match"]), 1, T(i)) for i in range(30)]
    state = empty(spark)
    for part in (rows[:12], rows[12:20], rows[3:12], rows[20:], rows):  # some replayed in other batches
        log, totals = merge_attempts(*state, spark.createDataFrame(part, SCHEMA), keep=5)
        state = spark.createDataFrame(log.collect(), LOG), spark.createDataFrame(totals.collect(), TOTALS)
    assert [r["wid"] for r in state[0].orderBy("ts").collect()] == ["25", "26", "27", "28", "29"]
    assert state[1].first()["found_total"] == sum(r[3] == "success" for r in rows)


def test_observations_replace_their_run(spark):
    old = spark.createDataFrame([("r1", "1", True, 5.0), ("r1", "2", True, 6.0), (None, "1", False, 7.0), ("r2", "1", True, 8.0)], "run string, wid string, trusted boolean, unit double")
    schema = "run string, wid string, trusted boolean, eligible boolean, from_url boolean, unit double"
    new = [("r1", "1", True, True, False, 1.0), ("r1", "1", None, None, True, 2.0), ("r1", "1", False, None, None, 3.0), ("r1", "2", False, False, False, 4.0), (None, "1", False, True, None, 9.0)]
    listings = spark.createDataFrame(new, schema)
    want = sorted([("r1", "1", True, 1.0), ("r1", "1", None, 2.0), ("r2", "1", True, 8.0), (None, "1", False, 9.0)], key=repr)
    once = record_observations(old, listings)
    assert rows_of(once) == want == rows_of(record_observations(once, listings))
    assert rows_of(record_observations(old.limit(0), listings.limit(0))) == []


def test_stream_restarts_and_replays(spark, tmp_path):
    folder = LifetimeYield(f"file://{tmp_path}/state")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        q = stream.writeStream.foreachBatch(folder.record).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    batches = [[("a.com", "1", "r1", "success", 2, T(1))], [("a.com", "2", "r1", "success", 1, T(2)), ("b.com", "1", "r1", "blocked", 0, T(2))], [("a.com", "1", "r1", "no_match", 0, T(3)), ("a.com", "2", "r1", "success", 1, T(2))]]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for n, df in enumerate(frames[:2]):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    run()
    frames[2].coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    run()
    after = rows_of(folder.state(spark, 2)[1])
    assert [r[:2] for r in after] == [("a.com", 1), ("b.com", 0)]
    folder.record(frames[2], 2)  # as after a crash before the batch was marked done
    assert rows_of(folder.state(spark, 2)[1]) == after
    try:
        folder.record(frames[2], 7)
        raise AssertionError("a lost batch wasn't seen")
    except ValueError as e:
        assert "after batch 6" in str(e)
