import datetime as dt
import random

import pytest

from larkspur.operators.history import EPSILON
from larkspur.streaming import offers

SCHEMA = "offer_id string, ts timestamp, unit double, in_stock boolean"
DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(offers.STORE)
    spark.conf.set(offers.STORE, offers.PROVIDER)
    yield spark
    spark.conf.set(offers.STORE, old)


def run(spark, folder, batches, **options):
    """Adds each list of rows as a file, then runs the stream until it has read them; all events so far."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")
    q = offers.offer_changes(stream, **options).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted((r["offer_id"], r["ts"], r["unit"], r["event"], r["since"]) for r in spark.read.parquet(f"file://{folder}/out").collect())


def brute(rows, until, retention):
    """Events of all rows up to a time, in whole milliseconds as watermarks are, offer by offer in the order of times."""
    out, until = [], until.replace(microsecond=until.microsecond // 1000 * 1000)
    for offer in {r[0] for r in rows}:
        times = {}
        for _, ts, unit, stock in (r for r in rows if r[0] == offer and r[2] is not None and r[1] is not None):
            if ts not in times or unit < times[ts][0]:
                times[ts] = (unit, stock)
        held = None
        for ts in sorted(t for t in times if t <= until):
            unit, stock = times[ts]
            if held and ts >= held[3] + retention * DAY:
                out.append((offer, held[3], held[0], "forgotten", held[1]))
                held = None
            if held is None:
                event, since = "new offer", ts
            elif abs(unit - held[0]) < EPSILON:
                event, since = "unchanged", held[1]
            else:
                event, since = "price drop" if unit < held[0] else "price increase", ts
            if held and held[2] is False and stock is not False:
                event += "; back in stock"
            held = (unit, since, stock, ts)
            out.append((offer, ts, unit, event, since))
        if held and held[3] + retention * DAY <= until:
            out.append((offer, held[3], held[0], "forgotten", held[1]))
    return sorted(out)


def test_rows_out_of_order_replays_restart(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(f"o{rng.randrange(4)}", START + rng.randrange(40) * DAY / 8 + dt.timedelta(microseconds=rng.randrange(3)), float(rng.randrange(5, 9)), rng.choice([True, False, None])) for _ in range(160)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [("o1", START, None, True), ("o1", None, 3.0, True), (None, START, 3.0, True)]
    order = sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[1] + rng.random() * DAY) + rows[-2:]  # each row at most a day late
    cut = len(order) // 2
    first = run(rocks, tmp_path, [order[: cut // 2], order[cut // 2 : cut]])
    seen = order[:cut]
    newest = max(r[1] for r in seen if r[1])
    assert first == brute([r for r in seen if r[0]], newest - 2 * DAY, 180)
    # Restarted from its checkpoint: the rest, replays of what was answered, and a row of another offer that moves the watermark.
    replays = [r for r in seen if r[1] and r[1] <= newest - 2 * DAY][:20]
    end = START + 30 * DAY
    got = run(rocks, tmp_path, [order[cut:] + replays, [("tick", end, 1.0, True)]])
    assert got == brute([r for r in order if r[0]], end - 2 * DAY, 180)


def test_late_rows_and_expiry(rocks, tmp_path):
    known = rocks.createDataFrame([("k", START - DAY, 9.0, START - 3 * DAY, False), ("idle", START - 5 * DAY, 2.0, START - 6 * DAY, True)], "offer_id string, ts timestamp, unit double, since timestamp, in_stock boolean")
    day = lambda n: START + n * DAY
    first = [[("a", day(0), 5.0, True), ("k", day(0), 9.0, True), ("k", day(-2), 1.0, True)], [("tick", day(6), 1.0, True)]]
    got = run(rocks, tmp_path, first, retention_days=10, known=known)
    assert got == [("a", day(0), 5.0, "new offer", day(0)), ("k", day(0), 9.0, "unchanged; back in stock", day(-3))]
    # a row later than two days is dropped; then the clock passes the retention of all but the last
    got = run(rocks, tmp_path, [[("a", day(3), 4.0, True)], [("tick", day(30), 1.0, True)], [("tick", day(33), 1.0, True)], [("a", day(32), 7.0, True)], [("tick", day(36), 2.0, True)]], retention_days=10, known=known)
    assert [g for g in got if g[0] in ("idle", "k")] == [("idle", day(-5), 2.0, "forgotten", day(-6)), ("k", day(0), 9.0, "forgotten", day(-3)), ("k", day(0), 9.0, "unchanged; back in stock", day(-3))]
    assert [g[1:4] for g in got if g[0] == "a"] == [(day(0), 5.0, "forgotten"), (day(0), 5.0, "new offer"), (day(32), 7.0, "new offer")]
    assert ("tick", day(6), 1.0, "forgotten", day(6)) in got or ("tick", day(30), 1.0, "unchanged", day(6)) in got


def test_gaps_longer_than_the_retention(rocks, tmp_path):
    rng = random.Random(8)
    rows = list({(r[0], r[1]): r for r in ((f"o{rng.randrange(3)}", START + rng.randrange(200) * DAY / 4, float(rng.randrange(3)), True) for _ in range(40))}.values())
    order = sorted(rows, key=lambda r: r[1] + rng.random() * DAY)
    end = START + 90 * DAY
    got = run(rocks, tmp_path, [order, [("tick", end, 1.0, True)]], retention_days=3)  # all rows wait together, whatever lies between them
    want = brute(order, end - 2 * DAY, 3)
    assert got == want and sum(w[3] == "forgotten" for w in want) > 10


def test_needs_its_store(spark):
    with pytest.raises(ValueError, match="providerClass"):
        offers.offer_changes(spark.createDataFrame([], SCHEMA))
