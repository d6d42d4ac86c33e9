"""Problems 1 to 3 on small frames: brute force, edge cases, invariances."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.readings import ReadingLimits, implausible_readings
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.versions import attributes_as_known

DAY = dt.date(2025, 1, 1)
SERIES = "id long, src string, day date, v double, reason_extra string"


def series(values, src="a", start=0):
    return [(i + start, src, DAY + dt.timedelta(days=i), v, "x") for i, v in enumerate(values)]


def flagged(spark, rows, **kw):
    df = spark.createDataFrame(rows, SERIES)
    out = implausible_readings(df, source="src", position="day", value="v", **kw)
    return {(r.id, r.reason) for r in out.collect()}


def noise(n, seed=1, level=100.0, sd=0.01):
    r = random.Random(seed)
    return [level * (1 + r.gauss(0, sd)) for _ in range(n)]


def test_spike_step_and_impossible(spark):
    v = noise(120)
    v[40] = 1000.0
    v[60] = -5.0
    v[70] = None
    v[80] = float("nan")
    v[90:] = [x * 2 for x in v[90:]]  # a lasting move
    assert flagged(spark, series(v)) == {(40, "spike"), (60, "impossible"), (80, "impossible")}


def test_each_source_by_its_own_behaviour(spark):
    calm, wild = noise(100, 2, sd=0.002), noise(100, 3, sd=0.2)
    calm[50] = calm[50] * 1.2
    wild[50] = wild[50] * 1.2
    assert flagged(spark, series(calm, "calm") + series(wild, "wild", 1000)) == {(50, "spike")}


def test_copies_of_a_wrong_reading_and_a_right_revision(spark):
    v = noise(60)
    rows = series(v)
    day = DAY + dt.timedelta(days=30)
    rows += [(900, "a", day, 5000.0, "x"), (901, "a", day, 5000.0, "x")]
    assert flagged(spark, rows) == {(900, "spike"), (901, "spike")}


def test_stuck_after_the_first_and_not_while_inactive(spark):
    v = noise(100)
    v[30:42] = [v[30]] * 12
    got = flagged(spark, series(v))
    assert got == {(i, "stuck") for i in range(31, 42)}
    idle = F.col("id").between(30, 41)
    assert flagged(spark, series(v), active=~idle) == set()


def test_stuck_run_across_blocks(spark):
    v = noise(100)
    v[10:80] = [v[10]] * 70
    limits = ReadingLimits(block_days=30, halo_days=20)
    assert flagged(spark, series(v), limits=limits) == {(i, "stuck") for i in range(11, 80)}


def test_readings_empty_and_null_keys(spark):
    assert flagged(spark, []) == set()
    assert flagged(spark, [(1, None, DAY, 1.0, ""), (2, "a", None, 1.0, ""), (3, "a", DAY, None, "")]) == set()


EVENTS = "id long, e string, ts timestamp, close double"
ATTRS = "pid long, e string, day date, loaded timestamp, close double"


def known(spark, events, attrs, period=7):
    a = spark.createDataFrame(attrs, ATTRS)
    out = attributes_as_known(
        spark.createDataFrame(events, EVENTS), a, event_entity="e", event_time="ts", entity="e",
        available=F.greatest(F.col("loaded"), F.date_add("day", 1).cast("timestamp")), rank=[F.col("day"), F.col("loaded"), -F.col("pid")], period_days=period,
    )
    assert "attr_close" in out.columns and "close" in out.columns
    return sorted((r.id, r.pid) for r in out.collect())


@pytest.mark.parametrize("period", [1, 7, 400])
def test_versions_match_brute_force(spark, period):
    r = random.Random(period)
    t = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(hours=r.randrange(24 * 60))
    attrs = [(i, r.choice("ab"), DAY + dt.timedelta(days=r.randrange(50)), t(), 1.0 * i) for i in range(120)] + [(500, None, DAY, t(), 1.0), (501, "a", None, t(), 1.0)]
    events = [(i, r.choice(["a", "b", "c", None]), t(), 0.0) for i in range(150)] + [(999, "a", None, 0.0)]
    want = []
    for i, e, ts, _ in events:
        if e is None or ts is None:
            continue
        ok = [a for a in attrs if a[1] == e and a[2] is not None and max(a[3], dt.datetime.combine(a[2] + dt.timedelta(days=1), dt.time())) <= ts]
        if ok:
            want.append((i, max(ok, key=lambda a: (a[2], a[3], -a[0]))[0]))
    assert known(spark, events, attrs, period) == sorted(want)


def test_versions_edges(spark):
    now = dt.datetime(2025, 3, 1)
    assert known(spark, [], [(1, "a", DAY, now, 1.0)]) == []
    assert known(spark, [(1, "a", now, 0.0)], []) == []
    twice = [(1, "a", now, 0.0), (1, "a", now, 0.0)]
    assert known(spark, twice, [(7, "a", DAY, now, 1.0), (7, "a", DAY, now, 1.0)]) == [(1, 7), (1, 7)]


def test_future_rows_change_nothing(spark):
    now = dt.datetime(2025, 2, 1)
    attrs = [(1, "a", DAY, now - dt.timedelta(days=3), 1.0)]
    later = [(2, "a", DAY + dt.timedelta(days=1), now + dt.timedelta(seconds=1), 2.0)]
    assert known(spark, [(5, "a", now, 0.0)], attrs) == known(spark, [(5, "a", now, 0.0)], attrs + later) == [(5, 1)]


@pytest.mark.parametrize("windows", [(1,), (7, 30), (5, 16)])
def test_rolling_matches_brute_force(spark, windows):
    r = random.Random(3)
    rows = [(r.choice("ab"), DAY + dt.timedelta(days=r.randrange(80)), r.choice([None, 1.0, 2.5, 4.0])) for _ in range(90)] + [(None, DAY, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "e string, d date, v double")
    got = {(x.e, x.d): x for x in rolling_totals(df, entity="e", day="d", measures={"v": F.col("v")}, windows=windows).collect()}
    for e in "ab":
        days = [x[1] for x in rows if x[0] == e and x[1]]
        span = [min(days) + dt.timedelta(days=i) for i in range((max(days) - min(days)).days + 1)]
        assert {k[1] for k in got if k[0] == e} == set(span)
        for d in span:
            for w in windows:
                v = [x[2] for x in rows if x[0] == e and x[1] and 0 <= (d - x[1]).days < w and x[2] is not None]
                assert got[e, d][f"v_sum_{w}"] == pytest.approx(sum(v)) and got[e, d][f"v_n_{w}"] == len(v)


def test_rolling_empty(spark):
    df = spark.createDataFrame([], "e string, d date, v double")
    assert rolling_totals(df, entity="e", day="d", measures={"v": F.col("v")}).count() == 0


def test_haar_details_add_up_and_wrong_days_in_a_row_are_both_found(spark):
    import numpy as np

    from tidemark.operators.readings import LEVELS, haar_details

    x = np.array(noise(40) + noise(25, 2, 7.0))
    start = np.array([0] * 40 + [40] * 25)
    details, a = haar_details(x, start, LEVELS)
    assert np.allclose(a + details.sum(axis=0), x)
    assert np.allclose(a[3:40], [x[i - 3 : i + 1].mean() for i in range(3, 40)]) and np.allclose(details[0][1:40], np.diff(x[:40]) / 2)
    v = noise(80)
    v[30], v[31], v[50] = 900.0, 870.0, 4.0
    assert flagged(spark, series(v)) == {(30, "spike"), (31, "spike"), (50, "spike")}


def test_readings_over_batch_borders(spark):
    """Many sources in one partition: the series that a batch of readings parts is judged whole."""
    rows = []
    for k in range(40):
        v = noise(90, k)
        v[45] *= 3
        rows += series(v, f"s{k}", 1000 * k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert flagged(spark, rows) == {(1000 * k + 45, "spike") for k in range(40)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
