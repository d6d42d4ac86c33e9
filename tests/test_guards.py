"""Guards: they pass clean frames on and name the row that breaks the rule."""

import datetime as dt

import pytest

from tidemark.operators import guards as G

D = dt.date


def test_point_in_time(spark):
    ok = spark.createDataFrame([(D(2025, 1, 1), D(2025, 1, 2)), (None, D(2025, 1, 2))], "asof date, pub date")
    assert G.known_before(ok, context="asof", event="pub") is ok
    with pytest.raises(G.PointInTimeViolation):
        G.known_before(ok.union(spark.createDataFrame([(D(2025, 1, 2), D(2025, 1, 2))], ok.schema)), context="asof", event="pub")
    assert G.known_before(ok.limit(0), context="asof", event="pub").count() == 0


def test_confirmation(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 9, 30, 12),)], "t timestamp")
    assert G.no_confirmation(df, time="t", begins="2025-10-01").count() == 1
    with pytest.raises(G.ConfirmationLeakError):
        G.no_confirmation(df, time="t", begins="2025-09-30")


def test_baseline(spark):
    rows = [("a", D(2025, 1, k), k < 4) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "event string, day date, estimation boolean")
    assert G.baseline_before_event(df, by=["event"], day="day", estimation="estimation").count() == 6
    with pytest.raises(G.BaselineLeakageError):
        G.baseline_before_event(df.union(spark.createDataFrame([("a", D(2025, 1, 5), True)], df.schema)), by=["event"], day="day", estimation="estimation")


def test_unique_and_complete(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 3.0), ("b", None, 1.0)], "k string, x double, y double")
    with pytest.raises(G.DataQualityError):
        G.unique_rows(df, ["k"])
    assert G.unique_rows(df, ["k", "x"]).count() == 3
    got = {r.k: (r.n_rows, r.kept, r.dropped) for r in G.complete_rows(df, ["x", "y"], ["k"]).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 1)}
    assert all(issubclass(e, G.GuardError) for e in (G.MissingEmbeddingError, G.DataQualityError))
