"""Invariants of the reference operators: truncation, splits, models, streaming, writers."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import scoring as C
from tidemark.operators import series as S
from tidemark.operators.calendars import as_of, day_map, price_panel, session_t0, union_calendar
from tidemark.operators.splits import SplitConfig, walk_forward
from tidemark.sources.files import insert_if_absent, insert_or_replace, strict_json
from tidemark.streaming.poll import article_stream, poll

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(n=80, ticker="A", seed=1):
    r, c, out, d = random.Random(seed), 100.0, [], dt.date(2025, 1, 6)
    while len(out) < n:
        if d.weekday() < 5:
            c *= 1 + r.gauss(0, 0.02)
            out.append((ticker, d, c, c * 1.01, c * 0.99, c, 1000.0 + r.randrange(500)))
        d += dt.timedelta(days=1)
    return out


FEATURES = {"mom": lambda: S.momentum(5), "vol": lambda: S.trailing_vol("ret", 20), "ma": lambda: S.moving_average_distance(20), "vz": lambda: S.volume_z(20), "rank": lambda: S.share_at_or_below("close", 30, 10)}


def test_features_do_not_see_the_future(spark):
    rows = bars()
    cut = rows[50][1]
    make = lambda x: {r.date: r for r in S.with_returns(spark.createDataFrame(x, PRICES)).select("date", *[f().alias(n) for n, f in FEATURES.items()]).collect() if r.date <= cut}
    assert make(rows) == make(rows[:51])


def test_short_windows_are_null_and_flat_volume_is_zero(spark):
    rows = [(*r[:6], 5.0) for r in bars(25)]
    out = S.with_returns(spark.createDataFrame(rows, PRICES)).orderBy("date").select(S.trailing_vol("ret", 20).alias("v"), S.volume_z(20).alias("z"), S.forward_compound("ret", 3).alias("f")).collect()
    assert out[19].v is None and out[20].v is not None
    assert out[18].z is None and out[19].z == 0.0
    assert out[21].f is not None and out[22].f is None


def test_panel_takes_the_latest_revision(spark):
    t = dt.datetime(2025, 1, 7)
    rows = [(1, "A", t.date(), 1.0, 1.0, 1.0, 1.0, -5.0, t), (2, "A", t.date(), 1.0, 1.0, 1.0, 2.0, 3.0, t + dt.timedelta(1)), (3, "A", t.date(), 1.0, 1.0, 1.0, None, 3.0, t + dt.timedelta(2))]
    df = spark.createDataFrame(rows, "price_id long, ticker string, date date, open double, high double, low double, close double, volume double, loaded_at timestamp")
    assert [(r.close, r.volume) for r in price_panel(df).collect()] == [(2.0, 3.0)]


def test_session_rule(spark):
    p = spark.createDataFrame(bars(10), PRICES)
    at = lambda h, m: dt.datetime(2025, 1, 8, h, m)  # noqa: E731  a Wednesday, New York is five hours behind
    ev = spark.createDataFrame([(1, "A", at(14, 29)), (2, "A", at(14, 30)), (3, "A", dt.datetime(2025, 1, 11, 12, 0)), (4, "Z", at(15, 0)), (5, "A", None)], "id long, ticker string, ts timestamp")
    got = {r.id: r.t0 for r in session_t0(ev, p, time="ts").collect()}
    assert got == {1: dt.date(2025, 1, 7), 2: dt.date(2025, 1, 8), 3: dt.date(2025, 1, 10), 4: None, 5: None}


def test_as_of_directions(spark):
    p = spark.createDataFrame(bars(10), PRICES)
    ev = spark.createDataFrame([("A", dt.date(2025, 1, 11))], "ticker string, d date")
    find = lambda how: as_of(ev, p, day=F.col("d"), how=how).first().asof_day
    assert [find(h) for h in ("before", "at_or_before", "at_or_after", "after")] == [dt.date(2025, 1, 10)] * 2 + [dt.date(2025, 1, 13)] * 2
    assert day_map(p).where("ticker = 'A'").count() == 40 + 12 + 40


def test_walk_forward_invariants(spark):
    r = random.Random(5)
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    rows = [(i, d, d + dt.timedelta(days=5)) for i, d in enumerate(sorted(r.choice(days) for _ in range(600)))]
    df = spark.createDataFrame(rows, "id long, t0 date, t1 date")
    cal = union_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    got = walk_forward(df, cal, SplitConfig(4, 3), id="id").collect()
    at = {i: (a, b) for i, a, b in rows}
    for k in range(1, 5):
        role = {n: {x.id for x in got if x.fold == k and x.role == n} for n in ("train", "test", "purged", "embargoed")}
        start = min(at[i][0] for i in role["test"])
        assert all(at[i][1] < start for i in role["train"]) and all(at[i][0] < start <= at[i][1] for i in role["purged"])
        assert sum(map(len, role.values())) == len(set().union(*role.values())) == len([1 for i in at if at[i][0] < start or i in role["test"]])
    tests = [x.id for x in got if x.role == "test"]
    assert len(tests) == len(set(tests))


def test_ridge_equals_normal_equations(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = 3 * x[:, 0] - x[:, 1] + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    beta, icept = M.ridge(df, ["a", "b"], "y", alpha=1e-9)
    assert beta == pytest.approx([3, -1], abs=1e-6) and icept == pytest.approx(0.5, abs=1e-6)


def test_garch_finds_clustered_variance():
    r, s, out = np.random.default_rng(1), 1e-4, []
    for _ in range(1500):
        x = r.normal() * np.sqrt(s)
        out.append(x)
        s = 5e-6 + 0.15 * x * x + 0.8 * s
    p = M.garch_fit(np.array(out))
    assert 0.05 < p[1] < 0.3 and 0.6 < p[2] < 0.95
    assert M.garch_fit(np.zeros(300)) is None


def test_confidence_set_drops_the_bad_model():
    import pandas as pd

    r = np.random.default_rng(0)
    base = r.random(300)
    assert M.model_confidence_set(pd.DataFrame({"good": base, "same": base + r.normal(0, 0.01, 300), "bad": base + 1}), draws=200) == ["good", "same"]
    with pytest.raises(ValueError):
        M.model_confidence_set(pd.DataFrame({"a": [1.0, None]}))


def test_ranking_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    m = C.ranking_metrics(df, "p", "y").first()
    assert m.roc_auc == pytest.approx((1 + 1 + 0.5 + 1) / 4) and m.pr_auc == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_writers(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, t int, v double")
    old, new = df([("a", 1, 1.0), ("b", 5, 2.0)]), df([("a", 2, 3.0), ("b", 4, 4.0), ("c", 1, 5.0), ("c", 1, 5.0), (None, 1, 6.0)])
    assert sorted(r.v for r in insert_if_absent(new, old, ["k"]).collect()) == [5.0, 6.0]
    assert {r.k: r.v for r in insert_or_replace(old, new.where("k is not null"), ["k"], "t").collect()} == {"a": 3.0, "b": 2.0, "c": 5.0}
    assert strict_json(df([("a", None, float("nan"))])).first().json == '{"k":"a","t":null,"v":null}'


def test_poll_is_idempotent_and_drops_late_rows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 12)
    schema = "url string, published_at timestamp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", t), ("b", t + dt.timedelta(minutes=1)), ("a", t), (None, t)])
    stream = lambda: article_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    run = lambda: poll(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    write([("a", t), ("c", t + dt.timedelta(hours=2))])
    run()
    write([("late", t - dt.timedelta(hours=3)), ("d", t + dt.timedelta(hours=3))])
    run()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d"]
