"""Implausible readings in measurement series, judged per source.

Each source's series goes through an undecimated Haar decomposition of several levels.  From its
details follow, for every level, how far a reading stands from the approximation just before it
and from the one just after it.  A lasting move shows on one side only, a spike on both, so the
smaller of the two (when the signs agree) is the spike coefficient of the level; it is measured in
units of the robust scale that the source's details have at this level.  Large spikes are peeled
off the series before its neighbours are judged, so that wrong readings in a row don't hide each
other.  Runs of zero level-1 details reveal stuck values, and bounds catch impossible ones.

Work is split by (source, block of days) with a halo of neighbouring days, so a source that
holds a third of all rows is still spread over many tasks; repeated readings are collapsed
before the shuffle and joined back at the end.  One Python stage decomposes many blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


@dataclass(frozen=True)
class ReadingLimits:
    """Thresholds of :func:`implausible_readings`.

    spike: least spike coefficient in robust scales; floor: least one in log units;
    edge: log units a reading without a level on one side must differ by;
    run: least number of equal readings on consecutive active days that counts as stuck;
    chance: longest expected number of accidental runs per source that is tolerated.
    """

    spike: float = 8.0
    floor: float = 0.05
    edge: float = 1.0
    run: int = 5
    chance: float = 0.05
    block_days: int = 180
    halo_days: int = 60


@dataclass(frozen=True)
class Field:
    """A measurement: its column, the lowest possible value (itself possible if ``lowest_ok``), the days on which
    measuring went on (all unless given), and its thresholds."""

    value: str
    lowest: float = 0.0
    lowest_ok: bool = False
    active: Column | None = None
    limits: ReadingLimits = field(default_factory=ReadingLimits)


LEVELS = 3  # approximations over 1, 2 and 4 readings
_SCORES = "field string, src string, day int, value double, core boolean, one_sided boolean, coef array<float>, noise array<float>, same boolean, run int, first_day int"


def _shift(x: np.ndarray, start: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places before, NaN where that lies before the series' first place ``start``."""
    at = np.arange(len(x)) - by
    return np.where(at >= start, x[np.maximum(at, 0)], np.nan)


def haar_details(x: np.ndarray, start: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Undecimated Haar decomposition of many series laid end to end.

    ``start``: place of the first value of each value's series.  Returns the details of levels 1 to
    ``levels`` - 1 and the last approximation: ``x = approximation + details.sum(axis=0)``.
    A value without one far enough before it keeps its approximation.
    """
    details, a = [], x
    for j in range(levels - 1):
        before = _shift(a, start, 1 << j)
        smooth = np.where(np.isnan(before), a, (a + before) / 2)
        details.append(a - smooth)
        a = smooth
    return np.array(details).reshape(levels - 1, len(x)), a


def _gaps(x: np.ndarray, level: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distance of ``x`` from the approximations of ``level`` that end just before it, one row a level."""
    details, _ = haar_details(level, start, LEVELS)
    # x - a_j(t-1) = (x - level(t-1)) + the details of the levels up to j at t-1
    step = x - _shift(level, start, 1)
    return np.array([step] + [step + sum(_shift(d, start, 1) for d in details[: j + 1]) for j in range(LEVELS - 1)])


def _both_gaps(x: np.ndarray, level: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from what comes before and from what comes after."""
    n = len(x)
    after = _gaps(x[::-1], level[::-1], (n - end)[::-1])[:, ::-1]
    return _gaps(x, level, start), after


def _smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smaller of two distances of one sign, 0 where the signs differ, the other where one is missing."""
    both = np.where(np.sign(left) == np.sign(right), np.sign(left) * np.minimum(np.abs(left), np.abs(right)), 0.0)
    return np.where(np.isnan(left), right, np.where(np.isnan(right), left, both))


def _middle(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each of ``n`` groups (0 where there is none)."""
    ok = ~np.isnan(x)
    x, group = x[ok], group[ok]
    order = np.lexsort((x, group))
    x, first = x[order], np.searchsorted(group[order], np.arange(n + 1))
    size = np.diff(first)
    lo, hi = first[:-1] + (size - 1) // 2, first[:-1] + size // 2
    return np.where(size > 0, (x[np.clip(lo, 0, max(len(x) - 1, 0))] + x[np.clip(hi, 0, max(len(x) - 1, 0))]) / 2, 0.0) if len(x) else np.zeros(n)


def _peeled(rep: np.ndarray, start: np.ndarray, end: np.ndarray, series: np.ndarray, n: int) -> np.ndarray:
    """The series with its outstanding spikes replaced by the level around them, highest ones first."""
    level = rep.copy()
    for _ in range(4):
        left, right = _both_gaps(level, level, start, end)
        scale = np.maximum(1.4826 * _middle(np.abs(left[0]), series, n), 0.01)[series]
        coef = np.abs(_smaller(left[-1], right[-1]))
        most = coef.copy()
        for by in range(1, 4):  # a spike's neighbours wait until it is gone
            most = np.fmax(most, np.fmax(_shift(coef, start, by), _shift(coef[::-1], (len(coef) - end)[::-1], by)[::-1]))
        odd = (coef >= 6 * scale) & (coef >= most) & ~np.isnan(left[-1]) & ~np.isnan(right[-1])
        if not odd.any():
            break
        level[odd] -= (left[-1] + right[-1])[odd] / 2
    return level


def _score(key: np.ndarray, day: np.ndarray, value: np.ndarray, active: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients and zero-detail runs of distinct readings, sorted by series (``key``), day and value."""
    x = np.log(value)
    change = np.concatenate([[True], (key[1:] != key[:-1])])
    series_of_row = np.cumsum(change) - 1
    fresh = change | np.concatenate([[True], day[1:] != day[:-1]])
    slot = np.cumsum(fresh) - 1  # one slot a (series, day)
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(x)) - 1
    series = series_of_row[head]
    n = int(series[-1]) + 1
    first = np.searchsorted(series, np.arange(n + 1))
    start, end = first[:-1][series], first[1:][series]

    # One representative a day: of several readings, the one nearest to the surrounding level.
    rep = (x[(head + last) // 2] + x[(head + last + 1) // 2]) / 2
    if len(head) < len(x):
        for _ in range(2):
            level = _peeled(rep, start, end, series, n)
            left, right = _both_gaps(level, level, start, end)
            around = level - np.where(np.isnan(left[-1]), np.where(np.isnan(right[-1]), 0, right[-1]), np.where(np.isnan(right[-1]), left[-1], (left[-1] + right[-1]) / 2))
            order = np.lexsort((np.abs(x - around[slot]), slot))
            rep = x[order[head]]
    level = _peeled(rep, start, end, series, n)
    steps = np.abs(_gaps(level, level, start))
    # Each reading is judged against what surrounds its day.
    base_left, base_right = _both_gaps(level, level, start, end)
    off = x - level[slot]
    left, right = off + base_left[:, slot], off + base_right[:, slot]
    coef = _smaller(left, right)
    noise = np.full((LEVELS, len(x)), np.nan)
    noise[:, head] = steps

    # Runs of zero level-1 details on consecutive days with trading; a day goes on with a run if any of its readings has the value.
    run, first_day, same = np.ones(len(x), np.int64), day.copy(), np.zeros(len(x), bool)
    rows = np.flatnonzero(active)
    if len(rows):
        trading = np.zeros(len(head), bool)
        trading[slot[rows]] = True
        nth = (np.cumsum(trading) - 1)[slot[rows]]
        order = np.lexsort((nth, value[rows], series_of_row[rows]))
        rows, nth = rows[order], nth[order]
        goes_on = np.concatenate([[False], (series_of_row[rows][1:] == series_of_row[rows][:-1]) & (value[rows][1:] == value[rows][:-1]) & (nth[1:] == nth[:-1] + 1)])
        chain = np.cumsum(~goes_on) - 1
        size = np.bincount(chain)
        run[rows], same[rows] = size[chain], goes_on
        first_day[rows] = day[rows][np.flatnonzero(~goes_on)][chain]
    return {"one_sided": np.isnan(left[0]) | np.isnan(right[0]), "coef": coef, "noise": noise, "same": same, "run": run, "first_day": first_day}


def _arrays(m: np.ndarray) -> pa.Array:
    """Columns of a matrix as one list each."""
    flat = np.ascontiguousarray(m.T, dtype=np.float32).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(m.shape[1] + 1, dtype=np.int32) * len(m)), pa.array(flat, mask=np.isnan(flat)))


def _decompose(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Scores of sorted readings; a series may go on from one batch to the next."""
    held: list[pa.RecordBatch] = []

    def out(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        num = lambda c: t[c].to_numpy()
        s = _score(num("key"), num("day"), num("value"), num("active"))
        cols = [t["field"], t["src"], t["day"], t["value"], t["core"], pa.array(s["one_sided"]), _arrays(s["coef"]), _arrays(s["noise"]), pa.array(s["same"]), pa.array(s["run"].astype(np.int32)), pa.array(s["first_day"].astype(np.int32))]
        made = pa.table(cols, names=["field", "src", "day", "value", "core", "one_sided", "coef", "noise", "same", "run", "first_day"]).filter(t["core"])
        return made.combine_chunks()

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            yield from out(table).to_batches()

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        yield from parts(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if held:
        yield from parts(pa.Table.from_batches(held))


def implausible_fields(df: DataFrame, *, source: str, position: str, fields: list[Field]) -> DataFrame:
    """Return the readings of ``df`` that are implausible for their ``source``: all columns, ``bad_field`` and ``reason``.

    A row comes out once for each of its ``fields`` that is wrong; else as :func:`implausible_readings`.
    """
    day = F.datediff(F.col(position), F.lit("1970-01-01").cast("date"))
    names = {f.value for f in fields}
    if len(names) < len(fields):
        raise ValueError("a column is named twice")
    reading = lambda f: F.struct(F.lit(f.value).alias("field"), F.col(f.value).cast("double").alias("value"), (F.lit(True) if f.active is None else F.coalesce(f.active, F.lit(False))).alias("active"), F.lit(float(f.lowest)).alias("lowest"), F.lit(f.lowest_ok).alias("lowest_ok"))
    keyed = df.where(F.col(source).isNotNull() & F.col(position).isNotNull())
    v = F.col("__r.value")
    impossible = F.isnan(v) | (v < F.col("__r.lowest")) | (v == float("inf")) | (~F.col("__r.lowest_ok") & (v == F.col("__r.lowest")))
    long = keyed.withColumn("__r", F.explode(F.array(*[reading(f) for f in fields]))).where(v.isNotNull()).withColumn("__impossible", impossible)
    readings = (
        long.where((~F.col("__impossible")) & (v != F.col("__r.lowest")))
        .select(F.col("__r.field").alias("field"), F.col(source).cast("string").alias("src"), day.alias("day"), (v - F.col("__r.lowest")).alias("value"), F.col("__r.active").alias("active"))
        .groupBy("field", "src", "day", "value")
        .agg(F.max("active").alias("active"))
    )
    size, halo = fields[0].limits.block_days, fields[0].limits.halo_days
    own = F.floor(F.col("day") / size).cast("int")
    inside = F.pmod(F.col("day"), F.lit(size))
    blocks = F.array_compact(F.array(own, F.when(inside < halo, own - 1), F.when(inside >= size - halo, own + 1)))
    blocked = (
        readings.withColumn("own", own)
        .withColumn("block", F.explode(blocks))
        .select(F.xxhash64("field", "src", "block").alias("key"), "field", "src", "day", "value", "active", (F.col("block") == F.col("own")).alias("core"))
    )
    # Written, as the scales and the verdicts both read it: Python runs once.
    scored = written(blocked.repartition("key").sortWithinPartitions("key", "src", "field", "day", "value").mapInArrow(_decompose, _SCORES))
    limit = lambda what: F.element_at(F.create_map(*[F.lit(y) for f in fields for y in (f.value, float(getattr(f.limits, what)))]), F.col("field"))
    scale = scored.groupBy("field", "src").agg(
        F.array(*[F.percentile_approx(F.col("noise")[j], 0.5, 1000) * 1.4826 for j in range(LEVELS)]).alias("scale"),
        F.avg(F.when(F.col("run") < limit("run"), F.col("same").cast("double"))).alias("p_same"),
        F.count(F.lit(1)).alias("n_read"),
    )
    judged = scored.join(scale, ["field", "src"])
    # A spike stands out at the coarsest level, and by the scale of the level's details.
    height, unit = F.abs(F.element_at("coef", -1)), F.element_at("scale", -1)
    spike = height >= F.greatest(F.when(F.col("one_sided"), limit("edge")).otherwise(limit("floor")), limit("spike") * F.coalesce(unit, F.lit(0.0)))
    # Expected number of accidental runs this long, were equal neighbours independent.
    by_chance = F.col("n_read") * F.pow(F.coalesce("p_same", F.lit(0.0)), F.col("run") - 1)
    stuck = (F.col("run") >= limit("run")) & (by_chance < limit("chance")) & (F.col("day") > F.col("first_day"))
    wrong = judged.select("field", "src", "day", "value", F.when(stuck, F.lit("stuck")).when(spike, F.lit("spike")).alias("why")).where("why is not null")
    out = lambda d, why: d.select(*df.columns, F.col("__r.field").alias("bad_field"), why.alias("reason"))
    tagged = long.where(~F.col("__impossible")).withColumns({"__f": F.col("__r.field"), "__s": F.col(source).cast("string"), "__d": day, "__v": v - F.col("__r.lowest")})
    hit = tagged.join(wrong.select(F.col("field").alias("__f"), F.col("src").alias("__s"), F.col("day").alias("__d"), F.col("value").alias("__v"), "why"), ["__f", "__s", "__d", "__v"])
    return out(long.where("__impossible"), F.lit("impossible")).unionByName(out(hit, F.col("why")))


def implausible_readings(
    df: DataFrame,
    *,
    source: str,
    position: str,
    value: str,
    lowest: float = 0.0,
    lowest_ok: bool = False,
    active: Column | None = None,
    limits: ReadingLimits = ReadingLimits(),
) -> DataFrame:
    """Return the rows of ``df`` whose ``value`` is implausible for its ``source``, with a ``reason``.

    ``reason`` is ``impossible`` (below ``lowest``, or equal to it unless ``lowest_ok``; NaN and
    infinite values too), ``spike`` or ``stuck``.  Every stored row is judged on its own value, so
    copies of a wrong reading are all returned.  Rows with a null source, position or value are
    never returned; rows equal to ``lowest`` while ``lowest_ok`` are no readings at all.  ``active``
    tells days on which measuring went on; other days neither lengthen nor end a stuck run.
    An empty input gives an empty result; further columns are passed through untouched.
    """
    return implausible_fields(df, source=source, position=position, fields=[Field(value, lowest, lowest_ok, active, limits)]).drop("bad_field")
