"""Rolling totals over trailing calendar periods by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_totals(df: DataFrame, *, entity: str, day: str, measures: dict[str, Column], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals of ``measures`` over each trailing window, for every entity and calendar day.

    The days of an entity run from its first to its last row; days without rows are filled in.
    Result: ``entity``, ``day`` and, for each measure m and window w, ``m_sum_w`` and ``m_n_w`` (the
    number of non-null values; the sum is 0.0 where it is 0).  Windows reaching back before the
    first day hold what there is.  Rows with a null entity or day are ignored, repeated rows each
    count, and an empty input gives an empty result.

    Rows are first added up per entity and day (map-side), so a window function only ever sees the
    calendar of an entity, however many rows it has.  Sums of 1, 2, 4, ... days come from adding a
    block to the block just before it; a window is the chain of blocks of its binary digits.
    """
    widest = max(windows)
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__d"))
        .agg(*[x for m, c in measures.items() for x in (F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"s_{m}"), F.count(c).alias(f"n_{m}"))])
    )
    span = daily.groupBy("__e").agg(F.min("__d").alias("lo"), F.max("__d").alias("hi"))
    calendar = span.select("__e", F.explode(F.sequence("lo", "hi")).alias("__d"))
    parts = [f"{k}_{m}" for m in measures for k in ("s", "n")]
    line = Window.partitionBy("__e").orderBy("__d")
    out = calendar.join(daily, ["__e", "__d"], "left").select("__e", "__d", *[F.coalesce(F.col(p), F.lit(0)).alias(f"{p}_1") for p in parts])
    size = 1
    while size * 2 <= widest:
        out = out.withColumns({f"{p}_{2 * size}": F.col(f"{p}_{size}") + F.coalesce(F.lag(f"{p}_{size}", size).over(line), F.lit(0)) for p in parts})
        size *= 2
    result = [F.col("__e").alias(entity), F.col("__d").alias(day)]
    for m in measures:
        for w in windows:
            for k, name in (("s", "sum"), ("n", "n")):
                total, back, block = None, 0, size
                while block:
                    if w & block:
                        piece = F.coalesce(F.lag(f"{k}_{m}_{block}", back).over(line), F.lit(0)) if back else F.col(f"{k}_{m}_{block}")
                        total = piece if total is None else total + piece
                        back += block
                    block //= 2
                result.append(total.alias(f"{m}_{name}_{w}"))
    return out.select(*result)
