"""Attributes as known at event time, by version numbers.

Every attribute row becomes *available* at one instant.  Per entity, the row that counts at an
instant is the best one (by a caller's ranking) among those available; each time a better row
appears the entity's version goes up by one.  Events and attribute rows are lined up as narrow
(entity, instant) rows, a cumulative count of changes gives each event its version, and one
equi-join on (entity, version) fetches the wide attributes.

The count runs inside (entity, period) groups, with the best row of all earlier periods carried
in, so a hot entity is spread over as many tasks as it has periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attributes_as_known(
    events: DataFrame,
    attributes: DataFrame,
    *,
    event_entity: str,
    event_time: str,
    entity: str,
    available: Column,
    rank: list[Column],
    period_days: int = 7,
) -> DataFrame:
    """Join each event with the best attribute row available at or before its time.

    ``available`` is the instant (timestamp) from which an attribute row may be used and ``rank``
    the ordering of usable rows, most significant first, larger is better; put a unique column last
    for a defined result.  Returned: all event columns, then the attribute columns, those whose
    names clash with an event column prefixed ``attr_``.

    Events with a null entity or time, and events before the first available row, are left out, as
    are attribute rows whose entity, instant or a rank column is null.  Repeated events are kept as
    they are; of attribute rows equal in every rank column one is used.
    """
    seconds = F.lit(period_days * 86400)
    period = lambda c: F.floor(F.unix_micros(c) / 1_000_000 / seconds)
    names = [f"r{i}" for i in range(len(rank))]
    usable = F.col(entity).isNotNull() & available.isNotNull()
    for r in rank:
        usable = usable & r.isNotNull()
    held = attributes.where(usable)
    narrow = held.select(F.col(entity).alias("e"), available.alias("t"), F.struct(*[r.alias(n) for r, n in zip(rank, names)]).alias("s")).withColumn("p", period(F.col("t")))

    # Best row before each period: a small table of one row per entity and period with changes.
    best = narrow.groupBy("e", "p").agg(F.max("s").alias("s"))
    running = Window.partitionBy("e").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    best = best.withColumn("s", F.max("s").over(running)).withColumn("to", F.lead("p").over(Window.partitionBy("e").orderBy("p")))

    wanted = events.where(F.col(event_entity).isNotNull() & F.col(event_time).isNotNull())
    moments = wanted.select(F.col(event_entity).alias("e"), F.col(event_time).alias("t")).distinct().withColumn("p", period(F.col("t")))
    active = moments.select("e", "p").union(narrow.select("e", "p")).distinct()
    # Every period that holds anything gets the best row of the periods before it.
    line = active.select("e", "p", F.lit(None).cast(best.schema["s"].dataType).alias("s")).union(best.select("e", F.col("p") + 1, "s"))
    line = line.groupBy("e", "p").agg(F.max("s").alias("s"))
    carried = line.withColumn("s", F.max("s").over(running)).where("s is not null").select("e", "p", F.lit(None).cast("timestamp").alias("t"), "s", F.lit(0).alias("kind"))

    rows = carried.union(narrow.select("e", "p", "t", "s", F.lit(1))).union(moments.select("e", "p", "t", F.lit(None).cast(best.schema["s"].dataType), F.lit(2)))
    order = Window.partitionBy("e", "p").orderBy(F.col("t").asc_nulls_first(), "kind", F.col("s").asc_nulls_last())
    so_far = F.max("s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("changed", (F.col("kind") < 2) & (so_far.isNull() | (F.col("s") > so_far)))
    rows = rows.withColumn("version", F.sum(F.col("changed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    versions = rows.where("changed").select("e", "p", "version", "s")
    placed = rows.where("kind = 2 and version > 0").select("e", "p", "t", "version")

    known = placed.join(versions, ["e", "p", "version"]).select("e", "t", "s")
    clash = set(events.columns)
    wide = held.select(F.col(entity).alias("__e"), F.struct(*[r.alias(n) for r, n in zip(rank, names)]).alias("__s"), *[F.col(c).alias(f"attr_{c}" if c in clash else c) for c in attributes.columns])
    first = wide.dropDuplicates(["__e", "__s"])
    return (
        wanted.join(known.select(F.col("e").alias(event_entity), F.col("t").alias(event_time), F.col("s").alias("__k")), [event_entity, event_time])
        .join(first, (F.col(event_entity) == F.col("__e")) & (F.col("__k") == F.col("__s")))
        .select(*[wanted[c] for c in events.columns], *[c for c in first.columns if c not in ("__e", "__s")])
    )
