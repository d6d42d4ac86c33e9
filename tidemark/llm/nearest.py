"""Matching records by nearest time within a tolerance.

Both tables are hash-partitioned by (entity, block of time); right rows near a block's edge are
copied to the next block, so every block is self-contained.  A block that holds too many rows is cut
into shorter ones in the same way.  Each Arrow group is handed to DuckDB,
which runs a backward and a forward ASOF join; the nearer candidate in tolerance is kept.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

_SQL = """
WITH b AS (SELECT l.id, r.rid, l.us - r.us AS gap FROM l ASOF JOIN r ON l.g = r.g AND l.us >= r.us),
     f AS (SELECT l.id, r.rid, r.us - l.us AS gap FROM l ASOF JOIN r ON l.g = r.g AND l.us <= r.us)
SELECT coalesce(b.id, f.id) AS id,
       CASE WHEN f.gap IS NULL OR b.gap <= f.gap THEN b.rid ELSE f.rid END AS rid
FROM b FULL JOIN f ON b.id = f.id
WHERE least(coalesce(b.gap, f.gap), coalesce(f.gap, b.gap)) <= {tolerance}
"""


def _match(tolerance: int):
    def run(group: pa.Table) -> pa.Table:
        con = duckdb.connect(config={"threads": "1", "memory_limit": "512MB"})
        try:
            con.register("rows_in", group)
            con.execute("CREATE TEMP TABLE l AS SELECT g, us, id FROM rows_in WHERE left_side")
            con.execute("CREATE TEMP TABLE r AS SELECT g, us, id AS rid FROM rows_in WHERE NOT left_side")
            return con.execute(_SQL.format(tolerance=tolerance)).to_arrow_table().cast(pa.schema([("id", pa.int64()), ("rid", pa.int64())]))
        finally:
            con.close()

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    left_entity: str,
    left_time: str,
    right_id: str,
    right_entity: str,
    right_time: str,
    tolerance_seconds: float,
    block_days: int = 16,
    rows_per_group: int = 200_000,
) -> DataFrame:
    """Pairs (``left_id``, ``right_id``): for each left row the right row of its entity nearest in time.

    Rows at most ``tolerance_seconds`` apart match; of two equally near rows the earlier one wins,
    of several rows at one instant the one with the lowest id.  Left rows without such a row, and
    rows with a null id, entity or time, are left out.  Left ids should be unique.  Empty tables
    give an empty result; further columns of either table play no part, so clashing names are fine.
    """
    tolerance = int(tolerance_seconds * 1_000_000)
    block = block_days * 86_400_000_000
    if tolerance >= block:
        raise ValueError("block_days must be longer than the tolerance")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.select(F.col(left_id).cast("bigint").alias("id"), F.col(left_entity).cast("string").alias("e"), us(left_time).alias("us")).dropna()
    r = (
        right.select(F.col(right_id).cast("bigint").alias("id"), F.col(right_entity).cast("string").alias("e"), us(right_time).alias("us"))
        .dropna()
        .groupBy("e", "us")
        .agg(F.min("id").alias("id"))
    )
    own = F.floor(F.col("us") / block)
    inside = F.col("us") - own * F.lit(block)
    l = l.withColumn("b", own)
    r = r.withColumn("b", F.explode(F.array_compact(F.array(own, F.when(inside <= tolerance, own - 1), F.when(inside >= block - tolerance, own + 1)))))
    # Blocks with too many rows: at most one for every ``rows_per_group`` rows of the tables.
    size = cut(l.select("e", "b").union(r.select("e", "b")).groupBy("e", "b").agg(F.count(F.lit(1)).alias("n")))
    total = size.agg(F.sum("n")).first()[0] or 0
    hot = size.where(F.col("n") > rows_per_group).select("e", "b", F.ceil(F.col("n") / rows_per_group).alias("k"))
    hot = F.broadcast(hot) if total <= 100_000 * rows_per_group else hot
    # Cut into k pieces of equal length; a right row goes to every piece it may be near to.
    at = F.floor((F.col("us") - F.col("b") * F.lit(block)) * F.col("k") / block)
    near = lambda d: F.floor((F.col("us") - F.col("b") * F.lit(block) + F.lit(d)) * F.col("k") / block)
    split = lambda d: d.join(hot, ["e", "b"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    lk = split(l).select("id", "e", "us", "b", at.alias("piece"), F.lit(True).alias("left_side"))
    rk = split(r).select("id", "e", "us", "b", F.explode(F.sequence(F.greatest(F.lit(0), near(-tolerance)), F.least(F.col("k") - 1, near(tolerance)))).alias("piece"), F.lit(False))
    rows = lk.union(rk)
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_group))
    rows = rows.select(F.xxhash64("e", "b", "piece").alias("g"), "us", "id", "left_side").withColumn("part", F.pmod("g", F.lit(parts)))
    out = rows.groupBy("part").applyInArrow(_match(tolerance), "id bigint, rid bigint")
    return out.select(F.col("id").alias(left_id), F.col("rid").alias(right_id))
