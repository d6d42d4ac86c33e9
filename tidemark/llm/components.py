"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every id of ``edges`` with the least id it is connected to: columns ``id``, ``first``.

    Alternates large-star and small-star steps until the edges stop changing; each round is cut
    by a checkpoint, nothing is brought to the driver but a count and two checksums of 64 and of 32 bits.  Edges with a null end and
    loops are ignored; an empty list gives an empty result.
    """
    links = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x != y").distinct()
        links = cut(small)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.hash("x", "y").cast("long"))).first()
        if now == seen:
            return links.select(F.col("x").alias("id"), F.col("y").alias("first")).union(links.select(F.col("y"), F.col("y")).distinct())
        seen = now
