"""Purged and embargoed walk-forward splits of records with label intervals [t0, t1]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitConfig:
    """folds: test blocks after a first training block; embargo_days: trading days (union calendar) left out after a test block of an earlier fold;
    expanding: train on everything before, else on the block before only."""

    folds: int = 5
    embargo_days: int = 5
    expanding: bool = True


def fold_bounds(df: DataFrame, cfg: SplitConfig, t0: str = "t0") -> DataFrame:
    """First and last t0 of each test block; cuts fall at equal counts of records, moved on to the next t0.

    Cuts come from one count per distinct t0, a table as small as the calendar.
    """
    per = df.groupBy(F.col(t0).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    line = Window.orderBy("d")
    per = per.select("d", (F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    k = F.explode(F.sequence(F.lit(1), F.lit(cfg.folds))).alias("fold")
    # The block k starts at the first t0 with at least round(total * k / (folds + 1)) records before it.
    starts = per.select("d", "before", "total", k).where(F.col("before") >= F.bround(F.col("total") * F.col("fold") / (cfg.folds + 1))).groupBy("fold").agg(F.min("d").alias("test_start"))
    last = per.agg(F.max("d").alias("end"))
    nxt = F.lead("test_start").over(Window.orderBy("fold"))
    return starts.withColumn("next_start", nxt).crossJoin(last)  # folds by one row


def walk_forward(df: DataFrame, calendar: DataFrame, cfg: SplitConfig = SplitConfig(), *, id: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Rows (``id``, ``fold``, ``role``) with role train, test, purged or embargoed.

    A training record is purged when its label reaches the test block (t1 at or after its start), and embargoed when its t0
    lies within ``embargo_days`` trading days after the end of an earlier fold's test block.  ``calendar`` has ``date`` and ``pos``.
    Records with a null t0 or t1 are left out.  The fold table has one row per fold and is broadcast.
    """
    df = df.where(F.col(t0).isNotNull() & F.col(t1).isNotNull())
    bounds = fold_bounds(df, cfg, t0)
    days = calendar.select(F.col("date").alias("last"), F.col("pos").alias("p"))
    # Last t0 before the next block starts, and the end of its embargo.
    ends = bounds.join(df.select(F.col(t0).alias("d")).distinct(), (F.col("next_start").isNull() | (F.col("d") < F.col("next_start"))) & (F.col("d") >= F.col("test_start"))).groupBy("fold", "test_start", "next_start").agg(F.max("d").alias("test_end"))
    at = calendar.select(F.col("date").alias("cd"), F.col("pos").alias("cp"))
    ends = ends.join(at, F.col("cd") == F.col("test_end"), "left").drop("cd")
    ends = ends.join(days, F.col("p") == F.col("cp") + cfg.embargo_days, "left").select("fold", "test_start", "next_start", "test_end", F.coalesce("last", F.lit("9999-12-31").cast("date")).alias("embargo_end"))
    earlier = ends.select(F.col("fold").alias("f"), F.struct("test_end", "embargo_end").alias("e"))
    folds = ends.join(earlier, F.col("f") < F.col("fold"), "left").groupBy("fold", "test_start", "next_start", "test_end").agg(F.collect_list("e").alias("bans"))
    first = F.lag("test_start").over(Window.orderBy("fold"))
    folds = folds.withColumn("train_start", F.lit(None).cast("date") if cfg.expanding else first)
    x = df.select(id, t0, t1).crossJoin(F.broadcast(folds))  # one row per fold
    test = (F.col(t0) >= F.col("test_start")) & (F.col("next_start").isNull() | (F.col(t0) < F.col("next_start")))
    before = (F.col(t0) < F.col("test_start")) & (F.col("train_start").isNull() | (F.col(t0) >= F.col("train_start")))
    banned = F.exists("bans", lambda e: (F.col(t0) > e["test_end"]) & (F.col(t0) <= e["embargo_end"]))
    role = F.when(test, "test").when(before & (F.col(t1) >= F.col("test_start")), "purged").when(before & banned, "embargoed").when(before, "train")
    return x.select(id, "fold", role.alias("role")).where("role is not null")
