"""Readers and idempotent writers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV list with header and declared types; fails when a required column holds a null."""
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return df


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a JSON document {version, items: [...]}."""
    return spark.read.schema(f"version string, items array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("items").alias("i")).select("i.*")


def insert_if_absent(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks, one per key; null keys never match, so such rows all stay."""
    keyed = new.dropna(subset=keys).dropDuplicates(keys)
    fresh = keyed.join(old.select(*keys).dropna(), keys, "left_anti") if old is not None else keyed
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull()
    return fresh.unionByName(new.where(blank))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both with the row of the highest ``order`` per key; of ties one of the new rows."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return rows.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__new")


def write_by_ticker(df: DataFrame, path: str) -> None:
    """Replace only the ticker partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path)


def strict_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON objects, NaN and infinite values as null."""
    cols = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))
