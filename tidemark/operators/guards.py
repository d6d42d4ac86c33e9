"""Guards that stop a plan whose inputs could leak the future, and the errors they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A guard found rows that must not exist."""


class DataQualityError(GuardError):
    """Rows break a quality rule."""


class ConfirmationLeakError(GuardError):
    """Rows of the confirmation period where none may be."""


class PointInTimeViolation(GuardError):
    """A value is used before it was known."""


class BaselineLeakageError(GuardError):
    """An estimation window reaches into its event window."""


class MissingEmbeddingError(GuardError):
    """A text has no vector."""


def forbid(df: DataFrame, wrong: Column, error: type[GuardError], message: str) -> DataFrame:
    """``df`` itself; raises ``error`` if any row is ``wrong`` (null is not).  Only one row is looked for."""
    hit = df.where(F.coalesce(wrong, F.lit(False))).limit(1).collect()
    if hit:
        raise error(f"{message}: {hit[0].asDict()}")
    return df


def known_before(df: DataFrame, *, context: str, event: str) -> DataFrame:
    """Every context day must lie before its event's day."""
    return forbid(df, F.to_date(context) >= F.to_date(event), PointInTimeViolation, f"{context} is not before {event}")


def no_confirmation(df: DataFrame, *, time: str, begins: str) -> DataFrame:
    """No row may lie in the confirmation period."""
    return forbid(df, F.col(time) >= F.lit(begins).cast("timestamp"), ConfirmationLeakError, f"{time} lies in the confirmation period")


def baseline_before_event(df: DataFrame, *, by: list[str], day: str, estimation: str) -> DataFrame:
    """In each group the last day of estimation must lie before the first day of the event; returns ``df``."""
    edges = df.groupBy(*by).agg(F.max(F.when(F.col(estimation), F.col(day))).alias("baseline_end"), F.min(F.when(~F.col(estimation), F.col(day))).alias("event_start"))
    forbid(edges, F.col("baseline_end") >= F.col("event_start"), BaselineLeakageError, "estimation reaches into the event")
    return df


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """No two rows may share their keys; returns ``df``."""
    forbid(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, DataQualityError, f"{keys} repeat")
    return df


def complete_rows(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Per group: all rows, those with every feature, and those dropped."""
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped"))


#: Feature, when what it measures happens, when that is published, from when a plan may use it.
FEATURE_TIMES = [
    ("mom5", "close of the day", "close of the day", "next day"), ("mom20", "close of the day", "close of the day", "next day"), ("vol20", "close of the day", "close of the day", "next day"),
    ("dist20", "close of the day", "close of the day", "next day"), ("mkt5", "close of the day", "close of the day", "next day"), ("mvol20", "close of the day", "close of the day", "next day"),
    ("rel5", "close of the day", "close of the day", "next day"), ("surprise", "quarter", "report", "day after the report"), ("sentiment", "publication", "publication", "publication"),
    ("novelty", "seven days before publication", "publication", "publication"), ("fwd_vol", "five days after", "close of the fifth day", "never: a target"), ("car", "event window", "end of the window", "never: a target"),
]


def feature_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_TIMES, "feature string, observed string, published string, available string")
