"""From a log of assertions and retractions to intervals, and the views of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.schema import FOREVER, VALUE_COLUMNS


def close_intervals(log: DataFrame, many: list[int]) -> DataFrame:
    """The log with valid_to of each row set to where the next row of its fact begins.

    A fact is (entity, attribute) and, for the attributes in many, the value too. Rows of a fact go by valid_from, then transaction, retraction before
    assertion, and place in the transaction.
    """

    def closed(rows: DataFrame, keys: list[str]) -> DataFrame:
        after = F.lead("valid_from").over(W.partitionBy(*keys).orderBy("valid_from", "t", "op", "seq"))
        return rows.withColumn("valid_to", F.coalesce(after, F.col("valid_to")))

    if not many:
        return closed(log, ["e", "a"])
    is_many = F.col("a").isin(many)
    return closed(log.where(~is_many), ["e", "a"]).unionByName(closed(log.where(is_many), ["e", "a", *VALUE_COLUMNS]))


def holding(log: DataFrame, many: list[int], ts: int | None = None) -> DataFrame:
    """What holds now, or held at a time, straight from the log: of each fact the last row that began by then, if it is an assertion.

    Later rows are filtered out before anything is shuffled, and each task sums up its own rows first, so history costs no sort of it all.
    """
    rows = log if ts is None else log.where(F.col("valid_from") <= ts)
    order, row = F.struct("valid_from", "t", "op", "seq"), F.struct(*log.columns)

    def last(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max_by(row, order).alias("row")).select("row.*")

    if many:
        is_many = F.col("a").isin(many)
        found = last(rows.where(~is_many), ["e", "a"]).unionByName(last(rows.where(is_many), ["e", "a", *VALUE_COLUMNS]))
    else:
        found = last(rows, ["e", "a"])
    return found.where(F.col("op") & (F.col("valid_to") == FOREVER if ts is None else F.col("valid_to") > ts))


def current(intervals: DataFrame) -> DataFrame:
    """What holds now."""
    return intervals.where(F.col("op") & (F.col("valid_to") == FOREVER))


def as_of(intervals: DataFrame, ts: int) -> DataFrame:
    """What held at a time; intervals are half-open."""
    return intervals.where(F.col("op") & (F.col("valid_from") <= ts) & (F.col("valid_to") > ts))
