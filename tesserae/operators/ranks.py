"""How many rows meet in a join with an inequality, by rank and not by pairs.

With x < y, a row meets those of its group (equal shared variables) whose y is beyond its x. Both sides are put in one order by group and value, and the numbers are summed along it: time grows
with the rows of both sides, not with their pairs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The values of a group are dealt to so many ranges of equal width, so that a large group is not one task's.
RANGES = 64
#: What an inequality is with its sides changed.
FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type in which Spark compares the two, if both sides can be ordered in it."""
    if a == b:
        return a if isinstance(a, T.AtomicType) else None
    return T.DoubleType() if {type(a), type(b)} == {T.LongType, T.DoubleType} else None


def _number(v: Column, kind: T.DataType) -> Column | None:
    """A double that never falls as v grows; None for types that have none."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(v).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("double")
    return v.cast("double") if isinstance(kind, T.NumericType) else None


def _ranged(rows: DataFrame, theirs: DataFrame, group: list[str], kind: T.DataType) -> DataFrame:
    """rows with `_range`, which never falls as _v grows within a group. Groups that theirs lacks go."""
    number = _number(F.col("_v"), kind)
    number = F.lit(0.0) if number is None else number
    bounds = theirs.groupBy(*group).agg(F.min(number).alias("_low"), (F.max(number) - F.min(number)).alias("_width"))
    # Not a number is above all others, for F.least and comparisons too.
    part = F.least(F.greatest((number - F.col("_low")) / F.nullif(F.col("_width"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    at = F.when((F.col("_width") > 0) & (F.col("_width") < math.inf), F.floor(part * RANGES)).otherwise(0).cast("int")
    return rows.join(bounds, group).withColumn("_range", at).drop("_low", "_width")


def met(mine: DataFrame, theirs: DataFrame, shared: list[str], x: str, op: str, y: str, counted: list[str], kind: T.DataType) -> DataFrame:
    """The rows of mine that meet any of theirs (equal on shared, and x op y), with the number of those as `_met`, and for each column of theirs in counted, the number where it is not
    null as `_met0`, `_met1`, ... kind: the type in which x and y compare."""
    group, sums = [f"_g{i}" for i in range(max(len(shared), 1))], ["_met", *[f"_met{i}" for i in range(len(counted))]]
    own = [F.col(f"`{c}`") for c in mine.columns]

    def sided(rows: DataFrame, v: str) -> list[Column]:
        return [*[F.col(f"`{c}`").alias(g) for c, g in zip(shared, group)], *([] if shared else [F.lit(0).alias("_g0")]), F.col(f"`{v}`").cast(kind).alias("_v")]

    bound = lambda rows, v: rows.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [*shared, v]]))
    packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])
    left = bound(mine, x).select(*sided(mine, x), packed.alias("_mine"))
    right = bound(theirs, y).select(*sided(theirs, y), *[F.col(f"`{c}`").alias(s) for c, s in zip(counted, sums[1:])])
    right = right.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_met"), *[F.count(s).alias(s) for s in sums[1:]])
    both = left.select("*", *[F.lit(0).cast("long").alias(s) for s in sums]).unionByName(right.withColumn("_mine", F.lit(None).cast(left.schema["_mine"].dataType)))
    both = _ranged(both, right, group, kind)
    # From the far end on. Of equal values, those of mine come first if equal ones don't meet.
    down, first = op in ("<", "<="), op in ("<", ">")
    order = [F.desc("_v") if down else F.asc("_v"), F.asc(F.col("_mine").isNull()) if first else F.desc(F.col("_mine").isNull())]
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy(*group).orderBy(F.desc("_range") if down else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = both.groupBy(*group, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    ranges = ranges.select(*group, "_range", *[F.coalesce(F.sum(s).over(beyond), F.lit(0)).alias(f"{s}_beyond") for s in sums])
    found = both.select(*group, "_range", "_mine", *[F.sum(s).over(inside).alias(s) for s in sums]).where("_mine IS NOT NULL").join(ranges, [*group, "_range"])
    found = found.select("_mine", *[(F.col(s) + F.col(f"{s}_beyond")).alias(s) for s in sums]).where("_met > 0")
    return found.select(*[F.col(f"_mine.c{i}").alias(c) for i, c in enumerate(mine.columns)], *sums)
