"""Scalar functions, predicates and aggregates that queries may name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.errors import PlanError

_INTEGRAL = ("bigint", "int", "smallint", "tinyint")
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
#: Names that Spark spells the same way.
_SAME = """upper lower trim ltrim rtrim length char_length substr left right replace reverse repeat lpad rpad concat startswith endswith contains
instr split_part initcap ascii chr md5 abs ceil floor round sqrt cbrt exp ln log log2 log10 sin cos tan asin acos atan atan2 signum degrees radians
coalesce nullif greatest least date_trunc date_part to_timestamp pow power year month day hour minute second current_timestamp""".split()
_RENAMED = {"starts_with": "startswith", "ends_with": "endswith", "strpos": "instr", "now": "current_timestamp", "extract": "date_part"}
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "stddev": F.stddev, "stddev_pop": F.stddev_pop,
    "var_samp": F.var_samp, "var_pop": F.var_pop, "approx_distinct": F.approx_count_distinct, "array_agg": F.collect_list, "bool_and": F.bool_and, "bool_or": F.bool_or,
    "count-distinct": F.count_distinct,
}


def aggregate(name: str, column: Column) -> Column:
    found = AGGREGATES.get(name.lower())
    if not found:
        raise PlanError(f"no aggregate {name}")
    return found(column)


def _integral(kind: T.DataType | None) -> bool:
    return kind is not None and kind.simpleString() in _INTEGRAL


def call(name: str, args: list[Column], kinds: list[T.DataType | None]) -> Column:
    """The function over its arguments; kinds are their types, None for a bare null."""
    name = name.lower()
    if name in COMPARISONS:
        return COMPARISONS[name](*args) if len(args) == 2 else F.lit(False)
    if name in "+-*/":
        if len(args) != 2:
            return F.lit(None).cast("double")
        a, b = args
        if name == "/":
            # Whole numbers divide to a whole number, cut toward zero; others as floating point, where x / 0 is infinite or not a number.
            if all(map(_integral, kinds)):
                return F.call_function("div", a, b)
            a, b = a.cast("double"), b.cast("double")
            return F.when(b == 0, F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))).otherwise(F.try_divide(a, b))
        return a + b if name == "+" else a - b if name == "-" else a * b
    if name == "str":
        return F.concat_ws("", *[a.cast("string") for a in args])
    if name == "concat":
        # Nulls are left out.
        return F.concat_ws("", *[a.cast("string") for a in args])
    if name == "log" and len(args) == 1:
        return F.log10(args[0])
    if name == "make_array":
        return F.array(*args)
    if name == "sha256":
        return F.sha2(args[0].cast("binary"), 256)
    name = _RENAMED.get(name, name)
    if name in _SAME:
        return F.call_function(name, *args)
    raise PlanError(f"no function {name}")
