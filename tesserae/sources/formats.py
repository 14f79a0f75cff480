"""Results as JSON, EDN and native Python values. Rows are rendered by the executors; the driver only joins them."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _micros(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        return F.unix_micros(c.cast("timestamp"))
    return c


def _trimmed(c: Column, kind: T.DataType) -> Column:
    """c with the colons before the keys of its structs left off and times as microseconds."""
    if isinstance(kind, T.StructType):
        made = F.struct(*[_trimmed(c.getField(f.name), f.dataType).alias(f.name.removeprefix(":")) for f in kind])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _trimmed(x, kind.elementType))
    return _micros(c, kind)


def json_rows(df: DataFrame) -> DataFrame:
    """One column `json`: each row as an object, nulls left out."""
    fields = [_trimmed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*fields)).alias("json"))


def to_json(df: DataFrame) -> str:
    return "[" + ",".join(r["json"] for r in json_rows(df).toLocalIterator()) + "]"


def _edn_string(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


_UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _edn(c: Column, kind: T.DataType) -> Column:
    """EDN text of a value; null where it is null."""
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(_UUID), F.concat(F.lit('#uuid "'), c, F.lit('"'))).otherwise(_edn_string(c))
    if isinstance(kind, T.StructType):
        # A null field is left out.
        parts = F.array(*[F.concat(F.lit(f.name + " "), _edn(c.getField(f.name), f.dataType)) for f in kind])
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array_compact(parts), " "), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_edn(x, kind.elementType), F.lit("nil"))), " "), F.lit("]"))
    return _micros(c, kind).cast("string")


def edn_rows(df: DataFrame) -> DataFrame:
    """One column `edn`: each row as a map, a null as nil."""
    parts = [F.concat(F.lit(f":{f.name} "), F.coalesce(_edn(F.col(f"`{f.name}`"), f.dataType), F.lit("nil"))) for f in df.schema]
    return df.select(F.concat(F.lit("{"), F.concat_ws(" ", *parts), F.lit("}")).alias("edn"))


def to_edn(df: DataFrame) -> str:
    return "[" + " ".join(r["edn"] for r in edn_rows(df).toLocalIterator()) + "]"


def _native(v: Any) -> Any:
    if hasattr(v, "asDict"):
        return {k: _native(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, list):
        return [_native(x) for x in v]
    if isinstance(v, dt.datetime):
        return int((v - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    return bytes(v) if isinstance(v, bytearray) else v


def to_native(df: DataFrame) -> list[dict[str, Any]]:
    return [{k: _native(v) for k, v in r.asDict().items()} for r in df.toLocalIterator()]
