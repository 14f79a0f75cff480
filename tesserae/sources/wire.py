"""The ingest schema: a typed column for each kind of value, and again for the value expected."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tesserae.errors import SerializationError

from .edn import Fact, Instant, Ref, micros
from .schema import VALUE_TYPES

CAS_COLUMNS = [c.replace("v_", "cas_", 1) for c, _ in VALUE_TYPES.values()]
WIRE_SCHEMA = T.StructType([
    T.StructField("e", T.LongType()), T.StructField("ident", T.StringType()), T.StructField("op", T.BooleanType()), T.StructField("valid_time", T.LongType()),
    *[T.StructField(c, k) for c, k in VALUE_TYPES.values()],
    *[T.StructField(n, k) for n, (_, k) in zip(CAS_COLUMNS, VALUE_TYPES.values())],
    T.StructField("seq", T.LongType()),
])


def value_type(v: Any) -> str:
    """The value type of a Python value."""
    for kind, name in ((bool, "Boolean"), (int, "Int64"), (float, "Float64"), (str, "String"), (Ref, "Ref"), ((Instant, dt.datetime), "Timestamp"), ((uuid.UUID, bytes), "Uuid")):
        if isinstance(v, kind):
            return name
    raise SerializationError(f"no value for a fact: {v!r}")


def _stored(v: Any) -> Any:
    if isinstance(v, Ref):
        return v.id
    if isinstance(v, Instant):
        return v.micros
    if isinstance(v, dt.datetime):
        return micros(v.isoformat())
    return v.bytes if isinstance(v, uuid.UUID) else v


def wire_frame(spark: SparkSession, facts: Iterable[Fact]) -> DataFrame:
    """Facts as rows in the ingest schema, in their order."""
    names = list(VALUE_TYPES)
    rows = []
    for i, f in enumerate(facts):
        row: list[Any] = [f.e, f.ident, f.op, f.valid_time, *[None] * (2 * len(names)), i]
        row[4 + names.index(value_type(f.v))] = _stored(f.v)
        if f.expect is not None:
            row[4 + len(names) + names.index(value_type(f.expect))] = _stored(f.expect)
        rows.append(row)
    return spark.createDataFrame(rows, WIRE_SCHEMA)
