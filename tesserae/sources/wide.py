"""Wide tables as facts: each column an attribute of the row's entity. They are always as of now, from transaction 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.errors import PlanError

from .schema import FIRST_ID, Attribute


@dataclass(frozen=True)
class WideTable:
    """key: the entity's id, unique a row. columns: ident to column, or to an expression over columns."""

    name: str
    frame: DataFrame
    key: Column
    columns: dict[str, Column]
    refs: frozenset[str] = frozenset()


def _type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, T.FractionalType | T.DecimalType):
        return "Float64"
    if isinstance(kind, T.IntegralType):
        return "Int64"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "Timestamp"
    return "String"


class WideFacts:
    def __init__(self, tables: list[WideTable]):
        self.tables: dict[str, WideTable] = {}
        self._attributes: dict[str, Attribute] = {}
        for t in tables:
            kinds = t.frame.select(*[c.alias(f"c{i}") for i, c in enumerate(t.columns.values())]).schema
            for ident, field in zip(t.columns, kinds):
                if ident in self.tables:
                    raise PlanError(f"{ident} is defined twice")
                self.tables[ident] = t
                self._attributes[ident] = Attribute(FIRST_ID + len(self._attributes), ident, "Ref" if ident in t.refs else _type(field.dataType))

    def attribute(self, ident: str) -> Attribute:
        if ident not in self._attributes:
            raise PlanError(f"no attribute {ident}")
        return self._attributes[ident]

    def idents(self) -> list[str]:
        return sorted(self._attributes)

    def _value(self, ident: str) -> Column:
        c = self.tables[ident].columns[ident]
        return c.cast("long") if self._attributes[ident].value_type in ("Int64", "Ref") else c

    def scan(self, ident: str) -> DataFrame:
        self.attribute(ident)
        t = self.tables[ident]
        v = self._value(ident)
        return t.frame.where(v.isNotNull()).select(t.key.cast("long").alias("e"), v.alias("v"), F.lit(0).cast("long").alias("t"), F.lit(True).alias("op"))

    def scan_any(self) -> DataFrame:
        """One pass over each table: its columns become rows."""
        parts = []
        for t in {x.name: x for x in self.tables.values()}.values():
            each = F.array(*[F.struct(F.lit(self._attributes[i].id).cast("long").alias("a"), self._value(i).cast("string").alias("v")) for i in t.columns])
            rows = t.frame.select(t.key.cast("long").alias("e"), F.explode(each).alias("f"))
            parts.append(rows.select("e", "f.a", "f.v", F.lit(0).cast("long").alias("t"), F.lit(True).alias("op")).where("v IS NOT NULL"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def star_group(self, ident: str) -> str | None:
        self.attribute(ident)
        return self.tables[ident].name

    aggregates = False

    def outer_star(self, idents: list[str], entities: DataFrame | None) -> DataFrame:
        t = self.tables[idents[0]]
        some = F.lit(False)
        for i in idents:
            some = some | self._value(i).isNotNull()
        return t.frame.where(some).select(t.key.cast("long").alias("e"), *[self._value(x).alias(f"v{i}") for i, x in enumerate(idents)])

    def star(self, idents: list[str]) -> DataFrame | None:
        t = self.tables[idents[0]]
        rows = t.frame
        for i in dict.fromkeys(idents):
            rows = rows.where(self._value(i).isNotNull())
        return rows.select(t.key.cast("long").alias("e"), *[self._value(x).alias(f"v{i}") for i, x in enumerate(idents)])
