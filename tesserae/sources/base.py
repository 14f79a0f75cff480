"""What the query compiler asks of a store of facts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .log import LogStore, Manifest
from .schema import MANY, VALUE_TYPES, Attribute


def uuid_text(column: Column) -> Column:
    """A 16-byte id in its usual form."""
    return F.lower(F.regexp_replace(F.hex(column), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))


class FactSource(Protocol):
    def attribute(self, ident: str) -> Attribute: ...
    def idents(self) -> list[str]: ...
    def scan(self, ident: str) -> DataFrame:
        """(e, v, t, op) of one attribute."""

    def scan_any(self) -> DataFrame:
        """(e, a, v, t, op) of all attributes, a being the attribute's number and v text."""

    def star(self, idents: list[str]) -> DataFrame | None:
        """(e, v0, v1, ...) of the entities that have all of these attributes, or None if one row an entity can't be had."""

    #: Whether rows of an entity have to be gathered, so that it pays to say which entities are wanted.
    aggregates: bool

    def outer_star(self, idents: list[str], entities: DataFrame | None) -> DataFrame:
        """(e, v0, v1, ...) of the entities that have any of these attributes of one group, one row each; of the wanted ones at least."""

    def star_group(self, ident: str) -> str | None:
        """Attributes of an equal group can be read together; None: never."""


class LogFacts:
    """The facts of a log, at one snapshot and in one view."""

    def __init__(self, store: LogStore, manifest: Manifest, ts: int | None = None, history: bool = False):
        self.store, self.manifest, self.ts, self.history = store, manifest, ts, history

    def attribute(self, ident: str) -> Attribute:
        return self.manifest.catalog.get(ident, self.ts)

    def idents(self) -> list[str]:
        return sorted(self.manifest.catalog.at(self.ts))

    def rows(self, attributes: list[int] | None = None) -> DataFrame:
        return self.store.view(self.manifest, self.ts, self.history, attributes)

    def scan(self, ident: str) -> DataFrame:
        a = self.attribute(ident)
        return self.rows([a.id]).select("e", _output(a).alias("v"), "t", "op")

    def scan_any(self) -> DataFrame:
        text = [uuid_text(F.col(c)) if isinstance(k, T.BinaryType) else F.col(c).cast("string") for c, k in VALUE_TYPES.values()]
        return self.rows().select("e", F.col("a").cast("long").alias("a"), F.coalesce(*text).alias("v"), "t", "op")

    def star_group(self, ident: str) -> str | None:
        return None if self.history or self.attribute(ident).cardinality == MANY else "log"

    aggregates = True

    def outer_star(self, idents: list[str], entities: DataFrame | None) -> DataFrame:
        own = [self.attribute(i) for i in idents]
        rows = self.rows(sorted({a.id for a in own}))
        if entities is not None:
            rows = rows.join(entities.select("e").distinct(), "e", "left_semi")
        return rows.groupBy("e").agg(*[F.max(F.when(F.col("a") == a.id, _output(a))).alias(f"v{i}") for i, a in enumerate(own)])

    def star(self, idents: list[str]) -> DataFrame | None:
        own = [self.attribute(i) for i in idents]
        # One pass over the attributes' partitions and one aggregation by entity, in place of a self-join for each attribute.
        values = [F.max(F.when(F.col("a") == a.id, _output(a))).alias(f"v{i}") for i, a in enumerate(own)]
        by = self.rows(sorted({a.id for a in own})).groupBy("e").agg(*values)
        for i in range(len(own)):
            by = by.where(F.col(f"v{i}").isNotNull())
        return by


def _output(a: Attribute) -> Column:
    return uuid_text(F.col(a.column)) if a.value_type == "Uuid" else F.col(a.column)
