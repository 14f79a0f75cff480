"""Transactions as set operations.

All checks read the state before the transaction, so a transaction is a function of that state and its facts: joins, then one commit. Nothing is
written unless every fact passes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tesserae.errors import CompareAndSwapFailed, SerializationError, TypeMismatch, UndefinedAttribute, UniqueConstraintViolation
from tesserae.sources.log import LogStore, Manifest
from tesserae.sources.schema import FOREVER, LOG_SCHEMA, MANY, VALUE_COLUMNS, VALUE_TYPES, Attribute
from tesserae.sources.wire import CAS_COLUMNS


@dataclass(frozen=True)
class TxReport:
    tx_id: int
    timestamp: int
    datoms_written: int


def _kind(columns: list[str]) -> Column:
    """The value type of the first of these columns that is not null."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in zip(VALUE_TYPES, columns)])


def _struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in VALUE_COLUMNS])


class Transactor:
    """Applies wire rows to a store. infer_schema: an unknown ident becomes an attribute typed by its first value."""

    def __init__(self, store: LogStore, infer_schema: bool = True):
        self.store, self.infer_schema = store, infer_schema

    def add_attribute(self, ident: str, value_type: str, unique: bool, cardinality: str, now: int) -> Attribute:
        m = self.store.manifest()
        tx = m.last_tx + 1
        catalog = m.catalog.with_new(ident, value_type, unique, cardinality, tx, now)
        self.store.commit(replace(m, catalog=catalog, last_tx=tx, last_ts=max(now, m.last_ts)))
        return catalog.attributes[-1]

    def transact(self, wire: DataFrame, now: int, stream: tuple[str, int] | None = None) -> TxReport:
        m = self.store.manifest()
        if stream:
            if m.streams.get(stream[0], -1) >= stream[1]:
                return TxReport(m.last_tx, now, 0)
            m = replace(m, streams=m.streams | {stream[0]: stream[1]})
        tx, spark = m.last_tx + 1, self.store.spark
        rows = wire.withColumn("seq", F.col("seq") if "seq" in wire.columns else F.monotonically_increasing_id())
        rows = rows.withColumn("op", F.coalesce("op", F.lit(True))).withColumn("vt", F.coalesce("valid_time", F.lit(now)).cast("long")).withColumn("kind", _kind(VALUE_COLUMNS))
        rows = rows.withColumn("e", F.when(F.col("e") == 0, F.lit(tx)).otherwise(F.col("e")))
        # Schema: attributes are few, facts may be many.
        bad = F.count_if(F.expr("e IS NULL OR e < 0 OR ident IS NULL OR kind IS NULL"))
        known, catalog = m.catalog.at(), m.catalog
        idents = rows.groupBy("ident").agg(F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"), bad.alias("bad")).collect()
        if any(r["bad"] for r in idents):
            raise SerializationError("a fact lacks its entity, attribute or value")
        for r in sorted(idents, key=lambda r: r["seq"]):
            if r["ident"] not in known:
                if not self.infer_schema:
                    raise UndefinedAttribute(r["ident"])
                catalog = catalog.with_new(r["ident"], r["kind"], tx=tx, ts=now)
        own = {i: a for i, a in catalog.at().items() if i in {r["ident"] for r in idents}}
        if not own:
            self.store.commit(replace(m, last_tx=tx, last_ts=max(now, m.last_ts)))
            return TxReport(tx, now, 0)
        of = F.create_map(*[x for i, a in own.items() for x in (F.lit(i), F.struct(F.lit(a.id).alias("a"), F.lit(a.value_type).alias("type"), F.lit(a.unique).alias("uniq"), F.lit(a.cardinality == MANY).alias("many")))])
        rows = rows.withColumn("attr", of[F.col("ident")]).select("*", "attr.*").drop("attr")
        to_ref = (F.col("type") == "Ref") & (F.col("kind") == "Int64")
        rows = rows.withColumns({"v_ref": F.when(to_ref, F.col("v_int")).otherwise(F.col("v_ref")), "v_int": F.when(to_ref, F.lit(None)).otherwise(F.col("v_int")), "kind": F.when(to_ref, F.lit("Ref")).otherwise(F.col("kind"))})
        cas_ref = (F.col("type") == "Ref") & F.col("cas_int").isNotNull()
        rows = rows.withColumns({"cas_ref": F.when(cas_ref, F.col("cas_int")).otherwise(F.col("cas_ref")), "cas_int": F.when(cas_ref, F.lit(None)).otherwise(F.col("cas_int"))})
        # Only the value column of the attribute's type is kept.
        rows = rows.withColumns({c: F.when(F.col("type") == k, F.col(c)) for k, (c, _) in VALUE_TYPES.items()}).withColumn("v", _struct())
        before = self.store.intervals(m, sorted(a.id for a in own.values()), self._touched(m, rows, [a.id for a in own.values() if a.unique])).where("op").select("e", "a", "valid_from", "valid_to", _struct().alias("old"))
        state = self._state(rows, before).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._check(state, before, any(a.unique for a in own.values()))
            folder = self.store.write(self._datoms(state, tx), "log")
            n = self.store.log(replace(m, log=(folder,))).count()
        finally:
            state.unpersist()
        self.store.commit(replace(m, log=(*m.log, folder) if n else m.log, catalog=catalog, last_tx=tx, last_ts=max(now, m.last_ts)))
        return TxReport(tx, now, n)

    def _touched(self, m: Manifest, rows: DataFrame, unique: list[int]) -> DataFrame:
        """(e, a) of the facts that this transaction is about: its own, and those that have held a unique value that it claims. Only their history is read."""
        own = rows.select("e", F.col("a").cast("int").alias("a"))
        if unique:
            value = F.xxhash64(*VALUE_COLUMNS)
            claims = rows.where("uniq AND op").select(F.col("a").cast("int").alias("a"), value.alias("v")).distinct()
            owners = self.store.log(m).where(F.col("a").isin(unique)).select("e", "a", value.alias("v")).join(claims, ["a", "v"], "left_semi")
            own = own.unionByName(owners.select("e", "a"))
        return own.distinct()

    def _state(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        """The facts with `olds`, the values that their entity and attribute held at their valid time, and whether theirs is one of them."""
        at = rows.select("seq", "e", "a", "vt").join(before, ["e", "a"]).where("valid_from <= vt AND vt < valid_to")
        olds = at.groupBy("seq").agg(F.collect_set("old").alias("olds"))
        state = rows.join(olds, "seq", "left").withColumn("olds", F.coalesce("olds", F.array().cast(olds.schema["olds"].dataType)))
        return state.withColumn("has", F.exists("olds", lambda o: o.eqNullSafe(F.col("v"))))

    def _check(self, state: DataFrame, before: DataFrame, unique: bool) -> None:
        """Raises for the first kind of fault found; one pass over the facts, and one more where attributes are unique."""
        expected = F.struct(*[F.col(n).alias(c) for n, c in zip(CAS_COLUMNS, VALUE_COLUMNS)])
        wants = F.greatest(*[F.col(c).isNotNull() for c in CAS_COLUMNS])
        who = F.struct("ident", "e", "type", "kind")
        found = state.agg(
            F.min(F.when(F.col("kind") != F.col("type"), who)).alias("type"),
            F.min(F.when(wants & ~F.exists("olds", lambda o: o.eqNullSafe(expected)), who)).alias("cas"),
        ).first()
        if bad := found["type"]:
            raise TypeMismatch(f"{bad['ident']} is of type {bad['type']}, not {bad['kind']}")
        if bad := found["cas"]:
            raise CompareAndSwapFailed(f"{bad['ident']} of {bad['e']} does not hold the expected value")
        if not unique:
            return
        claims = state.where("uniq AND op")
        twice = claims.groupBy("a", "ident", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ident", F.lit(None).cast("long").alias("owner"))
        own = claims.select("a", "ident", F.col("e").alias("claimant"), "vt", *[F.col(c).alias(f"_{c}") for c in VALUE_COLUMNS])
        same = F.col("a") == F.col("b")
        for c in VALUE_COLUMNS:
            same = same & F.col(f"_{c}").eqNullSafe(F.col(f"old.{c}"))
        # Another owner at that time or any time after.
        clash = own.join(before.withColumnRenamed("a", "b"), same).where("e != claimant AND valid_to > vt").select("ident", F.col("e").alias("owner"))
        if bad := twice.union(clash).head():
            raise UniqueConstraintViolation(f"{bad['ident']}: " + ("the transaction gives one value twice" if bad["owner"] is None else f"the value belongs to {bad['owner']}"))

    def _datoms(self, state: DataFrame, tx: int) -> DataFrame:
        """Assertions of new values, retractions of what they replace, retractions of what is held."""
        datom = lambda v, op, to: F.struct(v.alias("v"), F.lit(op).alias("op"), to.alias("valid_to"))
        none = F.array().cast(state.select(F.array(datom(F.col("v"), True, F.col("vt")))).schema[0].dataType)
        new = F.array(datom(F.col("v"), True, F.lit(FOREVER)))
        replaced = F.transform("olds", lambda o: datom(o, False, F.col("vt")))
        gone = F.array(datom(F.col("v"), False, F.col("vt")))
        made = F.when(F.col("op"), F.when(F.col("has"), none).when(F.col("many"), new).otherwise(F.concat(replaced, new))).otherwise(F.when(F.col("has"), gone).otherwise(none))
        rows = state.select("e", "a", "vt", "seq", F.explode(made).alias("d"))
        values = {c: F.col(f"d.v.{c}") for c in VALUE_COLUMNS}
        out = rows.select("e", "a", *[v.alias(c) for c, v in values.items()], F.lit(tx).cast("long").alias("t"), F.col("d.op").alias("op"), F.col("vt").alias("valid_from"), F.col("d.valid_to").alias("valid_to"), "seq")
        return out.select(*LOG_SCHEMA.names)
