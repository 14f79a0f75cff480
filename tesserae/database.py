"""The database: queries and transactions over a log, or queries over wide tables."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.config import Settings
from tesserae.errors import InvalidQuery, PlanError, Superseded
from tesserae.functions import registry
from tesserae.operators.transactor import Transactor, TxReport
from tesserae.plans.ast import Aggregate, Const, Pattern, Pull, Query, RuleSet, Var
from tesserae.plans.compiler import Compiler, Context, col
from tesserae.plans.parser import parse_query, parse_ruleset
from tesserae.plans.pull import pulled, without_values
from tesserae.plans.rules import Rules
from tesserae.sources import formats
from tesserae.sources.base import FactSource, LogFacts
from tesserae.sources.edn import Fact, parse_edn, parse_json
from tesserae.sources.log import RETAIN_SECONDS, LogStore
from tesserae.sources.schema import ONE, Attribute
from tesserae.sources.wide import WideFacts, WideTable
from tesserae.sources.wire import wire_frame

INPUT_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def _relation(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """Input rows as a DataFrame. No rows: no matches, so any type does."""
    kinds = []
    for i in range(len(names)):
        own = {type(r[i]) for r in rows}
        if len(own) > 1:
            raise InvalidQuery(f"input ?{names[i]} mixes types")
        kind = next(iter(own), int)
        if kind not in INPUT_TYPES:
            raise InvalidQuery(f"input ?{names[i]} is of type {kind.__name__}")
        kinds.append(INPUT_TYPES[kind])
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def _bind_inputs(spark: SparkSession, query: Query, inputs: list[Any]) -> tuple[dict[str, Any], list[DataFrame]]:
    """Variables of one value, and relations of the others."""
    wanted = [i for i in query.inputs or () if i.kind != "source"]
    if len(inputs) != len(wanted):
        raise InvalidQuery(f"the query takes {len(wanted)} inputs, not {len(inputs)}")
    constants: dict[str, Any] = {}
    relations = []
    for i, given in zip(wanted, inputs):
        if i.kind == "scalar":
            constants[i.vars[0]] = given
        elif i.kind == "tuple":
            if len(given) != len(i.vars):
                raise InvalidQuery(f"a tuple of {len(i.vars)} is expected, not of {len(given)}")
            constants |= dict(zip(i.vars, given))
        elif i.kind == "collection":
            relations.append(_relation(spark, i.vars, [(x,) for x in given]))
        else:
            if bad := [r for r in given if len(r) != len(i.vars)]:
                raise InvalidQuery(f"rows of {len(i.vars)} are expected, not of {len(bad[0])}")
            relations.append(_relation(spark, i.vars, [tuple(r) for r in given]))
    return constants, relations


def run_query(spark: SparkSession, facts: FactSource, text: str, inputs: list[Any] | None = None, rules: str | RuleSet | None = None, tabular: bool = False) -> DataFrame:
    """The result of a query: a column for each element of :find, in its order. Rows are a bag."""
    query = parse_query(text)
    constants, relations = _bind_inputs(spark, query, list(inputs or []))
    context = Context(spark, facts, constants, relations)
    if rules is not None:
        context.rule = Rules(context, parse_ruleset(rules) if isinstance(rules, str) else rules).relation
    known = Compiler(context).where(query.where)
    for v, value in constants.items():
        known = known.withColumn(v, F.lit(value))
    names = {f.name if isinstance(f, Var) else f.var for f in query.find}
    entity = _one_entity(query)
    for f in query.find:
        if isinstance(f, Pull) and f.var not in known.columns and entity is not None:
            # A pull of a variable that nothing binds is of the one entity that the clauses name, if they hold for it.
            known = known.distinct().withColumn(f.var, F.lit(entity))
    if lacking := sorted(names - set(known.columns)):
        raise PlanError(":find: not bound: " + ", ".join("?" + v for v in lacking))
    if tabular and any(isinstance(f, Pull) for f in query.find):
        raise InvalidQuery("pull is not tabular")
    aggregates = [registry.aggregate(f.name, col(f.var)).alias(f"{f.name}_{f.var}") for f in query.find if isinstance(f, Aggregate)]
    keys = list(dict.fromkeys(f.name if isinstance(f, Var) else f.var for f in query.find if not isinstance(f, Aggregate)))
    counts = [f for f in query.find if isinstance(f, Aggregate)]
    ranked = Compiler(context).counted(query.where, keys, [f.var for f in counts]) if counts and all(f.name.lower() == "count" for f in counts) else None
    if ranked is not None:
        known = ranked.select(*[col(k) for k in keys], *[F.col(f"count{i}").alias(f"{f.name}_{f.var}") for i, f in enumerate(counts)])
    elif aggregates:
        known = known.groupBy(*[col(k) for k in keys]).agg(*aggregates) if keys else known.agg(*aggregates)
    else:
        known = known.select(*[col(k) for k in keys])
    known = _pull(facts, known, [f for f in query.find if isinstance(f, Pull)])
    out = [f.name if isinstance(f, Var) else f"{f.name}_{f.var}" if isinstance(f, Aggregate) else f"pull_{f.var}" for f in query.find]
    return known.select(*[col(c) for c in dict.fromkeys(out)])


def _one_entity(query: Query) -> int | None:
    found = {c.e.value for c in query.where if isinstance(c, Pattern) and isinstance(c.e, Const)}
    return next(iter(found)) if len(found) == 1 else None


def _pull(facts: FactSource, known: DataFrame, pulls: list[Pull]) -> DataFrame:
    for p in pulls:
        trees = pulled(facts, known.select(col(p.var).alias("e")), p.attrs)
        empty = without_values(trees.schema["tree"].dataType)
        trees = trees.select(F.col("e").alias(p.var), F.col("tree").alias("_tree"))
        tree = F.when(col(p.var).isNotNull(), F.coalesce(F.col("_tree"), empty))
        known = known.join(trees, p.var, "left").withColumn(f"pull_{p.var}", tree).drop("_tree")
    return known


@dataclass
class Result:
    """A query's result, to be had in any form."""

    frame: DataFrame

    def rows(self) -> list[dict[str, Any]]:
        return formats.to_native(self.frame)

    def json(self) -> str:
        return formats.to_json(self.frame)

    def edn(self) -> str:
        return formats.to_edn(self.frame)

    def arrow(self):
        return self.frame.toArrow()


class WideDatabase:
    """Queries over tables whose columns are attributes."""

    def __init__(self, spark: SparkSession, tables: list[WideTable]):
        self.spark, self.facts = spark, WideFacts(tables)

    def query(self, text: str, inputs: list[Any] | None = None, rules: str | None = None, tabular: bool = False) -> DataFrame:
        return run_query(self.spark, self.facts, text, inputs, rules, tabular)

    def result(self, text: str, **options: Any) -> Result:
        return Result(self.query(text, **options))


class Database:
    """A bitemporal database under a path."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.store, self.settings = spark, LogStore(spark, path), settings
        self.transactor = Transactor(self.store, settings.infer_schema)

    # Writing

    @staticmethod
    def _now(now: int | None) -> int:
        return time.time_ns() // 1000 if now is None else now

    def add_attribute(self, ident: str, value_type: str, unique: bool = False, cardinality: str = ONE, now: int | None = None) -> Attribute:
        return self.transactor.add_attribute(ident, value_type, unique, cardinality, self._now(now))

    def transact(self, facts: Iterable[Fact] | DataFrame | str, now: int | None = None, stream: tuple[str, int] | None = None) -> TxReport:
        """Facts, rows in the ingest schema, or an EDN text, as one transaction. now: microseconds, the valid time of facts that give none.

        stream: a stream's name and the number of its batch; a batch that was committed before writes nothing.
        """
        if isinstance(facts, str):
            facts = parse_edn(facts)
        wire = facts if isinstance(facts, DataFrame) else wire_frame(self.spark, facts)
        report = self.transactor.transact(wire, self._now(now), stream)
        m = self.store.manifest()
        if 0 < self.settings.compact_after <= len(set(m.log) - set(m.covered)):
            try:
                self.compact()
            except Superseded:
                pass  # Another writer was faster; the transaction stands, and a later one compacts.
        return report

    def transact_json(self, text: str, now: int | None = None) -> TxReport:
        facts, at = parse_json(text)
        return self.transact(facts, at if at is not None else now)

    def compact(self) -> None:
        self.store.compact()

    def vacuum(self, retain_seconds: float = RETAIN_SECONDS) -> int:
        return self.store.vacuum(retain_seconds)

    # Reading

    def snapshot(self, as_of: int | None = None, history: bool = False) -> LogFacts:
        """Facts as of now, as of a valid time in microseconds, or all that was ever written. Later transactions don't change it."""
        return LogFacts(self.store, self.store.manifest(), as_of, history)

    def query(self, text: str, inputs: list[Any] | None = None, rules: str | None = None, as_of: int | None = None, history: bool = False, tabular: bool = False) -> DataFrame:
        return run_query(self.spark, self.snapshot(as_of, history), text, inputs, rules, tabular)

    def result(self, text: str, **options: Any) -> Result:
        return Result(self.query(text, **options))

    def query_rows(self, text: str, **options: Any) -> list[dict[str, Any]]:
        return self.result(text, **options).rows()

    def query_json(self, text: str, **options: Any) -> str:
        return self.result(text, **options).json()

    def query_edn(self, text: str, **options: Any) -> str:
        return self.result(text, **options).edn()

    def history(self, text: str, **options: Any) -> DataFrame:
        return self.query(text, history=True, **options)
