"""Compiles clauses to DataFrames.

What is known so far is a binding relation: a DataFrame with a column for each bound variable. Data patterns, rules and unions give
relations that are joined on the variables they share; predicates and functions apply once their arguments are bound, and
negations last, so the order of clauses in the text does not matter. Catalyst orders the joins and pushes the filters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import PlanError
from tesserae.functions import registry
from tesserae.operators import ranks
from tesserae.sources.base import FactSource

from .ast import Blank, Call, Clause, Const, DataSource, Keyword, Not, Or, Pattern, RuleCall, Term, Var, variables


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Context:
    spark: SparkSession
    facts: FactSource
    #: Inputs of one value: variable to value.
    constants: dict[str, Any]
    #: Inputs of many values.
    inputs: list[DataFrame]
    #: The relation of a rule call: name and constant arguments by place to a DataFrame with columns col0, col1, ...
    rule: Callable[[str, dict[int, Any]], DataFrame] | None = None

    def term(self, t: Term) -> Term:
        """The term, with a variable that has one value replaced by it."""
        return Const(self.constants[t.name]) if isinstance(t, Var) and t.name in self.constants else t


def _bound(df: DataFrame | None) -> list[str]:
    return df.columns if df is not None else []


def join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    """Inner join on the variables both bind; a product where there are none."""
    if a is None:
        return b
    shared = [v for v in a.columns if v in b.columns]
    return a.join(b, shared) if shared else a.crossJoin(b)


def _select(rows: DataFrame, places: list[tuple[Column, Term]]) -> DataFrame:
    """Filters places with constants, equates places with one variable, and names the rest by their variables."""
    named: dict[str, Column] = {}
    for c, t in places:
        if isinstance(t, Const):
            rows = rows.where(c == F.lit(t.value))
        elif isinstance(t, Keyword):
            rows = rows.where(c == F.lit(t.name))
        elif isinstance(t, Var):
            if t.name in named:
                rows = rows.where(named[t.name] == c)
            else:
                named[t.name] = c
    return rows.select(*[c.alias(v) for v, c in named.items()]) if named else rows.select(F.lit(True).alias("_exists"))


class Compiler:
    def __init__(self, context: Context):
        self.context = context

    def where(self, clauses: tuple[Clause, ...], start: DataFrame | None = None) -> DataFrame:
        """The binding relation of the clauses, joined to start."""
        flat: list[Clause] = []
        for c in clauses:
            flat += list(c) if isinstance(c, tuple) else [c]
        relations = [*self._patterns([c for c in flat if isinstance(c, Pattern)]), *[self._rule(c) for c in flat if isinstance(c, RuleCall)]]
        wanted = {v for c in flat for v in variables(c)}
        if start is None:
            relations = [*[i for i in self.context.inputs if wanted & set(i.columns)], *relations]
        known = self._joined(start, relations)
        known = self._functions(known, [c for c in flat if isinstance(c, Call)], [c for c in flat if isinstance(c, Or)])
        for c in flat:
            if isinstance(c, Not):
                known = self._not(known, c)
        if known is None:
            raise PlanError("nothing in :where binds a variable")
        return known.drop("_exists")

    def _joined(self, known: DataFrame | None, relations: list[DataFrame]) -> DataFrame | None:
        """Joins those first that share a variable with what is known, so products come last."""
        left = list(relations)
        while left:
            near = next((r for r in left if known is None or set(r.columns) & set(known.columns) - {"_exists"}), left[0])
            left = [r for r in left if r is not near]
            if "_exists" in near.columns:
                # A pattern without variables only asks whether there are such facts, as often as they are.
                near = near.drop("_exists") if len(near.columns) > 1 else near.withColumnRenamed("_exists", f"_exists{len(left)}")
            known = join(known, near)
        return known.drop(*[c for c in known.columns if c.startswith("_exists")]) if known is not None and any(not c.startswith("_exists") for c in known.columns) else known

    # Counts over an inequality between relations

    def counted(self, clauses: tuple[Clause, ...], keys: list[str], names: list[str]) -> DataFrame | None:
        """For each of keys, how many rows bind each of names, as count0, count1, ...: by rank, where all clauses are patterns and predicates and just one inequality stands between two sides.

        One side has the keys; each hangs together by shared variables. None for other clauses, whose rows must be made to be counted.
        """
        flat = [x for c in clauses for x in (c if isinstance(c, tuple) else (c,))]
        calls = [c for c in flat if isinstance(c, Call)]
        if not any(c.name in ranks.FLIPPED for c in calls) or any(not isinstance(c, Pattern | Call) or isinstance(c, Call) and c.binding for c in flat):
            return None
        wanted = {v for c in flat for v in variables(c)}
        relations = [*[i for i in self.context.inputs if wanted & set(i.columns)], *self._patterns([c for c in flat if isinstance(c, Pattern)])]
        needs = {id(c): {v for v in variables(c.args) if v not in self.context.constants} for c in calls}
        if any("_exists" in r.columns for r in relations):
            return None
        for c in calls:
            if c.name not in ranks.FLIPPED or len(c.args) != 2 or len(needs[id(c)]) != 2:
                continue
            (a, b) = (t.name for t in c.args)
            for x, op, y in ((a, c.name, b), (b, ranks.FLIPPED[c.name], a)):
                for mine in ([r for r in relations if {x, *keys} & set(r.columns)], [r for r in relations if y not in r.columns]):
                    theirs = [r for r in relations if not any(r is m for m in mine)]
                    has, other = ({v for r in side for v in r.columns} for side in (mine, theirs))
                    apart = x in has - other and y in other - has and {*keys} <= has and {*names} <= has | other
                    if apart and all(needs[id(p)] <= has or needs[id(p)] <= other for p in calls if p is not c) and self._connected(mine) and self._connected(theirs):
                        rest = [p for p in calls if p is not c]
                        left = self._functions(self._joined(None, mine), [p for p in rest if needs[id(p)] <= has], [])
                        right = self._functions(self._joined(None, theirs), [p for p in rest if not needs[id(p)] <= has], [])
                        return self._ranked(left, right, x, op, y, keys, names)
        return None

    @staticmethod
    def _connected(relations: list[DataFrame]) -> bool:
        left, known = list(relations), set(relations[0].columns) if relations else set()
        while near := [r for r in left if set(r.columns) & known]:
            left = [r for r in left if not any(r is n for n in near)]
            known |= {v for r in near for v in r.columns}
        return bool(relations) and not left

    def _ranked(self, mine: DataFrame, theirs: DataFrame, x: str, op: str, y: str, keys: list[str], names: list[str]) -> DataFrame | None:
        kind = ranks.common_type(mine.schema[x].dataType, theirs.schema[y].dataType)
        if kind is None:
            return None
        beyond = [v for v in dict.fromkeys(names) if v not in mine.columns]
        rows = ranks.met(mine, theirs, [v for v in mine.columns if v in theirs.columns], x, op, y, beyond, kind)
        each = [F.when(col(v).isNotNull(), F.col("_met")) if v in mine.columns else F.col(f"_met{beyond.index(v)}") for v in names]
        sums = [F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(f"count{i}") for i, e in enumerate(each)]
        return rows.groupBy(*[col(k) for k in keys]).agg(*sums)

    # Data patterns

    def _patterns(self, patterns: list[Pattern]) -> list[DataFrame]:
        facts, out, stars = self.context.facts, [], {}
        for p in patterns:
            p = Pattern(*[self.context.term(x) for x in (p.e, p.a, p.v, p.t, p.op)])
            plain = isinstance(p.a, Keyword) and isinstance(p.t, Blank) and isinstance(p.op, Blank) and isinstance(p.e, Var | Const)
            group = facts.star_group(p.a.name) if plain else None
            if group is None:
                out.append(self._pattern(p))
            else:
                stars.setdefault((p.e, group), []).append(p)
        for (e, _), own in stars.items():
            # Patterns on one entity are read in one pass, without joins.
            rows = facts.star([p.a.name for p in own]) if len(own) > 1 else None
            if rows is None:
                out += [self._pattern(p) for p in own]
            else:
                out.append(_select(rows, [(F.col("e"), e), *[(F.col(f"v{i}"), p.v) for i, p in enumerate(own)]]))
        return out

    def _pattern(self, p: Pattern) -> DataFrame:
        if isinstance(p.a, Keyword):
            rows = self.context.facts.scan(p.a.name)
            places = [(F.col("e"), p.e), (F.col("v"), p.v)]
        elif isinstance(p.a, Var | Blank):
            rows = self.context.facts.scan_any()
            v = Const(str(p.v.value).lower() if isinstance(p.v.value, bool) else str(p.v.value)) if isinstance(p.v, Const) else p.v
            places = [(F.col("e"), p.e), (F.col("a"), p.a), (F.col("v"), v)]
        else:
            raise PlanError("an attribute is a keyword, a variable or blank")
        return _select(rows, [*places, (F.col("t"), p.t), (F.col("op"), p.op)])

    # Rules

    def _rule(self, c: RuleCall) -> DataFrame:
        if self.context.rule is None:
            raise PlanError(f"no rule {c.name}")
        args = [self.context.term(a) for a in c.args]
        args = [Const(a.name) if isinstance(a, Keyword) else a for a in args if not isinstance(a, DataSource)]
        rows = self.context.rule(c.name, {i: a.value for i, a in enumerate(args) if isinstance(a, Const)})
        if len(rows.columns) != len(args):
            raise PlanError(f"rule {c.name} takes {len(rows.columns)} arguments, not {len(args)}")
        return _select(rows, [(F.col(f"col{i}"), a) for i, a in enumerate(args)])

    # Predicates, functions and unions

    def _functions(self, known: DataFrame | None, calls: list[Call], unions: list[Or]) -> DataFrame | None:
        """Applies what can be applied until nothing is left: each union as soon as the variables of its predicates are bound."""
        calls, unions = list(calls), list(unions)
        while calls or unions:
            bound = {*_bound(known), *self.context.constants}
            ready = next((c for c in calls if all(v in bound for v in variables(c.args))), None)
            if ready is not None:
                calls.remove(ready)
                known = self._call(known, ready)
                continue
            union = next((u for u in unions if all(v in bound for b in u.branches for v in self._needs(b))), None)
            if union is None:
                missing = sorted({v for c in calls for v in variables(c.args)} | {v for u in unions for b in u.branches for v in self._needs(b)})
                raise PlanError("unbound: " + ", ".join("?" + v for v in missing if v not in bound))
            unions.remove(union)
            known = self._or(known, union)
        return known

    def _needs(self, clauses: Any) -> list[str]:
        """Variables that predicates among these clauses use and no clause here binds."""
        own = clauses if isinstance(clauses, tuple) else (clauses,)
        gives = {v for c in own if isinstance(c, Pattern | RuleCall | Or) for v in variables(c)} | {v for c in own if isinstance(c, Call) for v in c.binding}
        inner = {v for c in own if isinstance(c, Or) for b in c.branches for v in self._needs(b)}
        return [v for v in {*(v for c in own if isinstance(c, Call) for v in variables(c.args)), *inner} if v not in gives and v not in self.context.constants]

    def _argument(self, known: DataFrame | None, t: Term) -> tuple[Column, Any]:
        t = self.context.term(t)
        if isinstance(t, Var):
            return col(t.name), known.schema[t.name].dataType
        if isinstance(t, Const | Keyword):
            c = F.lit(t.value if isinstance(t, Const) else t.name)
            return c, self.context.spark.range(0).select(c.alias("x")).schema["x"].dataType
        return F.lit(None), None

    def value(self, known: DataFrame | None, c: Call) -> Column:
        args = [self._argument(known, a) for a in c.args]
        return registry.call(c.name, [a for a, _ in args], [k for _, k in args])

    def _call(self, known: DataFrame | None, c: Call) -> DataFrame:
        known = self.context.spark.range(1).select(F.lit(True).alias("_exists")) if known is None else known
        made = self.value(known, c)
        if not c.binding:
            return known.where(made)
        if c.kind == "scalar":
            return self._bind(known, c.binding[0], made)
        if c.kind == "tuple":
            for i, v in enumerate(c.binding):
                known = self._bind(known, v, F.get(made, i))
            return known
        rows = known.withColumn("_each", F.explode(made))
        for i, v in enumerate(c.binding):
            rows = self._bind(rows, v, F.get("_each", i) if len(c.binding) > 1 else F.col("_each"))
        return rows.drop("_each")

    def _bind(self, known: DataFrame, v: str, made: Column) -> DataFrame:
        if v in self.context.constants:
            return known.where(made == F.lit(self.context.constants[v]))
        return known.where(col(v) == made) if v in known.columns else known.withColumn(v, made)

    def _or(self, known: DataFrame | None, c: Or) -> DataFrame:
        names = list(c.join) if c.join is not None else None
        if all(isinstance(b, Call) and not b.binding for b in c.branches) and known is not None:
            any_of = F.lit(False)
            for b in c.branches:
                any_of = any_of | F.coalesce(self.value(known, b), F.lit(False))
            return known.where(any_of)
        out = None
        for b in c.branches:
            clauses = b if isinstance(b, tuple) else (b,)
            needs = self._needs(clauses)
            start = known.select(*[col(v) for v in dict.fromkeys(v for v in variables(clauses) if v in known.columns)]).distinct() if needs else None
            rows = self.where(clauses, start)
            if names is None:
                names = [v for v in variables(clauses) if v in rows.columns]
            lacking = [v for v in names if v not in rows.columns and v not in self.context.constants]
            if lacking:
                raise PlanError("or: not bound in every branch: " + ", ".join("?" + v for v in lacking))
            rows = rows.select(*[col(v) for v in names if v not in self.context.constants])
            out = rows if out is None else out.unionByName(rows)
        return join(known, out.distinct())

    # Negation

    def _not(self, known: DataFrame | None, c: Not) -> DataFrame:
        if known is None:
            raise PlanError("not: nothing is bound outside it")
        body = tuple(x for b in c.body for x in (b if isinstance(b, tuple) else (b,)))
        inside = variables(body)
        if c.join is not None:
            for v in c.join:
                if v not in inside or v not in known.columns and v not in self.context.constants:
                    raise PlanError(f"not-join: ?{v} is not bound inside and outside")
        shared = [v for v in (c.join if c.join is not None else inside) if v in known.columns]
        if all(isinstance(x, Call) and not x.binding for x in body):
            every = F.lit(True)
            for x in body:
                if lacking := [v for v in variables(x.args) if v not in known.columns and v not in self.context.constants]:
                    raise PlanError("not: unbound: " + ", ".join("?" + v for v in lacking))
                every = every & F.coalesce(self.value(known, x), F.lit(False))
            return known.where(~every)
        needs = [v for v in self._needs(body) if v in known.columns]
        start = known.select(*[col(v) for v in dict.fromkeys([*shared, *needs])]).distinct() if needs and c.join is None else None
        rows = self.where(body, start)
        if not shared:
            return known.join(rows.select(F.lit(True).alias("_any")).limit(1), F.lit(True), "left_anti")
        return known.join(rows.select(*[col(v) for v in shared]), shared, "left_anti")
