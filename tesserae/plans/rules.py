"""Rules: inlined where they don't recur; else a fixpoint over distinct rows.

A transitive closure (a step, and a step followed by the rule) is computed by path doubling, in a number of rounds logarithmic in the longest path;
if a call fixes one end, only what is reached from there is followed. Other recursive rules, mutual ones included, are
evaluated from the rows that the last round found (all rows, where a body calls the group more than once).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.errors import PlanError
from tesserae.shared import written

from .ast import Call, Not, Or, Pattern, Rule, RuleCall, RuleSet, Var, variables
from .compiler import Compiler, Context, col

MAX_ROUNDS = 1000
HOPS = 4
#: Rounds after which a growing relation is written as one table.
GATHER = 4


def calls_in(node: Any) -> list[RuleCall]:
    if isinstance(node, RuleCall):
        return [node]
    if isinstance(node, tuple | list):
        return [c for x in node for c in calls_in(x)]
    if isinstance(node, Or):
        return calls_in(node.branches)
    return calls_in(node.body) if isinstance(node, Not) else []


def renamed(node: Any, names: dict[str, Any]) -> Any:
    """A clause with variables replaced by terms."""
    if isinstance(node, Var):
        return names.get(node.name, node)
    if isinstance(node, tuple):
        return tuple(renamed(x, names) for x in node)
    if isinstance(node, Pattern):
        return Pattern(*(renamed(x, names) for x in (node.e, node.a, node.v, node.t, node.op)))
    if isinstance(node, RuleCall):
        return RuleCall(node.name, renamed(node.args, names))
    if isinstance(node, Call):
        new = [names.get(v, Var(v)) for v in node.binding]
        return Call(node.name, renamed(node.args, names), tuple(v.name for v in new), node.kind)
    if isinstance(node, Or | Not):
        join = None if node.join is None else tuple(names.get(v, Var(v)).name for v in node.join)
        return Or(renamed(node.branches, names), join) if isinstance(node, Or) else Not(renamed(node.body, names), join)
    return node


class Rules:
    def __init__(self, context: Context, rules: RuleSet):
        self.rules = rules.rules
        self.context = Context(context.spark, context.facts, {}, [], self.relation)
        self._done: dict[str, DataFrame] = {}
        #: Relations of the group of rules that is being evaluated.
        self._open: dict[str, DataFrame] = {}
        reach = {n: {c.name for r in own for c in calls_in(r.body)} & set(self.rules) for n, own in self.rules.items()}
        for k in self.rules:
            for n in self.rules:
                if k in reach[n]:
                    reach[n] |= reach[k]
        self.groups = {n: sorted(m for m in self.rules if n in reach[m] and m in reach[n]) for n in self.rules}
        for n, own in self.rules.items():
            for r in own:
                negated = [c.name for x in r.body if isinstance(x, Not) for c in calls_in(x)]
                if set(negated) & set(self.groups[n]):
                    raise PlanError(f"rule {n} recurs through a negation")

    def relation(self, name: str, constants: dict[int, Any]) -> DataFrame:
        """The rows of a rule, columns col0, col1, ...; with constants perhaps only those that they select."""
        if name in self._open:
            return self._open[name]
        if name not in self.rules:
            raise PlanError(f"no rule {name}")
        if not self.groups[name]:
            return self._inline(name)
        if name not in self._done:
            step = self._closure_step(name)
            if step is not None and len(constants) == 1:
                return self._reached(step, *next(iter(constants.items())))
            if step is not None:
                self._done[name] = self._doubled(step)
            else:
                self._done.update(self._fixpoint(self.groups[name]))
        return self._done[name]

    def _body(self, rule: Rule) -> DataFrame:
        # A head variable that the body equates with nothing but binds is a column; one used twice in the head is two.
        rows = Compiler(self.context).where(rule.body)
        missing = [v for v in rule.head if v not in rows.columns]
        if missing:
            raise PlanError(f"rule {rule.name}: not bound: " + ", ".join("?" + v for v in missing))
        return rows.select(*[col(v).alias(f"col{i}") for i, v in enumerate(rule.head)])

    def _inline(self, name: str) -> DataFrame:
        parts = [self._body(r) for r in self.rules[name]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # Transitive closures

    def _closure_step(self, name: str) -> DataFrame | None:
        """The step's rows (col0, col1), if the rule is one base body and that body followed by the rule (on either side)."""
        own = self.rules[name]
        base = [r for r in own if not calls_in(r.body)]
        more = [r for r in own if calls_in(r.body)]
        if len(base) != 1 or len(more) != 1 or len(base[0].head) != 2 or len(set(base[0].head)) != 2 or self.groups[name] != [name]:
            return None
        calls = [c for c in more[0].body if isinstance(c, RuleCall)]
        rest = tuple(c for c in more[0].body if not isinstance(c, RuleCall))
        if len(calls) != 1 or calls[0].name != name or not rest or not all(isinstance(a, Var) for a in calls[0].args) or calls_in(rest):
            return None
        (x, y), (p, q) = more[0].head, (a.name for a in calls[0].args)
        if q == y and p not in (x, y):
            ends = (x, p)
        elif p == x and q not in (x, y):
            ends = (q, y)
        else:
            return None
        a, b = base[0].head
        if _canonical(base[0].body, (a, b)) != _canonical(rest, ends):
            return None
        return self._body(base[0]).distinct()

    def _doubled(self, step: DataFrame) -> DataFrame:
        """Paths of up to 2, 4, 8, ... steps, until none is new. A new path is two known ones, of which one is of the last round."""
        paths = fresh = written(step, "paths")
        for turn in range(MAX_ROUNDS):
            a, b = (fresh.select("col0", F.col("col1").alias("mid")), paths.select("col0", F.col("col1").alias("mid"))), (paths.select(F.col("col0").alias("mid"), "col1"), fresh.select(F.col("col0").alias("mid"), "col1"))
            longer = a[0].join(b[0], "mid").select("col0", "col1")
            if turn:
                longer = longer.union(a[1].join(b[1], "mid").select("col0", "col1"))
            fresh = written(longer.distinct().join(paths, ["col0", "col1"], "left_anti"), "paths")
            if fresh.isEmpty():
                return paths
            paths = self._gathered(paths, fresh, turn)
        raise PlanError(f"a rule did not end in {MAX_ROUNDS} rounds")

    @staticmethod
    def _gathered(total: DataFrame, fresh: DataFrame, turn: int) -> DataFrame:
        """Both as one; every so many rounds as one table, so that no plan grows with the rounds."""
        total = total.unionByName(fresh)
        return written(total, "total") if turn % GATHER == GATHER - 1 else total

    def _reached(self, step: DataFrame, place: int, value: Any) -> DataFrame:
        """What is reached from one end, by frontier."""
        here, there = f"col{place}", f"col{1 - place}"
        step = written(step, "step")
        found = frontier = written(step.where(F.col(here) == F.lit(value)).select(there), "reached")
        for turn in range(MAX_ROUNDS):
            if frontier.isEmpty():
                fixed = F.lit(value).cast(step.schema[here].dataType).alias(here)
                return found.select(*[fixed if c == here else F.col(c) for c in ("col0", "col1")])
            # HOPS steps in one job, as a round costs more than a step of few rows.
            hop, hops = frontier, []
            for _ in range(HOPS):
                hop = step.join(hop.select(F.col(there).alias(here)), here, "left_semi").select(there).distinct()
                hops.append(hop)
            new = hops[0]
            for h in hops[1:]:
                new = new.union(h)
            frontier = written(new.distinct().join(found, there, "left_anti"), "reached")
            found = self._gathered(found, frontier, turn)
        raise PlanError(f"a rule did not end in {MAX_ROUNDS} rounds")

    # Fixpoints

    def _fixpoint(self, group: list[str]) -> dict[str, DataFrame]:
        inner = set(group)
        recursive = {n: [r for r in self.rules[n] if {c.name for c in calls_in(r.body)} & inner] for n in group}
        total, delta = {}, {}
        for n in group:
            base = [r for r in self.rules[n] if r not in recursive[n]]
            parts = [self._body(r) for r in base]
            if not parts:
                continue
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            total[n] = delta[n] = written(out.distinct(), n)
        if not total:
            raise PlanError(f"rule {group[0]} has no definition that ends")
        for n in group:
            if n not in total:
                kinds = next(iter(total.values())).schema
                width = len(self.rules[n][0].head)
                kind = kinds[0].dataType
                total[n] = delta[n] = self.context.spark.createDataFrame([], ", ".join(f"col{i} {kind.simpleString()}" for i in range(width)))
        for turn in range(MAX_ROUNDS):
            fresh = {}
            for n in group:
                parts = []
                for r in recursive[n]:
                    used = [c.name for c in calls_in(r.body) if c.name in inner]
                    self._open = delta if len(used) == 1 else total
                    try:
                        parts.append(self._body(r))
                    finally:
                        self._open = {}
                if parts:
                    out = parts[0]
                    for p in parts[1:]:
                        out = out.unionByName(p)
                    fresh[n] = written(out.distinct().join(total[n], total[n].columns, "left_anti"), n)
            if all(f.isEmpty() for f in fresh.values()):
                return total
            delta = {n: fresh.get(n, total[n].limit(0)) for n in group}
            total = {n: self._gathered(total[n], fresh[n], turn) if n in fresh else total[n] for n in group}
        raise PlanError(f"rule {group[0]} did not end in {MAX_ROUNDS} rounds")


def _canonical(body: tuple, ends: tuple[str, str]) -> Any:
    """A body with its ends named alike and its other variables by order of use, to compare with another."""
    names = {ends[0]: Var("_from"), ends[1]: Var("_to")}
    for v in variables(body):
        names.setdefault(v, Var(f"_v{len(names)}"))
    return renamed(body, names)


