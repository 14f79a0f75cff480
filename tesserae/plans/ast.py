"""The parts of a Datalog query."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Blank:
    pass


@dataclass(frozen=True)
class Keyword:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class DataSource:
    name: str


Term = Var | Blank | Keyword | Const | DataSource


@dataclass(frozen=True)
class Pattern:
    """[e a v t op]; missing positions are blank."""

    e: Term
    a: Term
    v: Term = Blank()
    t: Term = Blank()
    op: Term = Blank()


@dataclass(frozen=True)
class Call:
    """[(name args...) binding?]; kind is scalar, tuple or relation."""

    name: str
    args: tuple[Term, ...]
    binding: tuple[str, ...] = ()
    kind: str = "scalar"


@dataclass(frozen=True)
class RuleCall:
    name: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class Or:
    branches: tuple[Any, ...]
    join: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Not:
    body: tuple[Any, ...]
    join: tuple[str, ...] | None = None


Clause = Pattern | Call | RuleCall | Or | Not


@dataclass(frozen=True)
class Aggregate:
    name: str
    var: str


@dataclass(frozen=True)
class PullAttr:
    """name "*" is all attributes; sub is the pattern under a reference."""

    name: str
    sub: tuple["PullAttr", ...] | None = None


@dataclass(frozen=True)
class Pull:
    var: str
    attrs: tuple[PullAttr, ...]


@dataclass(frozen=True)
class Input:
    """kind: source, scalar, collection, tuple or relation."""

    kind: str
    vars: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    find: tuple[Var | Aggregate | Pull, ...]
    inputs: tuple[Input, ...] | None
    where: tuple[Clause, ...]


@dataclass(frozen=True)
class Rule:
    name: str
    head: tuple[str, ...]
    body: tuple[Clause, ...]


@dataclass
class RuleSet:
    rules: dict[str, list[Rule]] = field(default_factory=dict)


def variables(node: Any) -> list[str]:
    """Names of the variables in a clause, term or tuple of them, in order of first use."""
    found: list[str] = []

    def visit(x: Any) -> None:
        if isinstance(x, Var):
            found.append(x.name)
        elif isinstance(x, Pattern):
            for y in (x.e, x.a, x.v, x.t, x.op):
                visit(y)
        elif isinstance(x, Call):
            visit(x.args)
            found.extend(x.binding)
        elif isinstance(x, RuleCall):
            visit(x.args)
        elif isinstance(x, Or):
            found.extend(x.join) if x.join else visit(x.branches)
        elif isinstance(x, Not):
            visit(x.body)
        elif isinstance(x, tuple | list):
            for y in x:
                visit(y)

    visit(node)
    return list(dict.fromkeys(found))
