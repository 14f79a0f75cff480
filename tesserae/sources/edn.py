"""Transactions in EDN and JSON, read to facts."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from tesserae.errors import SerializationError


@dataclass(frozen=True)
class Instant:
    """Microseconds since 1970."""

    micros: int


@dataclass(frozen=True)
class Ref:
    id: int


@dataclass(frozen=True)
class Fact:
    """One thing to assert or retract. valid_time: microseconds, None for the transaction's. expect: the value that must be held (compare and swap)."""

    e: int
    ident: str
    v: Any
    op: bool = True
    valid_time: int | None = None
    expect: Any = None


_TOKEN = re.compile(
    r"""(?P<space>[\s,]+|;[^\n]*)|(?P<set>\#\{)|(?P<mark>[\[\]{}])|(?P<string>"(?:\\.|[^"\\])*")
      |(?P<inst>\#inst\s+"[^"]*")|(?P<uuid>\#uuid\s+"[^"]*")|(?P<keyword>:[^\s,\[\]{}"]+)
      |(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s,\[\]{}]|$)|(?P<word>true|false|nil)(?=[\s,\[\]{}]|$)""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True)
class _Keyword:
    name: str


@dataclass(frozen=True)
class _Set:
    items: tuple


def micros(text: str) -> int:
    """Microseconds of an ISO 8601 time; without a zone it is UTC."""
    try:
        when = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise SerializationError(f"no time: {text!r}") from e
    when = when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)
    return (when - _EPOCH) // dt.timedelta(microseconds=1)


def _scalar(kind: str, text: str) -> Any:
    if kind == "string":
        return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[0]), text[1:-1], flags=re.DOTALL)
    if kind == "inst":
        return Instant(micros(text.split('"')[1]))
    if kind == "uuid":
        try:
            return uuid.UUID(text.split('"')[1])
        except ValueError as e:
            raise SerializationError(f"no uuid: {text}") from e
    if kind == "keyword":
        return _Keyword(text)
    if kind == "number":
        return float(text) if re.search("[.eE]", text) else int(text)
    return {"true": True, "false": False, "nil": None}[text]


def read_edn(text: str) -> Any:
    """One EDN value: vectors as lists, maps as lists of pairs in a tuple, sets as _Set."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SerializationError(f"unexpected {text[at]!r} at character {at}")
        at, kind, got = m.end(), m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "set" or got in ("[", "{"):
            stack.append((got, []))
        elif kind == "mark":
            opened, items = stack.pop()
            if {"[": "]", "{": "}", "#{": "}"}.get(opened) != got:
                raise SerializationError(f"{got} closes nothing at character {m.start()}")
            if opened == "{" and len(items) % 2:
                raise SerializationError("a map has a key without a value")
            made = items if opened == "[" else _Set(tuple(items)) if opened == "#{" else tuple(zip(items[::2], items[1::2]))
            stack[-1][1].append(made)
        else:
            stack[-1][1].append(_scalar(kind, got))
    if len(stack) > 1:
        raise SerializationError(f"{stack[-1][0]} is not closed")
    if len(stack[0][1]) != 1:
        raise SerializationError("one value is expected")
    return stack[0][1][0]


def _value(v: Any) -> Any:
    if isinstance(v, _Keyword):
        return v.name
    if v is None or isinstance(v, list | tuple | _Set):
        raise SerializationError(f"no value for a fact: {v!r}")
    return v


def _entity(e: Any) -> int:
    if isinstance(e, bool) or not isinstance(e, int) or not 0 <= e < 1 << 63:
        raise SerializationError(f"no entity id: {e!r}")
    return e


def parse_edn(text: str) -> list[Fact]:
    """[[:db/add e :attr value #inst?] [:db/retract ...] {:db/id e :attr value :attr #{values}}]"""
    whole = read_edn(text)
    if not isinstance(whole, list):
        raise SerializationError("a transaction is a vector")
    facts: list[Fact] = []
    for item in whole:
        if isinstance(item, list):
            if len(item) < 4 or item[0] not in (_Keyword(":db/add"), _Keyword(":db/retract")):
                raise SerializationError("a fact is [:db/add or :db/retract, entity, attribute, value]")
            if not isinstance(item[2], _Keyword):
                raise SerializationError(f"no attribute: {item[2]!r}")
            if len(item) > 4 and not isinstance(item[4], Instant):
                raise SerializationError("the fifth part of a fact is an #inst")
            facts.append(Fact(_entity(item[1]), item[2].name, _value(item[3]), item[0].name == ":db/add", item[4].micros if len(item) > 4 else None))
        elif isinstance(item, tuple):
            ids = [v for k, v in item if k == _Keyword(":db/id")]
            if not ids:
                raise SerializationError("a map has no :db/id")
            for k, v in item:
                if not isinstance(k, _Keyword):
                    raise SerializationError(f"no attribute: {k!r}")
                if k.name != ":db/id":
                    facts += [Fact(_entity(ids[-1]), k.name, _value(x)) for x in (v.items if isinstance(v, _Set) else (v,))]
        else:
            raise SerializationError("a transaction holds vectors and maps")
    return facts


def parse_json(text: str) -> tuple[list[Fact], int | None]:
    """{"facts": [{e, ident, v, op, cas_old_v?}], "tx_time"?}: the facts and the transaction's time."""
    try:
        whole = json.loads(text)
        facts = [Fact(_entity(f["e"]), f["ident"], f["v"], f.get("op", True), f.get("valid_time"), f.get("cas_old_v")) for f in whole["facts"]]
    except (ValueError, KeyError, TypeError) as e:
        raise SerializationError(f"no transaction: {e}") from e
    for f in facts:
        if f.v is None or isinstance(f.v, list | dict):
            raise SerializationError(f"no value for a fact: {f.v!r}")
    return facts, whole.get("tx_time")
