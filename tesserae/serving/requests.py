"""What the servers and the command line share: a request for a query, and results in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tesserae.database import Database
from tesserae.errors import InvalidQuery, TesseraeError
from tesserae.sources.formats import edn_rows, json_rows

#: Refusals that are the caller's to mend: this library's, and Spark's for values that don't fit (a cast, a division by zero under ANSI).
REFUSALS = (TesseraeError, PySparkException)


def refusal(e: Exception) -> str:
    """One line for the caller, without the plan or the JVM's stack."""
    return f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"


@dataclass(frozen=True)
class QueryRequest:
    """A query's text and options; `tabular` refuses pull, whose trees have no columns."""

    query: str
    as_of: int | None = None
    rules: str | None = None
    history: bool = False
    inputs: list[Any] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str | bytes) -> "QueryRequest":
        """{"query", "as_of"?, "rules"?, "history"?, "inputs"?}"""
        try:
            given = json.loads(text)
        except ValueError as e:
            raise InvalidQuery(f"no JSON: {e}") from e
        if not isinstance(given, dict) or not isinstance(given.get("query"), str):
            raise InvalidQuery("a request is an object with a query")
        kinds = {"query": str, "as_of": int, "rules": str, "history": bool, "inputs": list}
        given = {k: v for k, v in given.items() if v is not None}
        for k, v in given.items():
            if k not in kinds:
                raise InvalidQuery(f"a request has no {k}")
            if type(v) is not kinds[k]:
                raise InvalidQuery(f"{k} is of type {kinds[k].__name__}")
        # JSON has no tuples: rows of inputs come as lists.
        given["inputs"] = [[tuple(r) if isinstance(r, list) else r for r in i] if isinstance(i, list) else i for i in given.get("inputs", [])]
        return cls(**given)

    def frame(self, db: Database, tabular: bool = False) -> DataFrame:
        return db.query(self.query, self.inputs, self.rules, self.as_of, self.history, tabular)


def text_pieces(df: DataFrame, form: str) -> Iterator[str]:
    """A result as one JSON array or EDN vector, in pieces. The driver holds the rows of one partition at a time.

    The first row is computed before the first piece is handed out, so that a query that fails does so before an answer starts.
    """
    rows, column, between = (edn_rows(df), "edn", " ") if form == "edn" else (json_rows(df), "json", ",")
    found = rows.toLocalIterator()
    head = [r[column] for r in islice(found, 1)]
    yield "["
    for i, text in enumerate(chain(head, (r[column] for r in found))):
        yield (between if i else "") + text
    yield "]"
