"""What queries and transactions can be refused for."""


class TesseraeError(Exception):
    """The root of all errors of this library."""


class ParseError(TesseraeError):
    """A query, ruleset or transaction text breaks the grammar."""


class PlanError(TesseraeError):
    """A query is well-formed but can't be planned: an unknown attribute or rule, an unbound variable."""


class InvalidQuery(TesseraeError):
    """Inputs don't fit the :in clause, or the output format doesn't fit the query."""


class TypeMismatch(TesseraeError):
    """A value's type is not its attribute's."""


class UndefinedAttribute(TesseraeError):
    """A fact names an attribute that does not exist, and inference is off."""


class CompareAndSwapFailed(TesseraeError):
    """The value held is not the one expected."""


class UniqueConstraintViolation(TesseraeError):
    """A unique value has another owner at that time, or will have."""


class SerializationError(TesseraeError):
    """A transaction text or wire row can't be read."""


class Superseded(TesseraeError):
    """Another writer committed a manifest first."""
