"""Attributes, and the schema as it was at any time."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from tesserae.errors import PlanError

ONE, MANY = "one", "many"
#: Value types, in the order of the log's value columns: column and Spark type.
VALUE_TYPES: dict[str, tuple[str, T.DataType]] = {
    "Boolean": ("v_bool", T.BooleanType()),
    "Int64": ("v_int", T.LongType()),
    "Float64": ("v_float", T.DoubleType()),
    "String": ("v_str", T.StringType()),
    "Ref": ("v_ref", T.LongType()),
    "Timestamp": ("v_time", T.LongType()),
    "Uuid": ("v_uuid", T.BinaryType()),
}
VALUE_COLUMNS = [c for c, _ in VALUE_TYPES.values()]
#: valid_to of what holds until further notice.
FOREVER = (1 << 63) - 1
#: Microseconds are kept as BIGINT, as FOREVER is no timestamp.
LOG_SCHEMA = T.StructType([
    T.StructField("e", T.LongType(), False), T.StructField("a", T.IntegerType(), False),
    *[T.StructField(c, k) for c, k in VALUE_TYPES.values()],
    T.StructField("t", T.LongType(), False), T.StructField("op", T.BooleanType(), False), T.StructField("valid_from", T.LongType(), False),
    T.StructField("valid_to", T.LongType(), False), T.StructField("seq", T.LongType(), False),
])
FIRST_ID = 100


@dataclass(frozen=True)
class Attribute:
    id: int
    ident: str
    value_type: str
    unique: bool = False
    cardinality: str = ONE
    tx: int = 0
    ts: int = 0

    @property
    def column(self) -> str:
        return VALUE_TYPES[self.value_type][0]


class Catalog:
    """All attributes ever defined, with the transaction and time that did. Defining an ident again shadows it from then on."""

    def __init__(self, attributes: list[Attribute] | None = None):
        self.attributes = list(attributes or [])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Catalog) and self.attributes == other.attributes

    def at(self, ts: int | None = None) -> dict[str, Attribute]:
        """Idents and their attributes at a time (None: now)."""
        return {a.ident: a for a in self.attributes if ts is None or a.ts <= ts}

    def get(self, ident: str, ts: int | None = None) -> Attribute:
        found = self.at(ts).get(ident)
        if found is None:
            raise PlanError(f"no attribute {ident}")
        return found

    def with_new(self, ident: str, value_type: str, unique: bool = False, cardinality: str = ONE, tx: int = 0, ts: int = 0) -> "Catalog":
        if value_type not in VALUE_TYPES:
            raise PlanError(f"no value type {value_type}")
        new = Attribute(max([FIRST_ID - 1, *(a.id for a in self.attributes)]) + 1, ident, value_type, unique, cardinality, tx, ts)
        return Catalog([*self.attributes, new])

    def to_json(self) -> list[dict]:
        return [asdict(a) for a in self.attributes]

    @classmethod
    def from_json(cls, rows: list[dict]) -> "Catalog":
        return cls([Attribute(**r) for r in rows])
