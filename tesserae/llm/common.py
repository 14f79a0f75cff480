"""What the operators of this subpackage share: written intermediate tables, columns handed through, hashing splits, byte batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.shared import discard, shared_dir, stored_bytes, written  # noqa: F401

WORD_BREAK = r"[^\x20\x09-\x0D]+"
#: A written table of up to this many bytes on disk may be broadcast.
BROADCAST_BYTES = 8 << 20


class Kept:
    """Columns that an operator hands through, packed as the struct `kept`, so that no name of theirs clashes with one of the operator's.

    A kept column whose name the operator itself returns (made) gives way to the operator's.
    """

    def __init__(self, docs: DataFrame, keep: list[str], made: list[str]):
        taken = {m.lower() for m in made}
        self.names = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
        own = [F.col("`" + c.replace("`", "``") + "`") for c in self.names] or [F.lit(True)]
        self.column: Column = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(own)]).alias("kept")
        self.field = T.StructField("kept", docs.select(self.column).schema["kept"].dataType)
        self.made = made

    def schema(self, ddl: str) -> T.StructType:
        """The struct's field and those of a DDL string."""
        return T.StructType([self.field, *T.StructType.fromDDL(ddl).fields])

    def out(self, df: DataFrame) -> DataFrame:
        """The kept columns by their names, then the operator's."""
        return df.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(self.names)], *self.made)


def content_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash of some columns (nulls are values): rows of equal content have equal keys, and no null among them."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if it is small on disk; else Spark joins it by shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def let(value: Column, fn) -> Column:
    """fn(value), value being computed once a row even where fn uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the split into learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: list[bytes], limit: int):
    """Runs (first, last + 1) of texts of about limit bytes each; a longer text is a run of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
