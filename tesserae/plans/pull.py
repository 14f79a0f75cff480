"""Pull: entities as nested structures. A pattern's depth is fixed, so it compiles to one scan a table and one join a level of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.errors import PlanError
from tesserae.sources.base import FactSource
from tesserae.sources.schema import MANY

from .ast import PullAttr


def without_values(kind: T.StructType) -> Column:
    """A structure of this type without any value."""
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])


def pulled(facts: FactSource, entities: DataFrame | None, attrs: tuple[PullAttr, ...]) -> DataFrame:
    """(e, tree) for entities that have any of the attributes, those of the column e at least (None: all): tree is a struct with a field for each attribute, null where absent.

    The wildcard stands for all attributes not named otherwise. A Many attribute is a sorted array of distinct values. Under a reference that the entity
    has, a target without any of the attributes is an empty structure.
    """
    named = {a.name: a for a in attrs if a.name != "*"}
    if any(a.name == "*" for a in attrs):
        named |= {i: PullAttr(i) for i in facts.idents() if i not in named}
    kinds = {i: facts.attribute(i) for i in sorted(named)}
    for i, a in named.items():
        if a.sub is not None and kinds[i].value_type not in ("Ref", "Int64"):
            raise PlanError(f"{i} is no reference")
    groups: dict[str, list[str]] = {}
    for i, k in kinds.items():
        if k.cardinality != MANY:
            groups.setdefault(facts.star_group(i) or i, []).append(i)
    many = [i for i, k in kinds.items() if k.cardinality == MANY]
    stars = {g: facts.outer_star(own, entities) for g, own in groups.items()}
    if len(groups) == 1 and not many:
        # All from one row an entity: the scan itself, to be joined where it is asked for.
        (own, out), = [(groups[g], s) for g, s in stars.items()]
        fields = {i: F.col(f"v{n}") for n, i in enumerate(own)}
    else:
        ids = entities if entities is not None else _all_ids(facts, list(kinds), stars)
        out, fields = ids.select("e").where("e IS NOT NULL").distinct(), {}
        for g, (name, star) in enumerate(sorted(stars.items())):
            own = groups[name]
            out = out.join(star.select("e", *[F.col(f"v{n}").alias(f"g{g}_{n}") for n in range(len(own))]), "e", "left")
            fields |= {i: F.col(f"g{g}_{n}") for n, i in enumerate(own)}
        for n, i in enumerate(many):
            rows = facts.scan(i).select("e", "v").join(out.select("e"), "e", "left_semi")
            gathered = F.array_sort(F.collect_set("v"))
            if named[i].sub is not None:
                rows = _below(facts, rows, "v", named[i].sub)
                gathered = F.collect_list("v")
            out = out.join(rows.groupBy("e").agg(gathered.alias(f"m{n}")), "e", "left")
            fields[i] = F.col(f"m{n}")
    out = out.select("e", *[fields[i].alias(f"f{n}") for n, i in enumerate(kinds)])
    for n, i in enumerate(kinds):
        if named[i].sub is not None and kinds[i].cardinality != MANY:
            out = _below(facts, out, f"f{n}", named[i].sub)
    tree = F.struct(*[F.col(f"f{n}").alias(i) for n, i in enumerate(kinds)])
    return out.select("e", tree.alias("tree"))


def _all_ids(facts: FactSource, idents: list[str], stars: dict[str, DataFrame]) -> DataFrame:
    out = None
    for rows in [*(s.select("e") for s in stars.values()), *(facts.scan(i).select("e") for i in idents if facts.attribute(i).cardinality == MANY)]:
        out = rows if out is None else out.union(rows)
    return out


def _below(facts: FactSource, rows: DataFrame, column: str, attrs: tuple[PullAttr, ...]) -> DataFrame:
    """rows with the references in a column replaced by the trees under them."""
    below = pulled(facts, rows.select(F.col(column).alias("e")) if facts.aggregates else None, attrs)
    empty = without_values(below.schema["tree"].dataType)
    joined = rows.join(below.select(F.col("e").alias(column), F.col("tree").alias("_tree")), column, "left")
    tree = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_tree"), empty))
    return joined.withColumn("_tree", tree).drop(column).withColumnRenamed("_tree", column)
