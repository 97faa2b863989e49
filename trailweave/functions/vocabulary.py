"""Relation vocabulary: symmetric, transitive and inverse relations as an immutable value."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    symmetric: bool = False
    transitive: bool = False
    inverse: str | None = None
    description: str = ""


# The built-in relations, which results depend on.
_TRANSITIVE_PAIRS = (("is_a", "subsumes"), ("part_of", "has_part"))
_PAIRS = (
    ("causes", "caused_by"), ("prevents", "prevented_by"), ("requires", "required_by"),
    ("example_of", "has_example"), ("conforms_to", "specified_by"), ("used_in", "uses"),
)
_SYMMETRIC = ("contradicts", "compatible_with", "similar_to", "related_to")


def _builtin() -> dict[str, Relation]:
    out = {name: Relation(symmetric=True) for name in _SYMMETRIC}
    for pairs, transitive in ((_TRANSITIVE_PAIRS, True), (_PAIRS, False)):
        for a, b in pairs:
            out[a], out[b] = Relation(transitive=transitive, inverse=b), Relation(transitive=transitive, inverse=a)
    return out


@dataclass(frozen=True)
class Vocabulary:
    """Names and properties of relations. ``register`` returns another vocabulary; none is global."""

    relations: Mapping[str, Relation] = field(default_factory=_builtin)

    def register(self, name: str, **properties) -> Vocabulary:
        """With ``name``; a named inverse that is missing is added as its mirror."""
        own = Relation(**properties)
        known = {**self.relations, name: own}
        if own.inverse and own.inverse not in known:
            known[own.inverse] = replace(own, inverse=name, description=f"mirror of {name}")
        return Vocabulary(known)

    def __contains__(self, name: str) -> bool:
        return name in self.relations

    def properties(self, name: str) -> Relation:
        return self.relations.get(name, Relation())

    def inverse_of(self, name: str | None) -> str | None:
        own = self.relations.get(name)
        return None if own is None else name if own.symmetric else own.inverse

    def names(self) -> list[str]:
        return sorted(self.relations)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``name, symmetric, transitive, inverse, description``; a symmetric relation is its own inverse."""
        rows = [(n, r.symmetric, r.transitive, self.inverse_of(n), r.description) for n, r in sorted(self.relations.items())]
        return spark.createDataFrame(rows, "name string, symmetric boolean, transitive boolean, inverse string, description string")

    def inverse_column(self, name: Column) -> Column:
        """The inverse of a column's relation, as an expression without a join."""
        pairs = [x for n in self.names() if (i := self.inverse_of(n)) for x in (F.lit(n), F.lit(i))]
        return F.try_element_at(F.create_map(*pairs), name) if pairs else F.lit(None).cast("string")

    def symmetric_column(self, name: Column) -> Column:
        return F.coalesce(name.isin([n for n, r in self.relations.items() if r.symmetric]), F.lit(False))
