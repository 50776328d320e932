"""Following declared relationships between bundles.

The join strategy is left to Catalyst and AQE, which measure both sides.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relationship:
    name: str
    source: str
    target: str
    pairs: tuple[tuple[str, str], ...]

    def as_dict(self) -> dict:
        return asdict(self)


def _on(left: DataFrame, right: DataFrame, rel: Relationship) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[f"_to_{b}"] for a, b in rel.pairs])


def child_names(parents: DataFrame, children: DataFrame, rel: Relationship) -> dict[str, str]:
    """What the children's fields are called beside their parents': clashing names get the relationship's as prefix."""
    return {c: f"{rel.name}_{c}" if c in parents.columns else c for c in children.columns}


def include(parents: DataFrame, children: DataFrame, rel: Relationship, child_filter: Column | None = None) -> DataFrame:
    """Parents with their children's fields beside them; clashing names get the relationship's as prefix.

    Without child_filter parents without children stay; with it only matching pairs do.
    """
    kept = children if child_filter is None else children.where(child_filter)
    names = child_names(parents, kept, rel)
    right = kept.select(*[F.col(f"`{b}`").alias(f"_to_{b}") for _, b in rel.pairs], *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = parents.join(right, _on(parents, right, rel), "left" if child_filter is None else "inner")
    return joined.drop(*[f"_to_{b}" for _, b in rel.pairs])


def include_nested(parents: DataFrame, children: DataFrame, rel: Relationship, keep: list[str] | None = None) -> DataFrame:
    """Parents with an array of their children's fields in a column named after the relationship."""
    fields = keep or children.columns
    keys = [b for _, b in rel.pairs]
    grouped = children.groupBy(*[F.col(f"`{b}`").alias(f"_to_{b}") for b in keys]).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in fields])).alias(rel.name))
    joined = parents.join(grouped, _on(parents, grouped, rel), "left").drop(*[f"_to_{b}" for b in keys])
    return joined.withColumn(rel.name, F.coalesce(rel.name, F.array().cast(joined.schema[rel.name].dataType)))


def child_counts(parents: DataFrame, children: DataFrame, rel: Relationship) -> DataFrame:
    """Parents with n_children; children are counted before the join."""
    counts = children.groupBy(*[F.col(f"`{b}`").alias(f"_to_{b}") for _, b in rel.pairs]).agg(F.count("*").alias("n_children"))
    joined = parents.join(counts, _on(parents, counts, rel), "left").drop(*[f"_to_{b}" for _, b in rel.pairs])
    return joined.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
