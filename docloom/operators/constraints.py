"""Declared rules: required, unique and typed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.types import FieldDef
from docloom.plans.syntax import CommandError

#: Up to so many new values are looked for by a filter that the scan can push down.
FEW = 100


def fill_required(df: DataFrame, fields: list[FieldDef]) -> DataFrame:
    """Nulls of required fields become the default, where there is one."""
    made = {f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(f.default).cast(df.schema[f.name].dataType)) for f in fields if f.required and f.default is not None and f.name in df.columns}
    return df.withColumns(made) if made else df


def missing_required(df: DataFrame, fields: list[FieldDef]) -> DataFrame:
    """Documents in which a required field is still null."""
    bad = F.lit(False)
    for f in fields:
        if f.required:
            bad = bad | (F.col(f"`{f.name}`").isNull() if f.name in df.columns else F.lit(True))
    return df.where(bad)


def unique_violations(df: DataFrame, field: str) -> DataFrame:
    """(field, n) for the values that more than one document has; nulls never collide."""
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).where("n > 1")


def collisions(existing: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """New rows whose value an existing document has.  A few values go to the scan as a filter, more by a join."""
    few = new.select(field).where(F.col(field).isNotNull()).limit(FEW + 1).collect()
    if len(few) <= FEW:
        existing = existing.where(F.col(field).isin([r[0] for r in few]))
    return new.join(existing.select(field), field, "left_semi")


def mistyped(df: DataFrame, fields: list[FieldDef]) -> DataFrame:
    """Rows of text fields that cannot be read as the declared types."""
    bad = F.lit(False)
    for f in fields:
        if f.name in df.columns:
            value = F.col(f"`{f.name}`")
            bad = bad | (value.isNotNull() & value.try_cast(f.spark_type).isNull())
    return df.where(bad)


def typed(df: DataFrame, fields: list[FieldDef]) -> DataFrame:
    """df with text columns of other declared fields cast; raise if a value cannot be read as its type, or a column is of another type."""
    kinds = {f.name: f for f in fields if f.name in df.columns and df.schema[f.name].dataType != f.spark_type}
    text = [f for n, f in kinds.items() if df.schema[n].dataType.typeName() in ("string", "void")]
    for n, f in kinds.items():
        have = df.schema[n].dataType
        if f not in text and not (isinstance(have, T.IntegralType) and isinstance(f.spark_type, (T.LongType, T.DoubleType)) or isinstance(have, T.FloatType) and isinstance(f.spark_type, T.DoubleType)):
            raise CommandError(f"field '{n}' is {f.spark_type.simpleString()}, not {have.simpleString()}")
    if text and not mistyped(df, text).isEmpty():
        raise CommandError("a value is not of its field's type: " + ", ".join(f.name for f in text))
    return df.withColumns({n: F.col(f"`{n}`").cast(f.spark_type) for n, f in kinds.items()}) if kinds else df


def check_new(existing: DataFrame | None, new: DataFrame, fields: list[FieldDef]) -> None:
    """Raise if new breaks a rule, by itself or against existing."""
    known = [f for f in fields if f.name in new.columns]
    if not missing_required(new, fields).isEmpty():
        raise CommandError("a required field has no value and no default")
    for f in known:
        if f.unique:
            if not unique_violations(new, f.name).isEmpty() or (existing is not None and not collisions(existing, new, f.name).isEmpty()):
                raise CommandError(f"duplicate value in unique field '{f.name}'")
