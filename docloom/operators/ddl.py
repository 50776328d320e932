"""Changing the fields of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.types import ZERO, FieldDef
from docloom.plans.syntax import AddField, ChangeField, CommandError, RemoveField


def add_field(df: DataFrame, new: FieldDef) -> DataFrame:
    """A field with its default everywhere; a required one without default gets the zero value."""
    if new.name in df.columns:
        raise CommandError(f"field '{new.name}' already exists")
    return df.withColumn(new.name, F.lit(first_value(new)).cast(new.spark_type))


def first_value(new: FieldDef) -> object:
    """What documents that are there get in a new field."""
    return ZERO[new.type] if new.default is None and new.required else new.default


def change_field(df: DataFrame, old: str, new: FieldDef) -> DataFrame:
    """Rename and retype; values that do not fit the new type become its default."""
    if old not in df.columns:
        raise CommandError(f"field '{old}' does not exist")
    if new.name != old and new.name in df.columns:
        raise CommandError(f"field '{new.name}' already exists")
    value = F.col(f"`{old}`")
    if df.schema[old].dataType != new.spark_type:
        value = value.try_cast(new.spark_type)
    if new.default is not None:
        value = F.coalesce(value, F.lit(new.default).cast(new.spark_type))
    return df.select(*[value.alias(new.name) if c == old else F.col(f"`{c}`") for c in df.columns])


def remove_field(df: DataFrame, old: str) -> DataFrame:
    if old not in df.columns:
        raise CommandError(f"field '{old}' does not exist")
    return df.drop(old)


def apply_change(df: DataFrame, change) -> DataFrame:
    if isinstance(change, AddField):
        return add_field(df, change.new)
    if isinstance(change, ChangeField):
        return change_field(df, change.old, change.new)
    if isinstance(change, RemoveField):
        return remove_field(df, change.old)
    raise CommandError(f"no change of fields: {change}")
