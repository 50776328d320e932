"""Adding, updating and deleting documents as DataFrame rewrites.

Every function is lazy and narrow: a command costs one pass, however many documents match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.types import literal_type, typed_literal
from docloom.plans.syntax import CommandError


def one_row(df: DataFrame, values: dict) -> DataFrame:
    """A row of values with the columns of df; columns that df lacks are appended."""
    kinds = {f.name: f.dataType for f in df.schema}
    typed = {n: _as_field(v, n, kinds.get(n, literal_type(v))) for n, v in values.items()}
    known = [typed.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()]
    return df.sparkSession.range(0, 1, 1, 1).select(*known, *[c.alias(n) for n, c in typed.items() if n not in kinds])


def _as_field(value: object, name: str, kind: T.DataType) -> Column:
    """The literal as a value of the field's type; a literal of another type is refused."""
    if isinstance(value, str):
        fits = isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType))
    elif isinstance(value, bool):
        fits = isinstance(kind, T.BooleanType)
    else:
        fits = isinstance(kind, T.NumericType) and (isinstance(value, int) or not isinstance(kind, T.IntegralType))
    if not fits:
        raise CommandError(f"value of field '{name}' is no {kind.simpleString()}: {value}")
    return F.lit(value).cast(kind)


def add_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """All documents of df and rows; fields that one side lacks are null there."""
    return df.unionByName(rows, allowMissingColumns=True)


def update(df: DataFrame, values: dict, where: Column, touch: str | None = None) -> DataFrame:
    """df with values set on the matching documents; new fields are created.  touch: a timestamp column to renew."""
    hit = F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    made = {}
    for name, value in values.items():
        if name in kinds:
            made[name] = F.when(hit, _as_field(value, name, kinds[name])).otherwise(F.col(f"`{name}`"))
        else:
            made[name] = F.when(hit, typed_literal(value))
    if touch in kinds:
        made[touch] = F.when(hit, F.current_timestamp().cast(kinds[touch])).otherwise(F.col(f"`{touch}`"))
    return df.withColumns(made)


def update_raw(df: DataFrame, raw: dict[str, str], where: Column) -> DataFrame:
    """As older clients stored it: values stay the text that was written, so a set field becomes a string field."""
    hit = F.coalesce(where, F.lit(False))
    kept = lambda name: F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")
    return df.withColumns({name: F.when(hit, F.lit(text)).otherwise(kept(name)) for name, text in raw.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """df without the matching documents; a null comparison matches nothing."""
    return df.where(~F.coalesce(where, F.lit(False)))
