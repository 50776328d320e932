"""Filter expressions compiled to Column expressions.

Two semantics: ``documented`` compares as the language describes; ``compat`` keeps
two known oddities of older clients: OR acts as AND, and on strings and bools every
operator means equality; it compares no times.  A comparison that has no meaning is
false, also for !=.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.types import number_of
from docloom.plans.syntax import And, Compare, Or

OPS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
DOCUMENT_ID = "documentid"
EXTRA = "extra"
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)


def compile_filter(expr, schema: T.StructType, id_col: str, semantics: str = "documented") -> Column:
    """The filter as a Column over rows of schema; None filters nothing."""
    if expr is None:
        return F.lit(True)
    if isinstance(expr, (And, Or)):
        parts = [compile_filter(x, schema, id_col, semantics) for x in expr.items]
        join = operator.or_ if isinstance(expr, Or) and semantics == "documented" else operator.and_
        found = parts[0]
        for p in parts[1:]:
            found = join(found, p)
        return found
    return _compare(expr, schema, id_col, semantics == "compat")


def fields_of(expr) -> set[str]:
    """The fields that a filter tests."""
    if isinstance(expr, Compare):
        return {expr.field}
    return set() if expr is None else {f for x in expr.items for f in fields_of(x)}


def conjuncts(expr) -> list[Compare]:
    """The comparisons that every kept row must satisfy."""
    if isinstance(expr, Compare):
        return [expr]
    if isinstance(expr, And):
        return [c for x in expr.items for c in conjuncts(x)]
    return []


def _number(value: object) -> int | float | None:
    """A literal as a number; None if it is none."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    try:
        return int(value)
    except ValueError:
        try:
            return float(value)
        except ValueError:
            return None


def _compare(c: Compare, schema: T.StructType, id_col: str, compat: bool) -> Column:
    kinds = {f.name: f.dataType for f in schema}
    name = id_col if c.field.lower() == DOCUMENT_ID else c.field
    if name not in kinds:
        if isinstance(kinds.get(EXTRA), T.VariantType):
            return _compare_variant(F.col(EXTRA), f"$['{name}']", c, compat)
        return F.lit(False)
    return _typed(F.col(f"`{name}`"), kinds[name], c.op, c.value, compat)


def _typed(col: Column, kind: T.DataType, op: str, value: object, compat: bool) -> Column:
    same = OPS["==" if compat else op]
    if isinstance(kind, T.StringType):
        if isinstance(value, str):
            return same(col, F.lit(value))
        if isinstance(value, bool):
            return F.lit(False)
        return _finite(number_of(col), compat, lambda x: OPS[op](x, F.lit(float(value))))
    if isinstance(kind, T.BooleanType):
        return same(col, F.lit(value)) if isinstance(value, bool) else F.lit(False)
    if isinstance(kind, (*INTEGERS, *FRACTIONS)):
        number = _number(value)
        if number is None:
            return F.lit(False)
        if isinstance(kind, INTEGERS):
            if isinstance(number, float) and number.is_integer() and abs(number) < 2**53:
                number = int(number)
            if isinstance(number, int) and -(2**63) <= number < 2**63:
                return OPS[op](col, F.lit(number))  # stays a plain comparison, so it reaches the scan
            return OPS[op](col.cast("double"), F.lit(float(number)))
        return _finite(col, compat, lambda x: OPS[op](x, F.lit(float(number))))
    if isinstance(kind, TIMES) and isinstance(value, str) and not compat:
        # A text that is no date or time becomes null, which no comparison keeps.
        return OPS[op](col, F.lit(value).try_cast("timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"))
    return F.lit(False)


def _finite(col: Column, compat: bool, test) -> Column:
    """In compat mode a NaN compares false, as in IEEE arithmetic."""
    return test(col) & ~F.isnan(col) if compat else test(col)


def _compare_variant(extra: Column, path: str, c: Compare, compat: bool) -> Column:
    """An undeclared field: its own type decides, row by row."""
    whole = F.try_variant_get(extra, path, "variant")
    tag = F.schema_of_variant(whole)
    as_ = lambda kind: F.try_variant_get(extra, path, kind)
    is_number = tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL")
    found = F.when(tag == "STRING", _typed(as_("string"), T.StringType(), c.op, c.value, compat))
    found = found.when(tag == "BOOLEAN", _typed(as_("boolean"), T.BooleanType(), c.op, c.value, compat))
    found = found.when(tag == "BIGINT", _typed(as_("bigint"), T.LongType(), c.op, c.value, compat))
    return found.when(is_number, _typed(as_("double"), T.DoubleType(), c.op, c.value, compat)).otherwise(F.lit(False))
