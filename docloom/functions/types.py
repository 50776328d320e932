"""Declared field types, their Spark types, zero values and default coercion."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared names in any case.  DATETIME has no zone, as the stored columns.
SPARK_TYPES = {
    "STRING": T.StringType(),
    "INT": T.LongType(),
    "FLOAT": T.DoubleType(),
    "BOOL": T.BooleanType(),
    "DATETIME": T.TimestampNTZType(),
}
ZERO = {"STRING": "", "INT": 0, "FLOAT": 0.0, "BOOL": False, "DATETIME": None}
#: Decimal numbers as a whole text; try_cast alone would also take ' 5 ' and '5d'.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


class FieldTypeError(ValueError):
    """A declared type that is not known."""


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    required: bool = False
    unique: bool = False
    default: object = None

    def __post_init__(self):
        if self.type.upper() not in SPARK_TYPES:
            raise FieldTypeError(f"unknown field type: {self.type}")
        object.__setattr__(self, "type", self.type.upper())

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type, True, {"required": self.required, "unique": self.unique})

    def as_dict(self) -> dict:
        return asdict(self)


def coerce_default(type_name: str, raw: object) -> object:
    """A declared default as a value of the type; what cannot be read as one becomes the zero value."""
    kind = type_name.upper()
    if raw is None:
        return None
    try:
        if kind == "STRING":
            return raw if isinstance(raw, str) else str(raw)
        if kind == "INT":
            return int(raw)
        if kind == "FLOAT":
            return float(raw)
        if kind == "BOOL":
            return raw if isinstance(raw, bool) else {"true": True, "false": False}[str(raw).lower()]
    except (TypeError, ValueError, KeyError):
        return ZERO[kind]
    return raw


def literal_type(value: object) -> T.DataType:
    """The Spark type of a parsed literal; bool before int, since Python's bool is one."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    return T.StringType()


def typed_literal(value: object) -> Column:
    return F.lit(value).cast(literal_type(value))


def number_of(text: Column) -> Column:
    """A string column as double where the whole text is a number, else null."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
