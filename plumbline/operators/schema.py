"""Physical column kinds and the normalised view of a table that all operators start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import nan_to_null
from ..functions.values import col

NUMBER_KINDS = ("integral", "float", "decimal")

# Column metadata: the text stands for a nested or binary value.
NESTED = "plumbline.nested"


@dataclass(frozen=True)
class Field:
    """One column: its place in the table, its name and its physical kind."""

    ordinal: int
    name: str
    dtype: str
    kind: str

    @property
    def is_number(self) -> bool:
        return self.kind in NUMBER_KINDS

    @property
    def value(self) -> Column:
        return col(self.name)

    @property
    def label(self) -> Column:
        """The value as text, as it appears in samples and top lists."""
        if self.kind == "bool":
            return F.when(self.value, F.lit("True")).when(~self.value, F.lit("False"))
        return self.value.cast("string")

    @property
    def number(self) -> Column:
        return self.value.cast("double")


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.DecimalType):
        return "decimal"
    if isinstance(dt, T.IntegralType):
        return "integral"
    if isinstance(dt, T.FractionalType):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType, T.NullType)):
        return "string"
    return "nested"


def fields(df: DataFrame) -> list[Field]:
    return [
        Field(i, f.name, f.dataType.simpleString(), "nested" if f.metadata.get(NESTED) else kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]


def number_fields(df: DataFrame, names: list[str] | None = None) -> list[Field]:
    return [f for f in fields(df) if f.is_number and (names is None or f.name in names)]


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL, nested and binary values to text. Other columns pass through untouched."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if kind_of(f.dataType) == "float":
            c = nan_to_null(c).alias(f.name)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(c).alias(f.name, metadata={NESTED: True})
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c).alias(f.name, metadata={NESTED: True})
        elif kind_of(f.dataType) == "nested":
            c = c.cast("string").alias(f.name, metadata={NESTED: True})
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string").alias(f.name)
        out.append(c)
    return df.select(*out)
