"""Rules for numbers at any depth of a column: structs, arrays and maps are walked by their schema.

The expressions are built once from the type, so they stay inside the plan; a branch of the type
without floating-point numbers is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugework.functions.values import PUBLISHED_PLACES, is_finite, published


def holds_numbers(kind: T.DataType) -> bool:
    """Whether a type holds floating-point numbers somewhere."""
    if isinstance(kind, T.StructType):
        return any(holds_numbers(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return holds_numbers(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_numbers(kind.keyType) or holds_numbers(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def rounded_value(c: Column, kind: T.DataType, places: int = PUBLISHED_PLACES) -> Column:
    """``c`` with every floating-point number in it rounded for publication; nulls stay nulls at
    their depth. The keys of a map stay, as rounding could make two of them one."""
    if not holds_numbers(kind):
        return c
    if isinstance(kind, T.StructType):
        fields = [rounded_value(c.getField(f.name), f.dataType, places).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: rounded_value(v, kind.elementType, places))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: rounded_value(v, kind.valueType, places))
    return published(c, places)


def holds_unfit(c: Column, kind: T.DataType) -> Column:
    """Whether a number that is not finite stands anywhere in ``c``; nulls are fit."""
    if not holds_numbers(kind):
        return F.lit(False)
    if isinstance(kind, T.StructType):
        inner = F.lit(False)
        for f in kind.fields:
            if holds_numbers(f.dataType):
                inner = inner | holds_unfit(c.getField(f.name), f.dataType)
        return F.coalesce(inner, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda v: holds_unfit(v, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        keys = holds_unfit(F.map_keys(c), T.ArrayType(kind.keyType))
        return keys | holds_unfit(F.map_values(c), T.ArrayType(kind.valueType))
    return c.isNotNull() & ~F.coalesce(is_finite(c), F.lit(False))


def rounded(df: DataFrame, places: int = PUBLISHED_PLACES) -> DataFrame:
    """Every number of a table rounded for stable bytes, at any depth."""
    return df.select(*[rounded_value(F.col(f"`{f.name}`"), f.dataType, places).alias(f.name) for f in df.schema.fields])


def unfit_column(df: DataFrame) -> Column:
    """The first column of a row that holds a number that is not finite, or null."""
    return F.coalesce(
        *[F.when(holds_unfit(F.col(f"`{f.name}`"), f.dataType), F.lit(f.name)) for f in df.schema.fields],
        F.lit(None).cast("string"),
    )


def require_finite(df: DataFrame) -> DataFrame:
    """``df``, whose use fails the job where a number is not finite, and names the column."""
    column = unfit_column(df)
    message = F.raise_error(F.concat(F.lit("a number is not finite in "), column)).cast("boolean")
    return df.where(F.when(column.isNull(), F.lit(True)).otherwise(message))
