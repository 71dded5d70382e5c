"""What a column's type allows: family, order and equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numeric types from the narrowest to the widest.
NUMERIC_ORDER = ["tinyint", "smallint", "int", "integer", "bigint", "numeric", "decimal", "real", "double"]
# Parts of a type's name that tell its family; the first family that fits holds.
CATALOG_FAMILIES = {
    "numeric": "int|numeric|decimal|real|double|float|serial|money",
    "temporal": "date|time|timestamp",
    "string": "char|text|string",
    "uuid": "uuid",
    "json": "json",
    "binary": "bytea|blob|binary",
    "boolean": "bool",
}
CHANGE_FAMILIES = {
    "numeric": "^(" + "|".join(NUMERIC_ORDER) + ")$|float|double|decimal|numeric",
    "string": "char|text|string|clob",
    "temporal": "date|time",
    "boolean": "bool",
    "nested": "json|array|struct|map",
    "binary": "binary|blob|bytea",
}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def equatable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def orderable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def _first_family(name: Column, families: dict[str, str], other: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(pattern), family) for family, pattern in families.items()], other)


def normal_type(type_col: Column) -> Column:
    """A type's name in lower case, without its arguments."""
    return F.trim(F.regexp_replace(F.lower(F.trim(type_col)), r"\(.*\)", ""))


def type_caps(type_col: Column) -> Column:
    """(family, orderable, equatable) from a catalog's type text; null counts as no name (F8).

    A name is told by its parts, so that "interval" and "point", which hold "int", are numeric.
    """
    name = F.trim(F.replace(normal_type(F.coalesce(type_col, F.lit(""))), F.lit("[]"), F.lit("")))
    has = lambda *families: name.rlike("|".join(CATALOG_FAMILIES[f] for f in families))
    ordered = has("numeric", "temporal", "string", "boolean") & ~has("uuid", "json", "binary")
    return F.struct(_first_family(name, CATALOG_FAMILIES, F.lit("other")).alias("family"), ordered.alias("orderable"), (~name.rlike("json|xml")).alias("equatable"))


def type_change(old: Column, new: Column) -> Column:
    """same, widened, narrowed or changed (X8); where one side is not declared nothing can break, so it is widened."""
    a, b = normal_type(old), normal_type(new)
    family = lambda name: _first_family(name, CHANGE_FAMILIES, F.concat(F.lit("other:"), name))
    order = F.array(*map(F.lit, NUMERIC_ORDER))
    wider = lambda cond: F.when(cond, "widened").otherwise("narrowed")
    x, y = F.array_position(order, a), F.array_position(order, b)
    within = (
        F.when(family(a).isin("string", "boolean"), "widened")
        .when(family(a) == "temporal", wider((a == "date") & b.contains("timestamp")))
        .when((x > 0) & (y > 0), wider(y >= x))
        .otherwise("changed")
    )
    return F.when(a.eqNullSafe(b), "same").when(a.isNull() | b.isNull(), "widened").when(family(a) == family(b), within).otherwise("changed")
