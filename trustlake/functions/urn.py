"""URNs ``urn:asset:<Type>:<a.b.c>``: parse, build, clean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "urn:asset"


def clean(part: Column) -> Column:
    """A part without the characters that the grammar uses."""
    return F.translate(F.trim(part), ".: ", "___")


def build(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}:{kind}:"), F.concat_ws(".", *[clean(p) for p in parts]))


def is_urn(c: Column) -> Column:
    return c.rlike(rf"^{SCHEME}:[A-Za-z]+:[^.: ]+(\.[^.: ]+)*$")


def kind(c: Column) -> Column:
    return F.when(is_urn(c), F.split_part(c, F.lit(":"), F.lit(3)))


def path(c: Column) -> Column:
    return F.when(is_urn(c), F.split(F.split_part(c, F.lit(":"), F.lit(4)), r"\."))


def column_urn(dataset: Column, column: Column) -> Column:
    """The URN of a dataset's column: its path with the column's name, and type Column."""
    return F.concat(F.lit(f"{SCHEME}:Column:"), F.split_part(dataset, F.lit(":"), F.lit(4)), F.lit("."), clean(column))


def dataset_of(column: Column) -> Column:
    own = path(column)
    return F.when(kind(column) == "Column", F.concat(F.lit(f"{SCHEME}:Dataset:"), F.array_join(F.slice(own, 1, F.size(own) - 1), ".")))
