"""Columns that many plans use, as functions: a column cannot be made before there is a session."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def filled(name: str = "text") -> Column:
    """The column ``name`` with empty text for null."""
    return F.coalesce(F.col(name), F.lit(""))
