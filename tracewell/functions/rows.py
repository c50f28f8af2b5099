"""Columns of rows that are costly to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns, each made once a row.

    A column of withColumn is written out wherever a later filter names it, and again within each column that it names.
    What a generator makes is not.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(x.alias(c) for c, x in columns.items())))))
