"""Whole rows of documents, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def whole_row(docs: DataFrame) -> Column:
    """All columns as a struct."""
    return F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns called c0, c1 and so on: Arrow functions can't take names with dots."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
