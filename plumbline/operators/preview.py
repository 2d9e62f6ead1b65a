"""A first look at a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import text_literal
from plumbline.plans.fused import literal_rows, struct_sql


def columns(df: DataFrame) -> DataFrame:
    """Name and type of every column, in order. Looks at the schema only."""
    rows = [
        struct_sql({"pos": str(i), "name": text_literal(name), "type": text_literal(dtype)})
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return literal_rows(df.sparkSession, rows)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as the one column ``total_rows``."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first ``n`` rows and, on each, the number of rows in all.

    Without ``order_by`` any ``n`` rows may come; with it, each task keeps its own
    first ``n`` and only those are merged. The total is a subquery of its own that
    reads no columns. An empty dataset gives one row of NULLs with the total 0.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if "total_rows" in [c.lower() for c in df.columns]:
        raise ValueError("the dataset has a column total_rows, the name of the total")
    first = df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
    none = row_count(df).filter("total_rows = 0")
    blank = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], "total_rows")
    return first.select("*", row_count(df).scalar().alias("total_rows")).union(blank)
