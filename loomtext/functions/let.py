"""Values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once per row however often, or in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, in the place of one that is called so, computed once per row. A plain projection would
    be copied into every later use, and a filter on it pushed below; a generator of one row is not."""
    made = F.explode(F.array(value)).alias(name)
    return df.select(*[made if c == name else F.col(f"`{c}`") for c in df.columns], *([] if name in df.columns else [made]))
