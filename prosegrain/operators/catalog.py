"""Documents by name across scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_scope(rows: DataFrame, scopes: tuple[str, ...] = ("project", "personal", "shipped")) -> DataFrame:
    """One row a name: that of the first scope that has it. An aggregate, so a name's rows are never sorted."""
    rank = F.array_position(F.array(*[F.lit(s) for s in scopes]), F.col("scope"))
    others = [c for c in rows.columns if c != "name"]
    return rows.where(rank > 0).groupBy("name").agg(F.min_by(F.struct(*others), rank).alias("x")).select("name", "x.*")
