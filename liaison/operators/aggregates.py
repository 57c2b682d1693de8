"""Aggregations and reshaping of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_mean(rows: DataFrame, keys: list[str], values: list[str], drop_null_keys: bool = False) -> DataFrame:
    """Means by keys. A null key is a group of its own, or leaves the table with `drop_null_keys`."""
    rows = rows.dropna(subset=keys) if drop_null_keys else rows
    return rows.groupBy(*keys).agg(*(F.avg(f"`{v}`").alias(v) for v in values))


def melted(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """`(keys, metric, quantile, value)` from columns `<metric>_quantile_<q>` that start with `prefix`."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    long = rows.unpivot(keys, [f"`{n}`" for n in names], "name", "value")
    metric, q = F.regexp_extract("name", "(.*)_quantile_(.*)", 1), F.regexp_extract("name", "(.*)_quantile_(.*)", 2)
    return long.select(*keys, metric.alias("metric"), F.round(q.cast("double"), 4).alias("quantile"), "value")


def presence(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each of a known list of values."""
    return rows.select(key, column, F.lit(1).alias("one")).groupBy(key).pivot(column, values).agg(F.max("one")).na.fill(0)


def largest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(value).alias(value))


def over_represented(rows: DataFrame, group: str, item: str) -> DataFrame:
    """`(item, share_0, share_1, gap)`: an item's share of the rows of group 1 less that of group 0."""
    counts = rows.groupBy(item).agg(*(F.sum((F.col(group) == g).cast("long")).alias(f"n{g}") for g in (0, 1)))
    total = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    s0, s1 = F.col("n0") / F.col("t0"), F.col("n1") / F.col("t1")
    return counts.crossJoin(F.broadcast(total)).select(item, s0.alias("share_0"), s1.alias("share_1"), (s1 - s0).alias("gap"))
