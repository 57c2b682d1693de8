"""Seeded simulation of composite entities, of noise and of parameter grids; md5 orders stand in for shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered


def simulate(entities: DataFrame, group_size: int, per_target: int, overlap: float) -> DataFrame:
    """`(target, source)`: groups of `group_size` targets, each of `per_target` sources; a share of a group's slots are filled
    by sources that serve two of its targets. Slots go round the targets, so no target has a source twice.

    Of group_size * per_target slots, int(overlap * slots) // 2 sources take two each and the rest one; sources come in the
    order of md5(entity); groups that would run out of sources are not made."""
    slots = group_size * per_target
    shared = int(overlap * slots) // 2
    need = slots - shared
    order = numbered(entities.select("entity").distinct(), F.md5(F.col("entity").cast("string")), F.col("entity"))
    groups = F.floor(F.col("total") / need)
    total = order.agg(F.count("*").alias("total"))
    own = order.crossJoin(F.broadcast(total)).withColumn("g", F.floor(F.col("n") / need)).where(F.col("g") < groups).withColumn("k", F.col("n") % need)
    places = F.when(F.col("k") < shared, F.array(2 * F.col("k"), 2 * F.col("k") + 1)).otherwise(F.array(F.col("k") + shared))
    rows = own.select("entity", "g", F.explode(places).alias("slot"))
    target = F.concat(F.lit("Complex_"), (F.col("g") * group_size + F.col("slot") % group_size).cast("string"))
    return rows.select(target.alias("target"), F.col("entity").alias("source"))


def composite_profile(targets: DataFrame, profile: DataFrame) -> DataFrame:
    """The union of the sources' terms, as `(entity, term)`."""
    return targets.join(profile.select(F.col("entity").alias("source"), "term"), "source").select(F.col("target").alias("entity"), "term").distinct()


def flip(profile: DataFrame, terms: DataFrame, level: float) -> DataFrame:
    """int(level * ones) cells of `(entity, term)` go and int(level * zeros) others come, in md5 order over the whole matrix."""
    entities = profile.select("entity").distinct()
    key = F.md5(F.concat_ws("|", "entity", "term"))
    ones = profile.select("entity", "term").distinct()
    n1, n = ones.count(), entities.count() * terms.count()
    kept = numbered(ones, key, F.col("entity"), F.col("term"), name="_r").where(F.col("_r") >= int(level * n1)).drop("_r")
    zeros = entities.crossJoin(terms.select("term")).join(ones, ["entity", "term"], "left_anti")
    return kept.union(zeros.orderBy(key, "entity", "term").limit(int(level * (n - n1))))
