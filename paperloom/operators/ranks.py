"""Exact nearest ranks of groups of any size.

Equal values are counted first, the counted values are ranged over partitions
and summed within each, and only the sums of the ranges are added up per group.
So no task gets a whole group, however large, and no value is collected.

Defined results: null and NaN values take no part; a group without values has no
row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import checkpointed

Rank = Callable[[Column], Column]


def nearest(p: float) -> Rank:
    """The rank of the least value that a share ``p`` of the values doesn't exceed."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(p))).cast("bigint")


def upper_median(n: Column) -> Column:
    """The rank just past one half."""
    return (F.floor(n / 2) + 1).cast("bigint")


def ranked(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """``groups``, n, least, most, mean and the value at each of the ranks, by group."""
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    counted = df.select(*groups, v.alias("v")).where("v IS NOT NULL").groupBy(*groups, "v").agg(F.count("*").alias("k"))
    # written once: the ranges are drawn from a sample, and both uses must see the same ones
    ranged = checkpointed(counted.repartitionByRange(*groups, "v").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*groups, "part").agg(
        F.sum("k").alias("own"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v").cast("double") * F.col("k")).alias("total")
    )
    by_group = Window.partitionBy(*groups)
    parts = parts.withColumns({
        "before": F.sum("own").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("own").over(by_group),
        "least": F.min("least").over(by_group), "most": F.max("most").over(by_group), "mean": F.sum("total").over(by_group) / F.sum("own").over(by_group),
    })
    low = F.coalesce("before", F.lit(0))
    wanted = parts.select(
        *groups, "part", "n", "least", "most", "mean", low.alias("before"),
        F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).alias("rank")) for name, rank in ranks.items()]).alias("ranks"), "own",
    ).withColumn("ranks", F.filter("ranks", lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("own"))))
    # only the ranges that hold a wanted rank are summed value by value; the key of a group joins null groups, too
    key = F.struct(*[F.col(g) for g in groups]) if len(groups) > 1 else F.col(groups[0])
    held = wanted.where(F.size("ranks") > 0).select(key.alias("held"), F.col("part").alias("held_part"), F.col("before").alias("start"), F.col("ranks").alias("asked"))
    joined = ranged.withColumn("own_key", key).join(held, F.expr("own_key <=> held AND part = held_part"))
    upto = F.col("start") + F.sum("k").over(Window.partitionBy(*groups, "part").orderBy("v"))
    placed = joined.withColumn("upto", upto).withColumn("hits", F.filter("asked", lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("k"))))
    hits = placed.select("own_key", "v", F.explode("hits").alias("hit"))
    found = hits.groupBy("own_key").agg(*[F.max(F.when(F.col("hit.name") == name, F.col("v"))).alias(name) for name in ranks])
    whole = parts.groupBy(*groups).agg(*[F.max(c).alias(c) for c in ("n", "least", "most", "mean")]).withColumn("whole_key", key)
    return whole.join(found, F.expr("whole_key <=> own_key")).select(*groups, "n", "least", "most", "mean", *ranks)
