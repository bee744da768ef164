"""Global ranks and running sums inside groups that needn't fit one task.

Rows are range-partitioned by group and order; each task ranks its own part and adds what the parts before hold
of the same group. A hot group so spreads over as many tasks as it has rows for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.session import scratch, stored


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank", total: str | None = None, running: dict[str, Column] | None = None) -> DataFrame:
    """df with a 0-based global rank in each group; `total` names a column for the group's size.

    running: names of inclusive running sums in the same order -> what they add up. The order should be total
    (end it with a unique column), else ties take any order. No groups: the whole frame is one group.
    """
    running = running or {}
    keys = [f"_rk_g{i}" for i in range(len(groups))]
    sums = [f"_rk_s{i}" for i in range(len(running))]
    flat = df.select("*", *[F.col(g).alias(k) for k, g in zip(keys, groups)], *[c.alias(s) for s, c in zip(sums, running.values())])
    # written once: range bounds come from a sample, so two evaluations could deal the rows out differently
    spread = flat.repartitionByRange(_parts(df), *[F.col(k) for k in keys], *order).withColumn("_rk_pid", F.spark_partition_id())
    spread = stored(spread, scratch(df.sparkSession, "ranked"))
    inside = Window.partitionBy("_rk_pid", *keys).orderBy(*order)
    local = spread.withColumn("_rk_r", F.row_number().over(inside) - 1)
    for s in sums:
        local = local.withColumn(f"{s}_in", F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    counts = spread.groupBy("_rk_pid", *keys).agg(F.count("*").alias("_rk_n"), *[F.sum(s).alias(f"{s}_n") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select("_rk_pid", *[F.col(k).alias(f"{k}_") for k in keys], F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_before"), F.sum("_rk_n").over(whole).alias("_rk_total"), *[F.coalesce(F.sum(f"{s}_n").over(before), F.lit(0)).alias(f"{s}_before") for s in sums])
    out = local.join(offsets.withColumnRenamed("_rk_pid", "_rk_pid_"), (F.col("_rk_pid") == F.col("_rk_pid_")) & _same(keys), "left")
    picked = [(F.col("_rk_r") + F.col("_rk_before")).cast("long").alias(rank)]
    if total:
        picked.append(F.col("_rk_total").cast("long").alias(total))
    picked += [(F.col(f"{s}_in") + F.col(f"{s}_before")).alias(n) for n, s in zip(running, sums)]
    return out.select(*[F.col(c) for c in df.columns], *picked)


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return same


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by `order`, with a 1-based rank. Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)
