"""Token dispatch and combine, collectives, embedding gathers (JN3, JN9, AGG6, AGG10-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.operators.ranks import ranked


def gather(requests: DataFrame, tables: DataFrame, rows_per_head: int) -> DataFrame:
    """JN3: requests (b, l, head, row_id) -> their vectors (b, l, head, row_id, vec), one row a request.

    One id that is null, out of range or not in its head's table fails the whole call: every vector is zero then.
    """
    number = tables.schema["vec"].dataType.elementType
    bad = requests.agg(F.count_if(F.col("row_id").isNull() | (F.col("row_id") < 0) | (F.col("row_id") >= rows_per_head)).alias("_bad"))
    absent = requests.join(tables.select("head", "row_id"), ["head", "row_id"], "left_anti").agg(F.count("*").alias("_absent"))
    size = tables.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("_dim"))
    checked = bad.crossJoin(absent).crossJoin(size).select(F.when(F.col("_bad") + F.col("_absent") > 0, F.array_repeat(F.lit(0).cast(number), F.col("_dim"))).alias("_zero"))
    got = requests.join(tables, ["head", "row_id"], "left").crossJoin(F.broadcast(checked))
    return got.select("b", "l", "head", "row_id", F.coalesce("_zero", "vec").alias("vec"))


def dispatch(tokens: DataFrame) -> DataFrame:
    """JN9: tokens (rank, token, topk_idx) -> (expert, slot, rank, token): rows packed per expert by source rank, then token; -1 is masked."""
    e = tokens.select("rank", "token", F.explode("topk_idx").alias("expert")).where("expert >= 0")
    return ranked(e, ["expert"], [F.col("rank"), F.col("token")], "slot")


def dispatch_layout(tokens: DataFrame) -> DataFrame:
    """JN9: (expert, rank, begin, count, word) with word = begin in the upper, count in the lower 32 bits."""
    n = tokens.select("rank", F.explode("topk_idx").alias("expert")).where("expert >= 0").groupBy("expert", "rank").agg(F.count("*").alias("count"))
    begin = F.sum("count").over(Window.partitionBy("expert").orderBy("rank")) - F.col("count")
    return n.withColumn("begin", begin).withColumn("word", F.shiftleft(F.col("begin"), 32).bitwiseOR(F.col("count")))


def expert_load(tokens: DataFrame, experts: int) -> DataFrame:
    """AGG6: tokens per expert, zero where none, with max, min, mean and imbalance max / mean of all."""
    n = tokens.select(F.explode("topk_idx").alias("expert")).where("expert >= 0").groupBy("expert").agg(F.count("*").alias("n"))
    every = tokens.sparkSession.range(experts).select(F.col("id").alias("expert")).join(n, "expert", "left").select("expert", F.coalesce("n", F.lit(0)).alias("n"))
    total = every.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"))
    return every.crossJoin(F.broadcast(total)).withColumn("imbalance", F.try_divide("most", "mean"))


def combine(tokens: DataFrame, outputs: DataFrame) -> DataFrame:
    """AGG10: tokens (token, topk_idx, topk_weight), outputs (token, expert, x: array) -> (token, dim, value): weighted sums.

    Masked slots (-1) give nothing; an expert named twice by a token counts with both weights.
    """
    w = tokens.select("token", F.explode(F.arrays_zip("topk_idx", "topk_weight")).alias("z")).select("token", F.col("z.topk_idx").alias("expert"), F.col("z.topk_weight").cast("double").alias("w")).where("expert >= 0").groupBy("token", "expert").agg(F.sum("w").alias("w"))
    each = w.join(outputs, ["token", "expert"]).select("token", "w", F.posexplode("x").alias("dim", "v"))
    return each.groupBy("token", "dim").agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("value"))


def allreduce(parts: DataFrame, group: list[str], vector: str, op: str) -> DataFrame:
    """AGG11: element-wise SUM, MIN, MAX or PRODUCT over ranks -> (group, dim, value). AVG is no reduction here, as by contract."""
    how = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "PRODUCT": F.product}
    if op not in how:
        raise ValueError(f"unsupported reduction {op}")
    return parts.select(*group, F.posexplode(vector).alias("dim", "v")).groupBy(*group, "dim").agg(how[op](F.col("v").cast("double")).alias("value"))


def allgather(parts: DataFrame, rank: str, vector: str) -> DataFrame:
    """AGG12: all ranks' elements in rank order: (place, value). Places follow from running sums over range partitions."""
    placed = ranked(parts.select(rank, F.col(vector).alias("_v")), [], [F.col(rank)], "_rank", None, {"_end": F.size("_v")})
    return placed.select((F.col("_end") - F.size("_v")).alias("_before"), F.posexplode("_v").alias("_i", "value")).select((F.col("_before") + F.col("_i")).alias("place"), "value")


def reduce_scatter(parts: DataFrame, rank: str, vector: str, ranks: int) -> DataFrame:
    """AGG12: sums dealt out in equal chunks: (rank, place, value); the length must divide by ranks."""
    sums = allreduce(parts, [], vector, "SUM")
    n = parts.agg(F.max(F.size(vector)).alias("_n"))
    chunk = F.col("_n") / ranks
    return sums.crossJoin(F.broadcast(n)).select(F.floor(F.col("dim") / chunk).alias(rank), (F.col("dim") % chunk).cast("long").alias("place"), "value")


def alltoall(parts: DataFrame, src: str, dst: str) -> DataFrame:
    """AGG12: (src, dst, value) transposed."""
    return parts.withColumnsRenamed({src: "_s", dst: src}).withColumnRenamed("_s", dst)


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
