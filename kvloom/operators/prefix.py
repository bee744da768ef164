"""Prefix-cache matching: blocks of a prompt, rolling prefix ids, hits against earlier requests (SC6, WIN1, WIN4, JN7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.session import scratch, stored


def block_count(text: Column, block: int) -> Column:
    """Complete blocks only (SC6); 0 for null."""
    return F.coalesce(F.floor(F.length(text) / block), F.lit(0)).cast("long")


def prefix_chain(requests: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(id_col, pos, prefix_id): one row per complete block; an id stands for all text up to the block's end (WIN4).

    The text is cut into blocks once and each id hashes the one before with the block alone, so a long prompt costs
    time linear in its length.
    """
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("ids"))

    def step(acc, cut):
        own = F.md5(F.concat(acc["last"], cut).cast("binary"))
        return F.struct(own.alias("last"), F.concat(acc["ids"], F.array(own)).alias("ids"))

    blocks = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(?s).{{{block}}}"), F.lit(0))
    chained = requests.select(id_col, F.aggregate(blocks, start, step)["ids"].alias("ids"))
    return chained.select(id_col, F.posexplode("ids").alias("pos", "prefix_id"))


def first_seen(accesses: DataFrame, page: str, order: list[str]) -> DataFrame:
    """accesses with is_miss: true at the first access of a page in the given order, never again (WIN1).

    The first access is found by a combined minimum and joined back, so a page with a third of all accesses
    is no single task's work. The order must be total. Accesses are read twice: they are written before.
    """
    accesses = stored(accesses, scratch(accesses.sparkSession, "accesses"))
    firsts = accesses.groupBy(page).agg(F.min(F.struct(*order)).alias("_first"))
    return accesses.join(firsts, page).withColumn("is_miss", F.struct(*order) == F.col("_first")).drop("_first")


def prefix_match(requests: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """Per request with a block: blocks, hits, longest_matched (in characters) against all earlier ids (JN7).

    The match ends at the first block that no earlier request had.
    """
    seen = first_seen(prefix_chain(requests, id_col, text_col, block), "prefix_id", [id_col, "pos"])
    hit = ~F.col("is_miss")
    first_miss = F.min(F.when(~hit, F.col("pos")))
    return seen.groupBy(id_col).agg(F.count("*").alias("blocks"), F.count_if(hit).alias("hits"), (F.coalesce(first_miss, F.count("*")) * block).cast("long").alias("longest_matched"))


def match_cached(requests: DataFrame, cached: DataFrame, block_tokens: int) -> DataFrame:
    """Ordered semi-join of request blocks (req_id, pos, hash) with cached blocks (instance, medium, hash) (JN7).

    longest_matched tokens for each request, instance and medium: consecutive blocks from the first on.
    """
    wanted = requests.groupBy("req_id").agg(F.count("*").alias("n"))
    have = requests.join(cached, "hash").select("req_id", "instance", "medium", "pos").distinct()
    # the k-th smallest position found equals k - 1 exactly as long as no block is missing before
    runs = have.groupBy("req_id", "instance", "medium").agg(F.sort_array(F.collect_set("pos")).alias("got"))
    matched = F.aggregate(F.col("got"), F.lit(0), lambda acc, p: F.when(p == acc, acc + 1).otherwise(acc))
    return runs.join(wanted, "req_id").select("req_id", "instance", "medium", "n", (matched * block_tokens).cast("long").alias("longest_matched"))
