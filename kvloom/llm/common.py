"""Shared pieces of the training-data operators: scratch tables, checked broadcasts, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.session import collected, drop, scratch, stored  # noqa: F401  used by the operators

#: Ids sent to every executor at most; beyond it a join shuffles both sides instead.
BROADCAST_ROWS = 1_000_000
#: Edges up to which components() sends the minima of nodes to all tasks instead of shuffling edges for them, and
#: the tasks that then take what its shuffles dealt to all their partitions.
FEW_EDGES, FEW_TASKS = 1 << 17, 12


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most `rows` narrow rows, else df itself."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exists(spark, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, id_col: str, name: str, path: str) -> DataFrame | None:
    """docs with a key `name` of each row if ids are null or repeated, written to `path`; None if ids are such keys.

    Keys are in the order of the ids, nulls last, so the smallest key has the smallest id. Hashed texts part rows of one
    id, so that no task gets all rows without id.
    """
    if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return None
    return stored(docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64("text")).withColumn(name, F.monotonically_increasing_id()), path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def blocks(texts, most: int = 1 << 20):
    """Cut a list of byte strings into runs of about `most` bytes: (first index, list)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def parts(batches, rows: int = 1024):
    """Batches in parts of at most `rows` rows, so that not all their texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_made: dict = {}


def once(key, make):
    """make() once in this Python worker: what it makes serves all its tasks until another operator's takes its place."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Let go of what operators keep in this Python worker."""
    import pyarrow as pa

    _made.clear()
    pa.default_memory_pool().release_unused()


def texts_of(batch, name: str = "text") -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[str]]:
    """Connected components of the undirected graph `edges` (a, b: long), by alternating large and small stars.

    Returns (node, component) with component the smallest node reachable, for every node of an edge, and the
    scratch folders it lies in. Minima are combined before they are shuffled and each hub's edges are joined
    back by a plain join, which AQE may split, so a hub with a third of all edges is no single task's work. The
    minima of up to FEW_EDGES edges are broadcast, which spares a round two of its shuffles, and so few edges are
    read in FEW_TASKS tasks however many partitions a shuffle has.
    """
    spark = edges.sparkSession
    collected(spark)
    path = scratch(spark, name)
    now = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/0")
    seen, step = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).groupBy("node").agg(F.min("component").alias("component")), [path]
        seen = (mark["n"], mark["h"])
        few = mark["n"] <= FEW_EDGES
        sent = F.broadcast if few else lambda df: df
        close = (lambda df: df.coalesce(FEW_TASKS)) if few else lambda df: df
        both = now.union(now.select("b", "a"))
        low = close(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = close(both.join(sent(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # every edge now points from a larger to a smaller node: the neighbours below a node are its targets
        low = close(large.groupBy("a").agg(F.min("b").alias("m")))
        starred = large.join(sent(low), "a")
        step += 1
        now = stored(close(starred.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()), f"{path}/{step}")
        drop(spark, f"{path}/{step - 1}")
