"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to 8 dimensions, several times a table, and each projection is decoded to the
nearest point of the lattice E8; a table's cell is the points together. Every vector lies in its own cell of each
table and looks also into neighbouring cells (the nearest point of the other coset, one projection at a time).
Vectors that meet have their cosine computed in double precision. Equal vectors count as one with a weight.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import components, mix64, scratch, stored

#: Tables, projections of 8 dimensions a table, and scale: at cosine 0.95 a projection moves about 0.45 on average,
#: where E8's points are sqrt(2) apart.
TABLES, PARTS, SCALE, SEED = 16, 2, 0.5, 20240


@lru_cache(8)
def projections(dim: int, tables: int, parts: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * parts * 8)) * scale, rng.random(tables * parts * 8) * 2


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum) of each row of 8."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest point of E8 and twice the nearest one of the other coset, for each row of 8."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    pick = first[:, None]
    return np.rint(2 * np.where(pick, a, b)).astype(np.int64), np.rint(2 * np.where(pick, b, a)).astype(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by their largest component, so that no square over- or underflows."""
    return x / np.abs(x).max(1, keepdims=True)


def cells(x: np.ndarray, tables: int = TABLES, parts: int = PARTS, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cell codes (n, tables, 1 + parts): own cell, then the neighbouring ones."""
    r, shift = projections(x.shape[1], tables, parts, scale, seed)
    x = scaled(x)
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ r + shift
    own, near = decode(y.reshape(-1, 8))
    weights = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    code = lambda p: mix64((mix64(p.astype(np.uint64)) * weights).sum(1)).reshape(len(x), tables, parts)
    own, near = code(own), code(near)
    place = mix64(np.arange(1, parts + 1, dtype=np.uint64) + np.uint64(77))
    table = mix64(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(991))[None]
    own, near = own * place, near * place
    total = own.sum(2)
    out = [total, *(total - own[:, :, i] + near[:, :, i] for i in range(parts))]
    return mix64(np.stack(out, 2) + table[..., None]).astype(np.int64)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, parts: int = PARTS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Links: pairs found whose cosine is >= threshold; a pair's chance to be found is that of meeting in one of
    `tables` tables (measured in the tests: see README). Vectors that are null, zero, or hold null or non-finite
    components link with nothing; vectors of different lengths never link. n_links counts other rows, copies
    included. Rows without id link as others do, but name no component; repeated rows are copies of each other;
    other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "embedding_dedup")
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, F.transform(v, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.array_join("v", ","), 256)))
    # classes of equal vectors: copies are counted where they lie before anything is shuffled
    classes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), f"{path}/classes")

    def hashed(batches):
        for batch in batches:
            nodes, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                x = flat[starts[some][:, None] + np.arange(dim)]
                c = cells(x, tables, parts, scale)
                n, per = len(some), c.shape[1] * c.shape[2]
                own = np.broadcast_to(np.arange(c.shape[2]) == 0, c.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[some], per)), pa.array((c.reshape(n, -1) + dim).ravel()), pa.array(own.ravel())], names=["node", "cell", "own"])

    codes = stored(classes.select("node", "v").mapInArrow(hashed, "node long, cell long, own boolean"), f"{path}/codes")
    met = codes.select(F.col("node").alias("a"), "cell").join(codes.where("own").select(F.col("node").alias("b"), "cell"), "cell").where("a <> b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(batches):
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            a, b = x.values.to_numpy(), y.values.to_numpy()
            oa, ob = x.offsets.to_numpy(), y.offsets.to_numpy()
            good = np.zeros(batch.num_rows, bool)
            la, lb = np.diff(oa), np.diff(ob)
            for dim in np.unique(la[la == lb]):
                s = np.flatnonzero((la == dim) & (lb == dim))
                p, q = scaled(a[oa[s][:, None] + np.arange(dim)]), scaled(b[ob[s][:, None] + np.arange(dim)])
                good[s] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    left, right = (classes.select(F.col("node").alias(n), F.col("v").alias(m)) for n, m in (("a", "x"), ("b", "y")))
    links = stored(met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), f"{path}/links")

    weight = classes.select("node", "weight")
    both = links.union(links.select("b", "a"))
    degree = both.join(weight.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("others"))
    labels, _ = components(links, "embedding_components")
    placed = classes.drop("v").join(degree, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    placed = placed.join(smallest, "component").select("h", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    found = rows.select("vec_id", "h").join(placed, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
