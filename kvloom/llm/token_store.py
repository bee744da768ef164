"""Content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ids says so, so equal passages give equal chunks.
A chunk lies once in the store, under the SHA-256 of its bytes; a document is a recipe (its chunks' digests in
order) with the root of the Merkle tree over them. Recipes lie in ascending document order. Reading back checks
each chunk against its digest, each recipe against its root and each part's roots against the manifest.

Files below the store's folder, all Parquet:
  chunks/    digest, n, body (ids as little-endian uint16)
  recipes/   part, doc_id, row, n_tokens, digests (32 bytes each), root; parts ascend, rows in a part too
  manifest/  part, n_docs, n_tokens, root (Merkle root of the part's document roots)
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.llm.common import drop, mix64, parts, scratch, small, stored
from kvloom.llm.tokens import LibraryEncoder, SpacedSegments, once, read_text

#: Ids in the rolling window; a chunk ends where the window's hash has `MASK` clear; least and most ids of a chunk.
WINDOW, MASK, LEAST, MOST = 16, 511, 64, 4096


@lru_cache(1)
def _gear() -> np.ndarray:
    return mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of uint16 ids, the last one len(ids)."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    sums = np.cumsum(_gear()[ids])
    rolled = sums[WINDOW:] - sums[:-WINDOW]
    ends, last = [], 0
    for e in (np.flatnonzero((mix64(rolled) & np.uint64(MASK)) == 0) + WINDOW + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST and e < n:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed upward, an odd one goes up as it is; no leaf gives the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _times(a: int, b: int) -> int:
    """Product of polynomials over GF(2) modulo that of crc32, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(1 << 14)
def _shift(size: int) -> int:
    """x to the power 8 * size, modulo the polynomial of crc32."""
    out, square, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            out = _times(square, out)
        square, n = _times(square, square), n >> 1
    return out


def crc_join(first: int, second: int, size: int) -> int:
    """crc32 of two strings in a row from theirs; size: bytes of the second."""
    return _times(_shift(size), first) ^ second


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts by the tokenizers library, append end_id to each document and write the store at `path`.

    Null text is empty (the end id alone); rows without id come last; repeated rows are documents of their own
    that share all chunks; other columns are ignored; an empty table gives empty files. Ids are below 65,536.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(read_text(vocabulary))

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, sent, row = once(("library", vocabulary), lambda: SpacedSegments(LibraryEncoder(content.value))), set(), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u2").tobytes()
        for batch in parts(batches):
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.many([text or "" for text in batch.column(1).to_pylist()])):
                ids = np.frombuffer(ids + end, "<u2")
                digests, last = [], 0
                for e in cut(ids):
                    body = ids[last:e].tobytes()
                    digests.append(hashlib.sha256(body).digest())
                    if digests[-1] not in sent:
                        sent.add(digests[-1])
                        rows.append(("chunk", None, None, e - last, digests[-1], None, body))
                    last = e
                if len(sent) > 1 << 19:
                    sent.clear()
                rows.append(("recipe", key, row, len(ids), b"".join(digests), merkle(digests), None))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["kind", "doc_id", "row", "n", "digest", "root", "body"])

    schema = "kind string, doc_id long, row long, n long, digest binary, root binary, body binary"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source.mapInArrow(encoded, schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(schema).parquet(f"{path}/staged")

    # only chunks that several tasks made are shuffled; the others go to the store as they lie
    chunks = staged.where("kind = 'chunk'").select("digest", "n", "body")
    again = chunks.groupBy("digest").count().where("count > 1").select("digest")
    again = small(stored(again, f"{path}/again"))
    chunks.join(again, "digest", "left_anti").unionByName(chunks.join(again, "digest", "left_semi").dropDuplicates(["digest"])).write.option("compression", "zstd").parquet(f"{path}/chunks")

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]
    recipes = staged.where("kind = 'recipe'").select("doc_id", "row", F.col("n").alias("n_tokens"), F.col("digest").alias("digests"), "root")
    recipes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop(spark, f"{path}/staged", f"{path}/again")

    _roots(spark.read.parquet(f"{path}/recipes"), order).write.parquet(f"{path}/manifest")


_MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _roots(recipes: DataFrame, order: list) -> DataFrame:
    """One manifest row for each part of the recipes: documents, tokens and the Merkle root of their roots in order."""

    def rooted(batches):
        import pandas as pd

        last, n_docs, n_tokens, roots = None, 0, 0, []
        for pdf in batches:
            for part, n, root in zip(pdf["part"], pdf["n_tokens"], pdf["root"]):
                if last is not None and part != last:
                    yield pd.DataFrame([(last, n_docs, n_tokens, merkle(roots))], columns=["part", "n_docs", "n_tokens", "root"])
                    n_docs, n_tokens, roots = 0, 0, []
                last, n_docs, n_tokens = part, n_docs + 1, n_tokens + n
                roots.append(root)
        if last is not None:
            yield pd.DataFrame([(last, n_docs, n_tokens, merkle(roots))], columns=["part", "n_docs", "n_tokens", "root"])

    by_part = recipes.select("part", "doc_id", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", *order)
    return by_part.select("part", "n_tokens", "root").mapInPandas(rooted, _MANIFEST)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of each document, from the store's files.

    Bodies are read where they lie: of each only its digest's check, its length and its crc32 are shuffled.
    verified: every chunk has its digest, the recipe its root and the recipe's part the root in the manifest. Raises
    ValueError where a part hasn't the documents and tokens of its manifest row, as no row could say so.
    """

    def summed(batches):
        import pandas as pd

        for pdf in batches:
            wide = [np.frombuffer(b, "<u2").astype("<u4").tobytes() for b in pdf["body"]]
            yield pd.DataFrame({"digest": pdf["digest"], "n": [len(w) // 4 for w in wide], "crc": [zlib.crc32(w) for w in wide], "sound": [hashlib.sha256(b).digest() == d for b, d in zip(pdf["body"], pdf["digest"])]})

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "body").mapInPandas(summed, "digest binary, n long, crc long, sound boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    n = F.floor(F.length("digests") / 32).cast("int")
    each = recipes.select("row", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"), "digests").select("row", "at", F.expr("substring(digests, at * 32 + 1, 32)").alias("digest"))
    joined = each.join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc", "sound"))).alias("chunks"))

    # a row for each part: what its recipes give against its manifest row
    found = _roots(recipes, [F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")]).select("part", F.struct("n_docs", "n_tokens").alias("found"), F.col("root").alias("found_root"))
    parts = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").join(found, "part", "full")
    parts = stored(parts.select("part", "n_tokens", F.struct("n_docs", "n_tokens").eqNullSafe(F.col("found")).alias("whole"), F.col("root").eqNullSafe(F.col("found_root")).alias("rooted")), scratch(spark, "token_store_parts"))
    wrong = parts.where("not whole").count()
    if wrong:
        raise ValueError(f"recipes of {wrong} parts are not those of the manifest")

    # ids of the parts before, then of the documents before in the part
    before = parts.select("part", "rooted", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").isNull(), "doc_id", "row")
    starts = recipes.select("part", "doc_id", "row", "n_tokens", "digests", "root").withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    rows = starts.join(F.broadcast(before), "part").join(joined, "row", "left").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "digests", "root", "chunks", "rooted")

    def rebuilt(batches):
        import pyarrow as pa

        for b in batches:
            ns, crcs, fine = [], [], []
            for n_tokens, digests, root, chunks, rooted in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                crc, total, chunks = 0, 0, chunks or []
                for c in chunks:
                    crc = crc_join(crc, c["crc"], 4 * c["n"])
                    total += c["n"]
                leaves = [digests[i : i + 32] for i in range(0, len(digests), 32)]
                ns.append(total)
                crcs.append(crc)
                fine.append(rooted and total == n_tokens and len(leaves) == len(chunks) and merkle(leaves) == root and all(c["sound"] for c in chunks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64()), pa.array(fine, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return rows.mapInArrow(rebuilt, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document, rebuilt from its recipe."""

    def widen(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.concatenate([np.frombuffer(c["body"], "<u2") for c in x]).astype("i4") for x in pdf["chunks"]]})

    recipes = spark.read.parquet(f"{path}/recipes")
    each = recipes.select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.floor(F.length("digests") / 32).cast("int") - 1)).alias("at"), "digests")
    each = each.select("doc_id", "row", "at", F.expr("substring(digests, at * 32 + 1, 32)").alias("digest"))
    bodies = each.join(spark.read.parquet(f"{path}/chunks").select("digest", "body"), "digest")
    return bodies.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("chunks")).mapInPandas(widen, "doc_id long, ids array<int>")
