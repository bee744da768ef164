"""Exact deduplication by a keyed stream without expiry whose state lives on disk (RocksDB).

The state holds, for each digest of a normalised text, how many rows had it, the smallest identifier seen so
far and a locator of that row's content. Texts never enter the state or its shuffle: only rows that hit an
existing digest, and the rows they hit, have their whole bytes compared, found again by locator.

With a checkpoint folder the state of earlier calls goes on: rows of a new call are held against all rows before
them, whose texts lie in that folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import exists, scratch, small, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hits compared with one copy of the kept text; a larger group gets more copies.
HITS_PER_COPY = 512


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_feed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, batch: int = 0) -> DataFrame:
    """(digest, id, locator) of every row: what the keyed state retains. Locators (batch, row) are unique in all batches."""
    whole = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    return docs.select(
        F.unhex(whole).substr(1, digest_bits // 8).alias("digest"),
        F.col(id_col).cast("long").alias("id"),
        F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")).alias("locator"),
        F.unhex(whole).alias("content"),
    )


def keyed_state(stream: DataFrame) -> DataFrame:
    """Streaming aggregation per digest; rows of a digest are combined before they are shuffled."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    return stream.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))


def run_stream(feed_path: str, schema, spark, checkpoint: str, files_per_batch: int = 256) -> DataFrame:
    """Feed the files at feed_path, as far as they are new, through the state kept at `checkpoint`; return the state.

    A second call with the same checkpoint and more files goes on from the state of the first.
    """
    prefix = "spark.sql.streaming.stateStore."
    # many small stores: no space reserved ahead for each
    wanted = {f"{prefix}providerClass": ROCKSDB, f"{prefix}rocksdb.allowFAllocate": "false"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed_path)
        query = keyed_state(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    first, n = (f"value.`{c.name}`" for c in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"{first}.id").alias("keep_id"), F.col(f"{first}.locator").alias("keep_locator"), F.col(n).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, checkpoint: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Rows are equal when their texts are after each run of [\\x20\\x09-\\x0D] became one space; null is empty. The
    row with the smallest id stays; rows without id come last. Of rows that repeat id and text, one stays.
    Other columns of docs are ignored, whatever their names. An empty table gives no rows.

    checkpoint: a folder that all executors share. A later call with it goes on from its state: groups then hold the
    rows of all calls, texts of earlier ones are read from there, and the rows of the new docs are returned.
    digest_bits shortens the digest of the keyed state (tests use it to force collisions). Rows whose bytes
    differ from those of the row that their digest hit are grouped anew by their whole digest and bytes.
    """
    spark = docs.sparkSession
    path = scratch(spark, "exact_dedup")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    home, batch = checkpoint or path, 0
    if checkpoint:
        batch = next(n for n in count() if not exists(spark, f"{home}/texts/batch={n}/_SUCCESS"))
        new = stored(docs, f"{home}/texts/batch={batch}")
        docs = spark.read.schema(new.schema).parquet(f"{home}/texts/batch=*")
        digest_feed(new, "id", "text", digest_bits, batch).write.mode("append").option("compression", "zstd").parquet(f"{home}/feed")
        feed = spark.read.parquet(f"{home}/feed")
    else:
        feed = stored(digest_feed(docs, "id", "text", digest_bits), f"{home}/feed")
    state = run_stream(f"{home}/feed", feed.schema, spark, f"{home}/stream")
    groups = stored(state.where("group_size > 1"), f"{path}/groups")
    if checkpoint:  # all rows of the groups that the new ones belong to
        fresh = feed.where(F.col("locator.batch") == batch)
        feed = feed.join(stored(fresh.select("digest").distinct(), f"{path}/fresh"), "digest", "left_semi")
    marked = feed.join(groups, "digest", "left").withColumns({"keep_id": F.when(F.col("keep_locator").isNull(), F.col("id")).otherwise(F.col("keep_id")), "keep_locator": F.coalesce("keep_locator", "locator"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})

    # whole bytes of hits against those of the rows they hit: of other rows no text moves
    inside = stored(marked.where("group_size > 1"), f"{path}/inside")
    if inside.isEmpty():
        differ = None
    else:
        wanted = small(inside.select("id").where("id is not null").distinct())
        with_id = docs.join(wanted, "id", "left_semi").union(docs.where("id is null")).select(F.col("id").alias("t_id"), normalised(F.col("text")).alias("t"))
        whole = with_id.withColumn("t_content", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
        texts = inside.join(whole, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("content") == F.col("t_content"))).select("id", "locator", "keep_locator", "group_size", "t").dropDuplicates(["locator"])
        copies = F.ceil(F.col("group_size") / HITS_PER_COPY).cast("int")
        hits = texts.where("locator <> keep_locator").withColumn("part", F.pmod(F.hash("locator"), copies))
        heads = texts.where("locator = keep_locator").select(F.col("keep_locator"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"), F.col("t").alias("head"))
        differ = stored(hits.join(heads, ["keep_locator", "part"]).where("t <> head").select("locator", "id", F.col("t").alias("text"), "keep_locator"), f"{path}/differ")
    result = marked
    if differ is not None and not differ.isEmpty():
        anew = differ.groupBy("text").agg(F.min(F.struct(F.col("id").isNull(), "id", "locator")).alias("f"), F.count("*").alias("m"))
        moved = differ.join(anew, "text").select("locator", F.col("f.id").alias("k"), F.col("f.locator").alias("kl"), F.col("m"))
        lost = differ.groupBy("keep_locator").agg(F.count("*").alias("lost"))
        result = (
            marked.join(moved, "locator", "left").join(lost, "keep_locator", "left")
            .withColumns({"keep_id": F.when(F.col("m").isNotNull(), F.col("k")).otherwise(F.col("keep_id")), "group_size": F.coalesce("m", F.col("group_size") - F.coalesce("lost", F.lit(0))), "keep_locator": F.coalesce("kl", "keep_locator")})
        )
    return result.where(F.col("locator.batch") == batch).select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("locator") == F.col("keep_locator")).alias("kept"), F.lower(F.hex("content")).alias("text_sha256"))
