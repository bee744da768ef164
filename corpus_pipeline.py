"""A corpus pipeline of five training-data operators; each stage's result is written and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import collected, free_name, numbered, scratch, small, stored
from kvloom.llm.exact_dedup import exact_dedup
from kvloom.llm.jaccard_join import jaccard_classes
from kvloom.llm.language_id import fit, identify
from kvloom.llm.packing import pack
from kvloom.llm.pii import replace_entities

#: Rows of an Arrow batch at most: executors and their Python workers hold a few batches at once, beside the heap that the stages before left.
BATCH_ROWS = 1024


def _settled(spark: SparkSession) -> None:
    """Driver and executors give back the heap that the stages before left, and batches to Python have at most BATCH_ROWS rows from here on.

    A heap that has grown stays so while there is room in it, beside the workers' memory, though hardly anything in it is
    still used. As many tasks as there are cores ask for a full collection, after which a heap shrinks to a few times what it holds.
    """
    collected(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _without(docs: DataFrame, find) -> DataFrame:
    """Rows of docs but those that find, given (doc_id, text), names by doc_id.

    Where ids are null or repeated find gets keys of the rows instead, in the order of the ids, so a row never goes
    because another one has its id. Texts move only then and if there are too many ids to send to every task.
    """
    path, key = scratch(docs.sparkSession, "pipeline_ids"), free_name(docs, "row_key")
    rows = numbered(docs, "doc_id", key, f"{path}/rows")
    own = "doc_id" if rows is None else key
    rows = docs if rows is None else rows
    ids = find(rows.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias(own))
    return rows.join(small(stored(ids, f"{path}/ids")), own, "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject; learnt from the labelled rows of docs itself.

    Rows whose text is null or holds no letter go, as do all rows if none is labelled. Null and repeated ids stay as
    they are (a null id is never held out); columns named as the identification's own keep the caller's values.
    """
    _settled(spark)
    model = fit(docs.select("doc_id", "text", "lang"))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    return identify(told, model).where(~F.col("rejected")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts one of smallest doc_id; those without id come last.

    Null and empty texts are equal. Rows with one id and different texts are rows of their own; other columns are
    kept as they are; an empty table gives no rows.
    """
    _settled(spark)
    return _without(docs, lambda rows: exact_dedup(rows).where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of rows linked by 5-word shingles at Jaccard 0.75 one of smallest doc_id; those without id come last.

    Rows without words link with nothing and stay. Rows with one id and different texts are rows of their own; other
    columns are kept as they are; an empty table gives no rows.
    """
    _settled(spark)
    return _without(docs, lambda rows: jaccard_classes(rows, 75, 100).where("doc_id <> component_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text.

    Every row stays: null and empty texts, null and repeated ids and other columns are kept as they are.
    """
    _settled(spark)
    before, n = free_name(docs, "text_before"), F.length("text").cast(docs.schema["n_chars"].dataType)
    replaced = replace_entities(docs.withColumn(before, F.col("text")), count_col=None)
    return replaced.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(n)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; null ids stay null and repeated rows are documents of their own.
    """
    import public_tokenizers

    _settled(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1, words=150_000, keep=False)  # executors still hold heap of the stages before, and a next run finds the workers as this one leaves them


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), scratch(spark, f"pipeline_{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
