"""Queries op1 to op10: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"), 200)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kvloom.llm.chat_format import digests, format_chats

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return digests(format_chats(turns.unionByName(more)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kvloom.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kvloom.llm.common import scratch
    from kvloom.llm.token_store import read_store, write_store

    path = scratch(spark, "token_store")
    write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_store(spark, path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.language_id import fit, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kvloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), 75, 100)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kvloom.llm.pii import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_chat_format": op3_chat_format, "op4_byte_bpe": op4_byte_bpe, "op5_token_store": op5_token_store, "op6_language_id": op6_language_id, "op7_embedding_dedup": op7_embedding_dedup, "op8_packing": op8_packing, "op9_jaccard_join": op9_jaccard_join, "op10_pii": op10_pii}

_CONTROL = r"<\|turn\|>|<\|text\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

ORACLES = {
    "op3_chat_format": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, replace(role, chr(92), chr(92) || chr(92)) AS r2, replace(text, chr(92), chr(92) || chr(92)) AS t2 FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(r2) + length(t2) + len(regexp_extract_all(r2, '{_CONTROL}')) + len(regexp_extract_all(t2, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)""",
}
