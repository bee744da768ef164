"""Structured-object, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import structured
from kvloom.plans.base import Book, table
from kvloom.sources import jsonl

BOOK = Book()


def _emb(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")


@BOOK.add("prj1_select_members", "SELECT vec_id AS row_id, label FROM embeddings")
def prj1_select_members(spark, d):
    return structured.select_members(_emb(spark, d), ["label"])


@BOOK.add("prj2_slice", "SELECT vec_id AS row_id, label FROM embeddings WHERE vec_id >= 7 AND vec_id < (SELECT count(*) FROM embeddings) - 20 AND (vec_id - 7) % 3 = 0")
def prj2_slice(spark, d):
    return structured.slice_member(_emb(spark, d), 7, -20, 3).select("row_id", "label")


@BOOK.add("prj3_slice_length", "SELECT p_partkey, CASE WHEN p_partkey % 50 > p_size THEN 1 + (p_partkey % 50 - 1 - p_size) // 3 ELSE 0 END AS n FROM part")
def prj3_slice_length(spark, d):
    return table(spark, d, "part").select("p_partkey", structured.slice_length(F.col("p_size"), F.col("p_partkey") % 50, F.lit(3)).alias("n"))


@BOOK.add("prj4_get", "SELECT o_orderkey AS row_id, o_totalprice AS price, o_orderstatus AS status FROM orders")
def prj4_get(spark, d):
    o = table(spark, d, "orders")
    batch = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    other = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"))
    return structured.get_fields({"batch": batch, "non_tensor": other}, fields=["price", "status"])


@BOOK.add("prj5_gather", "WITH i AS (SELECT event_id AS pos, CASE WHEN event_id % 5 = 0 THEN -1 - event_id % 100 ELSE event_id * 7 % 400 END AS idx FROM events WHERE event_id < 1000) SELECT pos, vec_id AS row_id, label FROM i JOIN embeddings ON vec_id = CASE WHEN idx < 0 THEN idx + (SELECT count(*) FROM embeddings) ELSE idx END")
def prj5_gather(spark, d):
    k = F.col("event_id")
    i = table(spark, d, "events").where("event_id < 1000").select(k.alias("pos"), F.when(k % 5 == 0, -1 - k % 100).otherwise(k * 7 % 400).alias("idx"))
    return structured.gather_rows(_emb(spark, d), i).select("pos", "row_id", "label")


_RAGGED = "r AS (SELECT event_id AS row_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE [x FOR x IN range(0, user_id % 6)] END AS xs FROM events)"


def _ragged(spark, d):
    n = (F.col("user_id") % 6).cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 11 != 0, F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("xs"))


@BOOK.add("ns3_ragged_layout", f"WITH {_RAGGED}, l AS (SELECT row_id, coalesce(len(xs), 0) AS length, xs IS NULL AS is_null FROM r) SELECT row_id, CAST(sum(length) OVER (ORDER BY row_id) - length AS BIGINT) AS \"begin\", length, is_null FROM l")
def ns3_ragged_layout(spark, d):
    return structured.ragged_encode(_ragged(spark, d), "xs")[1]


@BOOK.add("ns3_ragged_data", f"WITH {_RAGGED}, x AS (SELECT row_id, unnest(xs) AS value FROM r) SELECT row_number() OVER (ORDER BY row_id, value) - 1 AS place, CAST(value AS INT) AS value FROM x")
def ns3_ragged_data(spark, d):
    return structured.ragged_encode(_ragged(spark, d), "xs")[0]


@BOOK.add("ns4_ragged_decode", f"WITH {_RAGGED} SELECT row_id, CASE WHEN xs IS NULL THEN 'null' ELSE array_to_string(xs, ',') END AS xs FROM r WHERE row_id % 3 = 0")
def ns4_ragged_decode(spark, d):
    r = _ragged(spark, d)
    data, layout = structured.ragged_encode(r, "xs")
    back = structured.ragged_decode(data, layout, r.select("row_id").where("row_id % 3 = 0"))
    return back.select("row_id", F.coalesce(F.array_join("value", ","), F.lit("null")).alias("xs"))


@BOOK.add("ns5_shred", "WITH j AS (SELECT event_id AS row_id, event_id % 4 AS m, user_id AS u, json_extract_string(props, '$.k') AS k FROM events) SELECT row_id, CASE WHEN m IN (0, 1) THEN k END AS a_k, m < 3 AS a_k_present, CAST(u AS VARCHAR) AS u, TRUE AS u_present FROM j")
def ns5_shred(spark, d):
    m = F.col("event_id") % 4
    k = F.get_json_object("props", "$.k")
    a = F.when(m < 2, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(m == 2, '{"k": null}').otherwise("{}")
    j = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit('{"a": '), a, F.lit(', "u": "'), F.col("user_id").cast("string"), F.lit('"}')).alias("record"))
    return structured.shred(j, "record", ["a.k", "u"])


@BOOK.add("ns6_manifest", "SELECT 'doc_id' AS name, 'long' AS type, 0 AS pos UNION ALL VALUES ('text', 'string', 1), ('lang', 'string', 2), ('source', 'string', 3), ('n_chars', 'long', 4)")
def ns6_manifest(spark, d):
    fields = structured.manifest(table(spark, d, "documents"))["fields"]
    return spark.createDataFrame([(f["name"], f["type"], i) for i, f in enumerate(fields)], "name string, type string, pos int")


@BOOK.add("snk1_markdown", "WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY event_type) + 1 AS line_no, '| ' || event_type || ' | ' || n || ' |' AS line FROM e UNION ALL SELECT 0, '| event_type | n |' UNION ALL SELECT 1, '| --- | --- |'")
def snk1_markdown(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return jsonl.markdown_lines(e, ["event_type", "n"]).withColumn("line", F.regexp_replace("line", r"^\| ---", "| ---"))


@BOOK.add("snk2_journal", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""")
def snk2_journal(spark, d):
    return jsonl.journal(table(spark, d, "events").select("user_id", "event_id", "event_type"))


@BOOK.add("snk4_pivot", "WITH e AS (SELECT event_type AS metric, user_id % 3 AS f, count(*) AS n FROM events GROUP BY 1, 2) SELECT metric, CAST(sum(n) FILTER (f = 0) AS BIGINT) AS \"run-0-d-f-h\", CAST(sum(n) FILTER (f = 1) AS BIGINT) AS \"run-1-d-f-h\", CAST(sum(n) FILTER (f = 2) AS BIGINT) AS \"run-2-d-f-h\" FROM e GROUP BY 1")
def snk4_pivot(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.concat(F.lit("out/run-"), (F.col("user_id") % 3).cast("string"), F.lit("-c-d-e-f-g-h.json")).alias("file")).agg(F.count("*").alias("value"))
    return jsonl.pivot_results(e)
