"""Prefix-cache and trace queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import prefix, stats
from kvloom.plans.base import Book, table

BOOK = Book()
BLOCK = 512
_CHAIN = f"""
    d AS (SELECT doc_id, text, CAST(length(text) // {BLOCK} AS BIGINT) AS blocks FROM documents WHERE length(text) >= {BLOCK}),
    c AS (SELECT doc_id, i - 1 AS pos, md5(substr(text, 1, {BLOCK} * i)) AS pid FROM (SELECT doc_id, text, unnest(range(1, blocks + 1)) AS i FROM d)),
    s AS (SELECT doc_id, pos, pid, row_number() OVER (PARTITION BY pid ORDER BY doc_id, pos) = 1 AS miss FROM c)"""


@BOOK.add("sc6_blocks", f"SELECT doc_id, CAST(length(text) // {BLOCK} AS BIGINT) AS n_blocks, CAST(length(text) % {BLOCK} AS BIGINT) AS rest FROM documents")
def sc6_blocks(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", prefix.block_count(text, BLOCK).alias("n_blocks"), (F.length(text) % BLOCK).cast("long").alias("rest"))


@BOOK.add("win4_prefix_chain", f"WITH {_CHAIN} SELECT CAST(pos AS BIGINT) AS pos, count(*) AS n, count(DISTINCT pid) AS n_ids FROM c GROUP BY pos")
def win4_prefix_chain(spark, d):
    chain = prefix.prefix_chain(table(spark, d, "documents").where(F.length("text") >= BLOCK), "doc_id", "text", BLOCK)
    # ids first, so that a depth with many rows is counted where they lie
    return chain.groupBy("pos", "prefix_id").agg(F.count("*").alias("c")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sum("c").alias("n"), F.count("*").alias("n_ids"))


@BOOK.add("win1_first_seen_pages", f"WITH {_CHAIN} SELECT doc_id, count(*) AS accesses, count(*) FILTER (miss) AS misses FROM s GROUP BY doc_id")
def win1_first_seen_pages(spark, d):
    chain = prefix.prefix_chain(table(spark, d, "documents").where(F.length("text") >= BLOCK), "doc_id", "text", BLOCK)
    return prefix.first_seen(chain, "prefix_id", ["doc_id", "pos"]).groupBy("doc_id").agg(F.count("*").alias("accesses"), F.count_if("is_miss").alias("misses"))


@BOOK.add(
    "jn7_prefix_match",
    f"WITH {_CHAIN} SELECT doc_id, count(*) AS blocks, count(*) FILTER (NOT miss) AS hits, CAST(coalesce(min(pos) FILTER (miss), count(*)) * {BLOCK} AS BIGINT) AS longest_matched FROM s GROUP BY doc_id",
)
def jn7_prefix_match(spark, d):
    return prefix.prefix_match(table(spark, d, "documents").where(F.length("text") >= BLOCK), "doc_id", "text", BLOCK)


@BOOK.add(
    "agg1_trace_stats",
    f"""WITH {_CHAIN}, m AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (NOT miss) AS hits FROM s GROUP BY doc_id)
    SELECT count(*) AS requests, CAST(sum(length(text)) AS BIGINT) AS input_chars, CAST(coalesce(sum(hits), 0) AS BIGINT) AS read_pages, CAST(coalesce(sum(m.blocks - hits), 0) AS BIGINT) AS write_pages, CAST(coalesce(sum(m.blocks), 0) AS BIGINT) AS total_pages,
      round(CASE WHEN sum(m.blocks) > 0 THEN sum(m.blocks - hits) / sum(m.blocks) ELSE 0 END, 8) AS write_ratio, round(CASE WHEN sum(m.blocks) > 0 THEN sum(hits) / sum(m.blocks) ELSE 0 END, 8) AS hit_rate FROM documents LEFT JOIN m USING (doc_id)""",
)
def agg1_trace_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    matched = jn7_prefix_match(spark, d)
    sizes = docs.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("input_chars"))
    pages = matched.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("read_pages"), F.coalesce(F.sum(F.col("blocks") - F.col("hits")), F.lit(0)).alias("write_pages"))
    total = F.col("read_pages") + F.col("write_pages")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), total), F.lit(0.0)), 8)
    return sizes.crossJoin(F.broadcast(pages)).withColumns({"total_pages": total, "hit_rate": share("read_pages"), "write_ratio": share("write_pages")})


@BOOK.add("agg2_merge_samples", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.99), 8) AS p99, CAST(count(DISTINCT user_id % 8) AS BIGINT) AS threads FROM events GROUP BY event_type")
def agg2_merge_samples(spark, d):
    """Percentiles of all threads' samples together, not means of their percentiles."""
    e = table(spark, d, "events").withColumn("thread", F.col("user_id") % 8)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 8).alias("p50"), F.round(F.percentile("value", 0.99), 8).alias("p99"), F.count_distinct("thread").alias("threads"))


@BOOK.add("win5_sample", "SELECT event_id, arrival FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS arrival FROM events) WHERE arrival % 7 = 0")
def win5_sample(spark, d):
    return stats.systematic_sample(table(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 7).select("event_id", "arrival")


@BOOK.add("win6_pacing", "SELECT event_id, round(100.0::DOUBLE + CAST(epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events) AS DOUBLE) / 2000.0::DOUBLE, 6) AS target FROM events")
def win6_pacing(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return stats.pacing(table(spark, d, "events"), ms, 100.0, 2.0).select("event_id", F.round("target", 6).alias("target"))


@BOOK.add(
    "jn7_cached_by_medium",
    f"""WITH {_CHAIN}, r AS (SELECT doc_id, pos, pid FROM c WHERE doc_id % 2 = 0), k AS (SELECT DISTINCT pid, doc_id % 3 AS instance FROM c WHERE doc_id % 2 = 1),
    h AS (SELECT DISTINCT r.doc_id, r.pos, k.instance FROM r JOIN k USING (pid)), g AS (SELECT doc_id, instance, pos, row_number() OVER (PARTITION BY doc_id, instance ORDER BY pos) - 1 AS rn FROM h)
    SELECT doc_id AS req_id, instance, CAST(count(*) FILTER (pos = rn) * {BLOCK} AS BIGINT) AS longest_matched FROM g GROUP BY 1, 2""",
)
def jn7_cached_by_medium(spark, d):
    """Even documents ask three instances that hold the odd documents' blocks."""
    chain = prefix.prefix_chain(table(spark, d, "documents").where(F.length("text") >= BLOCK), "doc_id", "text", BLOCK).withColumnRenamed("prefix_id", "hash")
    cached = chain.where("doc_id % 2 = 1").select((F.col("doc_id") % 3).alias("instance"), F.lit("cpu").alias("medium"), "hash").distinct()
    return prefix.match_cached(chain.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "req_id"), cached, BLOCK).select("req_id", "instance", "longest_matched")


def _lines(spark, df, name):
    """A JSONL file of df in the scratch folder."""
    from kvloom.session import scratch

    path = scratch(spark, name)
    df.write.text(path)
    return path


@BOOK.add("src1_trace_requests", "SELECT event_id / 4.0::DOUBLE AS timestamp, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS INT) AS input_length, CAST(0 AS INT) AS output_length, CASE WHEN event_id % 2 = 0 THEN event_id || ',' || user_id ELSE '' END AS hash_ids FROM events")
def src1_trace_requests(spark, d):
    """Requests written as JSON lines with fields left out and blank lines between, and read back."""
    from kvloom.sources import jsonl

    k, u = F.col("event_id"), F.col("user_id")
    r = F.struct((k / 4).alias("timestamp"), F.when(k % 3 != 0, u).alias("input_length"), F.when(k % 2 == 0, F.array(k, u.cast("long"))).alias("hash_ids"))
    e = table(spark, d, "events").select(F.explode(F.array(F.to_json(r), F.lit("  "))).alias("value"))
    return jsonl.read_trace(spark, _lines(spark, e, "trace")).withColumn("hash_ids", F.array_join(F.transform("hash_ids", lambda x: x.cast("string")), ","))


@BOOK.add("src2_replay_operations", "SELECT event_id AS op_id, CAST(user_id % 4 AS INT) AS lane, CASE event_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'get' ELSE 'remove' END AS op, 'k' || user_id AS key FROM events")
def src2_replay_operations(spark, d):
    from kvloom.sources import jsonl

    k, u = F.col("event_id"), F.col("user_id")
    op = F.element_at(F.array(F.lit("put"), F.lit("get"), F.lit("remove")), (k % 3 + 1).cast("int"))
    r = F.struct(F.lit(1).alias("schema_version"), k.alias("op_id"), (u % 4).alias("lane"), op.alias("op"), u.alias("object_id"), F.concat(F.lit("k"), u.cast("string")).alias("key"), k.alias("invoke_ns"), (k + 1).alias("return_ns"), F.lit("ok").alias("result"))
    return jsonl.read_replay(spark, _lines(spark, table(spark, d, "events").select(F.to_json(r)), "replay")).select("op_id", "lane", "op", "key")


@BOOK.add("src3_oplog_runs", "SELECT event_type AS \"case\", count(*) AS repeats, CAST(sum(event_id) AS BIGINT) AS entries FROM events GROUP BY 1")
def src3_oplog_runs(spark, d):
    from kvloom.sources import jsonl

    r = F.struct(F.lit(1).alias("schema_version"), F.col("event_type").alias("case"), F.lit(1).alias("repeat"), F.col("event_id").alias("entries"))
    runs = jsonl.read_oplog_runs(spark, _lines(spark, table(spark, d, "events").select(F.to_json(r)), "runs"))
    return runs.groupBy("case").agg(F.count("*").alias("repeats"), F.sum("entries").alias("entries"))


@BOOK.add("set5_runs_union", "SELECT run, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS run FROM events) GROUP BY 1")
def set5_runs_union(spark, d):
    """JSONL runs in files of their own, read as one."""
    e = table(spark, d, "events")
    paths = [_lines(spark, e.where(c).select(F.to_json(F.struct("event_id", F.lit(n).alias("run")))), f"run_{n}") for n, c in (("a", "true"), ("b", "event_id % 2 = 0"))]
    both = spark.read.schema("event_id long, run string").json(paths)
    return both.groupBy("run").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@BOOK.add("snk3_qos_lines", "SELECT user_id % 5 AS run, CAST(count(DISTINCT event_type) AS BIGINT) AS n_classes, min(event_type) AS first_class, TRUE AS null_kept FROM events GROUP BY 1")
def snk3_qos_lines(spark, d):
    """QoS lines read back: one a run, its classes nested, an absent value written as null."""
    from kvloom.sources import jsonl

    e = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    lines = spark.read.text(_lines(spark, jsonl.qos_lines(e.withColumns({"jain": F.lit(0.5), "p99": F.lit(None).cast("double")}), F.col("run")), "qos"))
    back = F.from_json("value", "run long, classes array<struct<n: bigint, name: string, p99: double>>")
    names = F.array_sort(F.transform(F.col("r.classes"), lambda c: c["name"]))
    return lines.select(back.alias("r"), "value").select("r.run", F.size("r.classes").cast("long").alias("n_classes"), F.get(names, F.lit(0)).alias("first_class"), F.contains("value", F.lit('"p99":null')).alias("null_kept"))


@BOOK.add("ud4_layout_accesses", "SELECT doc_id, CAST(layer AS INT) AS layer, CAST(page AS INT) AS page, CAST(layer * 1000000 + page * 64 AS BIGINT) AS place FROM (SELECT doc_id, unnest(range(0, length(text) // 4096)) AS page FROM documents) p, (VALUES (0), (1), (2)) v(layer)")
def ud4_layout_accesses(spark, d):
    """A layout of three layers of pages, given as a function."""
    from kvloom.operators.structured import accesses

    def layout(col):
        pages = F.floor(F.length(col("text")) / 4096).cast("int")
        each = lambda layer: F.transform(F.when(pages > 0, F.sequence(F.lit(0), pages - 1)).otherwise(F.array().cast("array<int>")), lambda p: F.struct(F.lit(layer).alias("layer"), p.alias("page"), (F.lit(layer * 1000000) + p * 64).cast("long").alias("place")))
        return F.concat(*[each(layer) for layer in range(3)])

    return accesses(table(spark, d, "documents").select("doc_id", "text"), layout).drop("text")


@BOOK.add("ns2_leaf_codecs", "SELECT key AS path, count(*) AS n, count(*) FILTER (type = 'NULL') AS nulls, CASE WHEN bool_and(type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')) THEN 'number' WHEN bool_and(type IN ('VARCHAR', 'NULL')) THEN 'text' ELSE 'json' END AS codec FROM events, json_each(props) GROUP BY 1")
def ns2_leaf_codecs(spark, d):
    from kvloom.operators.structured import leaf_codecs

    return leaf_codecs(table(spark, d, "events"), "props")
