"""JSON-lines sources and report sinks (SRC1-SRC3, SNK1-SNK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "timestamp double, input_length int, output_length int, hash_ids array<bigint>"
REPLAY = "schema_version int, op_id bigint, lane int, op string, object_id bigint, key string, invoke_ns bigint, return_ns bigint, result string"
OPLOG = "schema_version int, `case` string, repeat int, entries bigint, entries_per_sec double, transactions_per_sec double, cpu_cores_used double, batch_entries_mean double, encoded_bytes bigint, stage_latency_us map<string,double>"
#: Operations that a replay log may hold; fixed values.
OPERATIONS = ("put", "get", "remove", "exists", "upsert")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: requests of a trace; blank lines are skipped, missing fields are 0 or an empty list."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", TRACE).alias("r")).select("r.*")
    return raw.select(F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"), F.coalesce("input_length", F.lit(0)).alias("input_length"), F.coalesce("output_length", F.lit(0)).alias("output_length"), F.coalesce("hash_ids", F.array().cast("array<bigint>")).alias("hash_ids"))


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: validated operations; the first bad line of a file aborts the read with its number (1-based) when it runs.

    Each line must hold all fields, schema_version 1 and a known operation. Line numbers need whole files, so a file is one partition.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    r = lines.select((F.col("line") + 1).alias("line"), F.from_json("value", REPLAY).alias("r"))
    needed = ("op_id", "lane", "op", "object_id", "key", "invoke_ns", "return_ns", "result")
    bad = F.col("r").isNull() | (F.coalesce(F.col("r.schema_version"), F.lit(0)) != 1) | ~F.coalesce(F.col("r.op").isin(*OPERATIONS), F.lit(False))
    for c in needed:
        bad = bad | F.col(f"r.{c}").isNull()
    return r.select(F.when(bad, F.raise_error(F.concat(F.lit("bad line "), F.col("line").cast("string")))).otherwise(F.col("line")).cast("long").alias("line"), "r.*")


def read_oplog_runs(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: benchmark runs of schema version 1 with a case; others abort the read when it runs."""
    r = spark.read.schema(OPLOG).json(path)
    bad = (F.coalesce("schema_version", F.lit(0)) != 1) | F.col("case").isNull()
    return r.withColumn("schema_version", F.when(bad, F.raise_error(F.lit("unsupported run"))).otherwise(F.col("schema_version")).cast("int"))


def oplog_report(runs: DataFrame) -> DataFrame:
    """AGG4 over SRC3: per case medians, cv, stage medians and shares, bottleneck, theoretical rate, efficiency, status and what is missing.

    A field's median is given only if every row has it. Bytes per entry: median of encoded_bytes / entries.
    """
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.median(c))
    base = runs.groupBy("case").agg(F.count("*").alias("repeats"), whole("entries_per_sec").alias("median"), F.min("entries_per_sec").alias("min"), F.max("entries_per_sec").alias("max"), F.try_divide(F.stddev_pop("entries_per_sec"), F.avg("entries_per_sec")).alias("cv"), whole("cpu_cores_used").alias("cpu"), F.when(F.count("encoded_bytes") == F.count("*"), F.median(F.try_divide("encoded_bytes", "entries"))).alias("bytes_per_entry"))
    n = runs.groupBy("case").agg(F.count("*").alias("_n"))
    stages = runs.select("case", F.explode("stage_latency_us").alias("stage", "us")).groupBy("case", "stage").agg(F.median("us").alias("us"), F.count("us").alias("k")).join(n, "case").where("k = _n")
    top = stages.groupBy("case").agg(F.min(F.struct((-F.col("us")).alias("m"), "stage")).alias("t"), F.sum("us").alias("total"))
    us = -F.col("t.m")
    missing = F.array_compact(F.array(F.when(F.col("median").isNull(), "entries_per_sec"), F.when(F.col("cpu").isNull(), "cpu_cores_used"), F.when(F.col("bytes_per_entry").isNull(), "encoded_bytes"), F.when(F.col("t.stage").isNull(), "stage_latency_us")))
    theoretical = F.try_divide(F.lit(1e6), us)
    return base.join(top, "case", "left").select("case", "repeats", "median", "min", "max", "cv", "cpu", "bytes_per_entry", F.col("t.stage").alias("bottleneck"), F.try_divide(us, "total").alias("share"), theoretical.alias("theoretical"), F.try_divide("median", theoretical).alias("efficiency"), F.when(F.size(missing) > 0, "insufficient_data").otherwise("ok").alias("status"), missing.alias("missing"))


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """SNK1: one frame as JSON, CSV and Markdown (text lines) with the same columns in order; a report is a small frame, sorted by its first column."""
    rows = df.select(*order).coalesce(1).sortWithinPartitions(order[0])
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    markdown_lines(rows, order).select("line").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """SNK1: a Markdown table's lines: (line_no, line) with heading and rule first."""
    from pyspark.sql.window import Window

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(order[0])) + 1).alias("line_no"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(order) + " |"), (1, "|" + " --- |" * len(order))], "line_no int, line string")
    return head.union(body).orderBy("line_no")


def journal(df: DataFrame) -> DataFrame:
    """SNK2: one JSON line per row, keys in alphabetical order, nulls kept out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def qos_lines(report: DataFrame, run: Column) -> DataFrame:
    """SNK3: one JSON line a run with a nested `classes` array, absent values as null."""
    cls = F.struct(*sorted(c for c in report.columns if c not in ("jain", "run")))
    one = report.groupBy(run.alias("run")).agg(F.max("jain").alias("jain"), F.array_sort(F.collect_list(cls)).alias("classes"))
    return one.select(F.to_json(F.struct("run", "jain", "classes"), {"ignoreNullFields": "false"}).alias("value"))


def pivot_results(results: DataFrame, name: str = "file", metric: str = "metric", value: str = "value") -> DataFrame:
    """SNK4: metrics as rows, files as columns; a column's name is parts 1, 2, 4, 6 and 8 of the file's name split on -."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), "-")
    label = F.concat_ws("-", *[F.get(parts, F.lit(i - 1)) for i in (1, 2, 4, 6, 8)])
    return results.withColumn("_label", label).groupBy(metric).pivot("_label").agg(F.first(value))
