"""Streams give what the batch operators give over the same rows."""

from pyspark.sql import functions as F

from kvloom.operators import oplog
from kvloom.streaming import state

LOG = "shard long, seq long, op string, key string, payload string"


def stream(spark, tmp_path, parts, schema):
    """A file stream of the parts, one micro-batch each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")


def drained(spark, df, tmp_path, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName("drained").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("drained").collect()


def test_strict_log_holds_early_entries(spark, tmp_path):
    parts = [[(1, 0, "PUT_END", "a", "x"), (1, 2, "REMOVE", "a", ""), (1, 0, "PUT_END", "a", "dup")], [(1, 1, "FLY", "b", ""), (1, 1, "PUT_END", "b", "y")], [(1, 3, "PUT_END", "a", "z")]]
    rows = drained(spark, state.strict_oplog(stream(spark, tmp_path, parts, LOG)), tmp_path, "append")
    assert sorted(r["seq"] for r in rows if r["status"] == "applied") == [0, 1, 2, 3]
    assert [r["status"] for r in rows if r["op"] == "FLY"] == ["rejected"] and sum(r["status"] == "skipped" for r in rows) == 1
    live = oplog.compact(spark.createDataFrame([tuple(r)[:5] for r in rows if r["status"] == "applied"], LOG), ["shard", "key"])
    assert {(r["key"], r["payload"]) for r in live.collect()} == {("b", "y"), ("a", "z")}


def test_log_state_equals_batch(spark, tmp_path):
    parts = [[(1, i, ("PUT_END", "REMOVE", "NOOP", "PUT_END")[i % 4], f"k{i % 5}", str(i)) for i in range(a, a + 20)] for a in (0, 20, 40)]
    rows = drained(spark, state.apply_oplog(stream(spark, tmp_path, parts, LOG), ["shard", "key"]), tmp_path, "update")
    last: dict = {}
    for r in rows:
        last[r["key"]] = max(last.get(r["key"], (-1,)), (r["seq"], r["op"], r["payload"]))
    batch = oplog.compact(spark.createDataFrame([x for p in parts for x in p], LOG), ["shard", "key"])
    assert {(k, v[2]) for k, v in last.items() if v[1] == "PUT_END"} == {(r["key"], r["payload"]) for r in batch.collect()}


def test_heat_equals_batch_but_for_open_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts").orderBy("ts").collect()
    parts = [[tuple(r) for r in e[i : i + 250]] for i in range(0, len(e), 250)]
    schema = "user_id long, ts timestamp_ntz"
    rows = drained(spark, state.heat(stream(spark, tmp_path, parts, schema), "user_id", "ts", 86400), tmp_path, "append")
    batch = oplog.heat_windows(spark.createDataFrame([x for p in parts for x in p], schema), "user_id", "ts", 86400).collect()
    whole = {(r["user_id"], r["start_us"], r["hits"]) for r in batch}
    got = {(r["user_id"], r["start_us"], r["hits"]) for r in rows}
    assert got <= whole and len(whole - got) == len({r["user_id"] for r in batch})


def test_rates_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").collect()
    parts = [[tuple(r) for r in e[i : i + 400]] for i in range(0, len(e), 400)]
    schema = "event_type string, ts timestamp"
    rows = drained(spark, state.rates(stream(spark, tmp_path, parts, schema), "event_type", "ts", "6 hours"), tmp_path, "append")
    batch = spark.createDataFrame([x for p in parts for x in p], schema).groupBy("event_type", F.window("ts", "6 hours")["start"].alias("start")).agg(F.count("*").alias("n")).collect()
    assert len(rows) > 10 and {tuple(r) for r in rows} <= {tuple(r) for r in batch}


def test_index_events(spark, tmp_path):
    schema = "s long, seq long, kind string, hash long"
    parts = [[(1, 0, "stored", 7), (1, 1, "stored", 8), (1, 2, "stored", 9), (1, 3, "removed", 9)], [(1, 4, "cleared", None), (1, 5, "stored", 8)]]
    rows = drained(spark, state.index_events(stream(spark, tmp_path, parts, schema), ["s"], "hash"), tmp_path, "update")
    last: dict = {}
    for r in rows:
        last[r["hash"]] = max(last.get(r["hash"], (-1,)), (r["seq"], r["kind"]))
    cleared = last.pop(None)[0]
    live = {h for h, (q, k) in last.items() if k == "stored" and q > cleared}
    batch = oplog.event_index(spark.createDataFrame([x for p in parts for x in p], schema).withColumnsRenamed({"seq": "event_id", "kind": "event_type"}), ["s"], "hash")
    assert live == {r["hash"] for r in batch.collect()} == {8}
