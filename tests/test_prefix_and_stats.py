"""Trace sample, report golden, quantile definitions, rates."""

import statistics

import pytest
from pyspark.sql import functions as F

from kvloom.operators import prefix, stats
from kvloom.sources import jsonl


def test_trace_sample_matches_twelve_blocks(spark, tmp_path):
    lines = ['{"timestamp": 27482, "input_length": 6955, "output_length": 52, "hash_ids": [46,47,48,49,50,51,52,53,54,55,56,57,2353,2354]}', "", '{"timestamp": 30535, "input_length": 6472, "output_length": 26, "hash_ids": [46,47,48,49,50,51,52,53,54,55,56,57,2366]}', '{"timestamp": 1}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    t = jsonl.read_trace(spark, f"file://{tmp_path}/t.jsonl").orderBy("timestamp").collect()
    assert [(r["input_length"], len(r["hash_ids"])) for r in t] == [(0, 0), (6955, 14), (6472, 13)]
    cached = spark.createDataFrame([("i", "cpu", h) for h in t[1]["hash_ids"]], "instance string, medium string, hash long")
    asked = spark.createDataFrame([(1, i, h) for i, h in enumerate(t[2]["hash_ids"])], "req_id int, pos int, hash long")
    assert prefix.match_cached(asked, cached, 512).first()["longest_matched"] == 6144


def test_match_stops_at_the_first_miss(spark):
    df = spark.createDataFrame([(1, "aabbcc"), (2, "aaxxcc"), (3, "aabbcd"), (4, "a")], "id long, text string")
    got = {r["id"]: (r["blocks"], r["hits"], r["longest_matched"]) for r in prefix.prefix_match(df, "id", "text", 2).collect()}
    assert got == {1: (3, 0, 0), 2: (3, 1, 2), 3: (3, 2, 4)}


def runs(spark, n, stages=True):
    rate = [9000.0, 10000.0, 11000.0][:n]
    rows = [(1, "append", i, 8000, r, 5000.0, 1.0, 8.0, 800000, {"queue": 100.0, "encode": 200.0, "txn": 500.0, "callback": 200.0} if stages else None) for i, r in enumerate(rate)]
    return spark.createDataFrame(rows, jsonl.OPLOG)


def test_report_golden(spark):
    r = jsonl.oplog_report(runs(spark, 3)).first()
    assert (r["median"], r["min"], r["max"], r["bytes_per_entry"], r["cpu"], r["bottleneck"], r["share"]) == (10000, 9000, 11000, 100, 1.0, "txn", 0.5)
    assert r["status"] == "ok" and r["missing"] == []


def test_report_of_a_partial_row(spark):
    r = jsonl.oplog_report(runs(spark, 1, stages=False)).first()
    assert r["status"] == "insufficient_data" and r["missing"] == ["stage_latency_us"]


def test_case_report_efficiency(spark):
    rates = spark.createDataFrame([("c", i, r) for i, r in enumerate((9000.0, 10000.0, 11000.0))], "case string, repeat int, rate double")
    st = spark.createDataFrame([("c", i, s, u) for i in range(3) for s, u in (("queue", 12.5), ("encode", 25.0), ("txn", 62.5), ("callback", 25.0))], "case string, repeat int, stage string, us double")
    r = stats.case_report(rates, st).first()
    assert (r["theoretical"], r["efficiency"], r["bottleneck"], r["share"]) == (16000, 0.625, "txn", 0.5)


def test_bottleneck_tie_is_alphabetical(spark):
    rates = spark.createDataFrame([("c", 0, 1.0)], "case string, repeat int, rate double")
    st = spark.createDataFrame([("c", 0, s, 5.0) for s in ("b", "a", "c")], "case string, repeat int, stage string, us double")
    assert stats.case_report(rates, st).first()["bottleneck"] == "a"


@pytest.mark.parametrize("n", [2, 9, 11, 101])
def test_exclusive_quantiles_are_those_of_the_library(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    r = stats.quantiles_exclusive(df, "g", "v", "i", {"p90": (0.9, 10)}).first()
    assert r["p90"] == pytest.approx(statistics.quantiles(values, n=10, method="exclusive")[8] if n >= 10 else max(values))


def test_low_tail_names_are_inverted(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(100)], "g string, i int, v double")
    r = stats.quantiles_low_tail(df, "g", "v", "i", {"p99": 0.99, "p90": 0.9}).first()
    assert (r["p99"], r["p90"]) == (1.0, 10.0)


def test_bucket_bound_goes_into_its_bucket(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.1), ("g", 100.0), ("g", 101.0), ("g", None)], "g string, v double")
    assert {(r["bucket"], r["n"]) for r in stats.histogram(df, "g", "v", [1.0, 100.0]).collect()} == {(0, 1), (1, 2), (2, 1)}


def test_exposition_skips_sums_of_zero(spark):
    df = spark.createDataFrame([("z", 0.0), ("a", 2.0)], "g string, v double")
    assert {r["g"] for r in stats.exposition(df, "g", "v", [1.0]).collect()} == {"a"}


def test_qos_with_null_isolation(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0, 1.0, 0.5, None), ("b", 1.0, 10.0, 1.0, 1.0, 20.0)], "class string, weight double, bytes double, seconds double, slo_attainment double, isolated double")
    got = {r["class"]: r for r in stats.qos_report(df).withColumn("leakage", F.when(F.col("class") == "b", F.col("leakage"))).collect()}
    assert got["b"]["leakage"] == 0.5 and got["a"]["goodput"] == 5.0 and got["a"]["jain"] == 1.0


def test_replay_log_validation(spark, tmp_path):
    good = '{"schema_version":1,"op_id":1,"lane":0,"op":"put","object_id":1,"key":"k","invoke_ns":1,"return_ns":2,"result":"ok"}'
    (tmp_path / "a.jsonl").write_text(good + "\n\n" + good)
    assert [r["line"] for r in jsonl.read_replay(spark, f"file://{tmp_path}/a.jsonl").collect()] == [1, 3]
    (tmp_path / "b.jsonl").write_text(good + "\n" + good.replace('"put"', '"fly"'))
    with pytest.raises(Exception, match="bad line 2"):
        jsonl.read_replay(spark, f"file://{tmp_path}/b.jsonl").collect()


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    jsonl.write_report(df, f"file://{tmp_path}/r", ["name", "n"])
    text = [r["value"] for r in spark.read.text(f"file://{tmp_path}/r/markdown").collect()]
    assert text == ["| name | n |", "| --- | --- |", "| a |  |", "| b | 2 |"]
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r/csv").columns == ["name", "n"]
