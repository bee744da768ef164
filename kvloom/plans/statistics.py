"""Statistics queries over events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import stats
from kvloom.plans.base import Book, table

BOOK = Book()
# Bounds of latency histograms.
BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
_CASE = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_N = "WITH a AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@BOOK.add("qt1_linear", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def qt1_linear(spark, d):
    return _rounded(stats.quantiles_linear(_events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "p50", "p95", "p99")


def _exclusive(p, least, name):
    pos = f"(n * 1.0 * {p} + {p})"
    j = f"CAST(greatest(1, least(floor({pos}), n - 1)) AS BIGINT)"
    return f"round(CASE WHEN n < {least} THEN v[n] ELSE v[{j}] + ({pos} - {j}) * (v[{j} + 1] - v[{j}]) END, 6) AS {name}"


@BOOK.add("qt2_exclusive", f"{_N} SELECT event_type, n, {_exclusive('0.9::DOUBLE', 10, 'p90')}, {_exclusive('0.99::DOUBLE', 100, 'p99')}, {_exclusive('0.999::DOUBLE', 1000, 'p999')} FROM a")
def qt2_exclusive(spark, d):
    return _rounded(stats.quantiles_exclusive(_events(spark, d), "event_type", "value", "event_id", {"p90": (0.9, 10), "p99": (0.99, 100), "p999": (0.999, 1000)}), "p90", "p99", "p999")


@BOOK.add("qt3_floor", f"{_N} SELECT event_type, n, v[CAST(floor((n - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, v[CAST(floor((n - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99 FROM a")
def qt3_floor(spark, d):
    return stats.quantiles_floor(_events(spark, d), "event_type", "value", "event_id", {"p50": 0.5, "p99": 0.99})


@BOOK.add("qt4_round", f"{_N} SELECT event_type, n, v[CAST(floor((n - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((n - 1) * 0.99::DOUBLE + 0.5) AS BIGINT) + 1] AS p99 FROM a")
def qt4_round(spark, d):
    return stats.quantiles_round(_events(spark, d), "event_type", "value", "event_id", {"p50": 0.5, "p99": 0.99})


@BOOK.add("qt5_low_tail", f"{_N} SELECT event_type, n, v[CAST(floor(n * 10 / 100) AS BIGINT) + 1] AS p90, v[CAST(floor(n * 1 / 100) AS BIGINT) + 1] AS p99 FROM a")
def qt5_low_tail(spark, d):
    return stats.quantiles_low_tail(_events(spark, d), "event_type", "value", "event_id", {"p90": 0.9, "p99": 0.99})


def _cumulative(spark, d):
    e = _events(spark, d)
    bounds = [*BOUNDS, float("inf")]
    wide = e.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)])
    return wide.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(bounds)])).alias("x")).select("event_type", "x.le", F.col("x.c").alias("cumulative"))


_LE = " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS le, count(*) FILTER (value <= {b})::DOUBLE AS c FROM events GROUP BY 1" for b in [*BOUNDS]) + " UNION ALL SELECT event_type, 'inf'::DOUBLE, count(value)::DOUBLE FROM events GROUP BY 1"


@BOOK.add(
    "qt6_histogram_quantile",
    f"""WITH b AS ({_LE}), w AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS fr, max(c) OVER (PARTITION BY event_type) AS n FROM b)
    SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN fr ELSE fr + (le - fr) * (n * 0.9::DOUBLE - below) / (c - below) END, 6) AS quantile FROM w WHERE c >= n * 0.9::DOUBLE AND below < n * 0.9::DOUBLE""",
)
def qt6_histogram_quantile(spark, d):
    return _rounded(stats.histogram_quantile(_cumulative(spark, d), "event_type", "le", "cumulative", 0.9), "quantile")


@BOOK.add("qt7_streaming_summary")
def qt7_streaming_summary(spark, d):
    """Approximate by contract, so only its rows are checked."""
    return _events(spark, d).groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.9, 0.99], 10_000).alias("q")).select("event_type", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@BOOK.add(
    "agg3_phase_summary",
    """SELECT event_type, count(*) AS n, count(*) FILTER (value < 1) AS failures, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS rate, round(avg(value), 6) AS mean,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def agg3_phase_summary(spark, d):
    s = stats.phase_summary(_events(spark, d), "event_type", "ts", "value", F.col("value") < 1)
    return _rounded(s.withColumn("rate", F.round("rate", 8)), "mean", "p50", "p95", "p99")


@BOOK.add(
    "agg4_case_report",
    """WITH r AS (SELECT event_type AS c, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY 1, 2),
    s AS (SELECT event_type AS c, CAST(ts AS DATE) AS day, 'stage' || (CAST(json_extract_string(props, '$.k') AS INT) % 4) AS stage, avg(CAST(value AS DECIMAL(18,2))) AS us FROM events GROUP BY 1, 2, 3),
    m AS (SELECT c, stage, median(round(us, 6)) AS us FROM s GROUP BY 1, 2), t AS (SELECT c, max(us) AS top, sum(us) AS all_us FROM m GROUP BY 1),
    b AS (SELECT t.c, top, all_us, min(stage) AS bottleneck FROM t JOIN m ON m.c = t.c AND m.us = t.top GROUP BY ALL),
    q AS (SELECT c, count(*) AS repeats, median(rate) AS median, min(rate) AS min, max(rate) AS max, stddev_pop(rate) / avg(rate) AS cv FROM r GROUP BY 1)
    SELECT q.c AS "case", repeats, median, min, max, round(cv, 6) AS cv, bottleneck, round(top / all_us, 6) AS share, round(1e6 / top, 4) AS theoretical, round(median / (1e6 / top), 8) AS efficiency, 'ok' AS status FROM q JOIN b USING (c)""",
)
def agg4_case_report(spark, d):
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    runs = e.groupBy(F.col("event_type").alias("case"), F.col("day").alias("repeat")).agg(F.count("*").cast("double").alias("rate"))
    stage = F.concat(F.lit("stage"), F.get_json_object("props", "$.k").cast("int") % 4)
    stages = e.groupBy(F.col("event_type").alias("case"), F.col("day").alias("repeat"), stage.alias("stage")).agg(F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*"), 6).alias("us"))
    out = stats.case_report(runs, stages)
    return out.withColumns({"cv": F.round("cv", 6), "share": F.round("share", 6), "theoretical": F.round("theoretical", 4), "efficiency": F.round("efficiency", 8)})


@BOOK.add("agg5_cache_stats", "SELECT event_type AS tier, round(count(*) FILTER (value >= 10) / count(DISTINCT props)::DOUBLE, 2) AS hits_per_object, round(count(*) FILTER (value >= 10) / count(*)::DOUBLE, 2) AS valid_get_rate FROM events GROUP BY 1")
def agg5_cache_stats(spark, d):
    return stats.cache_rates(_events(spark, d).withColumnRenamed("event_type", "tier"), "tier", F.col("value") >= 10, "props")


_QOS = """c AS (SELECT l_returnflag || l_linestatus AS class, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS weight, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS bytes,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS seconds, count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE AS slo, CASE WHEN l_linestatus = 'F' THEN 2000.0::DOUBLE END AS isolated FROM lineitem GROUP BY ALL)"""


@BOOK.add(
    "agg7_qos_report",
    f"""WITH {_QOS}, t AS (SELECT *, bytes / seconds AS thr FROM c), j AS (SELECT pow(sum(thr / weight), 2) / (count(*) * sum((thr / weight) * (thr / weight))) AS jain FROM t)
    SELECT class, round(thr, 4) AS throughput, round(thr * slo, 4) AS goodput, round(thr * slo * weight, 4) AS weighted_goodput, round(CASE WHEN isolated IS NULL THEN NULL ELSE greatest(0, 1 - thr / isolated) END, 6) AS leakage, round(jain, 8) AS jain FROM t, j""",
)
def agg7_qos_report(spark, d):
    li = table(spark, d, "lineitem")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    weight = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(4.0)
    c = li.groupBy("l_returnflag", "l_linestatus").agg(exact("l_extendedprice").alias("bytes"), exact("l_quantity").alias("seconds"), (F.count_if(F.col("l_discount") <= 0.05) / F.count("*")).alias("slo_attainment"))
    c = c.select(F.concat("l_returnflag", "l_linestatus").alias("class"), weight.alias("weight"), "bytes", "seconds", "slo_attainment", F.when(F.col("l_linestatus") == "F", 2000.0).alias("isolated"))
    out = stats.qos_report(c).withColumn("leakage", F.when(F.col("class").endswith("F"), F.col("leakage")))
    return out.withColumns({"throughput": F.round("throughput", 4), "goodput": F.round("goodput", 4), "weighted_goodput": F.round("weighted_goodput", 4), "leakage": F.round("leakage", 6), "jain": F.round("jain", 8)})


@BOOK.add("agg16_stress_stats", "SELECT CAST(user_id % 4 AS BIGINT) AS worker, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def agg16_stress_stats(spark, d):
    return _events(spark, d).groupBy((F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


@BOOK.add(
    "agg17_task_rollup",
    """SELECT l_orderkey, count(*) AS slices, count(*) FILTER (l_returnflag <> 'R') AS success, count(*) FILTER (l_returnflag = 'R') AS failed, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R') AS BIGINT) AS bytes,
    count(*) FILTER (l_linestatus = 'F') = count(*) AS finished FROM lineitem GROUP BY 1""",
)
def agg17_task_rollup(spark, d):
    ok = F.col("l_returnflag") != "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("slices"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("l_quantity").cast("long"))).alias("bytes"), (F.count_if(F.col("l_linestatus") == "F") == F.count("*")).alias("finished"))


@BOOK.add("agg19_histogram", f"SELECT event_type, CAST({_CASE} AS INT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def agg19_histogram(spark, d):
    return stats.histogram(_events(spark, d), "event_type", "value", BOUNDS)


@BOOK.add(
    "agg20_bus_bandwidth",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'all_reduce' WHEN 'view' THEN 'all_gather' WHEN 'error' THEN 'reduce_scatter' WHEN 'signup' THEN 'alltoall' ELSE 'broadcast' END AS c, 2 + user_id % 7 AS n, value FROM events)
    SELECT event_id, c AS collective, round(value * 1e6 / 1e9 / 0.5, 9) AS algbw, round(value * 1e6 / 1e9 / 0.5 * CASE WHEN c = 'all_reduce' THEN 2 * (n - 1) / n::DOUBLE WHEN c IN ('reduce_scatter', 'all_gather', 'alltoall') THEN (n - 1) / n::DOUBLE ELSE 1 END, 9) AS busbw FROM e""",
)
def agg20_bus_bandwidth(spark, d):
    kinds = {"click": "all_reduce", "view": "all_gather", "error": "reduce_scatter", "signup": "alltoall"}
    c = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("broadcast"))
    alg = F.col("value") * 1e6 / 1e9 / 0.5
    return _events(spark, d).select("event_id", c.alias("collective"), F.round(alg, 9).alias("algbw"), F.round(alg * stats.bus_factor(c, 2 + F.col("user_id") % 7), 9).alias("busbw"))


@BOOK.add("agg21_wrong_elements", "SELECT o_orderstatus, count(*) FILTER (o_totalprice <> round(o_totalprice)) AS wrong, count(*) AS n FROM orders GROUP BY 1")
def agg21_wrong_elements(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") != F.round("o_totalprice")).alias("wrong"), F.count("*").alias("n"))


_COUNTER = "WITH s AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT event_type, h, CAST(n * (CASE WHEN hour(h) % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS counter FROM s)"


@BOOK.add(
    "win2_counter_rate",
    f"""{_COUNTER} SELECT event_type, epoch_ms(h) AS at, counter, CAST(coalesce(greatest(counter - lag(counter) OVER w, 0), 0) AS BIGINT) AS delta,
    round(coalesce(greatest(counter - lag(counter) OVER w, 0) / ((epoch_ms(h) - epoch_ms(lag(h) OVER w)) / 1000.0::DOUBLE), 0), 9) AS rate FROM c WINDOW w AS (PARTITION BY event_type ORDER BY h)""",
)
def win2_counter_rate(spark, d):
    s = _events(spark, d).groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"))
    c = s.select("event_type", "h", F.when(F.hour("h") % 5 == 0, F.lit(0)).otherwise(F.col("n")).cast("long").alias("counter"))
    return stats.counter_rate(c, "event_type", "h", "counter").select("event_type", F.unix_millis("h").alias("at"), "counter", "delta", F.round("rate", 9).alias("rate"))


@BOOK.add(
    "win3_ewma",
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, i, greatest(1.0, least(60.0, value)) AS v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, greatest(1.0, least(60.0, f.v * 0.75::DOUBLE + e.value * 0.25::DOUBLE)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, max(i) AS n, round(arg_max(v, i), 6) AS ewma FROM f GROUP BY 1""",
)
def win3_ewma(spark, d):
    return _rounded(stats.ewma(_events(spark, d), "user_id", "event_id", "value", 0.75, 1.0, 60.0), "ewma")




@BOOK.add(
    "snk5_exposition",
    "WITH w AS (SELECT event_type, sum(CAST(value AS DECIMAL(18,2))) AS s, count(value) AS c, " + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS)) + " FROM events GROUP BY 1 HAVING sum(value) <> 0) "
    + " UNION ALL ".join([f"SELECT event_type, {i} AS line_no, 'latency_bucket{{class=\"' || event_type || '\",le=\"{b:g}\"}} ' || b{i} AS line FROM w" for i, b in enumerate(BOUNDS)]
    + [f"SELECT event_type, {len(BOUNDS)}, 'latency_bucket{{class=\"' || event_type || '\",le=\"+Inf\"}} ' || c FROM w", f"SELECT event_type, {len(BOUNDS) + 1}, 'latency_sum{{class=\"' || event_type || '\"}} ' || s FROM w", f"SELECT event_type, {len(BOUNDS) + 2}, 'latency_count{{class=\"' || event_type || '\"}} ' || c FROM w"]),
)
def snk5_exposition(spark, d):
    return stats.exposition(_events(spark, d), "event_type", "value", BOUNDS)


@BOOK.add(
    "st8_rate_5m",
    """WITH e AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, epoch_ms(w) AS at, n, round(n / 300.0::DOUBLE, 9) AS rate FROM e""",
)
def st8_rate_5m(spark, d):
    e = _events(spark, d).groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.unix_millis("w").alias("at"), "n", F.round(F.col("n") / 300.0, 9).alias("rate"))
