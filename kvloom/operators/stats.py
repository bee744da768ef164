"""Statistics: order statistics in five definitions, reports, histograms, rates (QT, AGG3-5, AGG7, AGG16, AGG19-21, WIN2-3, WIN5-6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.operators.ranks import ranked


def _picked(df: DataFrame, group: str, value: str, tie: str, places: dict[str, Column]) -> DataFrame:
    """Per group the elements at 0-based places, each a Column of `n`; found by global rank, no group is collected."""
    r = ranked(df.where(F.col(value).isNotNull()).select(group, value, tie), [group], [F.col(value), F.col(tie)], "_rank", "n")
    return r.groupBy(group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_rank") == place.cast("long"), F.col(value))).alias(name) for name, place in places.items()])


def quantiles_linear(df: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """QT1: linear interpolation at (n - 1) p."""
    return df.groupBy(group).agg(F.count(value).alias("n"), *[F.percentile(value, p).alias(name) for name, p in ps.items()])


def quantiles_exclusive(df: DataFrame, group: str, value: str, tie: str, ps: dict[str, tuple[float, int]]) -> DataFrame:
    """QT2: position p (n + 1) with interpolation; the maximum where the group has fewer rows than a name's minimum."""
    places = {}
    n = F.col("n")
    for name, (p, _) in ps.items():
        j = F.greatest(F.lit(1), F.least(F.floor(n * 1.0 * p + p), n - 1))
        places |= {f"_{name}_a": j - 1, f"_{name}_b": F.least(j, n - 1)}
    got = _picked(df, group, value, tie, places | {"_max": n - 1})
    out = [F.col(group), n]
    for name, (p, least) in ps.items():
        j = F.greatest(F.lit(1), F.least(F.floor(n * 1.0 * p + p), n - 1))
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out.append(F.when(n < least, F.col("_max")).otherwise(a + (n * 1.0 * p + p - j) * (b - a)).alias(name))
    return got.select(*out)


def quantiles_floor(df: DataFrame, group: str, value: str, tie: str, ps: dict[str, float]) -> DataFrame:
    """QT3: element floor(q (n - 1))."""
    return _picked(df, group, value, tie, {name: F.floor((F.col("n") - 1) * p) for name, p in ps.items()})


def quantiles_round(df: DataFrame, group: str, value: str, tie: str, ps: dict[str, float]) -> DataFrame:
    """QT4: element round(p (n - 1)), half away from zero."""
    return _picked(df, group, value, tie, {name: F.floor((F.col("n") - 1) * p + 0.5) for name, p in ps.items()})


def quantiles_low_tail(df: DataFrame, group: str, value: str, tie: str, ps: dict[str, float]) -> DataFrame:
    """QT5: element floor(n (1 - p)): names are inverted, p99 is the 1st percentile of a utilisation."""
    return _picked(df, group, value, tie, {name: F.least(F.floor(F.col("n") * (100 - round(p * 100)) / 100), F.col("n") - 1) for name, p in ps.items()})


def histogram_quantile(buckets: DataFrame, group: str, le: str, cumulative: str, p: float) -> DataFrame:
    """QT6: quantile from cumulative buckets (le ascending, last infinite), linear inside a bucket."""
    w = Window.partitionBy(group).orderBy(le)
    b = buckets.select(group, le, cumulative, F.coalesce(F.lag(cumulative).over(w), F.lit(0)).alias("_below"), F.coalesce(F.lag(le).over(w), F.lit(0.0)).alias("_from"), F.max(cumulative).over(Window.partitionBy(group)).alias("_n"))
    hit = b.where((F.col(cumulative) >= F.col("_n") * p) & (F.col("_below") < F.col("_n") * p))
    inside = F.col("_from") + (F.col(le) - F.col("_from")) * (F.col("_n") * p - F.col("_below")) / (F.col(cumulative) - F.col("_below"))
    return hit.select(group, F.when(F.col(le) == float("inf"), F.col("_from")).otherwise(inside).alias("quantile"))


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """AGG19: index of the first bound >= value (a value equal to a bound goes into its bucket); len(bounds) above all."""
    case = F.when(value <= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        case = case.when(value <= b, i)
    return case.otherwise(len(bounds))


def histogram(df: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """AGG19: (group, bucket, n) of buckets that occur."""
    return df.where(F.col(value).isNotNull()).groupBy(group, bucket_of(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def exposition(df: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """SNK5: cumulative buckets, sum and count of each label as text lines; labels whose sum is 0 are left out."""
    labels = ["+Inf" if b is None else f"{b:g}" for b in [*bounds, None]]
    counts = [F.count_if(F.col(value) <= b) if b is not None else F.count(value) for b in [*bounds, None]]
    wide = df.groupBy(group).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("s"), F.count(value).alias("c"), *[c.alias(f"b{i}") for i, c in enumerate(counts)]).where("s <> 0")
    lines = F.array(*[F.concat(F.lit('latency_bucket{class="'), F.col(group), F.lit(f'",le="{name}"}} '), F.col(f"b{i}").cast("string")) for i, name in enumerate(labels)], F.concat(F.lit('latency_sum{class="'), F.col(group), F.lit('"} '), F.col("s").cast("string")), F.concat(F.lit('latency_count{class="'), F.col(group), F.lit('"} '), F.col("c").cast("string")))
    return wide.select(group, F.posexplode(lines).alias("line_no", "line"))


def phase_summary(ops: DataFrame, phase: str, ts: str, value: str, failed: Column) -> DataFrame:
    """AGG3: operations, failures, rate a second between first and last, mean, p50, p95, p99."""
    seconds = (F.max(ts).cast("timestamp").cast("double") - F.min(ts).cast("timestamp").cast("double"))
    return ops.groupBy(phase).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0).alias("rate"), F.avg(value).alias("mean"), *[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    )


def case_report(runs: DataFrame, stages: DataFrame, entries: str = "rate") -> DataFrame:
    """AGG4: runs (case, repeat, rate) and stages (case, repeat, stage, us) -> one row a case.

    median, min, max and cv of the rate (null if its mean is 0); bottleneck: the stage of largest median, the first
    by name in a tie; share of all stages' medians; theoretical rate 1e6 / bottleneck us; efficiency median / theoretical.
    status is insufficient_data where no stage has a median.
    """
    rate = runs.groupBy("case").agg(F.count("*").alias("repeats"), F.median(entries).alias("median"), F.min(entries).alias("min"), F.max(entries).alias("max"), F.try_divide(F.stddev_pop(entries), F.avg(entries)).alias("cv"))
    medians = stages.groupBy("case", "stage").agg(F.median("us").alias("us"))
    top = medians.groupBy("case").agg(F.min(F.struct((-F.col("us")).alias("minus"), "stage")).alias("top"), F.sum("us").alias("all_us"))
    worst = -F.col("top.minus")
    return rate.join(top, "case", "left").select(
        "case", "repeats", "median", "min", "max", "cv", F.col("top.stage").alias("bottleneck"), F.try_divide(worst, F.col("all_us")).alias("share"), F.try_divide(F.lit(1e6), worst).alias("theoretical"), F.try_divide(F.col("median"), F.try_divide(F.lit(1e6), worst)).alias("efficiency"), F.when(F.col("top.stage").isNull(), "insufficient_data").otherwise("ok").alias("status")
    )


def cache_rates(gets: DataFrame, tier: str, hit: Column, key: str) -> DataFrame:
    """AGG5: hits by tier over distinct cached objects (may exceed 1) and the part of gets that hit, two decimals."""
    return gets.groupBy(tier).agg(F.round(F.try_divide(F.count_if(hit).cast("double"), F.countDistinct(key).cast("double")), 2).alias("hits_per_object"), F.round(F.count_if(hit) / F.count("*"), 2).alias("valid_get_rate"))


def qos_report(classes: DataFrame) -> DataFrame:
    """AGG7: one row a class of (class, weight, bytes, seconds, slo_attainment, isolated) with the overall fairness.

    throughput = bytes / seconds; goodput = throughput x attainment; leakage = max(0, 1 - throughput / isolated),
    null without isolated; jain: (sum x)^2 / (n sum x^2) of throughput / weight over all classes.
    """
    thr = F.try_divide(F.col("bytes"), F.col("seconds"))
    rows = classes.withColumn("throughput", F.coalesce(thr, F.lit(0.0)))
    share = F.try_divide(F.col("throughput"), F.col("weight"))
    total = rows.agg(F.try_divide(F.pow(F.sum(share), F.lit(2.0)), F.count("*") * F.sum(share * share)).alias("jain"))
    return rows.crossJoin(F.broadcast(total)).select("class", "throughput", (F.col("throughput") * F.col("slo_attainment")).alias("goodput"), (F.col("throughput") * F.col("slo_attainment") * F.col("weight")).alias("weighted_goodput"), F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("throughput"), F.col("isolated"))).alias("leakage"), "jain")


def bus_factor(collective: Column, ranks: Column) -> Column:
    """AGG20: factor from algorithm to bus bandwidth."""
    part = (ranks - 1) / ranks
    return F.when(collective == "all_reduce", 2 * part).when(collective.isin("reduce_scatter", "all_gather", "alltoall"), part).otherwise(F.lit(1.0))


def counter_rate(samples: DataFrame, key: str, ts: str, counter: str) -> DataFrame:
    """WIN2/ST7: (delta, rate) against the sample before; delta at least 0, rate 0 at first or without elapsed time."""
    w = Window.partitionBy(key).orderBy(ts)
    delta = F.coalesce(F.greatest(F.col(counter) - F.lag(counter).over(w), F.lit(0)), F.lit(0))
    seconds = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double")
    return samples.withColumn("delta", delta).withColumn("rate", F.when(seconds > 0, F.col("delta") / seconds).otherwise(F.lit(0.0)))


def ewma(samples: DataFrame, key: str, order: str, value: str, alpha: float, low: float, high: float) -> DataFrame:
    """WIN3: fold alpha * previous + (1 - alpha) * observed over each key's samples in order, every step held in [low, high].

    The fold is sequential in a key by definition; keys are devices, so a key's samples are folded in one row.
    """
    held = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    fold = F.aggregate("xs", F.lit(None).cast("double"), lambda acc, x: held(F.when(acc.isNull(), x["v"]).otherwise(acc * alpha + x["v"] * (1 - alpha))))
    return samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("xs")).select(key, F.size("xs").cast("long").alias("n"), fold.alias("ewma"))


def systematic_sample(df: DataFrame, order: list[Column], every: int) -> DataFrame:
    """WIN5: rows 0, every, 2 every, ... in the given total order."""
    return ranked(df, [], order, "arrival").where(F.col("arrival") % every == 0)


def pacing(df: DataFrame, ts_ms: Column, start_s: float, scale: float) -> DataFrame:
    """WIN6: target second of each request: start + max(0, ts - first ts) / (1000 scale)."""
    first = df.agg(F.min(ts_ms).alias("_base"))
    return df.crossJoin(F.broadcast(first)).withColumn("target", F.lit(start_s) + F.greatest(F.lit(0.0), (ts_ms - F.col("_base")).cast("double")) / (1000.0 * scale)).drop("_base")


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
