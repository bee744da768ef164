"""Placement and choice: replicas, segments, transports, devices (FLT15, JN6, JN8, TK1-TK3, TK6, TK7, TK9, TK10, AGG15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.operators.ranks import ranked, top_per_group


def select_replica(replicas: DataFrame, key: str, endpoint_score: Column | None = None) -> DataFrame:
    """JN8: per key the best complete replica (its id and kind); keys without one are left out.

    replicas: key, pos (list order), id, kind, status, local. The first local MEMORY or NOF_SSD in list order wins;
    then remote MEMORY (lowest endpoint_score if given, ties in list order), remote NOF_SSD, the last LOCAL_DISK,
    the last DFS, the first DISK.
    """
    kind, pos = F.col("kind"), F.col("pos")
    score = F.lit(0) if endpoint_score is None else endpoint_score
    tier = F.when(F.col("local") & kind.isin("MEMORY", "NOF_SSD"), 0).when(kind == "MEMORY", 1).when(kind == "NOF_SSD", 2).when(kind == "LOCAL_DISK", 3).when(kind == "DFS", 4).when(kind == "DISK", 5)
    rank = F.struct(tier.alias("tier"), F.when(tier == 1, score).otherwise(0).alias("score"), F.when(tier.isin(3, 4), -pos).otherwise(pos).alias("pos"))
    best = replicas.where((F.col("status") == "COMPLETE") & tier.isNotNull()).groupBy(key).agg(F.min_by(F.struct("id", "kind"), rank).alias("_b"))
    return best.select(key, F.col("_b.id").alias("id"), F.col("_b.kind").alias("kind"))


def first_rule(requests: DataFrame, rules: DataFrame, request: str) -> DataFrame:
    """FLT15/JN6: number of the first rule whose present predicates all hold, null if none does.

    requests: request, segment_type, locality, size, priority; rules: rule_no, transport and the predicates
    segment_type, locality, min_size, max_size (inclusive), priority, each null where absent. Rules are a short
    configuration list, read by the driver, that becomes one CASE: requests aren't joined with anything.
    """
    tests = {"segment_type": lambda v: F.col("segment_type") == v, "locality": lambda v: F.col("locality") == v, "min_size": lambda v: F.col("size") >= v, "max_size": lambda v: F.col("size") <= v, "priority": lambda v: F.col("priority") == v}
    rule = F.when(F.lit(False), F.struct(F.lit(0).cast(rules.schema["rule_no"].dataType).alias("rule_no"), F.lit("").alias("transport")))
    for r in rules.orderBy("rule_no").collect():
        holds = F.lit(True)
        for name, test in tests.items():
            if r[name] is not None:
                holds = holds & test(r[name])
        rule = rule.when(holds, F.struct(F.lit(r["rule_no"]).cast(rules.schema["rule_no"].dataType).alias("rule_no"), F.lit(r["transport"]).alias("transport")))
    return requests.withColumn("_m", rule).select(request, F.col("_m.rule_no").alias("rule_no"), F.coalesce(F.col("_m.transport"), F.lit("unspecified")).alias("transport"))


def free_ratio(segments: DataFrame) -> DataFrame:
    """AGG15: free / capacity per segment over its allocators, 0 where capacity is 0."""
    s = segments.groupBy("segment").agg(F.sum("used").alias("used"), F.sum("capacity").alias("capacity"))
    return s.select("segment", F.coalesce(F.try_divide((F.col("capacity") - F.col("used")).cast("double"), F.col("capacity")), F.lit(0.0)).alias("free_ratio"), (F.col("capacity") > 0).alias("counted"))


def draw(*parts: Column | str) -> Column:
    """A number below 2**52 from the MD5 of the parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("long")


def place(objects: DataFrame, segments: DataFrame, object_id: str, replicas: int, score: Column | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """TK1 without sampling: distinct segments for each object: preferred ones in their order, then by free ratio (ties by name).

    objects: object_id, preferred (array of segment names); segments: segment, free_ratio, or what `score` (UD2; the
    higher the better) is worked out from. Excluded segments are never chosen. The ranking is the same for all
    objects, so only its head of replicas + (longest preferred list) is looked at. Fewer segments than asked give
    fewer rows (best effort).
    """
    segments = segments.where(~F.col("segment").isin(*excluded)) if excluded else segments
    segments = segments if score is None else segments.withColumn("free_ratio", score)
    longest = objects.agg(F.max(F.size("preferred"))).first()[0] or 0
    head = segments.orderBy(F.col("free_ratio").desc(), "segment").limit(replicas + max(longest, 0))
    order = F.array_sort(F.collect_list(F.struct((-F.col("free_ratio")).alias("r"), "segment")))
    ranked = F.broadcast(head.agg(F.transform(order, lambda x: x["segment"]).alias("_ranked")))
    known = segments.select(F.col("segment").alias("_s"))
    wanted = objects.select(object_id, F.posexplode("preferred").alias("_p", "_s")).join(known, "_s").groupBy(object_id).agg(F.array_sort(F.collect_list(F.struct("_p", "_s"))).alias("_own"))
    j = objects.select(object_id).join(wanted, object_id, "left").crossJoin(ranked)
    own = F.array_distinct(F.coalesce(F.transform("_own", lambda x: x["_s"]), F.array().cast("array<string>")))
    chosen = F.slice(F.concat(own, F.array_except(F.col("_ranked"), own)), 1, replicas)
    return j.select(object_id, F.posexplode(chosen).alias("replica", "segment"))


def place_random(objects: DataFrame, segments: DataFrame, object_id: str, replicas: int, seed: int) -> DataFrame:
    """TK2: contiguous segments by name from a start drawn by a seeded hash of the object; segments are joined by number."""
    numbered = ranked(segments.select("segment").distinct(), [], [F.col("segment")], "_at", "_of")
    n = F.broadcast(numbered.agg(F.max("_of").alias("_n")))
    each = objects.select(object_id).crossJoin(n).where("_n > 0").select(object_id, "_n", F.explode(F.sequence(F.lit(0), F.least(F.lit(replicas).cast("long"), "_n").cast("int") - 1)).alias("replica"))
    at = F.pmod(draw(object_id, F.lit(seed)) + F.col("replica"), F.col("_n"))
    return each.withColumn("_at", at).join(numbered.select("_at", "segment"), "_at").select(object_id, "replica", "segment")


def place_local_first(objects: DataFrame, segments: DataFrame, object_id: str, host: str, replicas: int) -> DataFrame:
    """TK3: segments of the object's own host first, then as `place` ranks them. objects: object_id, host; segments: segment, host, free_ratio."""
    best = top_per_group(segments, [host], [F.col("free_ratio").desc(), F.col("segment")], replicas, "_r")
    local = best.groupBy(host).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "segment"))), lambda x: x["segment"]).alias("preferred"))
    own = objects.join(local, host, "left").select(object_id, F.coalesce("preferred", F.array().cast("array<string>")).alias("preferred"))
    return place(own, segments, object_id, replicas)


def pick_nic(candidates: DataFrame, request: str) -> DataFrame:
    """TK6: per request the NIC of least (inflight + bytes) / ewma x penalty (ties by name), and its inverse-score share; jitter off.

    candidates: request, nic, inflight, bytes, ewma, penalty.
    """
    score = (F.col("inflight") + F.col("bytes")) / F.col("ewma") * F.col("penalty")
    c = candidates.withColumn("_score", score)
    best = c.groupBy(request).agg(F.min(F.struct("_score", "nic")).alias("_b"), F.sum(1 / F.col("_score")).alias("_inv"))
    return best.select(request, F.col("_b.nic").alias("nic"), F.col("_b._score").alias("score"), (1 / F.col("_b._score") / F.col("_inv")).alias("share"))


def route(tokens: DataFrame, token: str, experts: int, k: int, seed: int, zipf: float = 0.0) -> DataFrame:
    """TK7: k distinct experts a token by Gumbel top-k over uniform (zipf 0) or Zipf weights; seeded by token and expert."""
    u = (draw(token, "expert", F.lit(seed)) + 0.5) / float(1 << 52)
    each = tokens.select(token, F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("expert"))
    scored = each.withColumn("_g", -F.log(-F.log(u)) - zipf * F.log(F.col("expert") + 1.0))
    w = Window.partitionBy(token).orderBy(F.col("_g").desc(), "expert")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_g")


def pick_device(requests: DataFrame, preferred: list[str], available: list[str], draw: Column, retry: Column) -> DataFrame:
    """TK9: at retry 0 a device among the preferred (all if none) by draw; from then on by number through preferred, then available."""
    both = F.array(*[F.lit(x) for x in [*preferred, *available]])
    first = F.array(*[F.lit(x) for x in (preferred or available)])
    return requests.withColumn("device", F.when(retry == 0, F.get(first, F.pmod(draw, F.size(first)).cast("int"))).otherwise(F.get(both, F.pmod(retry - 1, F.size(both)).cast("int"))))


def pick_operation(df: DataFrame, draw: Column, mix: dict[str, int]) -> DataFrame:
    """TK10: operation by cumulative integer weights that sum to 100: the first boundary above a draw in [0, 100)."""
    if sum(mix.values()) != 100:
        raise ValueError("weights must sum to 100")
    case, at = None, 0
    for name, w in mix.items():
        at += w
        case = F.when(draw < at, name) if case is None else case.when(draw < at, name)
    return df.withColumn("operation", case)
