"""Leases, pins, eviction, admission, quotas (LS1-LS10, TK4, TK5, AGG14). Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.operators.ranks import ranked, top_per_group


def lease_after_read(lease: Column, now: Column, ttl_ms: int) -> dict[str, Column]:
    """LS1: a read's new lease max(lease, now + ttl), whether it needed a refresh, whether it had expired; all in ms."""
    return {"new_lease": F.greatest(lease, now + ttl_ms), "refreshed": lease <= now + ttl_ms // 2, "expired": now >= lease}


def soft_pin(pins: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """LS2: pin deadline after all write events (action PRESERVE, ENABLE or DISABLE; at, ttl): the last that isn't PRESERVE rules.

    ENABLE sets at + ttl (ttl 0 unpins), DISABLE unpins; null means not pinned.
    """
    acts = pins.where("action <> 'PRESERVE'")
    last = acts.groupBy(*keys).agg(F.max_by(F.when((F.col("action") == "ENABLE") & (F.col("ttl") > 0), F.col("at") + F.col("ttl")).otherwise(F.lit(-1)), seq).alias("d"))
    return pins.select(*keys).distinct().join(last, keys, "left").select(*keys, F.when(F.col("d") >= 0, F.col("d")).alias("deadline"))


def evict(objects: DataFrame, ratio: float, now: Column, soft_allowed: bool = True) -> DataFrame:
    """LS3/LS4/TK4: objects that a batch eviction removes (by contract; the order is exact LRU).

    objects: tenant_id, key, lease (orderable), complete, hard_pinned, soft_pin_until (or null), group_id (or null).
    Target: ceil(ratio x all objects). Units are groups within a tenant, or single objects; a unit is eligible if all members
    are complete, unleased and not hard-pinned; units without soft pin go first, oldest (latest member's lease)
    first; a group that starts below the target goes whole and may overshoot it.
    """
    soft = F.coalesce(F.col("soft_pin_until") > now, F.lit(False))
    # a unit is a string that no group and no key of another tenant can share
    named = objects.withColumn("_unit", F.when(F.col("group_id").isNotNull(), F.concat_ws("\x1f", F.lit("g"), "tenant_id", "group_id")).otherwise(F.concat_ws("\x1f", F.lit("o"), "tenant_id", "key")))
    marked = named.withColumn("_ok", F.col("complete") & ~F.col("hard_pinned") & (F.col("lease") <= now)).withColumn("_soft", soft)
    target = objects.agg(F.ceil(F.lit(ratio) * F.count("*")).cast("long").alias("_target"))
    units = marked.groupBy("_unit").agg(F.count("*").alias("_size"), F.bool_and("_ok").alias("_ok"), F.bool_or("_soft").alias("_soft"), F.max("lease").alias("_lease")).where("_ok")
    if not soft_allowed:
        units = units.where("not _soft")
    order = [F.col("_soft"), F.col("_lease"), F.col("_unit")]
    run = ranked(units, [], order, "_rank", None, {"_sum": F.col("_size")})
    gone = run.crossJoin(F.broadcast(target)).where(F.col("_sum") - F.col("_size") < F.col("_target")).select("_unit")
    return named.join(gone, "_unit", "left_semi").select(*objects.columns)


def evict_buckets(buckets: DataFrame, required: int, lru: bool = True, most: int = 1000) -> DataFrame:
    """LS5: buckets (bucket_id, size, last_access) freed until `required` bytes are: least recently used (ties by id) or smallest id; at most `most`."""
    order = [F.col("last_access"), F.col("bucket_id")] if lru else [F.col("bucket_id")]
    run = ranked(buckets, [], order, "_rank", None, {"_sum": F.col("size")})
    return run.where((F.col("_sum") - F.col("size") < required) & (F.col("_rank") < most)).select("bucket_id", "size")


def evict_to_limits(buckets: DataFrame, quota: int, space: int, physical: int, lru: bool = True, most: int = 1000) -> DataFrame:
    """LS5: whole buckets (bucket_id, size, disk, last_access) freed until three limits hold, `most` at most.

    Over by `quota` logical bytes (size), short of `space` free bytes and over a cap by `physical` bytes (both disk).
    """
    order = [F.col("last_access"), F.col("bucket_id")] if lru else [F.col("bucket_id")]
    run = ranked(buckets, [], order, "_rank", None, {"_size": F.col("size"), "_disk": F.col("disk")})
    wanted = (F.col("_size") - F.col("size") < quota) | (F.col("_disk") - F.col("disk") < max(space, physical))
    return run.where(wanted & (F.col("_rank") < most)).select("bucket_id", "size", "disk")


def list_order(touches: DataFrame, key: str, seq: str, capacity: int, lru: bool = True) -> DataFrame:
    """LS6: keys that a list of `capacity` still holds after all touches: by latest touch (LRU) or latest entries (FIFO, re-adds are entries of their own)."""
    if lru:
        last = touches.groupBy(key).agg(F.max(seq).alias("at"))
    else:
        last = touches.select(key, F.col(seq).alias("at"))
    return last.orderBy(F.col("at").desc()).limit(capacity)


def promoted(hits: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """LS7: keys (disk-only) hit at least `threshold` times; the exact count in place of a sketch's estimate."""
    return hits.groupBy(*keys).agg(F.count("*").alias("hits")).where(F.col("hits") >= threshold)


def promotion_queue(hits: DataFrame, tenant: str, key: str, seq: str, threshold: int, limit: int) -> DataFrame:
    """LS7: keys in the order in which their tenant's hits reach the threshold, as far as a queue of `limit` takes them.

    hits are those on disk-only keys. Only a key's first `threshold` hits are looked at, so a hot key costs no more.
    """
    first = top_per_group(hits.select(tenant, key, seq), [tenant, key], [F.col(seq)], threshold, "_n")
    reached = first.where(F.col("_n") == threshold).select(tenant, key, F.col(seq).alias("queued_at"))
    return reached.orderBy("queued_at").limit(limit)


def count_min(hits: DataFrame, key: str, seq: str, width: int = 4096, depth: int = 4, most: int = 255) -> DataFrame:
    """AGG18: (key, estimate): count-min estimates with saturating counters that are all halved after width x depth hits.

    Hits are numbered in order of seq; per counter the hits between two halvings are summed before they move, then
    folded in their order: at most one entry a counter and halving. The estimate is a key's smallest counter.
    """
    period = width * depth
    numbered = ranked(hits.select(key, seq), [], [F.col(seq)], "_rank").withColumn("_e", F.floor(F.col("_rank") / period))
    slot = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(i)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width))
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), slot(i).alias("slot")) for i in range(depth)])).alias("_s")
    sums = numbered.groupBy(key, "_e").agg(F.count("*").alias("n")).select("_e", "n", slots).groupBy("_s", "_e").agg(F.sum("n").alias("n"))
    halvings = numbered.agg(F.floor(F.count("*") / period).alias("_h"))
    entries = sums.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_e", "n"))).alias("_x"))
    halved = lambda c, times: F.call_function("shiftright", c, F.least(times, F.lit(62)).cast("int"))
    step = lambda acc, x: F.struct(F.least(F.lit(most).cast("long"), halved(acc["c"], x["_e"] - acc["e"]) + x["n"]).alias("c"), x["_e"].alias("e"))
    zero = F.lit(0).cast("long")
    folded = entries.select("_s", F.aggregate("_x", F.struct(zero.alias("c"), zero.alias("e")), step).alias("_r")).crossJoin(F.broadcast(halvings))
    counters = folded.select("_s", halved(F.col("_r.c"), F.col("_h") - F.col("_r.e")).alias("c"))
    return hits.select(key).distinct().select(key, slots).join(counters, "_s").groupBy(key).agg(F.min("c").alias("estimate"))


def copy_proposals(hits: DataFrame, key: str, ts: str, seconds: int, qps: float, mode: str = "enforce", replicas: DataFrame | None = None, most_replicas: int = 3, tracked: int = 50_000, cooldown: int = 0) -> DataFrame:
    """LS8: (key, window_start, hits, action) of hot aligned windows. Modes: off (none), observe, enforce (action copy).

    Only the `tracked` keys of a window that were hit first in it are counted. Keys with `most_replicas` (replicas:
    key, n) are left out, as are windows that start within `cooldown` seconds of the key's last proposal.
    """
    if mode not in ("off", "observe", "enforce"):
        raise ValueError(f"unknown mode {mode}")
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    each = hits.groupBy(key, w["start"].alias("window_start")).agg(F.count("*").alias("hits"), F.min(F.col(ts).cast("timestamp")).alias("_first"))
    hot = ranked(each, ["window_start"], [F.col("_first"), F.col(key)], "_rank").where((F.col("_rank") < tracked) & (F.col("hits") >= qps * seconds) & F.lit(mode != "off"))
    if replicas is not None:
        hot = hot.join(replicas.where(F.col("n") >= most_replicas).select(key), key, "left_anti")
    spots = F.array_sort(F.collect_list(F.struct("window_start", "hits")))
    kept = F.aggregate(F.col("_w"), F.array().cast("array<struct<window_start: timestamp, hits: bigint>>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.unix_seconds(x["window_start"]) - F.unix_seconds(F.element_at(acc, -1)["window_start"]) >= cooldown), F.concat(acc, F.array(x))).otherwise(acc))
    return hot.groupBy(key).agg(spots.alias("_w")).select(key, F.explode(kept).alias("x")).select(key, "x.window_start", "x.hits", F.lit("copy" if mode == "enforce" else "observe").alias("action"))


def heated(hits: DataFrame, key: str, ts: str, seconds: int, qps: float) -> DataFrame:
    """LS8: keys hit at least qps x seconds times in an aligned window of `seconds`, with the window's start."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return hits.groupBy(key, w["start"].alias("window_start")).agg(F.count("*").alias("hits")).where(F.col("hits") >= qps * seconds)


def hot_admission(gets: DataFrame, key: str, seq: str, used_local: Column, threshold: int) -> DataFrame:
    """LS9: the get at which each key is admitted: its threshold-th one that didn't use the local cache."""
    w = Window.partitionBy(key).orderBy(seq)
    return gets.where(~used_local).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == threshold).select(key, F.col(seq).alias("admitted_at"))


def quota_prefix(charges: DataFrame, tenant: str, seq: str, size: str, effective: str) -> DataFrame:
    """LS10 as a prefix rule: each tenant's charges in order while their running sum fits; deficit of the first beyond.

    Zero-byte charges always pass. The sequential rule, where a later smaller charge may pass, is `quota_sequential`.
    """
    r = ranked(charges, [tenant], [F.col(seq)], "_rank", None, {"charged": F.col(size)})
    return r.withColumn("accepted", (F.col("charged") <= F.col(effective)) | (F.col(size) == 0)).withColumn("deficit", F.greatest(F.lit(0), F.col("charged") - F.col(effective))).drop("_rank")


def quota_sequential(charges: DataFrame, tenant: str, seq: str, size: str, effective: str) -> DataFrame:
    """LS10: charges in order; one that doesn't fit is rejected and leaves the charge as it is; a later one may fit.

    Sequential in a tenant by definition: each tenant's (seq, size) pairs are folded in one row.
    """
    step = lambda acc, x: F.struct(F.when((acc["used"] + x["size"] <= x["cap"]) | (x["size"] == 0), acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), (acc["n"] + F.when((acc["used"] + x["size"] <= x["cap"]) | (x["size"] == 0), 1).otherwise(0)).alias("n"))
    xs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(size).cast("long").alias("size"), F.col(effective).cast("long").alias("cap"))))
    folded = charges.groupBy(tenant).agg(xs.alias("xs"), F.count("*").alias("charges"))
    return folded.select(tenant, "charges", F.aggregate("xs", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")), step).alias("r")).select(tenant, "charges", F.col("r.used").alias("charged"), F.col("r.n").cast("long").alias("accepted"))


def apportion(policies: DataFrame, capacity: int) -> DataFrame:
    """AGG14: effective quota of each tenant (tenant_id, has_policy, requested): as asked if all fit, else the largest-remainder
    share of capacity, remainders' ties by tenant id; tenants without policy get 0. Exact in DECIMAL(38, 0)."""
    d = "decimal(38,0)"
    asked = F.when(F.col("has_policy"), F.col("requested")).otherwise(0).cast("decimal(20,0)")
    p = policies.withColumn("_asked", asked)
    total = p.agg(F.coalesce(F.sum("_asked"), F.lit(0)).cast("decimal(20,0)").alias("_total"))
    p = p.crossJoin(F.broadcast(total))
    product = (F.col("_asked") * F.lit(capacity).cast("decimal(18,0)")).cast(d)
    divisor = F.greatest(F.col("_total"), F.lit(1)).cast(d)
    rem = F.pmod(product, divisor).cast(d)
    p = p.withColumn("_rem", rem).withColumn("_floor", ((product - rem) / divisor).cast(d))
    left = p.agg((F.lit(capacity).cast(d) - F.sum("_floor")).cast(d).alias("_left"))
    r = ranked(p.where("has_policy"), [], [F.col("_rem").desc(), F.col("tenant_id")], "_rank").select("tenant_id", "_rank")
    p = p.join(r, "tenant_id", "left").crossJoin(F.broadcast(left))
    share = F.col("_floor") + F.when(F.col("_rank") < F.col("_left"), 1).otherwise(0)
    return p.select("tenant_id", F.when(~F.col("has_policy"), 0).when(F.col("_total") <= capacity, F.col("_asked")).otherwise(share).cast("long").alias("effective"))


def admitted(requests: DataFrame, now: int, budget: int, owners: int, critical_slack: int, threshold: float, dropping: bool = True) -> DataFrame:
    """TK5: earliest deadline first. requests: id, seq, deadline (0: none), bytes, predicted, droppable.

    Past-deadline or hopeless requests (predicted / time left >= threshold) that may be dropped are, without
    using budget. Of the others, those within critical_slack of their deadline come first, then by deadline, none
    last, ties by seq; they are taken while their bytes fit the budget, stopping at the first that doesn't, and
    at most `owners` of them. action: drop, take or wait.
    """
    left = F.col("deadline") - now
    late = (F.col("deadline") > 0) & (left <= 0)
    hopeless = (F.col("deadline") > 0) & (left > 0) & (F.col("predicted") >= left * threshold)
    r = requests.withColumn("_drop", F.lit(dropping) & F.col("droppable") & (late | hopeless))
    critical = (F.col("deadline") > 0) & (left > 0) & (left - F.col("predicted") <= critical_slack)
    order = [~critical, F.when(F.col("deadline") > 0, F.col("deadline")).asc_nulls_last(), F.col("seq")]
    live = ranked(r.where("not _drop"), [], order, "_rank", None, {"_sum": F.col("bytes")})
    taken = live.select("id", F.when((F.col("_sum") <= budget) & (F.col("_rank") < owners), "take").otherwise("wait").alias("action"))
    return taken.union(r.where("_drop").select("id", F.lit("drop")))
