"""Eviction, quota and admission cases with exact survivors."""

import datetime as dt
from itertools import count

import pytest
from pyspark.sql import functions as F

from kvloom.operators import lease

NOW = dt.datetime(2024, 1, 1)
SCHEMA = "tenant_id string, key string, lease timestamp_ntz, complete boolean, hard_pinned boolean, soft_pin_until timestamp_ntz, group_id string"


def objects(spark, rows):
    made = []
    for i, r in enumerate(rows):
        age = r.get("age", len(rows) - i)
        at = NOW + dt.timedelta(hours=1) if r.get("leased") else NOW - dt.timedelta(seconds=age)
        made.append((r.get("tenant", "a"), r.get("key", f"{i:06d}"), at, True, r.get("hard", False), NOW + dt.timedelta(hours=2) if r.get("soft") else None, r.get("group")))
    return spark.createDataFrame(made, SCHEMA)


def gone(df, ratio, soft=True):
    return sorted(r["key"] for r in lease.evict(df, ratio, F.lit(NOW).cast("timestamp_ntz"), soft).collect())


def test_oldest_first(spark):
    assert gone(objects(spark, [{}] * 400), 0.05) == [f"{i:06d}" for i in range(20)]


@pytest.mark.parametrize("n, ratio, expected", [(250, 0.10, 25), (200, 0.80, 160)])
def test_counts(spark, n, ratio, expected):
    assert len(gone(objects(spark, [{}] * n), ratio)) == expected


def test_soft_pins_last(spark):
    df = objects(spark, [{"soft": True, "age": 100 - i} for i in range(10)] + [{"age": 50 - i} for i in range(10)])
    assert gone(df, 0.8) == sorted([f"{i:06d}" for i in range(10, 20)] + [f"{i:06d}" for i in range(6)])
    assert gone(df, 0.8, soft=False) == [f"{i:06d}" for i in range(10, 20)]


def test_group_goes_whole_and_a_leased_member_protects_it(spark):
    rows = [{"group": "g"}] * 3 + [{}] * 7
    assert gone(objects(spark, rows), 0.10) == ["000000", "000001", "000002"]
    rows[2] = {"group": "g", "leased": True}
    assert gone(objects(spark, rows), 0.10) == ["000003"]


def test_blocked_candidates_do_not_use_up_the_target(spark):
    rows = [{"group": "g"}] * 12 + [{"group": "g", "leased": True}] + [{}] * 1200
    out = gone(objects(spark, rows), 0.05)
    assert len(out) == 61 and out[0] == "000013"


def test_same_key_in_two_tenants(spark):
    df = objects(spark, [{"tenant": "a", "key": "k", "age": 9}, {"tenant": "b", "key": "k", "age": 5}])
    assert [r["tenant_id"] for r in lease.evict(df, 0.5, F.lit(NOW).cast("timestamp_ntz")).collect()] == ["a"]


def test_one_group_name_in_two_tenants_is_two_units(spark):
    df = objects(spark, [{"tenant": "a", "group": "g", "age": 9}, {"tenant": "b", "group": "g", "age": 5, "leased": True}, {}, {}])
    assert ("a", "000000") in {(r["tenant_id"], r["key"]) for r in lease.evict(df, 0.25, F.lit(NOW).cast("timestamp_ntz")).collect()}


def test_hard_pins_and_empty(spark):
    assert gone(objects(spark, [{"hard": True}] * 5), 1.0) == []
    assert gone(spark.createDataFrame([], SCHEMA), 0.5) == []


def quotas(spark, rows, capacity):
    df = spark.createDataFrame(rows, "tenant_id string, has_policy boolean, requested long").withColumn("requested", F.col("requested").cast("decimal(20,0)"))
    return {r["tenant_id"]: r["effective"] for r in lease.apportion(df, capacity).collect()}


def test_quota_fits(spark):
    assert quotas(spark, [("a", True, 3), ("b", True, 4), ("c", False, 9)], 10) == {"a": 3, "b": 4, "c": 0}


def test_quota_ties_by_tenant(spark):
    assert quotas(spark, [("b", True, 10), ("a", True, 10), ("c", True, 10)], 10) == {"a": 4, "b": 3, "c": 3}


def test_quota_near_two_to_62(spark):
    big = 1 << 62
    got = quotas(spark, [("a", True, big), ("b", True, big - 1)], 1_000_001)
    assert sum(got.values()) == 1_000_001 and got["a"] >= got["b"]


def test_sequential_quota_admits_a_later_smaller_charge(spark):
    df = spark.createDataFrame([("t", 1, 60, 100), ("t", 2, 50, 100), ("t", 3, 40, 100), ("t", 4, 0, 100)], "tenant string, seq int, size long, cap long")
    r = lease.quota_sequential(df, "tenant", "seq", "size", "cap").first()
    assert (r["charged"], r["accepted"], r["charges"]) == (100, 3, 4)
    p = {x["seq"]: x["accepted"] for x in lease.quota_prefix(df, "tenant", "seq", "size", "cap").collect()}
    assert p == {1: True, 2: False, 3: False, 4: True}


def test_admission_stops_at_the_first_that_does_not_fit(spark):
    ids = count(1)
    rows = [(next(ids), i, d, b, 0, False) for i, (d, b) in enumerate([(0, 10), (500, 60), (400, 30), (600, 5)])]
    df = spark.createDataFrame(rows, "id int, seq int, deadline long, bytes long, predicted long, droppable boolean")
    got = {r["id"]: r["action"] for r in lease.admitted(df, 100, 80, 10, 0, 1.0).collect()}
    assert got == {3: "take", 2: "wait", 4: "wait", 1: "wait"}


def test_admission_drops_late_ones_only_if_they_may_be(spark):
    df = spark.createDataFrame([(1, 0, 50, 10, 0, True), (2, 1, 50, 10, 0, False), (3, 2, 150, 10, 60, True)], "id int, seq int, deadline long, bytes long, predicted long, droppable boolean")
    got = {r["id"]: r["action"] for r in lease.admitted(df, 100, 80, 10, 0, 1.0).collect()}
    assert got == {1: "drop", 2: "take", 3: "drop"}


def test_lease_bounds(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in lease.lease_after_read(F.lit(1000), F.lit(1000), 10).items()]).first()
    assert (r["new_lease"], r["refreshed"], r["expired"]) == (1010, True, True)


def test_count_min_against_counters(spark):
    import hashlib
    import random

    rnd = random.Random(4)
    hits = [(i, f"k{min(int(rnd.expovariate(0.2)), 30)}") for i in range(700)]
    rows, total = [[0] * 8 for _ in range(2)], 0
    slot = lambda i, k: int(hashlib.md5(f"{i}/{k}".encode()).hexdigest()[:8], 16) % 8
    for _, k in hits:
        for i in range(2):
            rows[i][slot(i, k)] = min(60, rows[i][slot(i, k)] + 1)
        total += 1
        if total % 16 == 0:
            rows = [[c >> 1 for c in r] for r in rows]
    got = {r["key"]: r["estimate"] for r in lease.count_min(spark.createDataFrame(hits, "seq long, key string"), "key", "seq", 8, 2, 60).collect()}
    assert got == {k: min(rows[i][slot(i, k)] for i in range(2)) for _, k in hits}


def test_proposals_by_mode_and_cooldown(spark):
    rows = [("a", f"2024-01-01 00:00:{s:02}") for s in (0, 1, 10, 11, 20, 21, 30, 31)] + [("b", "2024-01-01 00:00:02")] * 5
    df = spark.createDataFrame(rows, "key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    told = lambda **k: sorted((r["key"], r["window_start"].second, r["action"]) for r in lease.copy_proposals(df, "key", "at", 10, 0.2, **k).collect())
    assert told(mode="off") == [] and told(mode="observe", tracked=1) == [("a", s, "observe") for s in (0, 10, 20, 30)]
    full = spark.createDataFrame([("b", 3)], "key string, n int")
    assert told(cooldown=20) == [("a", 0, "copy"), ("a", 20, "copy"), ("b", 0, "copy")] and told(cooldown=20, replicas=full) == [("a", 0, "copy"), ("a", 20, "copy")]


def test_promotion_queue_is_limited_and_by_tenant(spark):
    hits = [("t1", "x", 1), ("t2", "x", 2), ("t2", "x", 3), ("t1", "x", 4), ("t1", "y", 5), ("t1", "y", 6)]
    got = lease.promotion_queue(spark.createDataFrame(hits, "tenant string, key string, seq int"), "tenant", "key", "seq", 2, 2)
    assert sorted((r["tenant"], r["key"], r["queued_at"]) for r in got.collect()) == [("t1", "x", 4), ("t2", "x", 3)]
