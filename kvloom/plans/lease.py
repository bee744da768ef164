"""Lease, eviction, quota and admission queries: orders as objects, o_orderdate as lease, supplier as tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import lease
from kvloom.plans.base import Book, table

BOOK = Book()
NOW = "2000-01-01 00:00:00"
_MS = "epoch_ms(o_orderdate)"
_NOW_MS = 946684800000


def _objects(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("lease"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderpriority") == "1-URGENT").alias("hard_pinned"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("2001-01-01").cast("timestamp_ntz")).alias("soft_pin_until"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey").cast("string")).alias("group_id"),
    )


_O = "o AS (SELECT 't' || (o_custkey % 3) AS tenant_id, CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS lease, o_orderstatus <> 'P' AS complete, o_orderpriority = '1-URGENT' AS hard_pinned, coalesce(o_orderpriority = '2-HIGH', FALSE) AS soft, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) END AS group_id FROM orders)"


@BOOK.add("ls1_lease", f"SELECT o_orderkey, greatest({_MS}, {_NOW_MS} + 10000) AS new_lease, {_MS} <= {_NOW_MS} + 5000 AS refreshed, {_NOW_MS} >= {_MS} AS expired FROM orders")
def ls1_lease(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in lease.lease_after_read(ms, F.lit(_NOW_MS), 10000).items()])


@BOOK.add(
    "ls2_soft_pin",
    """WITH p AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id AS seq, CASE event_type WHEN 'signup' THEN 'ENABLE' WHEN 'error' THEN 'DISABLE' ELSE 'PRESERVE' END AS action, CAST(user_id % 4 * 1000 AS BIGINT) AS ttl FROM events),
    l AS (SELECT k, arg_max(CASE WHEN action = 'ENABLE' AND ttl > 0 THEN seq + ttl ELSE -1 END, seq) AS dl FROM p WHERE action <> 'PRESERVE' GROUP BY 1) SELECT k, CASE WHEN dl >= 0 THEN dl END AS deadline FROM (SELECT DISTINCT k FROM p) LEFT JOIN l USING (k)""",
)
def ls2_soft_pin(spark, d):
    t = F.col("event_type")
    p = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.when(t == "signup", "ENABLE").when(t == "error", "DISABLE").otherwise("PRESERVE").alias("action"), (F.col("user_id") % 4 * 1000).alias("ttl"))
    return lease.soft_pin(p, ["k"], "seq")


@BOOK.add(
    "ls3_evict_oldest",
    f"""WITH {_O}, e AS (SELECT *, row_number() OVER (ORDER BY soft, lease, 'o' || chr(31) || tenant_id || chr(31) || key) AS rn FROM o WHERE complete AND NOT hard_pinned AND lease <= TIMESTAMP '{NOW}') SELECT tenant_id, key FROM e WHERE rn <= (SELECT ceil(0.05::DOUBLE * count(*)) FROM o)""",
)
def ls3_evict_oldest(spark, d):
    o = _objects(spark, d).withColumn("group_id", F.lit(None).cast("string"))
    return lease.evict(o, 0.05, F.lit(NOW).cast("timestamp_ntz")).select("tenant_id", "key")


@BOOK.add(
    "ls4_group_evict",
    f"""WITH {_O}, n AS (SELECT *, CASE WHEN group_id IS NULL THEN 'o' || chr(31) || tenant_id || chr(31) || key ELSE 'g' || chr(31) || tenant_id || chr(31) || group_id END AS unit FROM o),
    u AS (SELECT unit, count(*) AS size, bool_or(soft) AS soft, max(lease) AS lease FROM n GROUP BY 1 HAVING bool_and(complete AND NOT hard_pinned AND lease <= TIMESTAMP '{NOW}')), r AS (SELECT unit, sum(size) OVER (ORDER BY soft, lease, unit) - size AS before FROM u)
    SELECT tenant_id, key FROM n WHERE unit IN (SELECT unit FROM r WHERE before < (SELECT ceil(0.2::DOUBLE * count(*)) FROM o))""",
)
def ls4_group_evict(spark, d):
    return lease.evict(_objects(spark, d), 0.2, F.lit(NOW).cast("timestamp_ntz")).select("tenant_id", "key")


_B = "b AS (SELECT o_custkey AS bucket_id, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS size, max(o_orderdate) AS last_access FROM orders GROUP BY 1)"


def _buckets(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("bucket_id")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("size"), F.max("o_orderdate").alias("last_access"))


@BOOK.add("ls5_bucket_lru", f"WITH {_B.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round(o_totalprice) AS BIGINT)')}, r AS (SELECT *, sum(size) OVER (ORDER BY last_access, bucket_id) - size AS before FROM b) SELECT bucket_id, size FROM r WHERE before < 50000000")
def ls5_bucket_lru(spark, d):
    return lease.evict_buckets(_buckets(spark, d), 50_000_000)


@BOOK.add("ls5_bucket_fifo", f"WITH {_B.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round(o_totalprice) AS BIGINT)')}, r AS (SELECT *, sum(size) OVER (ORDER BY bucket_id) - size AS before FROM b) SELECT bucket_id, size FROM r WHERE before < 50000000")
def ls5_bucket_fifo(spark, d):
    return lease.evict_buckets(_buckets(spark, d), 50_000_000, lru=False)


@BOOK.add("ls5_three_limits", f"WITH {_B.replace('CAST(o_totalprice AS BIGINT)', 'CAST(round(o_totalprice) AS BIGINT)')}, r AS (SELECT *, size * 2 AS disk, sum(size) OVER (ORDER BY last_access, bucket_id) - size AS before FROM b) SELECT bucket_id, size, disk FROM r WHERE before < 20000000 OR before * 2 < 50000000 ORDER BY last_access, bucket_id LIMIT 1000")
def ls5_three_limits(spark, d):
    return lease.evict_to_limits(_buckets(spark, d).withColumn("disk", F.col("size") * 2), 20_000_000, 50_000_000, 30_000_000)


@BOOK.add("ls6_lru_list", "SELECT user_id, max(event_id) AS at FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 50")
def ls6_lru_list(spark, d):
    return lease.list_order(table(spark, d, "events"), "user_id", "event_id", 50)


@BOOK.add("ls6_fifo_list", "SELECT user_id, event_id AS at FROM events ORDER BY 2 DESC LIMIT 50")
def ls6_fifo_list(spark, d):
    return lease.list_order(table(spark, d, "events"), "user_id", "event_id", 50, lru=False)


@BOOK.add("ls7_promotion", "SELECT user_id % 5 AS tenant_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS hits FROM events WHERE event_type = 'view' GROUP BY 1, 2 HAVING count(*) >= 2")
def ls7_promotion(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'").select((F.col("user_id") % 5).alias("tenant_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return lease.promoted(e, ["tenant_id", "k"], 2)


@BOOK.add("ls7_promotion_queue", "WITH h AS (SELECT user_id % 5 AS tenant_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id, row_number() OVER (PARTITION BY user_id % 5, CAST(json_extract_string(props, '$.k') AS INT) ORDER BY event_id) AS n FROM events WHERE event_type = 'view') SELECT tenant_id, k, event_id AS queued_at FROM h WHERE n = 2 ORDER BY event_id LIMIT 40")
def ls7_promotion_queue(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'").select((F.col("user_id") % 5).alias("tenant_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")
    return lease.promotion_queue(e, "tenant_id", "k", "event_id", 2, 40)


@BOOK.add(
    "agg18_count_min",
    """WITH h AS (SELECT user_id AS k, (row_number() OVER (ORDER BY event_id) - 1) // 256 AS e FROM events), s AS (SELECT r AS row, CAST('0x' || substr(md5(r || '/' || k), 1, 8) AS BIGINT) % 64 AS slot, e, k FROM h, (VALUES (0), (1), (2), (3)) v(r)), n AS (SELECT row, slot, e, count(*) AS n FROM s GROUP BY ALL),
    t AS (SELECT row, slot, unnest(range(0, (SELECT count(*) // 256 + 1 FROM events))) AS e FROM (SELECT DISTINCT row, slot FROM s)), l AS (SELECT row, slot, list(coalesce(n, 0) ORDER BY e) AS xs FROM t LEFT JOIN n USING (row, slot, e) GROUP BY ALL),
    c AS (SELECT row, slot, least(31, list_reduce(list_concat([0], xs[:-2]), lambda c, n: least(31, c + n) // 2) + xs[-1]) AS c FROM l) SELECT k AS user_id, min(c) AS estimate FROM (SELECT DISTINCT row, slot, k FROM s) JOIN c USING (row, slot) GROUP BY 1""",
)
def agg18_count_min(spark, d):
    """Small counters and few slots, so that saturation, halving and collisions all happen."""
    return lease.count_min(table(spark, d, "events"), "user_id", "event_id", 64, 4, 31)


@BOOK.add(
    "ls8_copy_proposals",
    """WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS s, count(*) AS hits, min(ts) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f, user_id) AS rn FROM w), h AS (SELECT * FROM r WHERE rn <= 20 AND hits >= 2 AND user_id % 10 <> 3)
    SELECT user_id, epoch_ms(s) AS at, hits, 'copy' AS action FROM h""",
)
def ls8_copy_proposals(spark, d):
    e = table(spark, d, "events")
    held = e.select("user_id", F.when(F.col("user_id") % 10 == 3, 3).otherwise(1).alias("n")).distinct()
    return lease.copy_proposals(e, "user_id", "ts", 21600, 2 / 21600, "enforce", held, 3, 20, 21600).select("user_id", F.unix_millis("window_start").alias("at"), "hits", "action")


@BOOK.add("ls8_heat_aligned", "SELECT user_id, epoch_ms(time_bucket(INTERVAL 6 HOUR, ts)) AS at, count(*) AS hits FROM events GROUP BY 1, time_bucket(INTERVAL 6 HOUR, ts) HAVING count(*) >= 2")
def ls8_heat_aligned(spark, d):
    return lease.heated(table(spark, d, "events"), "user_id", "ts", 21600, 2 / 21600).select("user_id", F.unix_millis("window_start").alias("at"), "hits")


@BOOK.add("ls9_hot_admission", "SELECT k, event_id AS admitted_at FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id, row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY event_id) AS rn FROM events WHERE event_type <> 'click') WHERE rn = 3")
def ls9_hot_admission(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return lease.hot_admission(e, "k", "event_id", F.col("event_type") == "click", 3)


@BOOK.add(
    "ls10_quota_prefix",
    "WITH c AS (SELECT event_id, user_id AS tenant, CAST(round(value * 100) AS BIGINT) AS size FROM events), s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY tenant ORDER BY event_id) AS BIGINT) AS charged FROM c) SELECT event_id, charged, charged <= 150000 OR size = 0 AS accepted, greatest(0, charged - 150000) AS deficit FROM s",
)
def ls10_quota_prefix(spark, d):
    c = table(spark, d, "events").select("event_id", F.col("user_id").alias("tenant"), F.round(F.col("value") * 100).cast("long").alias("size"), F.lit(150000).cast("long").alias("effective"))
    return lease.quota_prefix(c, "tenant", "event_id", "size", "effective").select("event_id", "charged", "accepted", "deficit")


@BOOK.add(
    "ls10_quota_sequential",
    """WITH RECURSIVE c AS (SELECT user_id AS tenant, CAST(round(value * 100) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT tenant, i, CASE WHEN size <= 150000 THEN size ELSE 0 END AS used, CASE WHEN size <= 150000 THEN 1 ELSE 0 END AS n FROM c WHERE i = 1 UNION ALL SELECT c.tenant, c.i, CASE WHEN used + size <= 150000 OR size = 0 THEN used + size ELSE used END, n + CASE WHEN used + size <= 150000 OR size = 0 THEN 1 ELSE 0 END FROM f JOIN c ON c.tenant = f.tenant AND c.i = f.i + 1)
    SELECT tenant, max(i) AS charges, arg_max(used, i) AS charged, CAST(arg_max(n, i) AS BIGINT) AS accepted FROM f GROUP BY 1""",
)
def ls10_quota_sequential(spark, d):
    c = table(spark, d, "events").select("event_id", F.col("user_id").alias("tenant"), F.round(F.col("value") * 100).cast("long").alias("size"), F.lit(150000).cast("long").alias("effective"))
    return lease.quota_sequential(c, "tenant", "event_id", "size", "effective")


_T = "t AS (SELECT 't' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS tenant_id, s_suppkey % 7 <> 0 AS has_policy, CAST(round(abs(s_acctbal) * 100) AS HUGEINT) AS req FROM supplier), a AS (SELECT *, CASE WHEN has_policy THEN req ELSE 0 END AS asked FROM t)"


@BOOK.add(
    "agg14_quota",
    f"""WITH {_T}, s AS (SELECT sum(asked)::HUGEINT AS total FROM a), f AS (SELECT a.*, total, CAST(10000019::HUGEINT * asked // total AS HUGEINT) AS fl, (10000019::HUGEINT * asked) % total AS rem FROM a, s), l AS (SELECT 10000019 - sum(fl) AS left_over FROM f),
    r AS (SELECT f.*, CASE WHEN has_policy THEN row_number() OVER (PARTITION BY has_policy ORDER BY rem DESC, tenant_id) END AS rn FROM f) SELECT tenant_id, CAST(CASE WHEN NOT has_policy THEN 0 WHEN total <= 10000019 THEN asked ELSE fl + CASE WHEN rn <= left_over THEN 1 ELSE 0 END END AS BIGINT) AS effective FROM r, l""",
)
def agg14_quota(spark, d):
    s = table(spark, d, "supplier")
    p = s.select(F.concat(F.lit("t"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("tenant_id"), (F.col("s_suppkey") % 7 != 0).alias("has_policy"), F.round(F.abs("s_acctbal") * 100).cast("decimal(20,0)").alias("requested"))
    return lease.apportion(p, 10_000_019)


@BOOK.add("agg13_quota_totals", f"WITH {_T} SELECT CAST(sum(req) AS BIGINT) AS requested, count(*) FILTER (has_policy) AS with_policy, count(*) AS tenants FROM a")
def agg13_quota_totals(spark, d):
    s = table(spark, d, "supplier")
    return s.agg(F.sum(F.round(F.abs("s_acctbal") * 100).cast("long")).alias("requested"), F.count_if(F.col("s_suppkey") % 7 != 0).alias("with_policy"), F.count("*").alias("tenants"))


@BOOK.add(
    "tk5_edf_admission",
    """WITH q AS (SELECT o_orderkey AS id, o_orderkey AS seq, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE CAST(o_custkey * 7 % 3000 AS BIGINT) END AS dl, CAST(round(o_totalprice) AS BIGINT) AS bytes, CAST(o_orderkey % 400 AS BIGINT) AS pred, o_orderstatus = 'P' AS droppable FROM orders),
    m AS (SELECT *, dl > 0 AND dl - 1000 <= 0 AS late, dl > 0 AND dl - 1000 > 0 AND pred >= (dl - 1000) * 0.9::DOUBLE AS hopeless, dl > 0 AND dl - 1000 > 0 AND dl - 1000 - pred <= 50 AS critical FROM q), k AS (SELECT * FROM m WHERE NOT (droppable AND (late OR hopeless))),
    s AS (SELECT id, sum(bytes) OVER w AS run, row_number() OVER w AS rn FROM k WINDOW w AS (ORDER BY NOT critical, CASE WHEN dl > 0 THEN dl END NULLS LAST, seq ROWS UNBOUNDED PRECEDING)) SELECT id, CASE WHEN run <= 200000000 AND rn <= 900 THEN 'take' ELSE 'wait' END AS action FROM s UNION ALL SELECT id, 'drop' FROM m WHERE droppable AND (late OR hopeless)""",
)
def tk5_edf_admission(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("id"), k.alias("seq"), F.when(c % 5 == 0, 0).otherwise(c * 7 % 3000).cast("long").alias("deadline"), F.round("o_totalprice").cast("long").alias("bytes"), (k % 400).alias("predicted"), (F.col("o_orderstatus") == "P").alias("droppable"))
    return lease.admitted(r, 1000, 200_000_000, 900, 50, 0.9)
