"""Catalog, lookup, delete, resolve and merge queries: orders as objects, supplier as segments, lineitem as replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import catalog
from kvloom.plans.base import Book, table

BOOK = Book()
NOW = "2000-01-01 00:00:00"
_OBJ = "o AS (SELECT 't' || (o_custkey % 10) AS tenant_id, 'key' || o_orderkey AS key, o_orderdate AS lease, o_orderstatus = 'P' AS busy, CAST(o_totalprice * 100 AS BIGINT) AS size, 'c' || (o_custkey % 50) AS client_id, o_orderkey FROM orders)"
_REQ = "q AS (SELECT event_id AS pos, 't' || (user_id % 10) AS tenant_id, 'key' || (event_id * 2 % 40000) AS key FROM events)"
_SEG = "g AS (SELECT 's' || (s_suppkey % 40) AS segment, CASE WHEN s_suppkey % 10 = 0 THEN 'DRAINING' ELSE 'OK' END AS status, CASE WHEN s_suppkey % 8 = 0 THEN 0 ELSE 1073741824 * (1 + s_suppkey % 5) END AS capacity, CASE WHEN s_suppkey % 8 = 0 THEN 0 ELSE CAST(round(abs(s_acctbal) * 100) AS BIGINT) END AS used FROM supplier)"
_REP = "r AS (SELECT l_orderkey, l_partkey * 1000 + l_suppkey AS id, CASE l_returnflag WHEN 'A' THEN 'MEMORY' WHEN 'N' THEN 'DISK' ELSE 'LOCAL_DISK' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'COMPLETE' ELSE 'PROCESSING' END AS status, 's' || l_suppkey AS segment FROM lineitem)"


def objects(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("t"), (F.col("o_custkey") % 10).cast("string")).alias("tenant_id"), F.concat(F.lit("key"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderdate").alias("lease_timeout"), (F.col("o_orderstatus") == "P").alias("busy"), (F.col("o_totalprice") * 100).cast("decimal(20,0)").cast("long").alias("size"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("client_id"), "o_orderkey")


def requested(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"), F.concat(F.lit("key"), (F.col("event_id") * 2 % 40000).cast("string")).alias("key"))


def segments(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    empty = k % 8 == 0
    return s.select(F.concat(F.lit("s"), (k % 40).cast("string")).alias("segment"), F.when(k % 10 == 0, "DRAINING").otherwise("OK").alias("status"), F.when(empty, F.lit(0)).otherwise(F.lit(1 << 30) * (1 + k % 5)).cast("long").alias("capacity"), F.when(empty, F.lit(0)).otherwise(F.round(F.abs("s_acctbal") * 100)).cast("long").alias("used"))


def replicas(spark, d):
    li, flag = table(spark, d, "lineitem"), F.col("l_returnflag")
    return li.select("l_orderkey", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"), F.when(flag == "A", "MEMORY").when(flag == "N", "DISK").otherwise("LOCAL_DISK").alias("kind"), F.when(F.col("l_linestatus") == "F", "COMPLETE").otherwise("PROCESSING").alias("status"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("segment"))


def with_replicas(spark, d):
    r = replicas(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("id", "kind", "status", "segment")).alias("replicas"))
    return objects(spark, d).join(r, F.col("o_orderkey") == F.col("l_orderkey"))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@BOOK.add("src4_all_keys", f"WITH {_OBJ} SELECT key FROM o WHERE tenant_id = 't3'")
def src4_all_keys(spark, d):
    return catalog.all_keys(objects(spark, d), "t3")


@BOOK.add("src5_segment_names", f"WITH {_SEG} SELECT segment FROM g WHERE status = 'OK'")
def src5_segment_names(spark, d):
    return catalog.segment_names(segments(spark, d))


@BOOK.add("src5_segment_details", f"WITH {_SEG} SELECT segment, status, round(capacity / 1073741824.0::DOUBLE, 6) AS capacity_gib, round(used / 1073741824.0::DOUBLE, 9) AS used_gib, round(CASE WHEN capacity = 0 THEN 0 ELSE used * 100.0::DOUBLE / capacity END, 6) AS used_percent FROM g")
def src5_segment_details(spark, d):
    s = catalog.segment_details(segments(spark, d))
    return s.withColumns({"capacity_gib": F.round("capacity_gib", 6), "used_gib": F.round("used_gib", 9), "used_percent": F.round("used_percent", 6)})


@BOOK.add("src6_scan_meta", "SELECT o_orderkey // 100 AS bucket_id, 'key' || o_orderkey AS key, o_orderkey % 100 AS slot FROM orders ORDER BY 1, 3")
def src6_scan_meta(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.floor(k / 100).alias("bucket_id"), F.concat(F.lit("key"), k.cast("string")).alias("key"), (k % 100).alias("slot")).orderBy("bucket_id", "slot")


@BOOK.add("src7_bucket_page", "WITH b AS (SELECT o_custkey // 10 AS bucket_id, count(*) AS n_keys FROM orders GROUP BY 1), s AS (SELECT *, sum(n_keys) OVER (ORDER BY bucket_id) AS c FROM b) SELECT bucket_id, n_keys, (SELECT min(bucket_id) FROM s WHERE c > 1234) AS next_bucket FROM s WHERE c <= 1234")
def src7_bucket_page(spark, d):
    b = table(spark, d, "orders").groupBy(F.floor(F.col("o_custkey") / 10).alias("bucket_id")).agg(F.count("*").alias("n_keys"))
    return catalog.bucket_page(b, 1234)


@BOOK.add("flt1_batch_exist", f"WITH {_OBJ}, {_REQ} SELECT pos, o.key IS NOT NULL AS found FROM q LEFT JOIN o USING (tenant_id, key)")
def flt1_batch_exist(spark, d):
    return catalog.exists(requested(spark, d), objects(spark, d)).select("pos", "found")


@BOOK.add("flt2_lookup_status", f"WITH {_OBJ}, {_REQ} SELECT pos, size, CASE WHEN o.key IS NULL THEN NULL ELSE greatest(0, epoch(lease)::BIGINT - epoch(TIMESTAMP '{NOW}')::BIGINT) END AS lease_left, CASE WHEN o.key IS NULL THEN 'OBJECT_NOT_FOUND' ELSE 'OK' END AS status FROM q LEFT JOIN o USING (tenant_id, key)")
def flt2_lookup_status(spark, d):
    return catalog.lookup(requested(spark, d), objects(spark, d), _now(), ["size"]).select("pos", "size", F.col("lease_left").cast("long").alias("lease_left"), "status")


@BOOK.add("flt3_admin_lookup", f"WITH {_OBJ}, {_REQ} SELECT pos, size, client_id FROM q JOIN o USING (tenant_id, key)")
def flt3_admin_lookup(spark, d):
    return requested(spark, d).join(objects(spark, d), catalog.ID).select("pos", "size", "client_id")


@BOOK.add("flt4_regex", "SELECT p_partkey, p_name AS key FROM part WHERE regexp_matches(p_name, '^red|ring$|dg')")
def flt4_regex(spark, d):
    return catalog.by_regex(table(spark, d, "part").withColumnRenamed("p_name", "key"), "^red|ring$|dg").select("p_partkey", "key")


@BOOK.add("flt5_remove_by_regex", f"WITH {_OBJ} SELECT count(*) AS removed FROM o WHERE tenant_id = 't4' AND regexp_matches(key, '[0-4]7') AND lease <= TIMESTAMP '{NOW}' AND NOT busy")
def flt5_remove_by_regex(spark, d):
    o = objects(spark, d).where("tenant_id = 't4'")
    return catalog.removed_by_regex(o, "[0-4]7", _now()).agg(F.count("*").alias("removed"))


@BOOK.add("flt6_anti_remove", f"WITH {_OBJ}, {_REQ} SELECT tenant_id, key FROM o ANTI JOIN q USING (tenant_id, key)")
def flt6_anti_remove(spark, d):
    return catalog.remaining(objects(spark, d), requested(spark, d)).select("tenant_id", "key")


@BOOK.add("flt7_prefix", f"WITH {_OBJ} SELECT key, size FROM o WHERE starts_with(key, 'key12')")
def flt7_prefix(spark, d):
    return catalog.by_prefix(objects(spark, d), "key12").select("key", "size")


@BOOK.add("flt8_memory_replicas", f"WITH {_REP} SELECT 'key' || l_orderkey AS key, count(*) FILTER (kind = 'MEMORY') AS n, coalesce(min(id) FILTER (kind = 'MEMORY'), -1) AS least FROM r GROUP BY 1")
def flt8_memory_replicas(spark, d):
    r = catalog.replicas_of_kind(with_replicas(spark, d), "MEMORY")
    return r.select("key", F.size("replicas").cast("long").alias("n"), F.coalesce(F.array_min(F.transform("replicas", lambda x: x["id"])), F.lit(-1)).alias("least"))


@BOOK.add("flt9_replicas_by_kind", f"WITH {_REP} SELECT 'key' || l_orderkey AS key, " + ", ".join(f"coalesce(string_agg(segment, ',' ORDER BY id, segment) FILTER (kind = '{k}'), '') AS {k.lower()}" for k in ("MEMORY", "DISK", "LOCAL_DISK")) + " FROM r GROUP BY 1")
def flt9_replicas_by_kind(spark, d):
    r = catalog.replicas_by_kind(with_replicas(spark, d), ["MEMORY", "DISK", "LOCAL_DISK"])
    return r.select("key", *[F.array_join(k, ",").alias(k) for k in ("memory", "disk", "local_disk")])


@BOOK.add("flt10_replica_quantifiers", f"WITH {_REP} SELECT 'key' || l_orderkey AS key, bool_or(status = 'COMPLETE') AS any_of, bool_and(status = 'COMPLETE') AS all_of, count(*) FILTER (status = 'COMPLETE') AS n_of FROM r GROUP BY 1")
def flt10_replica_quantifiers(spark, d):
    return catalog.replica_quantifiers(with_replicas(spark, d), lambda r: r["status"] == "COMPLETE").select("key", "any_of", "all_of", "n_of")


@BOOK.add("flt11_strict_multi_get", f"WITH {_OBJ} SELECT key, size FROM o")
def flt11_strict_multi_get(spark, d):
    o = objects(spark, d)
    return catalog.lookup_all(o.select("tenant_id", "key"), o, ["size"]).select("key", "size")


@BOOK.add("flt12_segment_usage", f"WITH {_SEG} SELECT segment, CAST(sum(used) AS BIGINT) AS used, CAST(sum(capacity) AS BIGINT) AS capacity FROM g GROUP BY 1 HAVING sum(capacity) > 0")
def flt12_segment_usage(spark, d):
    return catalog.segment_usage(segments(spark, d))


@BOOK.add("flt13_batch_ip", "WITH m AS (SELECT s_nationkey AS client_id, '10.0.' || s_nationkey || '.' || (s_suppkey % 7) AS ip FROM supplier) SELECT client_id, string_agg(DISTINCT ip, ',' ORDER BY ip) AS ips FROM m WHERE client_id IN (SELECT DISTINCT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1")
def flt13_batch_ip(spark, d):
    s = table(spark, d, "supplier")
    m = s.select(F.col("s_nationkey").alias("client_id"), F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), (F.col("s_suppkey") % 7).cast("string")).alias("ip"))
    c = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("client_id"))
    return catalog.client_ips(c, m).select("client_id", F.array_join("ips", ",").alias("ips"))


@BOOK.add("flt14_replica_clear", f"WITH {_OBJ}, {_REQ}, {_REP} SELECT tenant_id, key FROM o WHERE client_id = 'c5' AND o_orderkey IN (SELECT l_orderkey FROM r WHERE segment = 's7') AND (tenant_id, key) NOT IN (SELECT tenant_id, key FROM o WHERE o_orderkey % 3 = 0)")
def flt14_replica_clear(spark, d):
    o = with_replicas(spark, d)
    return catalog.cleared(o, o.where("o_orderkey % 3 <> 0"), "c5", "s7")


@BOOK.add(
    "jn1_resolve",
    """WITH l AS (SELECT 'key' || o_orderkey AS key, f AS field, o_orderkey // 64 + CASE WHEN f = 'c' THEN 100000 ELSE 0 END AS fragment, o_orderkey % 64 AS row FROM orders, (VALUES ('a'), ('b'), ('c'), ('d')) v(f) WHERE NOT (f = 'd' AND o_orderkey % 500 = 0)),
    k AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, 'key' || o_orderkey AS key FROM orders WHERE o_orderkey % 50 = 0), g AS (SELECT field, list(fragment * 1000 + row ORDER BY pos) AS spots FROM k JOIN l USING (key) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM k)),
    n AS (SELECT spots, string_agg(field, ',' ORDER BY field) AS fields FROM g GROUP BY 1) SELECT fields, i - 1 AS pos, spots[i] // 1000 AS fragment, spots[i] % 1000 AS row FROM (SELECT fields, spots, unnest(range(1, len(spots) + 1)) AS i FROM n)""",
)
def jn1_resolve(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("key"), k.cast("string")).alias("key"))
    loc = o.withColumn("field", F.explode(F.array(*[F.lit(x) for x in "abcd"]))).where(~((F.col("field") == "d") & (k % 500 == 0)))
    loc = loc.select("key", "field", (F.floor(k / 64) + F.when(F.col("field") == "c", 100000).otherwise(0)).alias("fragment"), (k % 64).alias("row"))
    wanted = o.where("o_orderkey % 50 = 0").select((F.floor(k / 50)).alias("pos"), "key")
    return catalog.resolve(wanted, loc)


@BOOK.add("jn2_append_columns", "SELECT o_orderkey AS row_id, o_totalprice AS a, o_custkey AS b FROM orders")
def jn2_append_columns(spark, d):
    o = table(spark, d, "orders")
    left = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a"))
    return catalog.append_columns(left, o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("b")))


@BOOK.add("jn10_subset", "WITH a AS (SELECT DISTINCT l_suppkey AS shard, l_partkey AS member FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_suppkey AS shard, l_partkey AS member FROM lineitem WHERE l_linenumber <= 1 AND l_partkey % 400 <> 3) SELECT shard, count(*) FILTER (b.member IS NULL) AS missing, count(*) FILTER (b.member IS NULL) = 0 AS subset FROM a LEFT JOIN b USING (shard, member) GROUP BY 1")
def jn10_subset(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shard"), F.col("l_partkey").alias("member"), "l_linenumber")
    old = li.where("l_linenumber = 1").select("shard", "member").distinct()
    return catalog.is_subset(old, li.where("l_linenumber <= 1 and member % 400 <> 3").select("shard", "member").distinct(), "shard", "member")


@BOOK.add("set1_last_writer", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def set1_last_writer(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return catalog.last_writer(e, ["k"], ["event_id"], ["event_type", "value"])


@BOOK.add("set1_merged_tags", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a=new' ELSE 'a=old' END || ',b=' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ',c=' || o_orderpriority ELSE '' END AS tags FROM orders")
def set1_merged_tags(spark, d):
    o, even = table(spark, d, "orders"), F.col("o_orderkey") % 2 == 0
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("o_orderstatus"))
    new = F.when(even, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("o_orderpriority"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.array_sort(F.transform(F.map_entries(catalog.merged_tags(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return o.select("o_orderkey", F.array_join(tags, ",").alias("tags"))


@BOOK.add("set2_fragment_refs", "SELECT l_suppkey AS fragment, count(DISTINCT (l_orderkey, l_linenumber)) AS refs FROM lineitem GROUP BY 1")
def set2_fragment_refs(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fragment"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("field"))
    return catalog.fragment_references(li)


@BOOK.add("set3_put_outcomes", "WITH p AS (SELECT 't' || (user_id % 3) AS tenant_id, 'k' || json_extract_string(props, '$.k') AS key, event_id AS seq, event_type = 'signup' AS upsert FROM events), f AS (SELECT tenant_id, key, min(seq) AS first FROM p GROUP BY ALL) SELECT seq, CASE WHEN seq = first THEN 'OK' WHEN upsert THEN 'REPLACED' ELSE 'OBJECT_ALREADY_EXISTS' END AS status FROM p JOIN f USING (tenant_id, key)")
def set3_put_outcomes(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("upsert"))
    return catalog.put_outcomes(p).select("seq", "status")


@BOOK.add("set4_job_progress", "WITH t AS (SELECT l_orderkey AS job, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 'FAILED' WHEN l_linestatus = 'F' THEN 'SUCCESS' ELSE 'PENDING' END AS s FROM lineitem) SELECT job, count(*) AS tasks, count(*) FILTER (s = 'SUCCESS') AS success, count(*) FILTER (s = 'FAILED') AS failed, CASE WHEN count(*) FILTER (s = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (s = 'SUCCESS') = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (s = 'SUCCESS') > 0 THEN 'PROCESSING' ELSE 'PENDING' END AS status FROM t GROUP BY 1")
def set4_job_progress(spark, d):
    li = table(spark, d, "lineitem")
    s = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), "FAILED").when(F.col("l_linestatus") == "F", "SUCCESS").otherwise("PENDING")
    return catalog.job_progress(li.select(F.col("l_orderkey").alias("job"), s.alias("status")), "job")


@BOOK.add("set5_key_sets", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT 'only_a' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)")
def set5_key_sets(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "AR")
    return a.subtract(b).select(F.lit("only_a").alias("part"), "k").union(a.intersect(b).select(F.lit("both"), "k"))


@BOOK.add("win7_gaps", "WITH e AS (SELECT user_id % 20 AS stream, event_id // 20 AS seq FROM events WHERE event_id % 13 <> 0), l AS (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS before FROM e) SELECT stream, seq, before, CASE WHEN seq = before THEN 'duplicate' ELSE 'gap' END AS kind FROM l WHERE before IS NOT NULL AND seq <> before + 1")
def win7_gaps(spark, d):
    e = table(spark, d, "events").where("event_id % 13 <> 0").select((F.col("user_id") % 20).alias("stream"), F.floor(F.col("event_id") / 20).alias("seq"))
    return catalog.gaps_of(e, ["stream"], "seq")
