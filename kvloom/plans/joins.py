"""Interval, placement, dispatch, op-log and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.functions import scalar
from kvloom.operators import boxes, moe, oplog, placement
from kvloom.plans.base import Book, table
from kvloom.plans.catalog import _SEG, segments

BOOK = Book()

# Sources: parts of each brand laid end to end; targets: cells of 100 over each brand's length.
_IV = """s AS (SELECT p_brand, p_partkey AS lid, CAST(sum(p_size) OVER w - p_size AS BIGINT) AS lb, CAST(sum(p_size) OVER w AS BIGINT) AS le FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT p_brand, max(le) AS n FROM s GROUP BY 1), t AS (SELECT p_brand, i AS rid, i * 100 AS rb, least(i * 100 + 100, n) AS re FROM (SELECT p_brand, n, unnest(range(0, (n + 99) // 100)) AS i FROM m))"""


def _intervals(spark, d):
    from pyspark.sql.window import Window

    run = F.sum("p_size").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0))
    s = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("lid"), (run - F.col("p_size")).alias("lb"), run.alias("le"))
    m = s.groupBy("p_brand").agg(F.max("le").alias("n"))
    t = m.select("p_brand", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 99) / 100) - 1)).alias("rid")).select("p_brand", "rid", (F.col("rid") * 100).alias("rb"), F.least(F.col("rid") * 100 + 100, F.col("n")).alias("re"))
    return s, t


@BOOK.add("jn4_interval_overlap", f'WITH {_IV} SELECT s.p_brand, lid, rid, greatest(lb, rb) AS "begin", least(le, re) AS "end" FROM s JOIN t ON s.p_brand = t.p_brand AND greatest(lb, rb) < least(le, re)')
def jn4_interval_overlap(spark, d):
    s, t = _intervals(spark, d)
    return boxes.interval_overlap(s, t, ["p_brand"], 100)


@BOOK.add(
    "jn4_box_overlap",
    """WITH b AS (SELECT p_partkey AS id, p_brand, p_partkey % 97 AS x, p_size AS w, p_partkey % 61 AS y, p_size % 9 + 1 AS h, p_type FROM part), l AS (SELECT * FROM b WHERE id % 2 = 0), r AS (SELECT * FROM b WHERE id % 2 = 1)
    SELECT l.p_brand, l.id AS lid, r.id AS rid, CAST((least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * (least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) AS BIGINT) AS volume FROM l JOIN r ON l.p_brand = r.p_brand AND l.x < r.x + r.w AND r.x < l.x + l.w AND l.y < r.y + r.h AND r.y < l.y + l.h""",
)
def jn4_box_overlap(spark, d):
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    b = p.select("p_brand", k.alias("id"), F.array(k % 97, k % 61).alias("o"), F.array(size, size % 9 + 1).alias("s"))
    left, right = (b.where(F.col("id") % 2 == r).select("p_brand", F.col("id").alias(f"{n}id"), F.col("o").alias(f"{n}o"), F.col("s").alias(f"{n}s")) for r, n in ((0, "l"), (1, "r")))
    return boxes.box_overlap(left, right, ["p_brand"], (25, 4)).select("p_brand", "lid", "rid", boxes.volume(F.col("shape"), 2).alias("volume"))


@BOOK.add(
    "jn5_transfer_plan",
    f"""WITH {_IV}, ss AS (SELECT s.*, dp FROM s, (VALUES (0), (1)) v(dp)), tt AS (SELECT t.*, rid % 3 AS dp FROM t), g AS (SELECT ss.p_brand, rid, lid, greatest(lb, rb) AS b, least(le, re) AS e FROM ss JOIN tt ON ss.p_brand = tt.p_brand AND ss.dp = tt.dp % 2 AND greatest(lb, rb) < least(le, re)),
    f AS (SELECT p_brand, rid, sum(e - b) AS filled FROM g GROUP BY 1, 2) SELECT g.p_brand, g.rid, lid, b AS "begin", e AS "end", filled = re - rb AS covered FROM g JOIN f USING (p_brand, rid) JOIN t USING (p_brand, rid)""",
)
def jn5_transfer_plan(spark, d):
    s, t = _intervals(spark, d)
    s = s.withColumn("dp", F.explode(F.array(F.lit(0), F.lit(1))))
    return boxes.transfer_plan(s, t.withColumn("dp", F.col("rid") % 3), ["p_brand"], 100)


_RANGES = "i AS (SELECT l_suppkey AS s, l_orderkey % 1000 AS b, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) % 7 AS e FROM lineitem)"


def _ranges(spark, d):
    li = table(spark, d, "lineitem")
    b = F.col("l_orderkey") % 1000
    return li.select(F.col("l_suppkey").alias("s"), b.alias("b"), (b + F.col("l_quantity").cast("long") % 7).alias("e"))


@BOOK.add(
    "agg8_cover",
    f"""WITH {_IV} SELECT p_brand, CAST(sum(le - lb) AS BIGINT) AS volume, FALSE AS overlaps, TRUE AS exact FROM s GROUP BY 1 UNION ALL SELECT 'r' || s, v, o, NOT o AND v = hi - lo FROM (SELECT s, CAST(sum(e - b) AS BIGINT) AS v, coalesce(bool_or(reach > b), FALSE) AS o, min(b) AS lo, max(e) AS hi
    FROM (SELECT *, max(e) OVER (PARTITION BY s ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT 'x' || l_suppkey AS s, l_orderkey % 1000 AS b, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) % 7 AS e FROM lineitem) WHERE e > b) GROUP BY s)""",
)
def agg8_cover(spark, d):
    s, _ = _intervals(spark, d)
    r = _ranges(spark, d).select(F.concat(F.lit("rx"), F.col("s").cast("string")).alias("p_brand"), F.col("b").alias("lb"), F.col("e").alias("le"))
    return boxes.cover_check(s.select("p_brand", "lb", "le").union(r), ["p_brand"], "lb", "le")


@BOOK.add(
    "agg8_box_cover",
    """WITH c AS (SELECT p_brand, p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, min(p_partkey) AS id FROM part GROUP BY 1, 2, 3) SELECT p_brand, CAST(count(*) * 4 AS BIGINT) AS volume, CAST(0 AS BIGINT) AS overlapping_pairs, count(*) = 100 AS exact FROM c GROUP BY 1""",
)
def agg8_box_cover(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").groupBy("p_brand", (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y")).agg(F.min("p_partkey").alias("id"))
    two = F.array(F.lit(2).cast("long"), F.lit(2).cast("long"))
    b = c.select("p_brand", "id", F.array(F.col("x") * 2, F.col("y") * 2).alias("offset"), two.alias("shape"), F.array(F.lit(20).cast("long"), F.lit(20).cast("long")).alias("container"))
    return boxes.box_cover(b, ["p_brand"], 2)


@BOOK.add(
    "agg9_merge",
    f"""WITH {_RANGES.replace('SELECT l_suppkey', 'SELECT DISTINCT l_suppkey')}, n AS (SELECT *, CASE WHEN b > max(e) OVER w THEN 1 WHEN max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY s ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT s, min(b) AS b, max(e) AS e FROM g GROUP BY s, island""",
)
def agg9_merge(spark, d):
    return boxes.merged_intervals(_ranges(spark, d), ["s"], "b", "e")


@BOOK.add(
    "win9_contiguous_runs",
    """WITH p AS (SELECT user_id % 10 AS stream, event_id AS pos, event_id AS src, event_id + CASE WHEN event_id % 17 = 0 THEN 5 ELSE 0 END AS dst FROM events), c AS (SELECT *, CASE WHEN src <> lag(src) OVER w + 1 OR dst <> lag(dst) OVER w + 1 THEN 1 WHEN lag(src) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM p WINDOW w AS (PARTITION BY stream ORDER BY pos)),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY stream ORDER BY pos) AS run FROM c) SELECT stream, arg_min(src, pos) AS src, arg_min(dst, pos) AS dst, count(*) AS length, count(*) * 64 AS bytes FROM r GROUP BY stream, run""",
)
def win9_contiguous_runs(spark, d):
    k = F.col("event_id")
    p = table(spark, d, "events").select((F.col("user_id") % 10).alias("stream"), k.alias("pos"), k.alias("src"), (k + F.when(k % 17 == 0, 5).otherwise(0)).alias("dst"))
    return boxes.contiguous_runs(p, ["stream"], "pos", "src", "dst", 64)


@BOOK.add("prj6_chunk_ranges", f"WITH {_IV} SELECT s.p_brand, rid, lid AS chunk, greatest(lb, rb) - lb AS src, greatest(lb, rb) - rb AS dst, least(le, re) - greatest(lb, rb) AS length FROM s JOIN t ON s.p_brand = t.p_brand AND greatest(lb, rb) < least(le, re)")
def prj6_chunk_ranges(spark, d):
    _, t = _intervals(spark, d)
    chunks = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("no"), F.col("p_size").cast("long").alias("size"))
    return boxes.chunk_ranges(chunks, t, ["p_brand"], 100)


@BOOK.add("ns7_shard_bounds", "SELECT p_partkey, r AS rank, CAST(r * (p_size // 4) + least(r, p_size % 4) AS BIGINT) AS \"begin\", CAST(r * (p_size // 4) + least(r, p_size % 4) + p_size // 4 + CASE WHEN r < p_size % 4 THEN 1 ELSE 0 END AS BIGINT) AS \"end\" FROM part, (VALUES (0), (1), (2), (3)) v(r)")
def ns7_shard_bounds(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("rank"))
    b, e = boxes.shard_bounds(F.col("p_size"), F.lit(4), F.col("rank"))
    return p.select("p_partkey", "rank", b.alias("begin"), e.alias("end"))


_KIND = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'MEMORY' WHEN l_returnflag = 'A' THEN 'NOF_SSD' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'LOCAL_DISK' WHEN l_returnflag = 'N' THEN 'DFS' ELSE 'DISK' END"


@BOOK.add(
    "jn8_replica_select",
    f"""WITH r AS (SELECT l_orderkey AS key, l_linenumber * 1000000 + l_partkey * 10 + CAST(l_quantity AS BIGINT) % 10 AS pos, {_KIND} AS kind, l_discount <= 0.07 AS ok, l_suppkey % 4 = 0 AS local FROM lineitem),
    k AS (SELECT *, CASE WHEN local AND kind IN ('MEMORY', 'NOF_SSD') THEN 0 WHEN kind = 'MEMORY' THEN 1 WHEN kind = 'NOF_SSD' THEN 2 WHEN kind = 'LOCAL_DISK' THEN 3 WHEN kind = 'DFS' THEN 4 ELSE 5 END AS tier FROM r WHERE ok),
    o AS (SELECT key, tier, kind, pos, row_number() OVER (PARTITION BY key ORDER BY tier, CASE WHEN tier IN (3, 4) THEN -pos ELSE pos END) AS rn FROM k) SELECT key, pos AS id, min(kind) AS kind FROM o WHERE rn = 1 GROUP BY 1, 2""",
)
def jn8_replica_select(spark, d):
    li = table(spark, d, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when((f == "A") & (s == "F"), "MEMORY").when(f == "A", "NOF_SSD").when((f == "N") & (s == "F"), "LOCAL_DISK").when(f == "N", "DFS").otherwise("DISK")
    pos = F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_quantity").cast("long") % 10
    r = li.select(F.col("l_orderkey").alias("key"), pos.alias("pos"), pos.alias("id"), kind.alias("kind"), F.when(F.col("l_discount") <= 0.07, "COMPLETE").otherwise("PROCESSING").alias("status"), (F.col("l_suppkey") % 4 == 0).alias("local"))
    return placement.select_replica(r, "key")


_RULES = [(0, "nvlink", "A", None, None, 100000.0, None), (1, "rdma", None, "F", 50000.0, None, 1), (2, "rdma", "N", "F", None, None, None), (3, "tcp", "R", None, None, 30000.0, None), (4, "tcp", None, None, 200000.0, None, None)]


def _rule(r):
    no, t, seg, loc, lo, hi, pri = r
    tests = [f"l_returnflag = '{seg}'" * (seg is not None), f"l_linestatus = '{loc}'" * (loc is not None), f"l_extendedprice >= {lo}" * (lo is not None), f"l_extendedprice <= {hi}" * (hi is not None), f"l_linenumber = {pri}" * (pri is not None)]
    return " AND ".join(x for x in tests if x) or "TRUE"


@BOOK.add(
    "flt15_policy_first_match",
    "WITH q AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE " + " ".join(f"WHEN {_rule(r)} THEN {r[0]}" for r in _RULES) + " END AS rule_no, CASE " + " ".join(f"WHEN {_rule(r)} THEN '{r[1]}'" for r in _RULES) + " ELSE 'unspecified' END AS transport FROM lineitem) SELECT rule_no, transport, count(*) AS n FROM q GROUP BY 1, 2",
)
def flt15_policy_first_match(spark, d):
    rules = spark.createDataFrame(_RULES, "rule_no int, transport string, segment_type string, locality string, min_size double, max_size double, priority int")
    li = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("req"), F.col("l_returnflag").alias("segment_type"), F.col("l_linestatus").alias("locality"), F.col("l_extendedprice").alias("size"), F.col("l_linenumber").alias("priority"))
    return placement.first_rule(li, rules, "req").groupBy("rule_no", "transport").agg(F.count("*").alias("n"))


@BOOK.add("agg15_util", f"WITH {_SEG} SELECT segment, round(CASE WHEN sum(capacity) = 0 THEN 0 ELSE (sum(capacity) - sum(used))::DOUBLE / sum(capacity)::DOUBLE END, 9) AS free_ratio, sum(capacity) > 0 AS counted FROM g GROUP BY 1")
def agg15_util(spark, d):
    return placement.free_ratio(segments(spark, d)).withColumn("free_ratio", F.round("free_ratio", 9))


@BOOK.add(
    "tk1_free_ratio_first",
    f"""WITH {_SEG}, f AS (SELECT segment, CASE WHEN sum(capacity) = 0 THEN 0 ELSE (sum(capacity) - sum(used))::DOUBLE / sum(capacity)::DOUBLE END AS free_ratio FROM g GROUP BY 1), h AS (SELECT segment, row_number() OVER (ORDER BY free_ratio DESC, segment) AS r FROM f),
    c AS (SELECT o_orderkey, 's' || (o_custkey % 50) AS segment, 0 AS r FROM orders WHERE 's' || (o_custkey % 50) IN (SELECT segment FROM f) UNION ALL SELECT o_orderkey, h.segment, h.r FROM orders, h WHERE h.r <= 4 AND h.segment <> 's' || (o_custkey % 50)),
    k AS (SELECT o_orderkey, segment, row_number() OVER (PARTITION BY o_orderkey ORDER BY r) - 1 AS replica FROM c) SELECT * FROM k WHERE replica < 3""",
)
def tk1_free_ratio_first(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string"))).alias("preferred"))
    return placement.place(o, placement.free_ratio(segments(spark, d)), "o_orderkey", 3)


_DRAW = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"


@BOOK.add("tk2_random_placement", f"WITH {_SEG}, n AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT segment FROM g)), o AS (SELECT o_orderkey, replica, {_DRAW.format("o_orderkey || '/7'")} + replica AS x FROM orders, (VALUES (0), (1)) v(replica)) SELECT o_orderkey, replica, segment FROM o JOIN n ON n.at = o.x % n.n")
def tk2_random_placement(spark, d):
    return placement.place_random(table(spark, d, "orders").select("o_orderkey"), segments(spark, d), "o_orderkey", 2, 7)


@BOOK.add(
    "tk3_local_first",
    f"""WITH {_SEG}, f AS (SELECT segment, CASE WHEN sum(capacity) = 0 THEN 0 ELSE (sum(capacity) - sum(used))::DOUBLE / sum(capacity)::DOUBLE END AS free_ratio, 'h' || (CAST(substr(segment, 2) AS INT) % 5) AS host FROM g GROUP BY 1),
    h AS (SELECT *, row_number() OVER (ORDER BY free_ratio DESC, segment) AS r, row_number() OVER (PARTITION BY host ORDER BY free_ratio DESC, segment) AS own FROM f), c AS (SELECT o_orderkey, segment, CASE WHEN h.host = 'h' || (o_custkey % 6) THEN 0 ELSE 1 END AS away, r FROM orders, h WHERE r <= 4 OR (own <= 2 AND h.host = 'h' || (o_custkey % 6))),
    k AS (SELECT o_orderkey, segment, row_number() OVER (PARTITION BY o_orderkey ORDER BY away, r) - 1 AS replica FROM c) SELECT * FROM k WHERE replica < 2""",
)
def tk3_local_first(spark, d):
    free = placement.free_ratio(segments(spark, d)).withColumn("host", F.concat(F.lit("h"), (F.substring("segment", 2, 9).cast("int") % 5).cast("string")))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("h"), (F.col("o_custkey") % 6).cast("string")).alias("host"))
    return placement.place_local_first(o, free, "o_orderkey", "host", 2)


@BOOK.add(
    "ud2_scored_placement",
    f"WITH {_SEG}, f AS (SELECT segment, sum(capacity) AS score FROM g WHERE segment NOT IN ('s1', 's2') GROUP BY 1), r AS (SELECT segment, row_number() OVER (ORDER BY score DESC, segment) - 1 AS replica FROM f) SELECT o_orderkey, replica, segment FROM orders, r WHERE replica < 2",
)
def ud2_scored_placement(spark, d):
    """A score of the caller's, here the capacity, and two segments left out."""
    s = segments(spark, d).groupBy("segment").agg(F.sum("capacity").alias("capacity"))
    o = table(spark, d, "orders").select("o_orderkey", F.array().cast("array<string>").alias("preferred"))
    return placement.place(o, s, "o_orderkey", 2, F.col("capacity").cast("double"), ("s1", "s2"))


@BOOK.add("tk4_oldest_ten_percent", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM orders)")
def tk4_oldest_ten_percent(spark, d):
    from kvloom.operators.ranks import ranked

    o = ranked(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [], [F.col("o_orderdate"), F.col("o_orderkey")], "rank", "n")
    return o.where(F.col("rank") < F.ceil(F.col("n") * 0.1)).select("o_orderkey")


@BOOK.add(
    "tk6_nic_pick",
    """WITH c AS (SELECT event_id AS request, n AS nic, (user_id * 7 + n * 13) % 50 AS inflight, value AS bytes, 10.0::DOUBLE + n AS ewma, CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS pen FROM events, (VALUES (0), (1), (2), (3)) v(n) WHERE value > 0),
    s AS (SELECT *, (inflight + bytes) / ewma * pen AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score, nic) AS rn, sum(1 / score) OVER (PARTITION BY request) AS inv FROM s) SELECT request, nic, round(score, 8) AS score, round(1 / score / inv, 8) AS share FROM r WHERE rn = 1""",
)
def tk6_nic_pick(spark, d):
    e = table(spark, d, "events").where("value > 0").select(F.col("event_id").alias("request"), "user_id", "value", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("nic"))
    c = e.select("request", "nic", ((F.col("user_id") * 7 + F.col("nic") * 13) % 50).alias("inflight"), F.col("value").alias("bytes"), (F.lit(10.0) + F.col("nic")).alias("ewma"), F.when(F.col("nic") % 2 == 0, 1.0).otherwise(1.5).alias("penalty"))
    return placement.pick_nic(c, "request").withColumns({"score": F.round("score", 8), "share": F.round("share", 8)})


@BOOK.add("tk7_routing", f"WITH e AS (SELECT vec_id AS token, unnest(range(0, 16)) AS expert FROM embeddings), s AS (SELECT token, expert, ({_DRAW.format("token || '/' || expert || '/11'")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM e), r AS (SELECT token, CAST(expert AS INT) AS expert, row_number() OVER (PARTITION BY token ORDER BY -ln(-ln(u)) - ln(expert + 1.0::DOUBLE) DESC, expert) AS rank FROM s) SELECT * FROM r WHERE rank <= 2")
def tk7_routing(spark, d):
    return placement.route(table(spark, d, "embeddings").select(F.col("vec_id").alias("token")), "token", 16, 2, 11, 1.0)


@BOOK.add("tk8_plan_order", 'WITH ' + _IV + ' SELECT p_brand, rid, rb, re, row_number() OVER (ORDER BY p_brand, rb, re, rid) - 1 AS plan_pos FROM t')
def tk8_plan_order(spark, d):
    from kvloom.operators.ranks import ranked

    _, t = _intervals(spark, d)
    return ranked(t, [], [F.col(c) for c in ("p_brand", "rb", "re", "rid")], "plan_pos")


@BOOK.add("tk9_device_pick", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'nic0' ELSE 'nic1' END ELSE CASE (user_id % 4 - 1) % 4 WHEN 0 THEN 'nic0' WHEN 1 THEN 'nic1' WHEN 2 THEN 'nic2' ELSE 'nic3' END END AS device FROM events")
def tk9_device_pick(spark, d):
    return placement.pick_device(table(spark, d, "events"), ["nic0", "nic1"], ["nic2", "nic3"], F.col("event_id"), F.col("user_id") % 4).select("event_id", "device")


@BOOK.add("tk10_operation_mix", "SELECT event_id, CASE WHEN event_id % 100 < 70 THEN 'get' WHEN event_id % 100 < 95 THEN 'put' ELSE 'remove' END AS operation FROM events")
def tk10_operation_mix(spark, d):
    return placement.pick_operation(table(spark, d, "events"), F.col("event_id") % 100, {"get": 70, "put": 25, "remove": 5}).select("event_id", "operation")


_TOP = "e AS (SELECT vec_id, label AS rank, embedding[1:16] AS s FROM embeddings), x AS (SELECT vec_id AS token, rank, unnest(range(0, 16)) AS expert, unnest(s)::DOUBLE AS score FROM e), t AS (SELECT token, rank, expert, score, row_number() OVER (PARTITION BY token ORDER BY score DESC, expert) AS k FROM x), q AS (SELECT * FROM t WHERE k <= 2)"


def _tokens(spark, d):
    e = table(spark, d, "embeddings")
    scored = F.transform(F.slice("embedding", 1, 16), lambda v, i: F.struct((-v.cast("double")).alias("m"), i.alias("expert")))
    top = F.slice(F.array_sort(scored), 1, 2)
    return e.select(F.col("label").alias("rank"), F.col("vec_id").alias("token"), F.transform(top, lambda x: x["expert"]).alias("topk_idx"), F.transform(top, lambda x: -x["m"]).alias("topk_weight"), "embedding")


@BOOK.add("jn9_dispatch", f"WITH {_TOP} SELECT expert, row_number() OVER (PARTITION BY expert ORDER BY rank, token) - 1 AS slot, rank, token FROM q")
def jn9_dispatch(spark, d):
    return moe.dispatch(_tokens(spark, d))


@BOOK.add("jn9_layout", f'WITH {_TOP}, n AS (SELECT expert, rank, count(*) AS "count" FROM q GROUP BY 1, 2), b AS (SELECT *, CAST(sum("count") OVER (PARTITION BY expert ORDER BY rank) - "count" AS BIGINT) AS "begin" FROM n) SELECT expert, rank, "count", "begin", "begin" * 4294967296 + "count" AS word FROM b')
def jn9_layout(spark, d):
    return moe.dispatch_layout(_tokens(spark, d))


@BOOK.add("agg6_expert_load", f"WITH {_TOP}, n AS (SELECT i AS expert, count(q.token) AS n FROM range(0, 20) r(i) LEFT JOIN q ON q.expert = i GROUP BY 1) SELECT expert, n, max(n) OVER () AS most, min(n) OVER () AS least, avg(n) OVER () AS mean, round(max(n) OVER () / avg(n) OVER (), 9) AS imbalance FROM n")
def agg6_expert_load(spark, d):
    return moe.expert_load(_tokens(spark, d), 20).withColumn("imbalance", F.round("imbalance", 9))


@BOOK.add("agg10_combine", f"WITH {_TOP}, w AS (SELECT q.token, q.score, j AS dim, m.embedding[j + 1]::DOUBLE * (1 + q.expert) AS v FROM q JOIN embeddings m ON m.vec_id = q.token, range(0, 8) r(j)) SELECT token, CAST(dim AS INT) AS dim, round(sum(score * v), 6) AS value FROM w GROUP BY 1, 2")
def agg10_combine(spark, d):
    t = _tokens(spark, d)
    out = t.select("token", F.explode("topk_idx").alias("expert"), F.slice("embedding", 1, 8).alias("v")).select("token", "expert", F.transform("v", lambda x: x.cast("double") * (1 + F.col("expert"))).alias("x"))
    return moe.combine(t, out).withColumn("value", F.round("value", 6))


for _op, _sql in (("sum", "round(sum(v), 5)"), ("min", "min(v)"), ("max", "max(v)")):

    @BOOK.add(f"agg11_allreduce_{_op}", f"WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, {_sql} AS value FROM x GROUP BY 1, 2")
    def _allreduce(spark, d, op=_op):
        r = moe.allreduce(table(spark, d, "embeddings"), ["label"], "embedding", op.upper())
        return r.withColumn("value", F.round("value", 5)) if op == "sum" else r


@BOOK.add("agg11_allreduce_product", "WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, round(product(1 + v / 1000), 7) AS value FROM x GROUP BY 1, 2")
def agg11_allreduce_product(spark, d):
    """Factors near 1, as products of many small numbers vanish."""
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: 1 + v.cast("double") / 1000).alias("v"))
    return moe.allreduce(e, ["label"], "v", "PRODUCT").withColumn("value", F.round("value", 7))


@BOOK.add("agg12_allgather", "WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT (row_number() OVER (ORDER BY vec_id, i) - 1) AS place, value FROM x")
def agg12_allgather(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return moe.allgather(e, "vec_id", "v")


@BOOK.add("agg12_reduce_scatter", "WITH x AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT CAST(dim // 8 AS BIGINT) AS rank, CAST(dim % 8 AS BIGINT) AS place, round(sum(v), 4) AS value FROM x GROUP BY 1, 2")
def agg12_reduce_scatter(spark, d):
    return moe.reduce_scatter(table(spark, d, "embeddings"), "rank", "embedding", 8).withColumn("value", F.round("value", 4))


@BOOK.add("agg12_alltoall", "SELECT o_custkey % 5 AS src, o_orderkey % 5 AS dst, o_orderkey AS value FROM orders")
def agg12_alltoall(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("src"), (F.col("o_custkey") % 5).alias("dst"), F.col("o_orderkey").alias("value"))
    return moe.alltoall(o, "src", "dst")


@BOOK.add("jn3_gather", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT e.event_id AS b, CAST(e.user_id % 3 AS BIGINT) AS l, m.label AS head, m.vec_id AS row_id, round(list_sum(m.embedding::DOUBLE[]), 5) AS total FROM events e, n JOIN embeddings m ON m.vec_id = e.event_id % n.n")
def jn3_gather(spark, d):
    m = table(spark, d, "embeddings").select(F.col("label").alias("head"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    n = m.count()
    r = table(spark, d, "events").select(F.col("event_id").alias("b"), (F.col("user_id") % 3).alias("l"), (F.col("event_id") % n).alias("row_id")).join(m.select("head", "row_id"), "row_id")
    return moe.gather(r, m, n).select("b", "l", "head", "row_id", F.round(moe.vector_sum(F.col("vec")), 5).alias("total"))


@BOOK.add("jn3_gather_out_of_range", "SELECT event_id AS b, 0.0::DOUBLE AS total FROM events")
def jn3_gather_out_of_range(spark, d):
    """One id beyond the table zeroes the whole output."""
    m = table(spark, d, "embeddings").select(F.lit(0).alias("head"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    r = table(spark, d, "events").select(F.col("event_id").alias("b"), F.lit(0).alias("l"), F.lit(0).alias("head"), F.when(F.col("event_id") == 17, -1).otherwise(0).cast("long").alias("row_id"))
    return moe.gather(r, m, 1).select("b", moe.vector_sum(F.col("vec")).alias("total"))


def _log(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events")
    op = F.when(t.isin("click", "view", "purchase"), "PUT_END").when(t == "error", "REMOVE").otherwise("PUT_REVOKE")
    return e.select((F.col("user_id") % 5).alias("tenant"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), F.col("value").cast("string").alias("payload"), "event_type", F.col("ts"))


_LOG = "l AS (SELECT user_id % 5 AS tenant, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'PUT_END' WHEN event_type = 'error' THEN 'REMOVE' ELSE 'PUT_REVOKE' END AS op, event_type, value FROM events)"


@BOOK.add("st1_compaction", f"WITH {_LOG}, m AS (SELECT tenant, k, max(seq) AS seq, arg_max(op, seq) AS op FROM l GROUP BY 1, 2) SELECT tenant, k, seq FROM m WHERE op = 'PUT_END'")
def st1_compaction(spark, d):
    return oplog.compact(_log(spark, d), ["tenant", "k"]).select("tenant", "k", "seq")


@BOOK.add("src9_snapshot_replay", f"WITH {_LOG}, m AS (SELECT tenant, k, max(seq) AS seq, arg_max(op, seq) AS op FROM l GROUP BY 1, 2) SELECT tenant, k, seq FROM m WHERE op = 'PUT_END'")
def src9_snapshot_replay(spark, d):
    """The state at sequence 4000 and the log after it give what the whole log gives."""
    log = _log(spark, d)
    base = oplog.compact(log.where("seq <= 4000"), ["tenant", "k"])
    return oplog.replay(base, 4000, log, ["tenant", "k"]).select("tenant", "k", "seq")


@BOOK.add(
    "st2_event_index",
    """WITH e AS (SELECT user_id % 8 AS stream, CAST(json_extract_string(props, '$.k') AS INT) AS hash, event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'stored' WHEN event_type = 'error' THEN 'removed' WHEN event_id % 40 = 0 THEN 'cleared' ELSE 'other' END AS kind FROM events),
    c AS (SELECT stream, max(event_id) AS c FROM e WHERE kind = 'cleared' GROUP BY 1), l AS (SELECT stream, hash, max(event_id) AS s, arg_max(kind, event_id) AS kind FROM e WHERE kind IN ('stored', 'removed') GROUP BY 1, 2) SELECT stream, hash, s AS stored_at FROM l LEFT JOIN c USING (stream) WHERE kind = 'stored' AND s > coalesce(c, -1)""",
)
def st2_event_index(spark, d):
    t, k = F.col("event_type"), F.col("event_id")
    kind = F.when(t.isin("click", "view", "purchase"), "stored").when(t == "error", "removed").when(k % 40 == 0, "cleared").otherwise("other")
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("stream"), F.get_json_object("props", "$.k").cast("int").alias("hash"), k.alias("event_id"), kind.alias("event_type"))
    return oplog.event_index(e, ["stream"], "hash")


@BOOK.add("st3_loss_detection", "WITH e AS (SELECT user_id % 6 AS stream, event_id // 6 AS seq FROM events WHERE event_id % 50 <> 7), l AS (SELECT *, lag(seq) OVER (PARTITION BY stream ORDER BY seq) AS before FROM e) SELECT stream, count(*) FILTER (seq > before + 1) AS gaps FROM l GROUP BY 1")
def st3_loss_detection(spark, d):
    from kvloom.operators.catalog import gaps_of

    e = table(spark, d, "events").where("event_id % 50 <> 7").select((F.col("user_id") % 6).alias("stream"), F.floor(F.col("event_id") / 6).alias("seq"))
    g = gaps_of(e, ["stream"], "seq").where("kind = 'gap'").groupBy("stream").agg(F.count("*").alias("n"))
    return e.select("stream").distinct().join(g, "stream", "left").select("stream", F.coalesce("n", F.lit(0)).alias("gaps"))


@BOOK.add(
    "st4_heat_tumbling",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, i, t AS start_us FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t >= f.start_us + 86400000000 THEN e.t ELSE f.start_us END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, start_us, count(*) AS hits FROM f GROUP BY 1, 2""",
)
def st4_heat_tumbling(spark, d):
    return oplog.heat_windows(table(spark, d, "events"), "user_id", "ts", 86400)


@BOOK.add("st6_liveness", "SELECT user_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-29 12:00:00') - epoch_us(max(ts)) > 43200000000 THEN 'NEED_REMOUNT' ELSE 'OK' END AS status FROM events GROUP BY 1")
def st6_liveness(spark, d):
    return oplog.liveness(table(spark, d, "events"), "user_id", "ts", F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"), 43200)


@BOOK.add("st9_lag", "WITH p AS (SELECT user_id % 5 AS shard, max(event_id) AS p FROM events GROUP BY 1), s AS (SELECT user_id % 5 AS shard, max(event_id) AS s FROM events WHERE event_id % 100 < 90 AND user_id % 5 <> 3 GROUP BY 1) SELECT shard, CAST(greatest(0, p - coalesce(s, 0)) AS BIGINT) AS lag, CAST(0 AS BIGINT) AS lag_ms FROM p LEFT JOIN s USING (shard)")
def st9_lag(spark, d):
    e = table(spark, d, "events").withColumn("shard", F.col("user_id") % 5)
    return oplog.replication_lag(e, e.where("event_id % 100 < 90 and shard <> 3"), "shard", "event_id")


@BOOK.add("sc_scalars", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS parsed, rpad(substr(p_name, 1, 6), 6, '_') || lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS fixed_key,
    replace(replace(replace(p_brand || '.' || p_name || '[0]\\', '\\', '\\\\'), '.', '\\.'), '[', '\\[') AS escaped, CASE WHEN p_partkey < 1024 THEN p_partkey || ' B' WHEN p_partkey < 1048576 THEN printf('%.2f KiB', p_partkey / 1024.0::DOUBLE) ELSE printf('%.2f MiB', p_partkey / 1048576.0::DOUBLE) END AS size_text, (p_size::BIGINT) * 1024 AS size_bytes FROM part""")
def sc_scalars(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.select(
        "p_partkey", scalar.key_to_u64(F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("x")))).cast("string").alias("parsed"), scalar.fixed_width_key(F.col("p_name"), k, 6).alias("fixed_key"),
        scalar.escape_path(F.concat("p_brand", F.lit("."), "p_name", F.lit("[0]\\"))).alias("escaped"), scalar.format_bytes(k).alias("size_text"), scalar.parse_size(F.concat(F.col("p_size").cast("string"), F.lit("k"))).alias("size_bytes"),
    )


@BOOK.add(
    "sc_more_scalars",
    """SELECT p_partkey, p_partkey * ((512 + 64 + 128) * 2 * 61) AS page_bytes, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS element_bytes, p_partkey || '-' || p_size AS uuid, CAST(p_partkey AS VARCHAR) AS high, CAST(p_size AS VARCHAR) AS low, p_partkey % 2 = 0 AND p_partkey % 1000 <> 0 AS newer,
    replace(replace(p_name || '"\\', '\\', '\\\\'), '"', '\\"') AS label, CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 8 AS shard, p_partkey % 2 = 0 AS sound FROM part""",
)
def sc_more_scalars(spark, d):
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    high, low = scalar.uuid_parts(scalar.uuid_text(k, size))
    # a number after the wrap of 2**64 comes after one before it
    late = F.when(k % 1000 == 0, k).when(k % 2 == 0, k + 5).otherwise(F.lit("18446744073709551000").cast("decimal(20,0)") - k)
    return p.select(
        "p_partkey", scalar.page_bytes(k, 512, 64, 128, 2, 61).alias("page_bytes"), scalar.element_bytes(F.element_at(F.array(F.lit("fp8"), F.lit("bf16"), F.lit("int64")), size % 3 + 1)).alias("element_bytes"), scalar.uuid_text(k, size).alias("uuid"), high.cast("string").alias("high"), low.cast("string").alias("low"),
        scalar.sequence_newer(late, k).alias("newer"), scalar.escape_label(F.concat("p_name", F.lit('"\\'))).alias("label"), scalar.shard_of(F.col("p_name"), 8).alias("shard"), scalar.payload_valid(F.col("p_name"), F.crc32(F.concat("p_name", F.when(k % 2 == 0, "").otherwise("x")).cast("binary"))).alias("sound"),
    )


@BOOK.add("sc7_box_geometry", "SELECT p_partkey, CAST(p_size * (p_size % 9 + 1) * 3 AS BIGINT) AS volume, CAST((p_size // 2 * (p_size % 9 + 1) + p_size % 9) * 3 + 2 AS BIGINT) AS place FROM part")
def sc7_box_geometry(spark, d):
    size = F.col("p_size").cast("long")
    shape = F.array(size, size % 9 + 1, F.lit(3).cast("long"))
    return table(spark, d, "part").select("p_partkey", boxes.volume(shape).alias("volume"), boxes.row_major_offset(F.array(F.floor(size / 2), size % 9, F.lit(2).cast("long")), shape).alias("place"))


@BOOK.add(
    "src8_published_events",
    """WITH n AS (SELECT event_id AS source_id, row_number() OVER (ORDER BY event_id) - 1 AS event_id, epoch_us(ts) // 21600000000 AS tick FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY source_id DESC) - 1 AS age, count(*) OVER (PARTITION BY tick) AS n FROM n)
    SELECT source_id, event_id, tick, (least(n, 5) - 1 - age) // 2 AS batch_no FROM a WHERE age < 5""",
)
def src8_published_events(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("source_id"), "ts")
    return oplog.published(e, "source_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000), 2, 5).select("source_id", "event_id", "tick", "batch_no")


@BOOK.add("st5_candidate_retries", "WITH w AS (SELECT i AS retry, w FROM (VALUES (1, 10), (2, 30), (3, 70), (4, 150), (5, 310), (6, 630), (7, 1270), (8, 2270)) v(i, w)) SELECT event_id, retry, epoch_us(ts) // 1000 + w AS retry_at FROM events, w")
def st5_candidate_retries(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return oplog.retries(e, "at").drop("at")
