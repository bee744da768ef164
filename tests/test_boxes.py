"""Boxes and intervals against a nested loop."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvloom.operators import boxes, moe

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
interval = st.tuples(st.integers(0, 60), st.integers(0, 25))


@SLOW
@given(st.lists(interval, min_size=1, max_size=12), st.lists(interval, min_size=1, max_size=12), st.integers(1, 30))
def test_intervals(spark, left, right, width):
    a = spark.createDataFrame([(0, i, b, b + n) for i, (b, n) in enumerate(left)], "k int, lid int, lb long, le long")
    b = spark.createDataFrame([(0, i, x, x + n) for i, (x, n) in enumerate(right)], "k int, rid int, rb long, re long")
    got = sorted(tuple(r)[1:] for r in boxes.interval_overlap(a, b, ["k"], width).collect())
    want = sorted((i, j, max(x, y), min(x + n, y + m)) for i, (x, n) in enumerate(left) for j, (y, m) in enumerate(right) if max(x, y) < min(x + n, y + m))
    assert got == want


box = st.tuples(st.lists(st.integers(0, 9), min_size=2, max_size=2), st.lists(st.integers(0, 6), min_size=2, max_size=2))


@SLOW
@given(st.lists(box, min_size=1, max_size=8), st.lists(box, min_size=1, max_size=8))
def test_boxes(spark, left, right):
    a = spark.createDataFrame([(0, i, o, s) for i, (o, s) in enumerate(left)], "k int, lid int, lo array<long>, ls array<long>")
    b = spark.createDataFrame([(0, i, o, s) for i, (o, s) in enumerate(right)], "k int, rid int, ro array<long>, rs array<long>")
    got = sorted((r["lid"], r["rid"], tuple(r["offset"]), tuple(r["shape"])) for r in boxes.box_overlap(a, b, ["k"], 3).collect())
    want = []
    for i, (o, s) in enumerate(left):
        for j, (p, t) in enumerate(right):
            begin = [max(x, y) for x, y in zip(o, p)]
            size = [min(x + n, y + m) - c for x, n, y, m, c in zip(o, s, p, t, begin)]
            if all(x > 0 for x in size):
                want.append((i, j, tuple(begin), tuple(size)))
    assert got == sorted(want)


@SLOW
@given(st.lists(box, min_size=1, max_size=8), st.lists(box, min_size=1, max_size=8), st.integers(-7, 0))
def test_boxes_with_bins_along_every_dimension(spark, left, right, move):
    left, right = ([([x + move for x in o], s) for o, s in side] for side in (left, right))
    a = spark.createDataFrame([(0, i, o, s) for i, (o, s) in enumerate(left)], "k int, lid int, lo array<long>, ls array<long>")
    b = spark.createDataFrame([(0, i, o, s) for i, (o, s) in enumerate(right)], "k int, rid int, ro array<long>, rs array<long>")
    got = sorted((r["lid"], r["rid"], tuple(r["offset"]), tuple(r["shape"]), r["v"]) for r in boxes.box_overlap(a, b, ["k"], (3, 2)).withColumn("v", boxes.volume(F.col("shape"), 2)).collect())
    want = []
    for i, (o, s) in enumerate(left):
        for j, (p, t) in enumerate(right):
            begin = [max(x, y) for x, y in zip(o, p)]
            size = [min(x + n, y + m) - c for x, n, y, m, c in zip(o, s, p, t, begin)]
            if all(x > 0 for x in size):
                want.append((i, j, tuple(begin), tuple(size), size[0] * size[1]))
    assert got == sorted(want)


def test_box_query_runs_compiled_and_deals_pairs_out(spark, tmp_path):
    """Overlaps of millions of boxes: no loops over arrays for each pair, and a small table isn't all one task's work."""
    from kvloom.plans import registry

    spark.createDataFrame([(i, "Brand#11", i % 50 + 1, "t") for i in range(40)], "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = registry.QUERIES["jn4_box_overlap"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "zip_with" not in plan
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    box_of = lambda k: (k % 97, k % 50 + 1, k % 61, (k % 50 + 1) % 9 + 1)
    want = []
    for i in range(0, 40, 2):
        for j in range(1, 40, 2):
            (x, w, y, h), (p, v, q, g) = box_of(i), box_of(j)
            a, b = min(x + w, p + v) - max(x, p), min(y + h, q + g) - max(y, q)
            if a > 0 and b > 0:
                want.append((i, j, a * b))
    assert sorted((r["lid"], r["rid"], r["volume"]) for r in out.collect()) == want


def test_cover(spark):
    df = spark.createDataFrame([("tile", 0, 5), ("tile", 5, 9), ("gap", 0, 5), ("gap", 6, 9), ("lap", 0, 6), ("lap", 5, 9)], "k string, b long, e long")
    got = {r["k"]: (r["volume"], r["overlaps"], r["exact"]) for r in boxes.cover_check(df, ["k"], "b", "e").collect()}
    assert got == {"tile": (9, False, True), "gap": (8, False, False), "lap": (10, True, False)}


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("k", 0, 2), ("k", 2, 3), ("k", 5, 6)], "k string, b long, e long")
    assert sorted((r["b"], r["e"]) for r in boxes.merged_intervals(df, ["k"], "b", "e").collect()) == [(0, 3), (5, 6)]


def test_row_major(spark):
    r = spark.range(1).select(boxes.row_major_offset(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (4, 5, 6)))).alias("o")).first()
    assert r["o"] == 1 * 30 + 2 * 6 + 3


def test_dispatch_and_combine(spark):
    t = spark.createDataFrame([(0, 0, [1, -1], [0.5, 9.0]), (1, 1, [1, 2], [1.0, 2.0]), (0, 2, [2, 2], [1.0, 1.0])], "rank int, token int, topk_idx array<int>, topk_weight array<double>")
    assert {(r["expert"], r["slot"], r["token"]) for r in moe.dispatch(t.where("token < 2")).collect()} == {(1, 0, 0), (1, 1, 1), (2, 0, 1)}
    out = spark.createDataFrame([(0, 1, [2.0]), (1, 1, [3.0]), (1, 2, [4.0]), (2, 2, [5.0])], "token int, expert int, x array<double>")
    assert {(r["token"], r["value"]) for r in moe.combine(t, out).collect()} == {(0, 1.0), (1, 11.0), (2, 10.0)}
    load = {r["expert"]: r["n"] for r in moe.expert_load(t, 4).collect()}
    assert load == {0: 0, 1: 2, 2: 3, 3: 0}


def test_gather_fails_whole(spark):
    tables = spark.createDataFrame([(0, i, [float(i)]) for i in range(3)], "head int, row_id int, vec array<double>")
    good = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 2)], "b int, l int, head int, row_id int")
    assert moe.gather(good, tables, 3).count() == 2
    for bad in ((0, 2, 0, 3), (0, 2, 0, -1), (0, 2, 0, None), (0, 2, 9, 1)):
        out = moe.gather(good.union(spark.createDataFrame([bad], good.schema)), tables, 3).collect()
        assert len(out) == 3 and all(x == 0 for r in out for x in r["vec"])
