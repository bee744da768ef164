"""Lookups, regex scans, merges, gathers, ragged columns, shredding, inference, scalars."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.functions import scalar
from kvloom.operators import catalog, placement, structured
from kvloom.operators.ranks import ranked

KEYS = ["prod/a.json", "prod/b.log", "test/c.json", "img1", "img22x", "KEYkey", "plain"]


def keys(spark, found):
    return sorted(r["key"] for r in found.collect())


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame([("a", k) for k in KEYS] + [("b", "prod/z.json")], "tenant_id string, key string")


@pytest.mark.parametrize("pattern, expected", [("^prod", ["prod/a.json", "prod/b.log"]), (r"\d+$", ["img1"]), ("key", ["KEYkey"]), (r"^prod|\.json$", ["prod/a.json", "prod/b.log", "test/c.json"]), (r"\.log$", ["prod/b.log"]), ("^plain$", ["plain"]), ("nothing", [])])
def test_regex_is_a_search_in_one_tenant(spark, objects, pattern, expected):
    assert keys(spark, catalog.by_regex(objects, pattern, "a")) == expected


def test_batch_answers_keep_repeats(spark, objects):
    q = spark.createDataFrame([(0, "a", "img1"), (1, "b", "img1"), (2, "a", "img1")], "pos int, tenant_id string, key string")
    assert {r["pos"]: r["found"] for r in catalog.exists(q, objects).collect()} == {0: True, 1: False, 2: True}


def test_strict_multi_get(spark):
    o = spark.createDataFrame([("a", "x", 1)], "tenant_id string, key string, size int")
    q = spark.createDataFrame([("a", "x"), ("a", "y")], "tenant_id string, key string")
    assert catalog.lookup_all(q, o, ["size"]).count() == 0 and catalog.lookup_all(q.limit(1), o, ["size"]).count() == 1


def test_bucket_page_stops_before_the_limit(spark):
    b = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "bucket_id int, n_keys int")
    assert [tuple(r) for r in catalog.bucket_page(b, 11).orderBy("bucket_id").collect()] == [(1, 5, 3), (2, 5, 3)]


def test_resolve_groups_fields_by_location(spark):
    loc = spark.createDataFrame([("k1", "a", 1, 0), ("k1", "b", 1, 0), ("k2", "a", 2, 3), ("k2", "b", 2, 3), ("k1", "c", 9, 9)], "key string, field string, fragment int, row int")
    q = spark.createDataFrame([(0, "k2"), (1, "k1")], "pos int, key string")
    assert sorted(tuple(r) for r in catalog.resolve(q, loc).collect()) == [("a,b", 0, 2, 3), ("a,b", 1, 1, 0)]


def test_append_rejects_collisions(spark):
    a = spark.createDataFrame([(0, 1)], "row_id int, x int")
    with pytest.raises(ValueError):
        catalog.append_columns(a, a)
    assert catalog.append_columns(a, spark.createDataFrame([(0, 7)], "row_id int, x int"), overwrite=True).first()["x"] == 7
    with pytest.raises(Exception, match="row on one side only"):
        catalog.append_columns(a, spark.createDataFrame([(0, 7), (1, 8)], "row_id int, y int")).collect()


@pytest.mark.parametrize(
    "rows, best",
    [
        ([(0, "NOF_SSD", True), (1, "MEMORY", True)], 0),
        ([(0, "LOCAL_DISK", False), (1, "LOCAL_DISK", False)], 1),
        ([(0, "DISK", False), (1, "DISK", False)], 0),
        ([(0, "DISK", False), (1, "MEMORY", False), (2, "MEMORY", False)], 1),
        ([(0, "DFS", False), (1, "DFS", False), (2, "DISK", False)], 1),
    ],
)
def test_replica_choice(spark, rows, best):
    df = spark.createDataFrame([("k", i, i, kind, "COMPLETE", local) for i, kind, local in rows], "key string, pos int, id int, kind string, status string, local boolean")
    assert placement.select_replica(df, "key").first()["id"] == best


def test_no_complete_replica(spark):
    df = spark.createDataFrame([("k", 0, 0, "MEMORY", "PROCESSING", True)], "key string, pos int, id int, kind string, status string, local boolean")
    assert placement.select_replica(df, "key").count() == 0


def test_placement_prefers_then_ranks(spark):
    seg = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "segment string, free_ratio double")
    o = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["nope", "c"])], "id int, preferred array<string>")
    got: dict = {}
    for r in placement.place(o, seg, "id", 2).orderBy("id", "replica").collect():
        got.setdefault(r["id"], []).append(r["segment"])
    assert got == {1: ["a", "b"], 2: ["b", "c"], 3: ["c", "b"]}


def test_routing_draws_distinct_experts(spark):
    r = placement.route(spark.range(50).withColumnRenamed("id", "t"), "t", 8, 3, 1, 1.0)
    assert r.groupBy("t").agg(F.countDistinct("expert").alias("n")).where("n <> 3").count() == 0


def member(spark, n=10):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("start, end, step", [(2, 8, 3), (-4, None, 1), (None, -20, 1), (0, 100, 4), (5, 2, 1)])
def test_slices_follow_python(spark, start, end, step):
    got = sorted(r["v"] for r in structured.slice_member(member(spark), start, end, step).collect())
    assert got == [i * 10 for i in range(10)[slice(start, end, step)]]


def test_gather_keeps_order_and_repeats(spark):
    idx = spark.createDataFrame([(0, -1), (1, 2), (2, 2)], "pos int, idx int")
    assert [r["v"] for r in structured.gather_rows(member(spark), idx).orderBy("pos").collect()] == [90, 20, 20]
    with pytest.raises(Exception, match="out of range"):
        structured.gather_rows(member(spark), spark.createDataFrame([(0, 10)], "pos int, idx int")).collect()


def test_ragged_round_trip(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, None), (2, []), (3, [5])], "row_id long, x array<int>")
    data, layout = structured.ragged_encode(df, "x")
    assert {r["row_id"]: r["value"] for r in structured.ragged_decode(data, layout).collect()} == {0: [1, 2], 1: None, 2: [], 3: [5]}


def test_missing_differs_from_null(spark):
    df = spark.createDataFrame([(0, '{"a": {"b": 1}}'), (1, '{"a": {"b": null}}'), (2, '{"a": {}}'), (3, "bad")], "row_id int, j string")
    got = {r["row_id"]: (r["a_b"], r["a_b_present"]) for r in structured.shred(df, "j", ["a.b"]).collect()}
    assert got == {0: ("1", True), 1: (None, True), 2: (None, False), 3: (None, False)}


def test_inference(spark):
    t = structured.infer([{"a": 1, "b": [1.5, 2]}, {"a": None, "b": None}])
    assert t == T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.DoubleType()))])
    with pytest.raises(ValueError):
        structured.infer([None, None])
    assert structured.infer([{str(i): 1 for i in range(65)}]) == T.StringType()


def test_fields_and_sections(spark):
    s = {"batch": member(spark), "other": member(spark).withColumnRenamed("v", "w")}
    assert structured.get_fields(s, batch=["v"]).columns == ["row_id", "v"]
    assert structured.get_fields(s).columns == ["row_id", "v", "w"]
    with pytest.raises(KeyError):
        structured.get_fields(s, fields=["nope"])


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.key_to_u64(F.lit("0xFFFFFFFFFFFFFFFF")).alias("h"), scalar.key_to_u64(F.lit("18446744073709551616")).alias("over"), scalar.key_to_u64(F.lit("12x")).alias("bad"), scalar.parse_size(F.lit("2M")).alias("m"), scalar.parse_size(F.lit("2Mb")).alias("mb"),
        scalar.sequence_newer(F.lit(1), F.lit("18446744073709551615").cast("decimal(20,0)")).alias("wraps"), scalar.escape_label(F.lit('a"\\\n')).alias("label"), scalar.format_bytes(F.lit(1536)).alias("b"), scalar.element_bytes(F.lit("bf16")).alias("e"),
    ).first()
    assert (int(r["h"]), r["over"], r["bad"], r["m"], r["mb"], r["wraps"], r["label"], r["b"], r["e"]) == (2**64 - 1, None, None, 2 << 20, None, True, 'a\\"\\\\\\n', "1.50 KiB", 2)


def test_ranks_over_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = ranked(df, ["g"], [F.col("v").desc()], "r", "n", {"s": F.col("v")}).collect()
    for g in ("hot", "cold"):
        mine = sorted((x for x in got if x["g"] == g), key=lambda x: -x["v"])
        assert [x["r"] for x in mine] == list(range(len(mine))) and mine[-1]["s"] == sum(x["v"] for x in mine) and mine[0]["n"] == len(mine)


def test_tags_new_win(spark):
    m = spark.range(1).select(catalog.merged_tags(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first()["m"]
    assert m == {"a": 1, "b": 3}


def test_leaf_codecs(spark):
    rows = ['{"a": 1, "b": "12", "c": [1, 2.5], "d": {"x": 1}, "e": null, "f": true, "g": 1}', '{"a": 2.5, "b": null, "c": [], "g": "x", "h": [1, "x"]}', None]
    got = {r["path"]: (r["n"], r["nulls"], r["codec"]) for r in structured.leaf_codecs(spark.createDataFrame([(r,) for r in rows], "j string"), "j").collect()}
    assert got == {"a": (2, 0, "number"), "b": (2, 1, "text"), "c": (2, 0, "numbers"), "d": (1, 0, "json"), "e": (1, 1, None), "f": (1, 0, "boolean"), "g": (2, 0, "json"), "h": (1, 0, "json")}


def test_strict_multi_get_of_null_values(spark):
    o = spark.createDataFrame([("a", "x", None), ("a", "y", 2)], "tenant_id string, key string, size int")
    assert catalog.lookup_all(o.select("tenant_id", "key"), o, ["size"]).count() == 2
