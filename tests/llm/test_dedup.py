"""Exact, passage, shingle and embedding deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words_of  # noqa: F401

from kvloom.llm import common, exact_dedup, jaccard_join, suffix_dedup
from kvloom.llm.embedding_dedup import near_vectors


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return sorted((((i is None, i or 0), min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("bits", [256, 8])
def test_exact(spark, odd, bits):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    extra = spark.createDataFrame([(100 + i, f"t{i % 40}") for i in range(120)], "doc_id long, text string")
    rows += [(r["doc_id"], r["text"]) for r in extra.collect()]
    out = exact_dedup.exact_dedup(odd.select("doc_id", "text").union(extra), digest_bits=bits).collect()
    assert sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == brute_exact(rows)
    assert sum(r["kept"] for r in out) == len({norm(t) for _, t in rows})


def test_exact_goes_on_from_its_state(spark, tmp_path):
    feed = lambda ids: exact_dedup.digest_feed(spark.createDataFrame([(i, f"t{i % 3}") for i in ids], "doc_id long, text string"))
    feed(range(5, 10)).write.parquet(f"file://{tmp_path}/feed")
    exact_dedup.run_stream(f"file://{tmp_path}/feed", feed([0]).schema, spark, f"file://{tmp_path}/cp")
    feed(range(5)).write.mode("append").parquet(f"file://{tmp_path}/feed")
    state = exact_dedup.run_stream(f"file://{tmp_path}/feed", feed([0]).schema, spark, f"file://{tmp_path}/cp")
    assert sorted((r["keep_id"], r["group_size"]) for r in state.collect()) == [(0, 4), (1, 3), (2, 3)]


@pytest.mark.parametrize("bits", [256, 8])
def test_two_batches_are_one(spark, tmp_path, bits):
    rows = [(i, f"t{i * 7 % 50}  x") for i in range(60)] + [(None, "t3 x"), (None, None), (200, ""), (5, "t35 x")]
    parts = [spark.createDataFrame(x, "doc_id long, text string") for x in (rows[30:], rows[:20], rows[20:30])]
    home = f"file://{tmp_path}/cp"
    seen = []
    for part, own in zip(parts, (rows[30:], rows[:20], rows[20:30])):
        out = exact_dedup.exact_dedup(part, digest_bits=bits, checkpoint=home).collect()
        seen += own
        got = [((r["doc_id"] is None, r["doc_id"] or 0), r["keep_id"], r["group_size"], r["text_sha256"]) for r in out]
        want = {(x[0], x[3]): x for x in brute_exact(seen)}
        assert len(out) == len(own) and all(want[x[0], x[3]] == x for x in got)
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out if r["doc_id"] not in (None, 5))
    feed = spark.read.parquet(f"{home}/feed")
    assert feed.select("locator").distinct().count() == len(rows) == feed.count()


def test_exact_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []


def brute_passages(rows, least):
    seen = Counter(t[i : i + least] for _, t in rows for i in range(len(t) - least + 1))
    out = []
    for key, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append(((key is None, key or 0), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [20_000, 2])
def test_passages(spark, odd, most):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(5)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for i in range(60):
        t = list("".join(rnd.choice(base)[rnd.randrange(50) : rnd.randrange(100, 300)] for _ in range(rnd.randrange(4))))
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = "z"
        rows.append((100 + i, "".join(t)))
    rows += [(300, "a" * 400), (301, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.repeated_passages(df, 40, k=16, most=most).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *tuple(r)[1:5]) for r in out) == brute_passages([(a, (b or "").encode()) for a, b in rows], 40)


def test_passages_of_200_bytes(spark):
    rnd = random.Random(21)
    base = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(150)) for _ in range(4)]
    rows = []
    for i in range(80):
        t = "".join(b[at : at + rnd.choice([150, 199, 200, 201, 260, 500])] + rnd.choice("xyz") for b in rnd.sample(base, rnd.randrange(4)) for at in [rnd.randrange(300)])
        rows.append((i, "é" * rnd.randrange(3) + t))
    rows += [(90, "ab" * 300), (91, None), (91, base[0]), (None, base[0] + "é"), (None, "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, row long")
    out = suffix_dedup.repeated_passages(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *tuple(r)[1:5]) for r in out) == brute_passages([(a, (b or "").encode()) for a, b in rows], 200)


@pytest.mark.parametrize("bits", [24, 9])
def test_anchors_against_brute_force(monkeypatch, bits):
    pos = np.uint64((1 << bits) - 1)
    monkeypatch.setattr(suffix_dedup, "_POS", pos)
    rnd = random.Random(11)
    for _ in range(20):
        texts = ["".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 30, 40, 41, 300, 700, 1500]))).encode() for _ in range(6)] + [b"a" * 600]
        want = set()
        for d, t in enumerate(texts):
            if len(t) >= 40:
                total, down = suffix_dedup.prefix_hashes(np.frombuffer(t, np.uint8))
                n = len(t) - 15
                h = (suffix_dedup.span_hash(total, down, np.arange(n), np.arange(16, n + 16)) & ~pos).tolist()
                want |= {(d, min(range(i, i + 25), key=lambda p: (h[p], p))) for i in range(len(t) - 39)}
        got = [(int(d), int(p)) for run in suffix_dedup.anchors(texts, 40, 16) for d, p in zip(run[0], run[1])]
        assert len(got) == len(set(got)) and set(got) == want


def test_passages_of_nothing(nothing):
    assert suffix_dedup.repeated_passages(nothing).collect() == []


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (200, 12)).astype(np.uint16)
    group = np.sort(rng.integers(0, 9, 200))
    order, shared = suffix_dedup.suffix_sort(rows, group)
    got = [(int(group[i]), rows[i].tolist()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(200))
    for k in range(1, 200):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = 12 if (a == b).all() else int((a != b).argmax())
        assert shared[k] == (same if group[k] == group[k - 1] else 0)


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup._POWERS, "get", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    rows = np.random.default_rng(2).integers(0, 3, (50, 6)).astype(np.uint16)
    order, _ = suffix_dedup.suffix_sort(rows, np.zeros(50, np.int64))
    assert [rows[i].tolist() for i in order] == sorted(rows.tolist())


def brute_classes(rows, num=75, den=100):
    from conftest import words_of

    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (words_of(t) for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k is None, k or 0), len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def near_rows():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for c in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(6, 90))]
        for _ in range(rnd.randrange(1, 9)):
            t = list(base)
            for _ in range(rnd.randrange(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((len(rows) + 50, " ".join(t)))
    shared = [rnd.choice(vocab) for _ in range(40)]
    for _ in range(30):
        rows.append((len(rows) + 50, " ".join([rnd.choice(vocab) for _ in range(12)] + shared + [rnd.choice(vocab) for _ in range(rnd.randrange(2, 9))])))
    return rows


def told_classes(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect())


@pytest.mark.parametrize("block, few, stars", [(512, 32, 2), (4, 1, 2), (2, 0, 0), (3, 2, 1)])
def test_classes(spark, odd, monkeypatch, block, few, stars):
    for name, value in (("BLOCK", block), ("FEW", few), ("STARS", stars)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + near_rows()
    assert told_classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_small_sets_in_refined_lists(spark, monkeypatch, levels):
    for name, value in (("BLOCK", 2), ("FEW", 0), ("STARS", 0), ("LEVELS", levels), ("TOGETHER", 7)):
        monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(17)
    vocab = [f"v{i}" for i in range(3)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 14)))) for i in range(150)]
    assert told_classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def test_words_on_which_polynomial_hashes_collide(spark):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, morse), (2, morse.translate(str.maketrans("ab", "ba"))), (3, f"{morse} x y z w"), (4, f"{morse} x y z w v")]
    assert told_classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


def test_long_texts_are_cut_at_white_space():
    text = b"  ".join(b"w%d" % (i * i) for i in range(500))
    one = np.concatenate([jaccard_join.hashed_words([p], 0)[0] for p in jaccard_join.pieces(text, 50)])
    assert (one == jaccard_join.hashed_words([text], 0)[0]).all() and len(list(jaccard_join.pieces(text, 50))) > 20


def test_skipping_and_derived_answers_lose_no_link():
    rnd = random.Random(2)
    for _ in range(300):
        lead = set(rnd.sample(range(60), 30))
        sets = [frozenset(rnd.sample(sorted(lead), rnd.randrange(10, 30))) | frozenset(rnd.sample(range(60), rnd.randrange(1, 20))) for _ in range(6)]
        token = rnd.randrange(60)
        some = [s for s in sets if token in s]
        n = np.array([len(s) for s in some])
        # what lies before the token is taken not to be shared
        pos = np.array([sum(x < token for x in s) for s in some])
        order = np.lexsort((pos, n))
        n, pos, some = n[order], pos[order], [some[i] for i in order]
        got = {(int(i), int(j)) for a, b in jaccard_join.feasible_pairs(np.zeros(len(n), int), n, pos, np.ones(len(n), int), 75, 100) for i, j in zip(a, b)}
        for j in range(len(some)):
            for i in range(j):
                after = len({x for x in some[i] & some[j] if x >= token})
                if 175 * after >= 75 * (n[i] + n[j]):
                    assert (i, j) in got
        shared = np.array([len(s & lead) if rnd.random() < 0.8 else -1 for s in some])
        if len(some) > 1:
            i, j = (np.array(x) for x in zip(*[(i, j) for j in range(len(some)) for i in range(j)]))
            possible, proven = jaccard_join.derived(n, [shared], [np.full(len(n), len(lead))], i, j, 75, 100)
            for k, (x, y) in enumerate(zip(i, j)):
                link = 175 * len(some[x] & some[y]) >= 75 * (n[x] + n[y])
                assert (possible[k] or not link) and (link or not proven[k])


def test_null_and_repeated_ids(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(vocab) for _ in range(60)] for _ in range(4)]
    text = lambda k, *at: " ".join("x" if i in at else w for i, w in enumerate(base[k]))
    # near copies without id; an id with two texts of which both have near copies; a unique text that shares a dropped row's id
    rows = [(1, text(0)), (None, text(0, 3)), (None, text(0, 3, 57)), (7, text(1)), (7, text(2)), (8, text(1, 2)), (9, text(2, 2)), (8, text(3)), (7, text(1)), (None, text(3)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_classes(df).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in out) == brute_classes(rows)
    pipeline = pytest.importorskip("corpus_pipeline")
    told = lambda d: sorted(((r["doc_id"] or -1), r["text"] or "") for r in d.collect())
    once = pipeline.exact(spark, df, "")
    assert told(once) == sorted((i or -1, t or "") for i, t in rows[:8] + rows[10:])
    assert told(pipeline.near(spark, df, "")) == sorted((i or -1, t or "") for i, t in [rows[0], rows[3], rows[4], rows[7], rows[10]])


def test_classes_of_nothing(nothing):
    assert jaccard_join.jaccard_classes(nothing).collect() == []


def test_bitmaps_never_rule_a_link_out():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 20)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        link = 100 * both >= 75 * (len(x) + len(y) - both)
        ok = jaccard_join.likely(np.array([len(x), len(y)]), [jaccard_join.bitmap(x), jaccard_join.bitmap(y)], np.array([0]), np.array([1]), 75, 100)[0] >= 0
        assert ok or not link


def test_awkward_vectors(spark):
    rng = np.random.default_rng(9)
    one = rng.standard_normal(4000)
    rows = [(None, one, 1), (None, one * 3e150, 2), (5, one * 1e-160, 3), (5, -one, 4), (5, one, 5), (8, rng.standard_normal(4000), 6), (9, one[:9], 7)]
    df = spark.createDataFrame([(i, [float(x) for x in v], k, k, k) for i, v, k in rows], "vec_id long, embedding array<double>, node long, h long, kept long")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect())
    assert got == sorted([(-1, 3, 5, False)] * 2 + [(5, 3, 5, True), (5, 0, 5, True), (5, 3, 5, True), (8, 0, 8, True), (9, 0, 9, True)])


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = []
    for b in base:
        b = b / np.linalg.norm(b)
        for c in (1.0, 0.99, 0.96, 0.951, 0.94):
            z = rng.standard_normal(64)
            z -= z @ b * b
            rows.append((len(rows), [float(v) for v in c * b + np.sqrt(1 - c * c) * z / np.linalg.norm(z)]))
    rows += [(1000 + i, rows[0][1]) for i in range(3)]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(cos, -1)
    want = (cos >= 0.95).sum(1)
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [None] + [1.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, []), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum()
    assert got[0]["n_links"] >= 3 and got[1002]["component_id"] == 0 and got[0]["kept"] and not got[1002]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert near_vectors(df.where("false")).collect() == []


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_with_and_without_broadcasts(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(0, 20)] + [(40, x) for x in range(30, 39)] + [(50, 50), (61, 60), (60, 61)]
    found, _ = common.components(spark.createDataFrame(edges, "a long, b long"), "components_test")
    assert {r["node"]: r["component"] for r in found.collect()} == {**{i: 0 for i in range(21)}, **{i: 30 for i in [40, *range(30, 39)]}, 60: 60, 61: 60}


def test_components_of_few_edges_spare_shuffles(spark):
    plans, stored = [], common.stored

    def kept(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, path)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(common, "stored", kept)
        m.setattr(common, "FEW_EDGES", 1 << 17)
        conf = "spark.sql.autoBroadcastJoinThreshold"
        spark.conf.set(conf, "-1")
        try:
            common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "components_test")
        finally:
            spark.conf.unset(conf)
    assert len(plans) > 1 and all("SortMergeJoin" not in p for p in plans)


def test_driver_gives_back_what_jobs_left(spark, tmp_path):
    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = full()
    common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    between = full()
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(8)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.jaccard_classes(docs).collect()} == {0, 2, 4, 6}
    assert before < between and full() - between > 2  # components() and answers() each ask for it


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    """Rounds over few edges don't run a task for each of many shuffle partitions."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old, seen, stored = {n: spark.conf.get(n) for n in names}, [], common.stored

    def noted(df, path):
        seen.append(df.rdd.getNumPartitions())
        return stored(df, path)

    monkeypatch.setattr(common, "stored", noted)
    try:
        spark.conf.set(names[0], 40)
        spark.conf.set(names[1], "false")
        found, _ = common.components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long"), "components_test")
        assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
    assert len(seen) > 2 and max(seen[1:]) <= common.FEW_TASKS
