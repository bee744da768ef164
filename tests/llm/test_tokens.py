"""Encoders against their libraries, store and packing round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kvloom.llm import bpe, packing, token_store, tokens

MULTI, PLAIN, WORDY = (P.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", " ", "  a", "a  b", " a", "a ", "a\n\nb", "it's  don't 123 456\t\tx", "ça va? ok\n", "日本語 テスト 🙂🙂 x", "foo.\nBar", "foo.\n\nBar\n", "\n", "a\x1cb c", "İstanbul ΑΣ Σ éx", "a" * 300, " " * 50 + "z", "!!! ??", "x\r\ny  \n z", "\x00 \x00a", "<|endoftext|> end", "a<|endoftext|>", "x <|endoftext|><|startoftext|> y", "<|ENDOFTEXT|> <|endoftext |>", "pre<|startoftext|>post  z", "é ́a"]


@pytest.fixture(scope="module")
def libraries():
    ranks = bpe.read_ranks(MULTI)
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = []
    for path in (PLAIN, WORDY):
        t = Tokenizer.from_file(path)
        own.append(lambda x, t=t: t.encode(x, add_special_tokens=False).ids)
    segments = [tokens.SpacedSegments(bpe.PieceEncoder(ranks, P.PATTERN), 50), tokens.SpacedSegments(tokens.LibraryEncoder(tokens.read_text(PLAIN)), 50), tokens.WordSegments(tokens.LibraryEncoder(tokens.read_text(WORDY)), 50)]
    return list(zip([tik.encode_ordinary, *own], segments))


def same(libraries, text):
    for library, mine in libraries:
        assert np.frombuffer(mine.ids(text), "<u2").tolist() == library(text), text


@pytest.mark.parametrize("text", TEXTS)
def test_awkward_texts(libraries, text):
    same(libraries, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "Thnt", " ", "  ", "\n", "\t", ".", ",", "'s", "12", "é", "日", "🙂", " ", " ", "A", "!!", "-", "ß", "İ", "\x1d", "<|endoftext|>", "<|startoftext|>"]), max_size=14).map("".join))
def test_random_texts(libraries, text):
    same(libraries, text)


def test_many_texts_at_once(libraries):
    texts = [*TEXTS, "", " ", "the end.", " the end", "the end ", "the\tend of\x85it", "the\x1fend", "İ the end. The end!"] * 2
    for library, mine in libraries:
        assert [np.frombuffer(x, "<u2").tolist() for x in mine.many(texts)] == [library(x) for x in texts]
        assert mine.many([]) == []


def test_words_are_asked_for_once_and_stops_not_kept():
    asked = []

    class Encoder(tokens.LibraryEncoder):
        def __call__(self, segment):
            asked.append(segment.strip())
            return super().__call__(segment)

    for cls, path in ((tokens.SpacedSegments, PLAIN), (tokens.WordSegments, WORDY)):
        asked.clear()
        one = cls(Encoder(tokens.read_text(path)))
        one.many(["x word, word. word! word"] * 3)
        assert sorted(asked) == sorted(["x", "word", ",", ".", "!"])
        memo = one.after_space if cls is tokens.SpacedSegments else one.memo
        assert "word" in memo and "word." not in memo


def test_runs_of_stops_and_lines_spare_words(libraries):
    asked = []

    class Encoder(tokens.LibraryEncoder):
        def __call__(self, segment):
            asked.append(segment)
            return super().__call__(segment)

    one = tokens.SpacedSegments(Encoder(tokens.read_text(PLAIN)))
    one.many(["x wörd$$$ wörd!! wörd\nx wörd.\nx", "x wörd$$$"])
    assert sorted(asked) == sorted(["x", " wörd", "$$$", "!!", ".", "\n"])
    texts = ["İ. x İ.", "\u0958. \u0958!!", "wörd$$$ a_ _ a__! don't''s a'\nsmith 'tis.\n\nx", "a\nb", "\na b", "a b\n", "\n", "a b ", " a\nb&& c", "x-y's'' z\"'\nre é!!\n$$ q"]
    for library, mine in libraries:
        assert [np.frombuffer(x, "<u2").tolist() for x in mine.many(texts)] == [library(x) for x in texts]


def test_backtracking_is_bpe_on_random_bytes():
    ranks = bpe.read_ranks(MULTI)
    tik = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    b, rnd = bpe.Backtracker(ranks, 1000), random.Random(1)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdeot hinrsÉé日") for _ in range(rnd.randrange(1, 60)))
        assert b.encode(piece.encode()) == tik.encode_ordinary(piece)


def test_encode_decode(spark, odd, nothing):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    want = []
    for r in odd.collect():
        ids = ref.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(odd, MULTI, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encode_decode(nothing, MULTI, P.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc_of_two_parts(a, b):
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_cuts_cover_and_shift():
    ids = np.random.default_rng(1).integers(0, 50000, 30000).astype(np.uint16)
    ends = token_store.cut(ids)
    assert ends[-1] == len(ids) and all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends)) and len(ends) > 20
    moved = token_store.cut(np.concatenate([ids[:7], ids]))
    assert len({e - 7 for e in moved} & set(ends)) > 0.8 * len(ends)
    assert token_store.cut(np.zeros(20000, np.uint16))[-1] == 20000 and token_store.cut(ids[:0]) == []


def test_store(spark, odd, nothing, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd.repartition(3), path, PLAIN)
    t = Tokenizer.from_file(PLAIN)
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "") for r in odd.collect())
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r["start"])
    assert all(r["verified"] for r in got) and len(got) == len(rows)
    by = defaultdict(list)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        by[r["doc_id"] is None, r["doc_id"] or 0].append((r["n_tokens"], r["ids_crc32"]))
    assert [k for k, _ in rows] == [(r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    want = defaultdict(list)
    for k, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[k].append((len(ids), zlib.crc32(ids.tobytes())))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert sum(r["n_tokens"] for r in spark.read.parquet(f"{path}/manifest").collect()) == at
    back = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).where("doc_id = 8").collect()}
    assert back[8][:-1] == t.encode(dict((k[1], x) for k, x in rows if not k[0])[8], add_special_tokens=False).ids
    token_store.write_store(nothing, f"{path}-none", PLAIN)
    assert token_store.read_store(spark, f"{path}-none").collect() == []


def test_a_changed_chunk_is_noticed(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd.where("doc_id = 8"), path, PLAIN)
    chunks = spark.createDataFrame(spark.read.parquet(f"{path}/chunks").collect(), "digest binary, n long, body binary")
    from pyspark.sql import functions as F

    chunks.withColumn("body", F.concat(F.unhex(F.lit("0100")), F.col("body").substr(3, 1 << 20))).write.mode("overwrite").parquet(f"{path}/chunks")
    assert not token_store.read_store(spark, path).first()["verified"]


def test_lost_recipes_chunks_and_other_manifests_are_noticed(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd, path, PLAIN)

    def put(name, keep):
        df = spark.read.parquet(f"{path}/{name}")
        rows, schema = df.collect(), df.schema
        spark.createDataFrame(keep(rows), schema).write.mode("overwrite").parquet(f"{path}/{name}")
        return lambda: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}")

    undo = put("recipes", lambda rows: rows[1:])
    with pytest.raises(ValueError):
        token_store.read_store(spark, path)
    undo()
    undo = put("manifest", lambda rows: [(r["part"], r["n_docs"], r["n_tokens"], bytes(32)) for r in rows])
    assert not any(r["verified"] for r in token_store.read_store(spark, path).collect())
    undo()
    assert all(r["verified"] for r in token_store.read_store(spark, path).collect())
    put("chunks", lambda rows: [])
    got = token_store.read_store(spark, path).collect()
    assert len(got) == odd.count() and not any(r["verified"] for r in got)


def test_packing_leaves_nothing_in_the_workers(spark):
    from kvloom.llm import common

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._made)], pa.int64())], names=["n"])

    docs = spark.createDataFrame([(i, f"word {i}") for i in range(16)], "doc_id long, text string").repartition(4)
    for keep in (True, False):
        assert packing.pack(docs, WORDY, keep=keep).count() == 16
    assert {r["n"] for r in spark.range(0, 64, 1, 4).mapInArrow(held, "n long").collect()} == {0}


def test_packing(spark, odd, nothing):
    t = Tokenizer.from_file(WORDY)
    rnd = random.Random(2)
    more = spark.createDataFrame([(100 + i, " ".join(rnd.choice("some words of all kinds here".split()) for _ in range(rnd.randrange(0, 900)))) for i in range(200)], "doc_id long, text string")
    docs = odd.where("doc_id is not null and doc_id <> 5").select("doc_id", "text").union(more).repartition(5)
    rows = packing.pack(docs, WORDY, size=256, open_windows=8, least_cut=4).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    total = 0
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    padded = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        want = at if at & (at - 1) == 0 else 256
        assert at <= 256 and {p["sequence_length"] for p in ps} == {want}
        padded += want
    assert padded < 1.05 * total
    assert packing.pack(nothing, WORDY).collect() == []
    assert packing.pack(odd, WORDY).count() >= odd.count()
