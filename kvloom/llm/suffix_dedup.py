"""Removal of repeated passages: every byte that a `least`-byte string covers which also starts elsewhere.

1. Each text's K-byte strings get polynomial hashes (from prefix hashes); of each `least`-byte window the K-byte
   string of smallest hash is its anchor. Equal windows have equal anchors at equal places, so two equal windows
   always meet at an anchor that occurs twice. Anchors are about 2 / (least - K + 2) of all positions.
2. An anchor's context is all bytes of windows that contain it. Contexts that occur twice, as 128-bit digests of
   their bytes tell, are removed whole; their number is combined before the shuffle, however many copies there are.
3. Other contexts of an anchor that occurs twice are suffix-sorted, forward from the anchor and backward from
   it: a mergesort whose comparisons find the common extension by binary search over prefix hashes. Every sorted
   neighbour pair is then checked byte by byte, and rows are sorted anew by their bytes if a hash misled.
4. Of the two orders and their common extensions follow the windows at each place that are equal to another's.
5. An anchor with more contexts than a task takes is divided by what equal windows share: those that start lo to hi
   bytes before the anchor share lo bytes before it and least - hi from it on. The range of starts is halved and
   contexts part by those bytes, until a group is small enough or a single window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import Powers, blocks, drop, mix64, numbered, parts, scratch, small, stored, texts_of

LEAST, K = 200, 64
#: Different contexts of one anchor that are sorted together; an anchor with more is divided by the bytes its windows share.
SORTED = 20_000
BASE = 0xD1342543DE82EF95
_POWERS = Powers(BASE)
_POS = np.uint64((1 << 24) - 1)


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * BASE**i up to each position, and the inverse powers; modulo 2**64."""
    up, down = _POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return total, down


def span_hash(total, down, start, end):
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(texts: list[bytes], least: int = LEAST, k: int = K):
    """For each run of texts: index of the text, place in it, anchor hash, context digest (two int64), bytes before and from the place on."""
    width = least - k + 1
    for first, part in blocks(texts, 1 << 20):
        sizes = np.array([len(t) for t in part])
        if not (sizes >= least).any():
            continue
        buf = np.frombuffer(b"".join(part), np.uint8)
        total, down = prefix_hashes(buf)
        starts = np.cumsum(np.append(0, sizes))
        n = len(buf) - k + 1
        h = span_hash(total, down, np.arange(n), np.arange(k, n + k))
        m = len(buf) - least + 1
        inside = np.zeros(len(buf) + 1, bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= least:
                inside[a : b - least + 1] = True
        at = _smallest(h, inside[:m], width)
        doc = np.searchsorted(starts, at, side="right") - 1
        lo = np.maximum(starts[doc], at - (least - k))
        hi = np.minimum(starts[doc + 1], at + least)
        raw = memoryview(buf)
        # contexts are equal if their bytes and the anchor's place in them are
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, salt=n.to_bytes(2, "little")).digest() for a, b, n in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())])
        yield first + doc, at - starts[doc], h[at], np.frombuffer(digests, np.int64).reshape(-1, 2), at - lo, hi - at


def _smallest(h: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost smallest hash, by its upper bits, of each window of `width` places that starts inside.

    Windows are looked at in slices whose places fit the place bits, so a run of any length gives the same.
    """
    found = []
    step = int(_POS) + 1 - width
    for first in range(0, len(inside), step):
        wanted = inside[first : first + step]
        m = len(wanted)
        n = m + width - 1
        grid = np.full(-(-n // width) * width + width, ~np.uint64(0))
        grid[:n] = (h[first : first + n] & ~_POS) | np.arange(n, dtype=np.uint64)
        grid = grid.reshape(-1, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(right[:m], left[width - 1 : width - 1 + m])
        found.append(first + np.unique((low & _POS)[wanted]).astype(np.int64))
    return np.unique(np.concatenate(found))


def anchor_table(docs: DataFrame, least: int, k: int) -> DataFrame:
    """(row, place, anchor, context, context2, before, after) of every anchor."""
    schema = "row long, place int, anchor long, context long, context2 long, before int, after int"

    def run(batches):
        for batch in parts(batches):
            rows = batch.column(0).to_numpy()
            for doc, place, anchor, context, before, after in anchors(texts_of(batch), least, k):
                columns = (rows[doc], place.astype(np.int32), anchor.astype(np.int64), context[:, 0], context[:, 1], before.astype(np.int32), after.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("row", "text").mapInArrow(run, schema)


def _extension(total, down, width, a, b):
    """Length of the common prefix of rows a and b, by binary search over their prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), width)
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = total[a, mid] == total[b, mid]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes (uint16, 256 ends a text) within each group, and common prefixes of neighbours.

    Bottom-up mergesort: groups are contiguous; all merges of a level run at once, each element finding its rank
    in the other half by binary search, each comparison a binary search for the common extension.
    """
    n, width = rows.shape
    up, down = _POWERS.get(width + 1)
    total = np.zeros((n, width + 1), np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=total[:, 1:])

    def less(a, b, or_equal):
        """rows[a] < rows[b], or <= where or_equal."""
        at = _extension(total, down, width, a, b)
        end = at == width
        at = np.minimum(at, width - 1)
        return np.where(end, or_equal, rows[a, at] < rows[b, at])

    order = np.arange(n)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, n))
    start_of, size_of = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    half = 1
    while half < (sizes.max() if n else 0):
        live = np.flatnonzero(size_of > half)
        inside = live - start_of[live]
        pair = inside // (2 * half) * (2 * half)
        mid = np.minimum(pair + half, size_of[live])
        end = np.minimum(pair + 2 * half, size_of[live])
        left = inside < mid
        low = np.where(left, mid, pair) + start_of[live]
        base = low.copy()
        high = np.where(left, end, mid) + start_of[live]
        me = order[live]
        while (open_ := np.flatnonzero(low < high)).size:
            at = (low[open_] + high[open_]) >> 1
            # an element of the left half goes before equals of the right half
            before = less(order[at], me[open_], ~left[open_])
            low[open_[before]] = at[before] + 1
            high[open_[~before]] = at[~before]
        target = pair + start_of[live] + np.where(left, inside - pair, inside - mid) + (low - base)
        order[target] = me
        half *= 2
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = rows[a] != rows[b]
        at = np.where(differ.any(1), differ.argmax(1), width)
        same_group = group[1:] == group[:-1]
        end = np.minimum(at, width - 1)
        if (same_group & (at < width) & (rows[a, end] > rows[b, end])).any():  # a hash misled the sort
            order = np.lexsort((*(rows[:, c] for c in range(width - 1, -1, -1)), group))
            a, b = order[:-1], order[1:]
            differ = rows[a] != rows[b]
            at = np.where(differ.any(1), differ.argmax(1), width)
        shared[1:] = np.where(same_group, at, 0)
    return order, shared


def repeated_windows(contexts: list[bytes], before: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, bytes before the anchor: lo to hi) of each window that another context of the group holds at the same place.

    Two orders tell it: with i bytes before the anchor two windows are equal if their contexts share i bytes
    backward and least - i forward. Runs of such neighbours are numbered in both orders; equal pairs of numbers
    are equal windows.
    """
    n, back = len(contexts), least - k
    fore, rear = np.full((n, least), 256, np.uint16), np.full((n, max(1, back)), 256, np.uint16)
    sizes = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(sizes)
    after = sizes - before
    cols = np.arange(least)
    ok = cols[None] < after[:, None]
    fore[ok] = flat[((ends - after)[:, None] + cols[None])[ok]]
    cols = np.arange(back)
    ok = cols[None] < before[:, None]
    rear[:, :back][ok] = flat[((ends - after - 1)[:, None] - cols[None])[ok]]
    order_f, shared_f = suffix_sort(fore, group)
    order_b, shared_b = suffix_sort(rear, group)
    found_at, found_i = [], []
    number_f, number_b = np.empty(n, np.int64), np.empty(n, np.int64)
    new_group = np.append(True, group[1:] != group[:-1])
    for i in range(back + 1):
        # a window with i bytes before must lie inside the context
        fits = (before >= i) & (after >= least - i) & (lo <= i) & (i <= hi)
        if not fits.any():
            continue
        number_f[order_f] = np.cumsum((shared_f < least - i) | new_group)
        number_b[order_b] = np.cumsum((shared_b < i) | new_group)
        some = np.flatnonzero(fits)
        pair = number_f[some] * np.int64(n + 1) + number_b[some]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = some[count[inverse] > 1]
        found_at.append(hit)
        found_i.append(np.full(len(hit), i))
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_i)


def sorted_spans(contexts: DataFrame, least: int, k: int) -> DataFrame:
    """(row, start, end): spans of bytes in windows that repeat, from contexts in groups of at least two."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["group", "lo", "row", "place"], ignore_index=True)
        group = np.cumsum(np.append(False, (np.diff(pdf["group"].to_numpy()) != 0) | (np.diff(pdf["lo"].to_numpy()) != 0)))
        lo, hi = (pdf[c].to_numpy() for c in ("lo", "hi"))
        at, i = repeated_windows(pdf["bytes"].tolist(), pdf["before"].to_numpy().astype(np.int64), group, lo, hi, least, k)
        row, start = pdf["row"].to_numpy()[at], pdf["place"].to_numpy()[at] - i
        order = np.lexsort((start, row))
        at, row, start = at[order], row[order], start[order]
        first = np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + least))[: len(row)]
        last = np.append(first[1:], True)[: len(row)]
        return pd.DataFrame({"row": row[first], "start": start[first], "end": start[last] + least}).astype({"row": "int64", "start": "int32", "end": "int32"})

    return contexts.groupBy("bucket").applyInPandas(run, "row long, start int, end int")


def halved(contexts: DataFrame, least: int) -> DataFrame:
    """Contexts in groups by each half of their range of starts and the bytes that its equal windows share."""
    schema = "row long, place int, before int, bytes binary, group long, lo int, hi int"

    def run(batches):
        for batch in batches:
            rows = []
            for row, place, before, text, group, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if before >= a and len(text) - before >= least - b:
                        shared = hashlib.blake2b(text[before - a : before + least - b], digest_size=8, key=(group % (1 << 64)).to_bytes(8, "little"), salt=a.to_bytes(2, "little")).digest()
                        rows.append((row, place, before, text, int.from_bytes(shared, "little", signed=True), a, b))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[c.split()[0] for c in schema.split(", ")])

    return contexts.select("row", "place", "before", "bytes", "group", "lo", "hi").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most: int = SORTED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as `kept` if with_text) of each row.

    A byte is removed if a string of `least` bytes that covers it also starts anywhere else, in the same or any
    other row; strings never cross rows and are judged on the input. n_spans counts maximal removed runs.
    Null text counts as empty. Rows without id, repeated rows and rows with one id are rows of their own, so the
    copies of a long row are removed whole; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "suffix_dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = numbered(docs, "doc_id", "row", f"{path}/rows")
    keyed = docs.withColumn("row", F.col("doc_id")) if rows is None else rows
    table = stored(anchor_table(keyed, least, k), f"{path}/anchors")

    # small sides are written before they are joined, so that a frequent anchor's rows may be split
    kind = ["anchor", "context", "context2"]
    ends = F.struct("context", "context2")
    repeated = table.groupBy("anchor").agg(F.count("*").alias("n"), F.min(ends).alias("a"), F.max(ends).alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("several"))
    twice = stored(table.join(stored(repeated, f"{path}/repeated"), "anchor"), f"{path}/twice")
    drop(spark, f"{path}/anchors", f"{path}/repeated")
    alike = twice.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"), F.max("several").alias("several"), F.first("before").alias("before"), F.first("after").alias("after"))
    alike = stored(alike, f"{path}/alike")
    whole = twice.join(stored(alike.where("n > 1").select(*kind), f"{path}/copies"), kind).where(f"before + after >= {least}").select("row", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end"))

    # one context of each kind, of anchors that have several kinds, cut from its text
    wanted = alike.where("several").select(F.col("one.row").alias("row"), F.col("one.place").alias("place"), "anchor", "before", "after")
    wanted = stored(wanted.groupBy("row").agg(F.collect_list(F.struct("place", "anchor", "before", "after")).alias("cuts")), f"{path}/wanted")

    def cut(batches):
        for batch in batches:
            rows = []
            for row, text, cuts in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                rows += [(row, c["place"], c["anchor"], c["before"], text[c["place"] - c["before"] : c["place"] + c["after"]]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["row", "place", "anchor", "before", "bytes"])

    contexts = keyed.join(wanted, "row").select("row", "text", "cuts").mapInArrow(cut, "row long, place int, anchor long, before int, bytes binary")
    contexts = contexts.select("row", "place", "before", "bytes", F.col("anchor").alias("group"), F.lit(0).alias("lo"), F.lit(least - k).alias("hi"))
    counts = alike.where("several").groupBy(F.col("anchor").alias("group"), F.lit(0).alias("lo")).count()
    total, level = alike.where("several").count(), 0
    small_ones: list[DataFrame] = []
    while not (many := stored(counts.where(f"count > {most}").select("group", "lo"), f"{path}/many{level}")).isEmpty():
        contexts = stored(contexts, f"{path}/contexts{level}")
        large = contexts.join(many, ["group", "lo"])
        # all of a group of one window are equal; other large groups are divided
        whole = whole.union(large.where("lo = hi").select("row", (F.col("place") - F.col("lo")).alias("start"), (F.col("place") - F.col("lo") + least).alias("end")))
        small_ones.append(contexts.join(many, ["group", "lo"], "left_anti"))
        level += 1
        contexts = stored(halved(large.where("lo < hi"), least), f"{path}/halves{level}")
        counts = contexts.groupBy("group", "lo").count()
        contexts = contexts.join(stored(counts.where("count > 1").select("group", "lo"), f"{path}/pairs{level}"), ["group", "lo"])
        total += contexts.count()
    for part in small_ones:
        contexts = contexts.union(part.select(contexts.columns))
    buckets = max(8, total // 20_000 + 1)
    spans = sorted_spans(contexts.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))), least, k)
    spans = stored(whole.union(spans).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), f"{path}/spans")
    drop(spark, f"{path}/twice", f"{path}/alike", f"{path}/wanted")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def kept(batches):
        for batch in parts(batches):
            rows = []
            for key, text, spans in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist()):
                pieces, at, n = [], 0, 0
                for s in spans or ():
                    if s["start"] > at or n == 0:
                        n += 1
                        pieces.append(text[at : s["start"]])
                    at = max(at, s["end"])
                pieces.append(text[at:])
                left = b"".join(pieces)
                rows.append((key, len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest(), left)[: 5 + with_text])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=[c.split()[0] for c in schema.split(", ")])

    return keyed.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(kept, schema)

