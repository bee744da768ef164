"""Exact set-similarity join of documents by Jaccard over word shingles, with set-relation skipping.

1. Documents with the same shingle set collapse to one node (its copies are linked by definition).
2. Shingles get one total order, estimated-frequent ones last (a merged sketch of all shingles; any order gives
   the same result, this one keeps common shingles out of prefixes). Each node lists its prefix with the positions:
   sets with Jaccard >= t share a shingle of both prefixes, so no link is lost.
3. Index lists are built per shingle and hold (set, size, position); lists with the same members are one list.
4. Members are compared with leaders of their lists, those that stay outside a list's largest component also with
   some of its members. The overlaps found are kept: they are the leaders' answers.
5. Only pairs that are still in different components are looked at. A list's members lie in blocks of equal size
   and position; pairs of blocks whose sizes and positions rule the threshold out are skipped whole. What a
   leader's answers say of two members (bounds of their overlap from both overlaps with it) settles most other
   pairs, parity bitmaps some more, and the rest is compared exactly. First come the likeliest pairs that would
   join the components, then, with the components these make, all pairs that are left.
6. A long list in which many members lie outside the largest component is refined first: members move on to lists
   by their next common shingle, up to LEVELS shingles. In a long list with few such members each of them meets
   slices of the others, so that no list is paired with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import blocks, collected, components, drop, forget, mix64, numbered, parts, scratch, small, stored, texts_of

WORDS = 5
#: Log2 of the counters of the frequency sketch; prefix shingles a bucket of the index holds on average.
SKETCH_BITS, BUCKET = 21, 100_000
#: Bytes of list members that a task pairs on average; pairs of them looked at together; words of bitmaps together.
TASK_BYTES, TOGETHER, WORDS_TOGETHER = 4 << 20, 1 << 17, 1 << 19
#: Members of a list that are paired with each other in one task; longer lists are dealt out in such blocks.
BLOCK = 512
#: Members outside a long list's largest component that may meet all slices of it; lists with more are refined.
FEW, LEVELS = 32, 3
#: Leaders that a member is compared with at most before all other pairs are looked at; members of the largest
#: component that those outside it are held against in each list, and how many times.
STARS, HEADS, ROUNDS = 2, 4, 2
#: Families of hashes tried until no two sets share a signature.
SEEDS = 8
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CLASS = np.uint64(59)


def pieces(text: bytes, most: int = 1 << 18):
    """A text cut at white space into pieces of about `most` bytes."""
    at = 0
    while len(text) - at > most and (gap := _GAP.search(text, at + most)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def hashed_words(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keyed 64-bit hashes (SipHash) of the lower-cased words of some texts, and where each text's begin."""
    from pandas.util import hash_array

    hashes, counts, held = [np.empty(0, np.uint64)], [0], []

    def flush():
        row = np.empty(len(held), object)
        row[:] = held
        hashes.append(hash_array(row, hash_key=f"{seed:016d}", categorize=False))
        held.clear()

    for text in texts:
        count = 0
        for piece in pieces(text):
            words = piece.lower().split()
            count += len(words)
            held += words
            if len(held) > 1 << 15:
                flush()
        counts.append(count)
    flush()
    return np.concatenate(hashes), np.cumsum(counts)


def shingle_sets(texts: list[bytes], seed: int = 0, words: int = WORDS):
    """For each text the sorted distinct 64-bit hashes of its shingles (its whole word sequence if it has fewer words)."""
    for _, part in blocks(texts, 1 << 18):
        word, first = hashed_words(part, seed)
        rolled = word[: max(0, len(word) - words + 1)].copy()
        for j in range(1, words):
            rolled = mix64(rolled * _STEP + word[j : j + len(rolled)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                one = np.sort(rolled[a : b - words + 1])
                keep = np.ones(len(one), bool)
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                yield one[keep]
            elif b > a:
                h = np.array([b - a], np.uint64)
                for at in range(a, b):
                    h = mix64(h * _STEP + word[at : at + 1])
                yield h
            else:
                yield np.empty(0, np.uint64)


def signature(one: np.ndarray) -> int:
    return int(mix64(mix64(one).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(one)))[0].astype(np.int64))


def least_shared(n, num: int, den: int):
    """Shingles that a set of n must share with any set it links with."""
    return -(-num * n // den)


def bitmap(one: np.ndarray) -> bytes:
    """Parity bitmap: each hash flips a bit; at least a bit a hash. Halves of a longer one fold by xor."""
    bits = max(64, 1 << max(0, len(one) - 1).bit_length())
    return np.packbits(np.bincount((one >> np.uint64(8)) & np.uint64(bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, n: int) -> np.ndarray:
    """Rows of bitmap words folded to n words."""
    while bits.shape[1] > n:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def first_pass(docs: DataFrame, seed: int) -> DataFrame:
    """Per document its set's size and two 64-bit signatures; per task the slices of its frequency sketch."""
    schema = "doc_id long, n long, sig long, sig2 long, bits binary, slice int, counts binary"

    def run(batches):
        forget()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in parts(batches):
            n, sig, sig2, bits = [], [], [], []
            for one in shingle_sets(texts_of(batch), seed):
                at = one & np.uint64(len(sketch) - 1)
                sketch[at] += sketch[at] < 255  # held at 255, which is frequent anyway
                n.append(len(one))
                sig.append(signature(one))
                sig2.append(mix64(one ^ _STEP).sum(dtype=np.uint64).astype(np.int64))
                bits.append(bitmap(one))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((batch.column(0).to_pylist(), n, sig, sig2, bits, none, none), types)], names=names)
        none = [None] * 64
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, none, range(64), [s.tobytes() for s in sketch.reshape(64, -1)]), types)], names=names)

    return docs.mapInArrow(run, schema)


def merged_sketch(slices: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: a fixed 2**SKETCH_BITS counters whatever the input."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c in b.column(1).to_pylist():
                one = np.frombuffer(c, np.uint8).astype(np.uint64)
                total = one if total is None else total + one
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    got = slices.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    if not got:
        return np.zeros(1 << SKETCH_BITS, np.uint64)
    return np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in sorted(got, key=lambda r: r["slice"])])


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """0 for shingles that aren't known to be frequent, else one more with each doubling."""
    classes = np.zeros(len(sketch), np.uint64)
    mean = float(sketch.mean())
    unit = mean + 5 * mean**0.5 + 4  # what rare shingles that share a counter rarely reach
    heavy = sketch > unit
    classes[heavy] = np.floor(np.log2(sketch[heavy] / unit)).astype(np.uint64) + np.uint64(1)
    return np.minimum(classes, 31).astype(np.uint8)


def in_order(one: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's shingles in the common order, frequent ones last."""
    return np.sort(classes[one & np.uint64(len(classes) - 1)].astype(np.uint64) << _CLASS | one >> np.uint64(5))


def prefixes(docs: DataFrame, seed: int, classes, buckets: int, num: int, den: int) -> DataFrame:
    """Prefix shingles with node, size and position, packed per bucket: (bucket, tokens, sigs, sizes, places) as binary arrays."""
    names = ["bucket", "tokens", "sigs", "sizes", "places"]

    def run(batches):
        def flush():
            tok, sig, size, place = (np.concatenate(x) for x in zip(*held))
            salt = np.where(tok >> _CLASS > 0, sig.astype(np.uint64), np.uint64(0))  # a frequent shingle goes to many buckets
            to = (mix64(tok + mix64(salt)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(to[order])) + 1, len(order))
            cuts = [order[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            return pa.RecordBatch.from_arrays([pa.array([int(to[c[0]]) for c in cuts], pa.int32()), *(pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (tok, sig, size, place))], names=names)

        forget()
        held, seen, many = [], set(), 0
        for batch in parts(batches):
            for one in shingle_sets(texts_of(batch), seed):
                if not (n := len(one)) or (sig := signature(one)) in seen:
                    continue
                seen.add(sig)
                p = int(n - least_shared(n, num, den) + 1)
                held.append((in_order(one, classes.value)[:p], np.full(p, sig), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
                many += p
                if many > 1 << 18:
                    yield flush()
                    held, seen, many = [], set(), 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, tokens binary, sigs binary, sizes binary, places binary")


def index_lists(packed: DataFrame) -> DataFrame:
    """(list, sig, n, pos): members of index lists with two members or more. Frequent shingles' members pass through, list by list."""

    def run(pdf):
        import pandas as pd

        kinds = (("tokens", np.uint64), ("sigs", np.int64), ("sizes", np.int32), ("places", np.int32))
        tok, sig, size, place = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in kinds)
        order = np.lexsort((sig, tok))
        tok, sig, size, place = tok[order], sig[order], size[order], place[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        tok, sig, size, place = tok[keep], sig[keep], size[keep], place[keep]
        frequent = tok >> _CLASS > 0
        starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        count = np.diff(np.append(starts, len(tok)))
        members = np.add.reduceat(mix64(sig.astype(np.uint64)), starts)
        # lists of the same members are one list, that of the first shingle in order
        name = np.where(frequent[starts], tok[starts], mix64(members + count.astype(np.uint64)))
        first = np.zeros(len(starts), bool)
        first[np.unique(name, return_index=True)[1]] = True
        wanted = np.repeat((first & (count > 1)) | frequent[starts], count)
        return pd.DataFrame({"list": np.repeat(name, count)[wanted].astype(np.int64), "sig": sig[wanted], "n": size[wanted].astype(np.int64), "pos": place[wanted].astype(np.int64)})

    return packed.groupBy("bucket").applyInPandas(run, "list long, sig long, n long, pos long")


def likely(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most Jaccard that the parity bitmaps allow pairs of rows (i, j), -1 where it is below num / den."""
    width = np.array([len(b) // 8 for b in bits])
    least = np.minimum(width[i], width[j])
    score = np.full(len(i), -1.0)
    for w in np.unique(least).tolist():
        some = np.flatnonzero(least == w)
        rows = np.unique(np.concatenate([i[some], j[some]]))
        folded = np.empty((len(rows), w), np.uint64)
        for wide in np.unique(width[rows]):
            own = np.flatnonzero(width[rows] == wide)
            step = max(1, WORDS_TOGETHER // int(wide))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                folded[part] = fold(np.frombuffer(b"".join(bits[r] for r in rows[part]), np.uint64).reshape(len(part), wide), w)
        step = max(1, WORDS_TOGETHER // w)
        for at in range(0, len(some), step):
            part = some[at : at + step]
            differ = np.bitwise_count(folded[np.searchsorted(rows, i[part])] ^ folded[np.searchsorted(rows, j[part])]).sum(1, dtype=np.int64)
            # |x and y| <= (|x| + |y| - differ) / 2
            total = n[i[part]] + n[j[part]]
            overlap = (total - differ) // 2
            score[part] = np.where(den * overlap >= num * (total - overlap), overlap / np.maximum(total - overlap, 1), -1.0)
    return score


def derived(n: np.ndarray, shared: list[np.ndarray], sizes: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the leaders' answers leave pairs of members (i, j) a link, and whether they prove one.

    shared: overlaps of members with each leader (-1: not known), sizes: the leaders' sizes. Of two sets that share
    s and t shingles with a leader of size m, what they share lies in s + t - m .. min(s, t) + min(rest of each).
    """
    possible, proven = np.ones(len(i), bool), np.zeros(len(i), bool)
    need = num * (n[i] + n[j])
    for s, m in zip(shared, sizes):
        x, y = s[i], s[j]
        known = (x >= 0) & (y >= 0)
        most = np.minimum(x, y) + np.minimum(n[i] - x, n[j] - y)
        possible &= ~known | ((num + den) * most >= need)
        proven |= known & ((num + den) * (x + y - m[i]) >= need)
    return possible, proven


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indexes of edges (a, b) that join different classes, best scores first, without a circle.

    label holds the class of each node and is brought up to date: each round every class takes its best edge.
    """
    order = np.argsort(-score, kind="stable")
    live, chosen = np.arange(len(order)), []
    while True:
        x, y = label[a[order[live]]], label[b[order[live]]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return order[np.array(chosen, np.int64)]
        best = np.full(len(label), len(order))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        parent = list(range(len(label)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for e in np.unique(best[best < len(order)]).tolist():
            p, q = root(int(label[a[order[e]]])), root(int(label[b[order[e]]]))
            if p != q:
                parent[p] = q
                chosen.append(e)
        to = np.array(parent)
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def expanded(count: np.ndarray, at: int, till: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, 0 .. count[k] - 1) for k from `at` to `till`."""
    some = count[at:till]
    k = np.repeat(np.arange(at, till), some)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(some) - some, some)


def slices_of(count: np.ndarray, most: int):
    """Runs of consecutive k whose counts sum to about `most`."""
    sums, at = np.cumsum(count), 0
    while at < len(count):
        till = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        yield at, till
        at = till


def feasible_pairs(group: np.ndarray, n: np.ndarray, pos: np.ndarray, depth: np.ndarray, num: int, den: int):
    """Pairs of rows (i, j) of a group whose sizes and positions allow a link, a slice at a time.

    Rows come in order of group, n and pos. Those equal in all three are a block: blocks are held against each
    other first, from each the run of blocks of the sizes that can reach the threshold, and pairs of blocks whose
    positions leave too few shingles are skipped without a look at their members.
    """
    if not len(n):
        return
    head = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])))
    size = np.diff(np.append(head, len(n)))
    bn, rest, d = n[head], n[head] - 1 - pos[head], depth[head]
    wide = int(n.max()) + 1
    at = group[head] * wide
    stop = np.searchsorted(at + bn, at + np.minimum(bn * den // num, wide - 1), side="right")
    count = stop - np.arange(len(head))
    for lo, hi in slices_of(count, TOGETHER):
        p, q = expanded(count, lo, hi)
        q += p
        fits = (num + den) * (d[p] + np.minimum(rest[p], rest[q])) >= num * (bn[p] + bn[q])
        p, q = p[fits], q[fits]
        many = size[p] * size[q]
        for a, b in slices_of(many, TOGETHER):
            k, m = expanded(many, a, b)
            i, j = head[p[k]] + m // size[q[k]], head[q[k]] + m % size[q[k]]
            keep = i < j
            yield i[keep], j[keep]


def cross_pairs(rows: DataFrame, bits: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """(a, b, proven): pairs within a list that lie in different components and that nothing known rules out.

    If not `whole`, of those that a task sees only a spanning forest of the components, likeliest pairs first: as
    many rows as a task has members at most. If these turn out to be links, the others need not be looked at.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["list", "lo", "hi", "n", "pos", "sig"], ignore_index=True)
        n, comp, sig, own, lo, hi, name, pos, depth = (pdf[c].to_numpy() for c in ("n", "comp", "sig", "own", "lo", "hi", "list", "pos", "depth"))
        few, alone = pdf["few"].to_numpy(), (comp != pdf["top"].to_numpy())
        shared, sizes = ([pdf[f"{c}{k}"].to_numpy() for k in (0, 1)] for c in "om")
        bits = pdf["bits"].tolist()
        group = np.cumsum(np.append(False, (name[1:] != name[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        comp, node = (np.unique(x, return_inverse=True)[1] for x in (comp, sig))
        label = np.arange(int(comp.max()) + 1)
        out = []
        for i, j in feasible_pairs(group, n, pos, depth, num, den):
            # each pair of members in one of the tasks that its list was dealt to
            here = np.where(few[i], ~(alone[i] & alone[j]) | (lo[i] == 0), (lo[i] == hi[i]) | (own[i] != own[j]))
            keep = here & (label[comp[i]] != label[comp[j]])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            possible, proven = derived(n, shared, sizes, i, j, num, den)
            i, j, proven = i[possible], j[possible], proven[possible]
            _, first = np.unique(np.minimum(node[i], node[j]) * len(pdf) + np.maximum(node[i], node[j]), return_index=True)
            i, j, proven = i[first], j[first], proven[first]
            score = likely(n, bits, i, j, num, den)
            i, j, proven, score = (x[score >= 0] for x in (i, j, proven, score))
            if not whole:
                picked = spanning(label, comp[i], comp[j], score + proven)
                i, j, proven = i[picked], j[picked], proven[picked]
            out.append((np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), proven))
        a, b, proven = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return pd.DataFrame({"a": a, "b": b, "proven": proven})

    nb = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.withColumns({"nb": nb, "few": (nb > 1) & (F.col("m") - F.col("most") <= FEW)}).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("nb") - 1)
    to = F.when(F.col("few") & (F.col("comp") == F.col("top")), F.array("own")).when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(everywhere)
    dealt = dealt.withColumn("other", F.explode(to))
    dealt = dealt.withColumns({"lo": F.when(F.col("few"), F.col("other")).otherwise(F.least("own", "other")), "hi": F.when(F.col("few"), F.col("other")).otherwise(F.greatest("own", "other"))})
    held = rows.agg(F.sum(F.col("n") / 4 + 200)).first()[0] or 0
    task = F.pmod(F.xxhash64("list", "lo", "hi"), F.lit(max(8, int(held / TASK_BYTES) + 1)))
    full = dealt.select("list", "lo", "hi", "own", "few", "top", "sig", "n", "pos", "depth", "comp", "o0", "m0", "o1", "m1", task.alias("task")).join(bits, "sig")
    return full.groupBy("task").applyInPandas(run, "a long, b long, proven boolean").groupBy("a", "b").agg(F.max("proven").alias("proven"))


def scored(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, score) of the pairs that sizes and bitmaps allow."""

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            score = likely(n, batch.column(4).to_pylist() + batch.column(5).to_pylist(), np.arange(k), np.arange(k, 2 * k), num, den)
            good = pa.array(score >= 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(good) for i in (0, 1)), pa.array(score).filter(good)], names=["a", "b", "score"])

    left, right = (bits.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long, score double")


def compared(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, shared, link): the pairs' sets compared element by element."""
    left = nodes.select(F.col("sig").alias("a"), F.col("shingles").alias("x"))
    right = nodes.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            shared, link = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                s = int(np.count_nonzero(both[1:] == both[:-1]))
                shared.append(s)
                link.append(den * s >= num * (len(x) + len(y) - s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(link, pa.bool_())], names=["a", "b", "shared", "link"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long, link boolean")


def within_reach(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of mixed lists that some other member's size and position allow a link, with m, most and top of their list.

    With depth shingles shared and r left after its place a member reaches (num + den) * (depth + r) - num * n: a
    partner's num * n must not be above that, nor its own above a partner's reach.
    """
    reach = (num + den) * (F.col("depth") + F.col("n") - 1 - F.col("pos")) - num * F.col("n")
    ends = rows.groupBy("list").agg(F.max(reach).alias("far"), F.min("n").alias("least"))
    near = rows.join(ends, "list").where((F.col("far") >= num * F.col("n")) & (reach >= num * F.col("least"))).drop("far", "least")
    of = near.groupBy("list", "comp").agg(F.count("*").alias("c")).groupBy("list").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("t"))
    mixed = near.join(of.where("m > t.c").select("list", "m", F.col("t.c").alias("most"), F.col("t.comp").alias("top")), "list")
    # members of the largest component meet only those outside it
    alone = mixed.where("comp <> top").groupBy("list").agg(F.max(reach).alias("far"), F.min("n").alias("least"))
    return mixed.join(alone, "list").where((F.col("comp") != F.col("top")) | ((F.col("far") >= num * F.col("n")) & (reach >= num * F.col("least")))).drop("far", "least")


def refined(rows: DataFrame, nodes: DataFrame, classes, num: int, den: int) -> DataFrame:
    """Members of lists by their next common shingle: one row for each shingle after pos that may be it.

    A set of n that shares `depth` shingles meets its next one at n - least_shared + depth at the latest. Rows whose
    set needs no further one stay too, as `ended` rows of their list: any two of them either differ in a further
    shared shingle or are links if their sizes allow.
    """
    wanted = rows.groupBy("sig").agg(F.collect_list(F.struct("list", "pos", "depth", "o0", "m0", "o1", "m1")).alias("at"), F.first("n").alias("n"))
    names = ["list", "sig", "n", "pos", "depth", "o0", "m0", "o1", "m1", "ended"]

    def run(batches):
        for batch in batches:
            for sig, n, at, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                key = in_order(np.frombuffer(one.as_buffer(), np.uint64), classes.value)
                need = int(least_shared(n, num, den))
                for r in at:
                    q = np.arange(r["pos"] + 1, min(n, n - need + r["depth"] + 1))
                    ended = np.zeros(len(q) + (need <= r["depth"]), bool)
                    to = mix64(mix64(np.full(len(q), r["list"]).astype(np.uint64)) + key[q]).astype(np.int64)
                    if need <= r["depth"]:
                        ended[-1], to, q = True, np.append(to, r["list"]), np.append(q, r["pos"])
                    if len(q):
                        same = lambda v: np.full(len(q), v, np.int64)
                        depth = np.where(ended, r["depth"], r["depth"] + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (to, same(sig), same(n), q, depth, *(same(r[c]) for c in ("o0", "m0", "o1", "m1")), ended)], names=names)

    schema = ", ".join(f"{c} {'boolean' if c == 'ended' else 'long'}" for c in names)
    return wanted.join(nodes, "sig").select("sig", "n", "at", "shingles").mapInArrow(run, schema)


def jaccard_classes(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs.

    Sets are the distinct 5-word shingles of the lower-cased (A-Z) words between ASCII white space; a text of
    fewer words is one shingle; an empty or null text has none and links with nothing. Texts link when
    den * |intersection| >= num * |union|. component_id is the smallest id reachable by links, itself included.
    Rows without id take part and get component_id as others do, null if all reachable ids are null; repeated
    rows are copies of each other; other columns are ignored; an empty table gives no rows.
    Links between copies are implied: the join runs over distinct sets.
    """
    path = scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = numbered(docs, "doc_id", "row", f"{path}/rows")
    if rows is None:
        return _classes(docs, num, den, path)
    found = _classes(rows.select(F.col("row").alias("doc_id"), "text"), num, den, path)
    ids = rows.select("row", "doc_id")
    found = found.withColumnsRenamed({"doc_id": "row", "component_id": "least"}).join(ids, "row")
    return found.join(ids.select(F.col("row").alias("least"), F.col("doc_id").alias("component_id")), "least").select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, num: int, den: int, path: str) -> DataFrame:
    """jaccard_classes of (doc_id, text) where each row has an id of its own: texts are read again by it."""
    spark = docs.sparkSession
    for seed in range(SEEDS):
        first = stored(first_pass(docs, seed), f"{path}/first{seed}")
        per_doc = first.where("slice is null").select("doc_id", "n", "sig", "sig2", "bits")
        sets = stored(per_doc.groupBy("sig", "sig2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits")), f"{path}/sets{seed}")
        if sets.groupBy("sig").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"two sets share a signature under each of {SEEDS} families of hashes")
    classes = spark.sparkContext.broadcast(frequency_classes(merged_sketch(first.where("slice is not null").select("slice", "counts"))))
    size = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(size * (den - num) / den / BUCKET) + 1)
    # lists of the same members have one name in all buckets: the first shingle's positions are the smallest ones
    members = index_lists(prefixes(docs.select("doc_id", "text"), seed, classes, buckets, num, den))
    lists = stored(members.groupBy("list", "sig").agg(F.min("n").alias("n"), F.min("pos").alias("pos")), f"{path}/lists")
    bits = sets.select("sig", "n", "bits")

    def sets_again(sigs: DataFrame, name: str) -> DataFrame:
        """(sig, shingles) of some nodes, made anew from their documents' texts; other texts don't move."""
        members = small(stored(sigs.join(sets.select("sig", "doc_id"), "sig"), f"{path}/members_{name}"))

        def run(batches):
            for batch in parts(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(texts_of(batch), seed)], pa.binary())], names=["sig", "shingles"])

        return stored(docs.join(members, "doc_id").select("sig", "text").mapInArrow(run, "sig long, shingles binary"), f"{path}/shingles_{name}")

    def answers(pairs: DataFrame, name: str) -> DataFrame:
        nodes = sets_again(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), name)
        found = stored(compared(pairs.select("a", "b"), nodes, num, den), f"{path}/answers_{name}")
        drop(spark, f"{path}/shingles_{name}", f"{path}/members_{name}")
        collected(spark)
        return found

    # leaders of each list, and of each member's leaders the likeliest ones
    other = F.xxhash64("sig")
    leaders = lists.groupBy("list").agg(F.min(F.struct("sig", "n")).alias("l0"), F.min(F.struct(other.alias("h"), "sig", "n")).alias("l1"))
    leaders = stored(leaders.select("list", *(F.col(f"l{k}.{c}").alias(f"{d}{k}") for k in (0, 1) for c, d in (("sig", "s"), ("n", "m")))), f"{path}/leaders")

    def led(rows: DataFrame, heads: list[Column], most: int, name: str) -> DataFrame:
        """Answers of each member and the likeliest of the heads (struct of s and m) of its lists, `most` of them."""
        pairs = rows.select("sig", "n", F.explode(F.array(*heads)).alias("h")).where(f"h.s <> sig and {num} * greatest(h.m, n) <= {den} * least(h.m, n)")
        likeliest = scored(pairs.select(F.col("h.s").alias("a"), F.col("sig").alias("b")).distinct(), bits, num, den)
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "a"))), 1, most)
        picked = likeliest.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return answers(stored(picked, f"{path}/picked_{name}"), name)

    known = led(lists.join(leaders, "list"), [F.struct(F.col(f"s{k}").alias("s"), F.col(f"m{k}").alias("m")) for k in (0, 1)], STARS, "star")
    links = known.where("link").select("a", "b")
    labels, used = components(links, "jaccard_star")

    def open_rows(rows: DataFrame, name: str) -> DataFrame:
        """Rows that may still join components, each with its component."""
        placed = rows.join(labels.select(F.col("node").alias("sig"), F.col("component").alias("c")), "sig", "left").withColumn("comp", F.coalesce("c", "sig")).drop("c")
        return stored(within_reach(stored(placed, f"{path}/placed_{name}"), num, den), f"{path}/open_{name}")

    now = open_rows(lists.withColumn("depth", F.lit(1).cast("long")), "lists")
    drop(spark, f"{path}/placed_lists")
    for turn in range(ROUNDS):
        # those outside a list's largest component against some of its members
        member = F.struct(F.col("sig").alias("s"), F.col("n").alias("m"))
        heads = now.where("comp = top").groupBy("list").agg(*[F.min_by(member, F.xxhash64(F.lit(HEADS * turn + k), "sig")).alias(f"h{k}") for k in range(HEADS)])
        more = led(now.where("comp <> top").select("list", "sig", "n").join(stored(heads, f"{path}/heads{turn}"), "list"), [F.col(f"h{k}") for k in range(HEADS)], HEADS, f"round{turn}")
        known, new = known.union(more), more.where("link").select("a", "b")
        if new.isEmpty():
            break
        links = links.union(new)
        labels, old = components(links, f"jaccard_round{turn}")
        drop(spark, *used)
        used = old
        now = open_rows(now.select("list", "sig", "n", "pos", "depth"), f"round{turn}")
    known = stored(known.groupBy("a", "b").agg(F.max("shared").alias("shared")), f"{path}/known")
    both = known.select(F.col("a").alias("leader"), F.col("b").alias("sig"), "shared").union(known.select("b", "a", "shared"))
    now = now.join(leaders, "list")
    for k in (0, 1):
        now = now.join(both.withColumnsRenamed({"leader": f"s{k}", "shared": f"o{k}"}), [f"s{k}", "sig"], "left").withColumn(f"o{k}", F.when(F.col(f"s{k}") == F.col("sig"), F.col("n")).otherwise(F.coalesce(f"o{k}", F.lit(-1))))
    now = stored(now.drop("s0", "s1"), f"{path}/level0")
    columns = ["list", "sig", "n", "pos", "depth", "o0", "m0", "o1", "m1"]
    kept, extra = [], None
    for level in range(1, LEVELS + 1):
        long = (F.col("m") > BLOCK) & (F.col("m") - F.col("most") > FEW)
        more = now.where(long)
        if more.isEmpty():
            break
        kept.append(now.where(~long).select(columns))
        nodes = sets_again(more.select("sig").distinct(), f"level{level}")
        deeper = stored(refined(more, nodes, classes, num, den), f"{path}/refined{level}")
        drop(spark, f"{path}/shingles_level{level}", f"{path}/members_level{level}")
        ended = deeper.where("ended")
        ends = ended.join(ended.groupBy("list").agg(F.min(F.struct("n", "sig")).alias("e")), "list").where(f"e.sig <> sig and {num} * (n + e.n) <= {num + den} * depth")
        ends = ends.select(F.least("sig", "e.sig").alias("a"), F.greatest("sig", "e.sig").alias("b")).distinct()
        extra = ends if extra is None else extra.union(ends)
        now = open_rows(deeper.where("not ended").select(columns), f"level{level}")
        drop(spark, f"{path}/placed_level{level}")
    kept.append(now.select(columns))
    rows = kept[0]
    for part in kept[1:]:
        rows = rows.union(part)
    if len(kept) > 1:
        rows = stored(rows, f"{path}/kept")
    if extra is not None:
        links = links.union(stored(extra, f"{path}/ends"))
        labels, old = components(links, "jaccard_ends")
        drop(spark, *used)
        used = old

    compared_pairs = known.select("a", "b")
    for whole in (False, True):
        step = "whole" if whole else "forest"
        pairs = stored(cross_pairs(open_rows(rows, step), bits.select("sig", "bits"), num, den, whole).join(compared_pairs, ["a", "b"], "left_anti"), f"{path}/pairs_{step}")
        drop(spark, f"{path}/placed_{step}", f"{path}/open_{step}")
        found = answers(pairs.where("not proven"), step)
        compared_pairs = compared_pairs.union(pairs.select("a", "b"))
        new = found.where("link").select("a", "b").union(pairs.where("proven").select("a", "b"))
        if not new.isEmpty():
            links = links.union(new)
            labels, old = components(links, f"jaccard_{step}")
            drop(spark, *used)
            used = old
    drop(spark, f"{path}/lists")

    placed = sets.join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    # a set without shingles links with nothing, not even with another empty one
    smallest = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_sig = placed.where("n > 0").join(smallest, "component").select("sig", "component_id")
    return per_doc.join(by_sig, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
