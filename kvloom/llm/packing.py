"""Bounded-space online packing of documents into sequences of fixed size.

Each partition packs its documents as they come, holding a fixed number of open windows. A piece goes into the
window that it fills best; if it fits in none, the fullest is filled up with the piece's first ids (unless the gap
is smaller than `least_cut`) and emitted. The windows still open at the end are merged across partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.common import forget, parts, scratch, stored
from kvloom.llm.tokens import LibraryEncoder, WordSegments, once, read_text

#: Partitions whose open windows are merged by one task.
MERGED = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Windows:
    """At most `most` open windows, each a list of pieces (doc_id, start, length, crc, doc_tokens) and its length."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut, self.open = size, most, least_cut, []

    def add(self, key, ids: np.ndarray, emit) -> None:
        """Place all ids of a document (uint32)."""
        at, n = 0, len(ids)
        while at < n:
            left = n - at
            if left >= self.size:
                emit([self.piece(key, ids, at, self.size)], self.size)
                at += self.size
                continue
            best = max((w for w in self.open if w[1] + left <= self.size), key=lambda w: w[1], default=None)
            if best is None and len(self.open) < self.most:
                best = [[], 0]
                self.open.append(best)
            if best is None:
                best = max(self.open, key=lambda w: w[1])
                if (gap := self.size - best[1]) >= self.least_cut:
                    best[0].append(self.piece(key, ids, at, gap))
                    best[1] += gap
                    at += gap
                self.open.remove(best)
                emit(*best)
                continue
            best[0].append(self.piece(key, ids, at, left))
            best[1] += left
            at = n
            if best[1] == self.size:
                self.open.remove(best)
                emit(*best)

    @staticmethod
    def piece(key, ids: np.ndarray, at: int, n: int) -> tuple:
        return key, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)


def merged(windows: list[tuple[list, int]], size: int) -> list[list]:
    """Windows joined, largest first into the fullest that has room."""
    out: list[list] = []
    for pieces, n in sorted(windows, key=lambda w: (-w[1], w[0][0][:2] if w[0][0][0] is not None else (-1, -1))):
        best = max((w for w in out if w[1] + n <= size), key=lambda w: w[1], default=None)
        if best is None:
            out.append([list(pieces), n])
        else:
            best[0] += pieces
            best[1] += n
    return out


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, open_windows: int = 48, least_cut: int = 8, id_col: str = "doc_id", text_col: str = "text", words: int = 350_000, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Whole texts are encoded by the tokenizers library without special tokens, end_id is appended, and every id
    lies in exactly one piece. Null text counts as empty (the end id alone); a null id stays null; repeated rows
    are documents of their own; other columns are ignored; an empty table gives no rows. sequence_length is the
    length padded to `size`, but a sequence whose length is a power of two isn't padded.
    Windows still open in a partition carry only the description of their pieces, so what is merged at the end
    is at most open_windows * MERGED windows a task, however large the table. `words` bounds the encoded words that
    a Python worker keeps (up to twice as many); fewer cost time and change no result. Without `keep`
    a worker lets go of them and of the vocabulary after each task, for applications whose other steps need the memory.
    """
    spark = docs.sparkSession
    path = scratch(spark, "packing")
    content = spark.sparkContext.broadcast(read_text(vocabulary))

    def rows_of(pieces, total, number):
        at, padded = 0, total if total & (total - 1) == 0 else size
        for p in pieces:
            yield (*p, number, at, padded)
            at += p[2]

    names = [c.split()[0] for c in PIECE.split(", ")]

    def placed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = once(("words", vocabulary, words), lambda: WordSegments(LibraryEncoder(content.value), words))
        windows, end, number = Windows(size, open_windows, least_cut), np.array([end_id], "<u4"), part << 32
        rows: list[tuple] = []

        def emit(pieces, total):
            nonlocal number
            rows.extend((*r, None) for r in rows_of(pieces, total, number))
            number += 1

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 9)], names=[*names, "part"])
            rows.clear()
            return out

        for batch in parts(batches):
            for key, ids in zip(batch.column(0).to_pylist(), encoder.many([text or "" for text in batch.column(1).to_pylist()])):
                windows.add(key, np.concatenate([np.frombuffer(ids, "<u2").astype("<u4"), end]), emit)
            yield batch_of()
        for pieces, total in windows.open:
            rows.extend((*r, part) for r in rows_of(pieces, total, number))
            number += 1
        yield batch_of()
        if not keep:
            del encoder
            forget()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(source.mapInArrow(placed, PIECE + ", part long"), f"{path}/pieces")

    def joined(pdf):
        import pandas as pd

        windows: dict[int, list] = {}
        nullable = pdf["doc_id"].isna()
        for r, none in zip(pdf.sort_values(["sequence_id", "offset"]).itertuples(index=False), nullable.loc[pdf.sort_values(["sequence_id", "offset"]).index]):
            windows.setdefault(r.sequence_id, []).append((None if none else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens))
        first = int(pdf["sequence_id"].min())
        out = merged([(w, sum(p[2] for p in w)) for w in windows.values()], size)
        ids = sorted(windows)
        made = [x for k, (w, n) in enumerate(out) for x in rows_of(w, n, ids[k] if k < len(ids) else first)]
        return pd.DataFrame(made, columns=names).astype({"doc_id": "Int64"})

    leftover = pieces.where("part is not null").withColumn("group", F.floor(F.col("part") / MERGED)).groupBy("group").applyInPandas(joined, PIECE)
    return pieces.where("part is null").drop("part").unionByName(leftover)
