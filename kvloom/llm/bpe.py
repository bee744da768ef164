"""Byte-level BPE by backtracking from longest matches, in linear time.

Bytes are mapped to Latin-1 characters for pyahocorasick, whose one pass over a piece gives the longest
vocabulary entry at each position. Tokens are taken longest first; a token may follow another only if BPE
would keep their boundary, a question about the two tokens alone that is memoised. Where no token fits, the
last one is taken back and a shorter prefix tried; a position given up once is never entered again.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.tokens import SpacedSegments, once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes `token`, or None if merges of lower rank don't leave two."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        low, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if low >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Backtracker:
    """Encoder and decoder of pieces for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], most: int = 1_000_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.halves = {r: merge_pair(t, ranks) or (r, r) for t, r in ranks.items()}
        self.merged = {p: r for r, p in self.halves.items() if p != (r, r)}
        self.prefix = {r: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None) for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            if r == self.merged.get(self.halves[r]) or len(t) == 1:
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the boundary between two tokens: undo their merges, latest first, looking for one across it."""
        limit = 1 << 62  # ranks from here on come too late to join what now meets at the boundary
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            a, b = self.halves[left][1], self.halves[right][0]
            if left > right and a != left or b == right:
                if a == left:
                    return True
                limit, left = left, a
            else:
                limit, right = right + 1, b

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, length, fits = len(piece), self.length, self.fits
        longest: list = [None] * n
        best = [0] * n
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            size = length[r]
            at = end + 1 - size
            if size > best[at]:
                best[at], longest[at] = size, r
        open_at, out, at = [True] * (n + 1), [], 0
        token = longest[0]
        while at < n:
            last, found = (out[-1] if out else None), False
            while token is not None:
                if open_at[at + length[token]]:
                    if last is None:
                        found = True
                    elif (found := fits.get((last, token))) is None:
                        if len(fits) > self.most:
                            fits.clear()
                        found = fits[last, token] = self.compatible(last, token)
                    if found:
                        break
                token = self.prefix[token]
            if found:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
            else:
                open_at[at] = False
                token = out.pop()
                at -= length[token]
        return out


class PieceEncoder:
    """Segments of text -> ids as uint16 bytes: each match of the pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.backtracker, self.pieces = Backtracker(ranks), regex.compile(pattern).findall

    def __call__(self, segment: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(segment):
            ids += self.backtracker.encode(piece.encode("utf-8"))
        return np.array(ids, "<u2").tobytes()


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: array<int> if with_ids) of each row of docs, in its place.

    Whole texts are encoded by the ranks in the file `vocabulary`, each match of `pattern` by itself, without
    special tokens; then the ids are decoded to bytes. Null text counts as empty and gives no ids. A null id
    stays null; repeated rows each give a row; other columns are ignored. Ids must be below 65,536.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa

        encoder = once(("bpe", vocabulary, pattern), lambda: SpacedSegments(PieceEncoder(ranks.value, pattern)))
        bytes_of = encoder.encode.backtracker.bytes_of.__getitem__
        decimal = once.__dict__.setdefault("decimal", [str(i) for i in range(1 << 16)]).__getitem__
        for batch in batches:
            keys, counts, shas, back, lists = batch.column(0).to_pylist(), [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.ids(text or ""), "<u2").tolist()
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(bytes_of, ids))).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
