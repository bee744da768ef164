"""Structured Streaming forms of the event operators (ST1, ST2, ST4, ST6, ST7, LS8, SRC8).

Each takes a streaming frame and returns one; the batch operators of the same name give the same result over the
same rows, which is how they are tested. State lives in the state store of the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def publish(events: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """SRC8: events with a watermark; batches and their order are the source's."""
    return events.withWatermark(ts, delay)


def apply_oplog(log: DataFrame, keys: list[str]) -> DataFrame:
    """ST1: latest operation of each key as keyed state without expiry (update mode); rows with op PUT_END are live."""
    known = log.where(F.col("op").isin("PUT_END", "PUT_REVOKE", "REMOVE"))
    return known.groupBy(*keys).agg(F.max(F.struct("seq", "op", "payload")).alias("l")).select(*keys, "l.seq", "l.op", "l.payload")


def strict_oplog(log: DataFrame, key_schema: str = "shard long") -> DataFrame:
    """ST1: strict sequence fold per shard: an entry of the expected number is applied, an older one skipped, a newer one waits for the gap to close.

    log: shard, seq, op, key, payload. Out: (shard, seq, op, key, payload, status) with status applied or skipped.
    Entries that come early are held in the state, ordered, until their turn. A bad operation is rejected
    without advancing.
    """
    out = "shard long, seq long, op string, key string, payload string, status string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, held = state.get if state.exists else (0, [])
        waiting = {int(h[0]): tuple(h[1:]) for h in held}
        done = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if r.op not in ("PUT_END", "PUT_REVOKE", "REMOVE"):
                done.append((key[0], r.seq, r.op, r.key, r.payload, "rejected"))
            elif r.seq < expected or r.seq in waiting:
                done.append((key[0], r.seq, r.op, r.key, r.payload, "skipped"))
            else:
                waiting[int(r.seq)] = (r.op, r.key, r.payload)
            while expected in waiting:
                op, k, payload = waiting.pop(expected)
                done.append((key[0], expected, op, k, payload, "applied"))
                expected += 1
        state.update((expected, [(s, *v) for s, v in sorted(waiting.items())]))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in out.split(", ")])

    return log.groupBy("shard").applyInPandasWithState(fold, out, "expected long, held array<struct<seq: long, op: string, key: string, payload: string>>", "append", GroupStateTimeout.NoTimeout)


def index_events(events: DataFrame, stream: list[str], item: str) -> DataFrame:
    """ST2: last event of each item with the stream's own clears told apart later: (stream, item, seq, kind), update mode."""
    e = events.where("kind in ('stored', 'removed', 'cleared')").withColumn("_item", F.when(F.col("kind") == "cleared", F.lit(None)).otherwise(F.col(item)))
    return e.groupBy(*stream, F.col("_item").alias(item)).agg(F.max(F.struct("seq", "kind")).alias("l")).select(*stream, item, "l.seq", "l.kind")


def heat(hits: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """ST4: tumbling windows of each key's own origin; a window comes out when the next one opens (append mode).

    Hits must come in order of time within a key. The window still open stays in the state.
    """
    out = f"{key} long, start_us long, hits long"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        done = []
        for t in sorted(int(x) for b in batches for x in b["us"]):
            if start is None or t >= start + seconds * 1_000_000:
                if start is not None:
                    done.append((k[0], start, n))
                start, n = t, 0
            n += 1
        state.update((start, n))
        yield pd.DataFrame(done, columns=[key, "start_us", "hits"])

    us = hits.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return us.groupBy(key).applyInPandasWithState(fold, out, "start long, n long", "append", GroupStateTimeout.NoTimeout)


def last_pings(pings: DataFrame, client: str, ts: str) -> DataFrame:
    """ST6: time of each client's last ping (update mode); status is a comparison with now."""
    return pings.groupBy(client).agg(F.max(ts).alias("last"))


def rates(events: DataFrame, key: str, ts: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST7/ST8/LS8: counts of each key per aligned window behind a watermark (append mode)."""
    w = F.window(ts, window)
    return events.withWatermark(ts, delay).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
