"""Op-log and cache-event state in batch form (ST1, ST2, ST4, ST6, ST9, SRC9). The streaming forms are in kvloom.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame, keys: list[str], seq: str = "seq", op: str = "op", payload: str = "payload") -> DataFrame:
    """ST1: metadata after the log: a key's last PUT_END, unless a later PUT_REVOKE or REMOVE took the whole key.

    Unknown operations change nothing; an empty payload is stored as empty. Repeats of one sequence number must be equal.
    """
    known = log.where(F.col(op).isin("PUT_END", "PUT_REVOKE", "REMOVE"))
    last = known.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(op).alias("op"), F.coalesce(payload, F.lit("")).alias("payload"))).alias("l"))
    return last.where("l.op = 'PUT_END'").select(*keys, F.col("l.seq").alias("seq"), F.col("l.payload").alias("payload"))


def replay(snapshot: DataFrame, at: int, log: DataFrame, keys: list[str]) -> DataFrame:
    """SRC9: a snapshot (keys, seq, payload) of sequence `at` and the log's entries after it."""
    base = snapshot.select(*keys, "seq", F.lit("PUT_END").alias("op"), "payload")
    return compact(base.unionByName(log.where(F.col("seq") > at).select(*keys, "seq", "op", "payload")), keys)


def event_index(events: DataFrame, stream: list[str], item: str, seq: str = "event_id", kind: str = "event_type") -> DataFrame:
    """ST2: items each stream holds: last event stored, and after the stream's last cleared. Order is the event number's, not time's."""
    cleared = events.where(F.col(kind) == "cleared").groupBy(*stream).agg(F.max(seq).alias("_c"))
    last = events.where(F.col(kind).isin("stored", "removed")).groupBy(*stream, item).agg(F.max(F.struct(F.col(seq).alias("s"), F.col(kind).alias("k"))).alias("_l"))
    return last.join(cleared, stream, "left").where((F.col("_l.k") == "stored") & (F.col("_l.s") > F.coalesce("_c", F.lit(-1)))).select(*stream, item, F.col("_l.s").alias("stored_at"))


def heat_windows(hits: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """ST4: tumbling windows with an origin of each key's own: the first hit after expiry opens the next one.

    Sequential in a key by definition, so each key's distinct times, counted before they move, are folded in one row:
    the fold notes where windows open, so its time is linear in a key's times.
    """
    times = hits.groupBy(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))
    ordered = times.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("_t"))
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("seen"), F.array().cast("array<struct<start: bigint, before: bigint>>").alias("windows"))

    def step(acc, x):
        opens = acc["open"].isNull() | (x["t"] >= acc["open"] + seconds * 1_000_000)
        more = F.concat(acc["windows"], F.array(F.struct(x["t"].alias("start"), acc["seen"].alias("before"))))
        return F.struct(F.when(opens, x["t"]).otherwise(acc["open"]).alias("open"), (acc["seen"] + x["n"]).alias("seen"), F.when(opens, more).otherwise(acc["windows"]).alias("windows"))

    folded = ordered.select(key, F.aggregate("_t", start, step).alias("r"))
    w, total = F.col("r.windows"), F.col("r.seen")
    each = F.transform(w, lambda x, i: F.struct(x["start"].alias("start"), (F.coalesce(F.get(w, i + 1)["before"], total) - x["before"]).alias("hits")))
    return folded.select(key, F.explode(each).alias("w")).select(key, F.col("w.start").alias("start_us"), F.col("w.hits").alias("hits"))


def published(events: DataFrame, order: str, tick: Column, batch: int, capacity: int) -> DataFrame:
    """SRC8: events with the number they are published under (event_id, monotone) and their batch of at most `batch`.

    A queue of `capacity` is emptied at each tick: of a tick's events the oldest beyond it are dropped, which leaves
    a gap in event_id that `catalog.gaps_of` finds.
    """
    from kvloom.operators.ranks import ranked

    numbered = ranked(events.withColumn("_tick", tick), [], [F.col(order)], "event_id")
    last = ranked(numbered, ["_tick"], [F.col(order).desc()], "_age", "_of").where(F.col("_age") < capacity)
    place = F.least(F.col("_of"), F.lit(capacity)) - 1 - F.col("_age")
    return last.withColumns({"tick": F.col("_tick"), "batch_no": F.floor(place / batch)}).drop("_tick", "_age", "_of")


def retries(candidates: DataFrame, at: str, first_ms: int = 10, most_ms: int = 1000, most: int = 8, ttl_ms: int = 60_000) -> DataFrame:
    """ST5: when candidates (at: milliseconds) are tried again: delays double from first_ms to most_ms, `most` times at most within ttl_ms."""
    delays = [min(first_ms << i, most_ms) for i in range(most)]
    waits = [sum(delays[: i + 1]) for i in range(most)]
    plan = F.array(*[F.struct(F.lit(i + 1).alias("retry"), F.lit(w).cast("long").alias("wait")) for i, w in enumerate(waits) if w <= ttl_ms])
    return candidates.withColumn("_r", F.explode(plan)).select(*candidates.columns, F.col("_r.retry").alias("retry"), (F.col(at) + F.col("_r.wait")).alias("retry_at"))


def liveness(pings: DataFrame, client: str, ts: str, now, ttl_seconds: int) -> DataFrame:
    """ST6: OK or NEED_REMOUNT by the time since each client's last ping."""
    last = pings.groupBy(client).agg(F.max(F.col(ts).cast("timestamp")).alias("last"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros("last")
    return last.select(client, F.when(age > ttl_seconds * 1_000_000, "NEED_REMOUNT").otherwise("OK").alias("status"))


def replication_lag(primary: DataFrame, standby: DataFrame, by: str, seq: str) -> DataFrame:
    """ST9: max(0, primary's last sequence - standby's); the time lag is always 0, as by contract."""
    p, s = primary.groupBy(by).agg(F.max(seq).alias("_p")), standby.groupBy(by).agg(F.max(seq).alias("_s"))
    return p.join(s, by, "left").select(by, F.greatest(F.lit(0), F.col("_p") - F.coalesce("_s", F.lit(0))).cast("long").alias("lag"), F.lit(0).cast("long").alias("lag_ms"))
