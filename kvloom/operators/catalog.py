"""Object catalog: scans, lookups, deletes, resolve, last-writer merges (SRC4-7, FLT1-14, JN1, JN2, JN10, SET1-3, SET5).

An object catalog has tenant_id, key and what a query needs of size, lease_timeout, replicas, ...; identity is the
pair (tenant_id, key), so joins use both. Lookups answer per requested row, with a status instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvloom.operators.ranks import ranked

ID = ["tenant_id", "key"]


def all_keys(objects: DataFrame, tenant: str | None = None) -> DataFrame:
    """SRC4: keys of one tenant or of all."""
    return (objects if tenant is None else objects.where(F.col("tenant_id") == tenant)).select("key")


def segment_names(segments: DataFrame) -> DataFrame:
    """SRC5: names of segments whose status is OK."""
    return segments.where("status = 'OK'").select("segment")


def segment_details(segments: DataFrame) -> DataFrame:
    """SRC5: every segment with capacity and use in GiB and use in percent, 0 where capacity is 0."""
    gib = float(1 << 30)
    return segments.select("segment", "status", (F.col("capacity") / gib).alias("capacity_gib"), (F.col("used") / gib).alias("used_gib"), F.coalesce(F.try_divide(F.col("used") * 100.0, F.col("capacity")), F.lit(0.0)).alias("used_percent"))


def segment_usage(segments: DataFrame) -> DataFrame:
    """FLT12: used and capacity over allocators of one name; a capacity of 0 is not found."""
    s = segments.groupBy("segment").agg(F.sum("used").alias("used"), F.sum("capacity").alias("capacity"))
    return s.where("capacity > 0")


def bucket_page(buckets: DataFrame, limit: int, start: int = 0) -> DataFrame:
    """SRC7: whole buckets (bucket_id, n_keys) from `start` while their keys fit `limit`; next_bucket follows the page.

    A first bucket larger than limit gives an empty page that names itself as next (the caller's error).
    """
    r = ranked(buckets.where(F.col("bucket_id") >= start), [], [F.col("bucket_id")], "_rank", None, {"_sum": F.col("n_keys").cast("long")})
    rest = r.where(F.col("_sum") > limit).agg(F.min("bucket_id").alias("next_bucket"))
    return r.where(F.col("_sum") <= limit).select("bucket_id", "n_keys").crossJoin(F.broadcast(rest))


def exists(requested: DataFrame, objects: DataFrame) -> DataFrame:
    """FLT1: requested (with its order column) and found: one answer per requested row, repeats included."""
    known = objects.select(*ID).distinct().withColumn("_f", F.lit(True))
    return requested.join(known, ID, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def lookup(requested: DataFrame, objects: DataFrame, now: Column, columns: list[str]) -> DataFrame:
    """FLT2/FLT3: columns of each requested object, seconds its lease has left (0 if expired), status OK or OBJECT_NOT_FOUND."""
    left = F.greatest(F.lit(0), F.unix_seconds(F.col("lease_timeout").cast("timestamp")) - F.unix_seconds(now.cast("timestamp")))
    known = objects.select(*ID, *columns, "lease_timeout", F.lit(True).alias("_f"))
    return requested.join(known, ID, "left").select(*requested.columns, *columns, F.when(F.col("_f"), left).alias("lease_left"), F.when(F.col("_f"), "OK").otherwise("OBJECT_NOT_FOUND").alias("status"))


def lookup_all(requested: DataFrame, objects: DataFrame, columns: list[str]) -> DataFrame:
    """FLT11: strict multi-get: rows only if every requested key exists, else none."""
    got = requested.join(objects.select(*ID, *columns, F.lit(True).alias("_f")), ID, "left_outer").withColumn("_missing", F.col("_f").isNull()).drop("_f")
    missing = got.agg(F.count_if("_missing").alias("_n"))
    return got.drop("_missing").crossJoin(F.broadcast(missing)).where("_n = 0").drop("_n")


def by_regex(objects: DataFrame, pattern: str, tenant: str | None = None) -> DataFrame:
    """FLT4: objects of a tenant whose key the pattern is found in anywhere; no match is an empty frame."""
    scope = objects if tenant is None else objects.where(F.col("tenant_id") == tenant)
    return scope.where(F.col("key").rlike(pattern))


def removed_by_regex(objects: DataFrame, pattern: str, now: Column, force: bool = False) -> DataFrame:
    """FLT5: objects that a delete by pattern removes; without force those with a live lease or task stay."""
    hit = by_regex(objects, pattern)
    return hit if force else hit.where((F.col("lease_timeout") <= now) & ~F.col("busy"))


def remaining(objects: DataFrame, doomed: DataFrame) -> DataFrame:
    """FLT6: objects but those named by doomed."""
    return objects.join(doomed.select(*ID).distinct(), ID, "left_anti")


def by_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """FLT7: objects whose key starts with a prefix."""
    return objects.where(F.col("key").startswith(prefix))


def replicas_of_kind(objects: DataFrame, kind: str) -> DataFrame:
    """FLT8: nested replicas of one kind only."""
    return objects.withColumn("replicas", F.filter("replicas", lambda r: r["kind"] == kind))


def replicas_by_kind(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """FLT9: one array of segments per kind, in order of replica id."""
    of = lambda k: F.transform(F.array_sort(F.transform(F.filter("replicas", lambda r: r["kind"] == k), lambda r: F.struct(r["id"].alias("id"), r["segment"].alias("segment")))), lambda r: r["segment"])
    return objects.select(*ID, *[of(k).alias(k.lower()) for k in kinds])


def replica_quantifiers(objects: DataFrame, test) -> DataFrame:
    """FLT10: any, all, count and first id of nested replicas under a test (a function of the replica column)."""
    hits = F.filter("replicas", test)
    return objects.select(*ID, F.exists("replicas", test).alias("any_of"), F.forall("replicas", test).alias("all_of"), F.size(hits).cast("long").alias("n_of"), F.get(hits, F.lit(0))["id"].alias("first_of"))


def client_ips(clients: DataFrame, mounted: DataFrame) -> DataFrame:
    """FLT13: requested clients that exist with their distinct ips, sorted; an empty list if there is none; others omitted."""
    known = mounted.groupBy("client_id").agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    return clients.distinct().join(known, "client_id")


def cleared(objects: DataFrame, wanted: DataFrame, client: str, segment: str | None = None) -> DataFrame:
    """FLT14: requested keys of the client whose replicas are cleared; segment None or empty means every segment."""
    own = objects.where(F.col("client_id") == client)
    if segment:
        own = own.where(F.exists("replicas", lambda r: r["segment"] == segment))
    return own.join(wanted.select(*ID).distinct(), ID, "left_semi").select(*ID)


def resolve(keys: DataFrame, locations: DataFrame) -> DataFrame:
    """JN1: ordered keys (pos, key) x fields -> for each group of fields with one location vector its fields and locations.

    locations: (key, field, fragment, row). Fields that some key lacks are left out; all keys must exist.
    """
    n = keys.count()
    got = keys.join(locations, "key").select("field", "pos", "fragment", "row")
    # a field's locations are told by their number and two sums of hashes, so no task holds all keys of a field
    hashed = [F.sum(F.xxhash64(F.lit(seed), "pos", "fragment", "row").cast("decimal(38,0)")).alias(f"_h{seed}") for seed in (1, 2)]
    told = got.groupBy("field").agg(F.count("*").alias("_n"), *hashed).where(F.col("_n") == n)
    groups = told.groupBy("_h1", "_h2").agg(F.min("field").alias("field"), F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields"))
    return got.join(groups.select("field", "fields"), "field").select("fields", "pos", "fragment", "row")


def append_columns(left: DataFrame, right: DataFrame, row: str = "row_id", overwrite: bool = False) -> DataFrame:
    """JN2: columns of right added to the rows of left by row id; a name on both sides is an error unless overwrite.

    Both sides must hold the same rows: a row id that only one side has aborts the job when it runs.
    """
    both = [c for c in right.columns if c in left.columns and c != row]
    if both and not overwrite:
        raise ValueError(f"columns exist: {both}")
    own = left.drop(*both).withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), row, "full_outer")
    alone = F.col("_l").isNull() | F.col("_r").isNull()
    checked = F.when(alone, F.raise_error(F.concat(F.lit("row on one side only: "), F.col(row).cast("string")))).otherwise(F.col(row))
    return own.withColumn(row, checked.cast(left.schema[row].dataType)).drop("_l", "_r")


def is_subset(old: DataFrame, new: DataFrame, shard: str, member: str) -> DataFrame:
    """JN10: per shard of old whether all its members are in new."""
    missing = old.join(new.select(shard, member), [shard, member], "left_anti").groupBy(shard).agg(F.count("*").alias("missing"))
    return old.select(shard).distinct().join(missing, shard, "left").select(shard, F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("subset"))


def last_writer(updates: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """SET1/SET3: newest values of each key; maxima are combined before the shuffle."""
    return updates.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_w")).select(*keys, *[F.col(f"_w.{v}").alias(v) for v in values])


def merged_tags(old: Column, new: Column) -> Column:
    """SET1: tags of both maps, new ones winning."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def fragment_references(locations: DataFrame) -> DataFrame:
    """SET2: references to each fragment: distinct (key, field); a fragment without any is gone."""
    return locations.groupBy("fragment").agg(F.count_distinct("key", "field").alias("refs"))


def put_outcomes(puts: DataFrame) -> DataFrame:
    """SET3: status of each put in order (seq): the first of a key is OK, a later plain put fails, an upsert replaces.

    puts: tenant_id, key, seq, upsert.
    """
    first = puts.groupBy(*ID).agg(F.min("seq").alias("_first"))
    return puts.join(first, ID).withColumn("status", F.when(F.col("seq") == F.col("_first"), "OK").when(F.col("upsert"), "REPLACED").otherwise("OBJECT_ALREADY_EXISTS")).drop("_first")


def job_progress(tasks: DataFrame, job: str) -> DataFrame:
    """SET4: status of copy, move and drain jobs from their tasks' (status)."""
    done, bad = F.count_if(F.col("status") == "SUCCESS"), F.count_if(F.col("status") == "FAILED")
    return tasks.groupBy(job).agg(F.count("*").alias("tasks"), done.alias("success"), bad.alias("failed"), F.when(bad > 0, "FAILED").when(done == F.count("*"), "SUCCESS").when(done > 0, "PROCESSING").otherwise("PENDING").alias("status"))


def gaps_of(df: DataFrame, stream: list[str], seq: str) -> DataFrame:
    """WIN7/ST3: places where a stream's sequence jumps (gap) or repeats (duplicate)."""
    w = Window.partitionBy(*stream).orderBy(seq)
    d = df.select(*stream, seq, F.lag(seq).over(w).alias("before"))
    return d.where(F.col("before").isNotNull() & (F.col(seq) != F.col("before") + 1)).withColumn("kind", F.when(F.col(seq) == F.col("before"), "duplicate").otherwise("gap"))
