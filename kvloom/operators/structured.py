"""Columnar structured objects: members, rows, ragged columns, record shredding, inference (PRJ1-PRJ5, NS1-NS6).

A structured object is a frame with one column per member and a stable 0-based row_id; order is data, so every
operator that gives an order gives it as a column.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.operators.ranks import ranked

#: Limits of inference: depth, keys of a record, items of a positional list, sampled rows.
DEPTH, KEYS, ITEMS, SAMPLED = 32, 64, 8, 128


def select_members(obj: DataFrame, names: list[str] | None) -> DataFrame:
    """PRJ1: row_id and the named members; None is all; an unknown name is an error."""
    if names is None:
        return obj
    if missing := [n for n in names if n not in obj.columns]:
        raise KeyError(missing)
    return obj.select("row_id", *[n for n in names if n != "row_id"])


def slice_bounds(n: Column, start: int | None, end: int | None) -> tuple[Column, Column]:
    """Bounds by the rules of Python slices: negative from the end, then held in [0, n]."""
    hold = lambda x, default: default if x is None else F.greatest(F.lit(0), F.least(n, F.lit(x) if x >= 0 else n + x))
    return hold(start, F.lit(0)), hold(end, n)


def slice_member(obj: DataFrame, start: int | None, end: int | None, step: int = 1) -> DataFrame:
    """PRJ2: rows start, start + step, ... below end; step must be positive."""
    if step <= 0:
        raise ValueError("step must be positive")
    total = obj.agg(F.count("*").alias("_n"))
    b, e = slice_bounds(F.col("_n"), start, end)
    r = obj.crossJoin(F.broadcast(total))
    return r.where((F.col("row_id") >= b) & (F.col("row_id") < e) & ((F.col("row_id") - b) % step == 0)).drop("_n")


def slice_length(start: Column, end: Column, step: Column) -> Column:
    """PRJ3: 1 + (end - 1 - start) // step, 0 if empty."""
    return F.when(end > start, 1 + F.floor((end - 1 - start) / step)).otherwise(F.lit(0)).cast("long")


def covering_bytes(start: Column, end: Column, step: Column, row_bytes: int) -> tuple[Column, Column]:
    """PRJ3: byte range that covers a slice."""
    n = slice_length(start, end, step)
    return start * row_bytes, F.when(n > 0, (start + (n - 1) * step + 1) * row_bytes).otherwise(start * row_bytes)


def get_fields(sections: dict[str, DataFrame], fields: list[str] | None = None, **lists: list[str]) -> DataFrame:
    """PRJ4: members of several sections (frames on row_id) in one frame.

    `fields` names members of any section and excludes section lists; giving a list for one section empties the
    sections without one; nothing given is everything. Unknown names are errors.
    """
    if fields is not None and lists:
        raise ValueError("fields excludes section lists")
    known = {c: s for s, df in sections.items() for c in df.columns if c != "row_id"}
    asked = fields if fields is not None else [c for s in sections for c in lists.get(s, [])] if lists else list(known)
    if missing := [c for c in asked if c not in known]:
        raise KeyError(missing)
    out = None
    for s, df in sections.items():
        if own := [c for c in asked if known[c] == s]:
            part = df.select("row_id", *own)
            out = part if out is None else out.join(part, "row_id")
    return out.select("row_id", *asked)


def gather_rows(obj: DataFrame, indexes: DataFrame) -> DataFrame:
    """PRJ5: rows by a list of indexes (pos, idx): order and repeats kept, negatives from the end.

    An index out of range fails the whole gather when it runs.
    """
    total = obj.agg(F.count("*").alias("_n"))
    idx, n = F.col("idx"), F.col("_n")
    sound = F.when((idx >= n) | (idx < -n), F.raise_error(F.concat(F.lit("row index out of range: "), idx.cast("string")))).otherwise(F.when(idx < 0, idx + n).otherwise(idx)).cast("long")
    return indexes.crossJoin(F.broadcast(total)).select("pos", sound.alias("row_id")).join(obj, "row_id")


def ragged_encode(obj: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """NS3: an array column as flat data (place, value) and layout (row_id, begin, length, is_null); null is empty with its flag."""
    size = F.coalesce(F.size(F.col(column)), F.lit(0))
    size = F.when(F.col(column).isNull(), 0).otherwise(size).cast("long")
    layout = ranked(obj.select("row_id", size.alias("length"), F.col(column).isNull().alias("is_null")), [], [F.col("row_id")], "_k", None, {"_sum": F.col("length")})
    layout = layout.select("row_id", (F.col("_sum") - F.col("length")).alias("begin"), "length", "is_null")
    data = obj.select("row_id", F.posexplode(column).alias("_i", "value")).join(layout.select("row_id", "begin"), "row_id").select((F.col("begin") + F.col("_i")).alias("place"), "value")
    return data, layout


def ragged_decode(data: DataFrame, layout: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """NS4: (row_id, value array) back from flat data, for all rows or some; flagged rows are null."""
    wanted = layout if rows is None else layout.join(rows, "row_id", "left_semi")
    places = wanted.where("length > 0").select("row_id", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)).alias("place"))
    got = places.join(data, "place").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("value"))
    kind = got.schema["value"].dataType.simpleString()
    return wanted.join(got, "row_id", "left").select("row_id", F.when(~F.col("is_null"), F.coalesce("value", F.array().cast(kind))).alias("value"))


def shred(records: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """NS5: JSON records as one column and one presence flag per path: an absent key differs from a null value."""
    v = F.try_parse_json(column)
    out = [F.col("row_id")]
    for p in paths:
        name = p.replace(".", "_")
        parent, _, leaf = p.rpartition(".")
        keys = F.json_object_keys(F.get_json_object(column, f"$.{parent}") if parent else F.col(column))
        out += [F.try_variant_get(v, f"$.{p}", "string").alias(name), F.coalesce(F.array_contains(keys, leaf), F.lit(False)).alias(f"{name}_present")]
    return records.select(*out)


def manifest(df: DataFrame) -> dict[str, Any]:
    """NS6: description of a stored frame's schema."""
    return df.schema.jsonValue()


def infer(rows: list[Any], depth: int = 0) -> T.DataType:
    """NS1/NS2: type of a column from sampled Python values (SAMPLED at most): records and short mixed lists become structs, else a leaf.

    Leaves in order of priority: numeric list, numeric, bytes, text, anything else as JSON text. An all-null column is refused.
    """
    values = [v for v in rows[:SAMPLED] if v is not None]
    if not values:
        raise ValueError("a column of nulls has no type")
    if all(isinstance(v, dict) for v in values) and depth < DEPTH:
        keys = sorted({k for v in values for k in v})
        if all(isinstance(k, str) for k in keys) and len(keys) <= KEYS:
            return T.StructType([T.StructField(k, infer([v.get(k) for v in values], depth + 1)) for k in keys])
    if all(isinstance(v, list) for v in values) and depth < DEPTH and max(map(len, values)) <= ITEMS and all(x is None or isinstance(x, (dict, list)) for v in values for x in v) and any(values):
        n = max(map(len, values))
        return T.StructType([T.StructField(str(i), infer([v[i] if i < len(v) else None for v in values], depth + 1)) for i in range(n)])
    number = lambda v: isinstance(v, (int, float))
    if all(isinstance(v, list) and all(number(x) for x in v) for v in values):
        return T.ArrayType(T.DoubleType() if any(isinstance(x, float) for v in values for x in v) else T.LongType())
    if all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if all(number(v) for v in values):
        return T.DoubleType() if any(isinstance(v, float) for v in values) else T.LongType()
    if all(isinstance(v, bytes) for v in values):
        return T.BinaryType()
    return T.StringType()


def conforms(df: DataFrame, hints: dict[str, bool]) -> DataFrame:
    """Hinted schema: (column, nulls) of columns that hold nulls though hinted not nullable (hints: column -> nullable)."""
    strict = [c for c, nullable in hints.items() if not nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in strict])).alias("x")).select("x.column", "x.nulls").where("nulls > 0")


def leaf_codecs(df: DataFrame, column: str) -> DataFrame:
    """NS1/NS2 over a JSON text column: (path, n, nulls, codec) of each top-level field, found in all rows by the executors.

    Codec by priority: numbers (array of numbers), number, boolean, text, json for records, mixed lists and mixed types;
    null where a field is always null.
    """
    made = df.select(F.parse_json(column).alias("_j")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_j").outer()))
    made = made.select(F.col("key").alias("path"), F.schema_of_variant("value").alias("_t"))
    number, t = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\))", F.col("_t")
    kind = F.when(t == "VOID", None).when(t.rlike(rf"^ARRAY<({number}|VOID)>$"), "numbers").when(t.rlike(rf"^{number}$"), "number").when(t == "BOOLEAN", "boolean").when(t == "STRING", "text").otherwise("json")
    each = made.select("path", kind.alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n"))
    codec = F.when(F.count("kind") > 1, "json").otherwise(F.max("kind"))
    return each.groupBy("path").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), codec.alias("codec"))


def accesses(requests: DataFrame, layout) -> DataFrame:
    """UD4: what a layout makes of each request: rows of an array of structs that `layout(requests' columns)` gives."""
    return requests.select(*requests.columns, F.inline(layout(F.col)))
