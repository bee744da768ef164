"""Scalar functions on columns (SC1-SC14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of an element by data type.
DTYPE_BYTES = {"int8": 1, "uint8": 1, "bool": 1, "fp8": 1, "int16": 2, "uint16": 2, "fp16": 2, "bf16": 2, "int32": 4, "uint32": 4, "fp32": 4, "int64": 8, "uint64": 8, "fp64": 8}
TWO64 = "18446744073709551616"


def key_to_u64(key: Column) -> Column:
    """SC1: whole string as decimal or 0x hex -> DECIMAL(20, 0); null for anything else or from 2**64 on."""
    hexed = F.when(F.length(key) <= 18, F.conv(F.substring(key, 3, 16), 16, 10).cast("decimal(20,0)"))
    plain = F.when(F.length(F.regexp_replace(key, "^0+", "")) <= 20, key.try_cast("decimal(38,0)"))
    value = F.when(key.rlike(r"^0[xX][0-9a-fA-F]+$"), hexed).when(key.rlike(r"^[0-9]+$"), plain)
    return F.when(value < F.lit(TWO64).cast("decimal(38,0)"), value).cast("decimal(20,0)")


def fixed_width_key(prefix: Column, number: Column, width: int) -> Column:
    """SC2: prefix cut or padded with _ to width, then 16 digits."""
    return F.concat(F.rpad(F.substring(prefix, 1, width), width, "_"), F.lpad(number.cast("string"), 16, "0"))


def escape_path(path: Column) -> Column:
    """SC3: a backslash before each backslash, dot and opening bracket."""
    return F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\.")), F.lit("["), F.lit("\\["))


def format_bytes(n: Column) -> Column:
    """SC4: plain bytes below 1024, else two decimals (half to even) of the largest binary unit."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        text = F.format_string(f"%.2f {unit}", F.bround(n / float(1 << 10 * i), 2))
        out = out.when(n < 1 << 10 * (i + 1), text) if unit != "TiB" else out.otherwise(text)
    return out


def page_bytes(tokens: Column, rank: int, rope: int, index: int, precision: int, layers: int) -> Column:
    """SC5: tokens x (rank + rope + index) x precision x layers."""
    return tokens * ((rank + rope + index) * precision * layers)


def block_count(length: Column, block: int) -> Column:
    """SC6: complete blocks only."""
    return F.floor(length / block)


def element_bytes(dtype: Column) -> Column:
    """SC8: bytes of an element; null for an unknown type."""
    return F.create_map(*[F.lit(x) for kv in DTYPE_BYTES.items() for x in kv])[dtype]


def uuid_text(high: Column, low: Column) -> Column:
    """SC9: a pair of numbers as high-low."""
    return F.concat_ws("-", high.cast("string"), low.cast("string"))


def uuid_parts(text: Column) -> tuple[Column, Column]:
    """SC9: the two numbers of high-low, as DECIMAL(20, 0)."""
    return tuple(F.split(text, "-")[i].try_cast("decimal(20,0)") for i in (0, 1))


def sequence_newer(a: Column, b: Column) -> Column:
    """SC10: whether sequence a comes after b where numbers wrap at 2**64: (a - b) modulo 2**64 below 2**63 and not 0."""
    d = "decimal(38,0)"
    ahead = F.pmod(a.cast(d) - b.cast(d), F.lit(TWO64).cast(d))
    return (ahead > 0) & (ahead < F.lit("9223372036854775808").cast(d))


def escape_label(text: Column) -> Column:
    """SC11: backslash, quote and newline as a metrics label needs them."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def shard_of(key: Column, shards: int) -> Column:
    """SC12: stable shard of a key, from its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards))


def payload_valid(payload: Column, checksum: Column) -> Column:
    """SC13: whether the payload's crc32 is the checksum."""
    return F.crc32(payload.cast("binary")) == checksum


def parse_size(text: Column) -> Column:
    """SC14: 4k, 2M, 1g, 1T (binary) or bare digits -> bytes; null for anything else."""
    n = F.regexp_extract(text, r"^([0-9]+)[kKmMgGtT]?$", 1)
    unit = F.lower(F.regexp_extract(text, r"([kKmMgGtT])$", 1))
    return F.when(text.rlike(r"^[0-9]+[kKmMgGtT]?$"), n.try_cast("long") * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1))
