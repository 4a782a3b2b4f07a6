"""Element types, names and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element sizes in bytes, and the storage and mantissa bits of the types that can be masked.
SIZES = {"float32": 4, "bfloat16": 2, "float16": 2, "int8": 1, "int32": 4}
LAYOUTS = {"float32": (4, 23), "float16": (2, 10), "bfloat16": (2, 7)}
ALIASES = {"fp16": "float16", "bf16": "bfloat16"}
# Prefixes of a tensor's name and the category they stand for; the longer one first.
PREFIXES = (("master_weights::", "master_weights"), ("optimizer.exp_avg_sq::", "exp_avg_sq"), ("optimizer.exp_avg::", "exp_avg"))
#: Bytes of each element that go to the sidecar.
SIDECAR_BYTES = {"float32": 2, "float16": 1, "bfloat16": 1}


def _lookup(key: Column, table: dict, otherwise) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(otherwise)


def parse(text: Column) -> Column:
    """Type named in any string such as torch.bfloat16; "unknown" if none is. bfloat16 holds float16, so it is tried first."""
    out = None
    for name in ("float32", "bfloat16", "float16", "int8"):
        out = F.when(text.contains(name), F.lit(name)) if out is None else out.when(text.contains(name), F.lit(name))
    return F.coalesce(out.otherwise("unknown"), F.lit("unknown"))


def element_size(dtype: Column) -> Column:
    """Bytes of an element, 0 if unknown."""
    return _lookup(dtype, SIZES, 0)


def storage(dtype: Column) -> Column:
    """(bytes, mantissa bits) of a maskable type given by name or alias; others raise when evaluated."""
    name = _lookup(dtype, ALIASES, dtype)
    bad = F.raise_error(F.concat(F.lit("no layout for dtype "), F.coalesce(dtype, F.lit("null"))))
    return F.struct(F.coalesce(_lookup(name, {k: v[0] for k, v in LAYOUTS.items()}, None), bad.cast("int")).alias("bytes"), _lookup(name, {k: v[1] for k, v in LAYOUTS.items()}, None).alias("mantissa_bits"))


def category(name: Column) -> Column:
    """Category of a tensor from the prefix of its name, model_state without one."""
    out = None
    for prefix, value in PREFIXES:
        out = F.when(name.startswith(prefix), F.lit(value)) if out is None else out.when(name.startswith(prefix), F.lit(value))
    return out.otherwise("model_state")


def bits_to_bytes(bits: Column) -> Column:
    return F.floor((bits + 7) / 8).cast("long")


def megabytes(n: Column) -> Column:
    return n / F.lit(1024.0 * 1024.0)


def shape_text(shape: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ","), F.lit("]"))


def layout_text(contiguous: Column, rank: Column) -> Column:
    return F.when(rank == 0, "scalar").when(contiguous, "contiguous").otherwise("non-contiguous")


def sanitize(token: Column) -> Column:
    """Characters other than letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(token, r"[^A-Za-z0-9_.\-]", "_")


def safe_name(name: Column) -> Column:
    return F.translate(name, "/.", "__")
