"""Bit patterns and small scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def float_bits(x: pd.Series) -> pd.Series:
    """fp32 bit pattern as a number in [0, 2^32)."""
    return pd.Series(x.to_numpy("float32").view("uint32").astype("int64"))


@F.pandas_udf(T.FloatType())
def float_value(x: pd.Series) -> pd.Series:
    """The fp32 value of a bit pattern, 0 to 2^32."""
    return pd.Series(x.to_numpy("int64").astype("uint32").view("float32"))


@F.pandas_udf(T.FloatType())
def decode_half(x: pd.Series) -> pd.Series:
    """IEEE half-precision bits to their value."""
    return pd.Series(x.to_numpy("uint16").view("float16").astype("float32"))


@F.pandas_udf(T.FloatType())
def decode_bfloat16(x: pd.Series) -> pd.Series:
    """bfloat16 bits to their value: the upper half of a float32."""
    return pd.Series((x.to_numpy("uint32") << 16).view("float32"))


def to_float(word: Column, dtype: Column) -> Column:
    """The value of a word of a type: floats by their bits, int8 and int32 as numbers; null if unknown."""
    signed = lambda b: F.when(word >= (1 << (b - 1)), word - (1 << b)).otherwise(word).cast("float")
    return (
        F.when(dtype == "float32", float_value(word)).when(dtype == "float16", decode_half(word.bitwiseAND(65535)))
        .when(dtype == "bfloat16", decode_bfloat16(word.bitwiseAND(65535))).when(dtype == "int8", signed(8)).when(dtype == "int32", signed(32))
    )


def split_word(word: Column, dtype: Column) -> tuple[Column, Column]:
    """(masked word, sidecar): the low two bytes of a float32 and the low one of 16-bit floats go to the
    sidecar, nothing of others. Together they are the word."""
    low = F.when(dtype == "float32", word.bitwiseAND(65535)).when(dtype.isin("float16", "bfloat16"), word.bitwiseAND(255)).otherwise(F.lit(0).cast("long"))
    return word - low, low


def mul32(h: Column, c: int) -> Column:
    """h * c modulo 2^32 without overflow of a signed long."""
    low = h.bitwiseAND(65535) * c
    high = (F.shiftright(h, 16) * c).bitwiseAND(65535) * 65536
    return (low + high).bitwiseAND(4294967295)


def fmix32(h: Column) -> Column:
    """Finaliser of MurmurHash3."""
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = mul32(h, 2246822507)
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = mul32(h, 3266489909)
    return h.bitwiseXOR(F.shiftright(h, 16))


def bit_length(n: Column) -> Column:
    """Bits to tell ``n`` symbols apart, 1 at least."""
    return F.when(n <= 1, 1).otherwise(F.length(F.bin(n - 1)))


def align(x: Column, to: int = 256) -> Column:
    return F.ceil(x / F.lit(to)) * to


def safe_div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(b) <= eps, F.lit(0.0)).otherwise(a / F.when(F.abs(b) <= eps, F.lit(1.0)).otherwise(b))


def similarity(a: Column, b: Column) -> Column:
    """Component similarity in per cent."""
    return F.greatest(F.lit(0.0), 100 * (1 - F.least(F.lit(1.0), F.abs(a - b) / (F.abs(a) + F.abs(b) + 1e-12))))


# Patterns in a parameter's name and the roles they stand for, in order.
ROLES = (("q_proj|query", "query"), ("k_proj|key", "key"), ("v_proj|value", "value"), ("o_proj|output", "attn_output"), ("norm", "layernorm"), ("gate_proj", "mlp_gate"), ("up_proj", "mlp_up"), ("down_proj", "mlp_down"))


def role(name: Column) -> Column:
    """Layer role from a parameter name; the first match counts."""
    n, out = F.lower(name), None
    for pattern, value in ROLES:
        out = F.when(n.rlike(pattern), value) if out is None else out.when(n.rlike(pattern), value)
    return out.otherwise("other")
