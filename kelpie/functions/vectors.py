"""Vector distances and quantisation as column expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _summed(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: each(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _summed(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _summed(a, b, lambda x, y: (x - y) * (x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, clamped; 1 if a vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1.0 - F.greatest(F.least(dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which arrays of whole numbers differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Distances by name; smaller is nearer, so dot is negative.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine_distance,
    "l2": lambda a, b: F.sqrt(squared_l2(a, b)),
    "squared_l2": squared_l2,
    "dot": lambda a, b: -dot(a, b),
    "l1": lambda a, b: _summed(a, b, lambda x, y: F.abs(x - y)),
    "hamming": hamming,
}


def distance(a: Column, b: Column, name: str = "cosine") -> Column:
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name}; known: {', '.join(DISTANCES)}")
    return DISTANCES[name](a, b)


def _half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def quantized_s8(vec: Column, largest: Column) -> Column:
    """Signed 8-bit numbers with scale 127 / largest magnitude, half away from zero, saturating."""
    return F.transform(vec, lambda x: F.when(largest == 0, 0).otherwise(F.greatest(F.least(_half_away(x.cast("double") * 127.0 / largest), F.lit(127)), F.lit(-128))).cast("int"))


def quantized_u8(vec: Column, low: Column, high: Column) -> Column:
    """Unsigned 8-bit numbers with scale 255 / range from the lowest value on."""
    return F.transform(vec, lambda x: F.when(high == low, 0).otherwise(F.greatest(F.least(_half_away((x.cast("double") - low) * 255.0 / (high - low)), F.lit(255)), F.lit(0))).cast("int"))


def quantized_bits(vec: Column, threshold: float = 0.0) -> Column:
    """One bit a number, set if it is at least the threshold, in 32-bit words, lowest bit first."""
    words = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 32).cast("int"))
    bits = F.transform(vec, lambda x: (x >= threshold).cast("long"))
    return F.transform(words, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.call_function("shiftleft", F.get(bits, w * 32 + i), i), F.lit(0).cast("long"))))


#: What the numbers of a type may be; null bounds ask nothing.
TYPES: dict[str, tuple[float | None, float | None]] = {"f32": (None, None), "f16": (None, None), "bf16": (None, None), "u8": (0, 255), "i8": (-128, 127), "bit": (0, 1)}


def parsed(text: Column, kind: str, dimensions: int | None = None) -> Column:
    """The numbers of a JSON list, a comma before its end allowed; null if it is none, has another number of dimensions, or a number
    that the type can't hold."""
    low, high = TYPES[kind]
    numbers = F.from_json(F.regexp_replace(text, r",\s*\]\s*$", "]"), "array<double>")
    fits = F.forall(numbers, lambda x: x.isNotNull() & (F.lit(True) if low is None else (x >= low) & (x <= high) & (x == F.floor(x))))
    return F.when(fits & (F.lit(True) if dimensions is None else F.size(numbers) == dimensions), numbers)


def as_type(vec: Column, kind: str) -> Column:
    """The numbers as a type of 16 bits holds them, as doubles: rounded to the nearest, ties to even."""

    @F.pandas_udf("array<double>")
    def held(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            x = np.asarray(v, np.float32)
            if kind == "f16":
                return x.astype(np.float16).astype(float)
            bits = x.view(np.uint32)
            whole = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
            return np.where(np.isfinite(x), whole.view(np.float32), x).astype(float)

        return vectors.map(one)

    return held(vec)


def typed_distance(a: Column, b: Column, name: str, kind: str) -> Column:
    """The distance of vectors of a type; bits are compared by Hamming's, whatever the name."""
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    if kind == "bit":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x).cast("double")
    return distance(as_type(a, kind), as_type(b, kind), name) if kind in ("f16", "bf16") else distance(a, b, name)
