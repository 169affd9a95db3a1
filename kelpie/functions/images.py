"""Looks of pictures: 300 x 300 grey levels by averaging boxes, and whether two are nearly the same."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: The side of a look and the largest mean difference of near duplicates.
SIDE, NEAR = 300, 5.0


@lru_cache(64)
def shares(size: int, side: int = SIDE) -> np.ndarray:
    """side x size: the share of each pixel in each box of equal length."""
    edges = np.arange(side + 1) * size / side
    pixels = np.arange(size)
    share = np.clip(np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels), 0, None)
    return share / share.sum(1, keepdims=True)


def look_of(pixels: bytes | None, width: int | None, height: int | None) -> bytes | None:
    """The look of grey pixels, row by row; null where they aren't width times height."""
    if not pixels or not width or not height or len(pixels) != width * height:
        return None
    grey = np.frombuffer(pixels, np.uint8).reshape(height, width)
    return np.rint(shares(height) @ grey @ shares(width).T).astype(np.uint8).tobytes()


def difference(a: bytes | None, b: bytes | None) -> float:
    """The mean difference of two looks; without bounds where one is missing or they differ in size."""
    if not a or not b or len(a) != len(b):
        return float("inf")
    return float(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).mean())


def alike(a: bytes | None, b: bytes | None) -> bool:
    return difference(a, b) <= NEAR


@F.pandas_udf(BinaryType())
def look(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Looks of a column of grey pictures."""
    whole = lambda v: None if pd.isna(v) else int(v)
    return pd.Series([look_of(None if p is None else bytes(p), whole(w), whole(h)) for p, w, h in zip(pixels, width, height, strict=True)], dtype=object)
