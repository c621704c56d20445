"""Vectors as little-endian 32-bit floats, the way stores with binary columns keep them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("binary")
def to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf("array<float>")
def from_bytes(blobs: pd.Series) -> pd.Series:
    """The vector of each blob; null if its length isn't a multiple of four."""
    return blobs.map(lambda b: None if len(b) % 4 else np.frombuffer(b, "<f4"), na_action="ignore")
