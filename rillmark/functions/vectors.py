"""Vectors as arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.text import WHITE, tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _counts(buckets: pd.Series, dimension: pd.Series) -> pd.Series:
    """How often each bucket occurs; Catalyst has no histogram of an array."""
    return pd.Series([np.bincount(np.asarray(b, np.int64), minlength=d).astype(np.float64) for b, d in zip(buckets, dimension, strict=True)])


def hash_embedding(text: Column, dimension: int = 64, white: str = WHITE) -> Column:
    """Counts of tokens by bucket, the bucket being the token's md5 (first 8 digits) modulo ``dimension``."""
    bucket = F.transform(tokens(F.lower(text), white), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("int"))
    return _counts(bucket, F.lit(dimension))
