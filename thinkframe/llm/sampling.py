"""Bounded training samples and training in one task.

Classifiers here are fitted on a sample of labelled rows whose expected size
is a parameter. Rows are chosen by a hash of their key, so reruns agree, and
only keys and labels are read to choose them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def fold(key: Column, of: int) -> Column:
    """Remainder of the unsigned crc32 of the key's text; null key: null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of))


def kept_share(key: Column, share: Column | float, seed: int) -> Column:
    """True for about ``share`` of all keys, by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(SCALE)) < F.lit(SCALE) * share


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes:
    """``fit`` over all ``rows`` (a bounded sample) in one task; its bytes."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fit(frame)]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(one, "model binary").first()
    return bytes(found["model"]) if found else b""
