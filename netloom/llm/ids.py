"""Ids on their way through pandas, where a missing one would turn all of a batch into floating-point numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def carried(doc_id: str) -> list[Column]:
    """The columns ``doc_id`` (0 where there is none) and ``missing``."""
    value = F.col(doc_id).cast("long")
    return [F.coalesce(value, F.lit(0)).alias("doc_id"), value.isNull().alias("missing")]


def whole(doc_id, missing) -> pd.arrays.IntegerArray:
    """Ids as they were, whole and missing ones apart."""
    return pd.arrays.IntegerArray(np.array(doc_id, np.int64), np.array(missing, bool))
