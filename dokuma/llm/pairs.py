"""Texts for candidate pairs: only those that some pair needs are shuffled."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 8 MB, whatever the number of pairs


def wanted(rows: DataFrame, key: str, pairs: DataFrame, *columns: str) -> DataFrame:
    """The rows whose ``key`` stands in one of the columns of pairs, and a few others.

    A set of BITS bits is made of the keys by a distributed aggregation (at most a sixty-fourth as many numbers reach the
    driver, a fixed bound) and broadcast; a row whose bit is off is in no pair. The more keys there are, the more other
    rows pass, which costs time only: the join that follows decides.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(BITS)).cast("long")
    ids = reduce(DataFrame.unionByName, (pairs.select(F.col(c).alias(key)) for c in columns)).select(bit.alias("bit"))
    words = ids.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words["slot"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def stands(b: pd.Series) -> pd.Series:
        at = b.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0)

    return rows.where(stands(bit))
