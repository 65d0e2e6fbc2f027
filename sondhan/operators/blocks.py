"""A stated set of queries against all items, in blocks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_join(
    queries: DataFrame, items: DataFrame, query: str, item: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, query_rows: int = 2_000, item_rows: int = 5_000,
) -> DataFrame:
    """``run`` over every block of queries with every block of items; nothing passes through the driver but two counts.

    Rows go to blocks by a hash of their key (``query``, ``item``), about ``query_rows`` and ``item_rows`` to a block
    whatever the size of the tables, so a task holds two blocks.  A query is sent to each block of items and an
    item to each block of queries; a few thousand queries are one block, and items are then not copied.
    """
    nq, ni = (max(1, math.ceil(n / rows)) for n, rows in ((queries.count(), query_rows), (items.count(), item_rows)))
    block = lambda key, n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("__q", block(query, nq)).withColumn("__i", every(ni)).groupBy("__q", "__i")
    right = items.withColumn("__i", block(item, ni)).withColumn("__q", every(nq)).groupBy("__q", "__i")
    return left.cogroup(right).applyInPandas(run, schema)
