"""One ranking from several differently-scaled scores by ideal points (problem 2).

Within each search every score is winsorised at both ends, moved to start at its
lower bound, vector-normalised, and each article is measured against the ideal
point (all scores at their best) and the anti-ideal point; the rank follows the
relative closeness d- / (d+ + d-).

Winsorising at the upper end makes an article that is far ahead on one score no
better than one that merely leads there, and moving the origin keeps a score whose
values are all near 96 from losing its say against one that starts at 0.  Scores
that are constant in a search have no spread and drop out of its distances.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondhan.operators.numbering import number_rows


def ideal_point_ranking(
    df: DataFrame, search: str, item: str, scores: Sequence[str], weights: Sequence[float] | None = None,
    low: float = 0.05, high: float = 0.85, k: int | None = None,
) -> DataFrame:
    """(search, item, closeness, rank), ranks from 1; the first ``k`` only if given.

    ``low`` and ``high`` are the winsor quantiles of each score within its search, over its values
    that are not null (exact up to 10,000 distinct values, within 1/10,000 of the rows beyond).
    Null and NaN scores count as the lowest.  Repeated rows of an item count once (its best values).  Rows
    without search or item are ignored; ties in closeness go to the smaller item.  Bounds and norms are aggregates with
    map-side combine; with ``k`` a window limit prunes before the shuffle, without it all rows are
    numbered by counted ranges, so a search may hold any share of the rows.
    """
    weights = list(weights or [1.0] * len(scores))
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"s{i}") for i, s in enumerate(scores)]
    one = df.filter(F.col(search).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(search).alias("g"), F.col(item).alias("i")).agg(*clean)
    quantile = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(10000))
    bounds = one.groupBy("g").agg(*[quantile(f"s{i}", q).alias(f"{name}{i}") for i in range(len(scores)) for name, q in (("lo", low), ("hi", high))])
    won = one.join(bounds, "g").select(
        "g", "i",  # least() skips nulls, so a null score is told apart first
        *[F.when(F.col(f"s{i}").isNull(), 0.0).otherwise(F.greatest(F.least(F.col(f"s{i}"), F.col(f"hi{i}")), F.col(f"lo{i}")) - F.col(f"lo{i}")).alias(f"x{i}") for i in range(len(scores))],
    )
    norms = won.groupBy("g").agg(*[F.sqrt(F.sum(F.col(f"x{i}") ** 2)).alias(f"norm{i}") for i in range(len(scores))], *[F.max(f"x{i}").alias(f"top{i}") for i in range(len(scores))])
    far = won.join(norms, "g")
    v = [F.when(F.col(f"norm{i}") > 0, w * F.col(f"x{i}") / F.col(f"norm{i}")).otherwise(0.0) for i, w in enumerate(weights)]
    top = [F.when(F.col(f"norm{i}") > 0, w * F.col(f"top{i}") / F.col(f"norm{i}")).otherwise(0.0) for i, w in enumerate(weights)]
    plus = F.sqrt(reduce(lambda a, b: a + b, [(t - x) ** 2 for t, x in zip(top, v, strict=True)]))
    minus = F.sqrt(reduce(lambda a, b: a + b, [x**2 for x in v]))
    ranked = far.select("g", "i", F.coalesce(F.try_divide(minus, plus + minus), F.lit(0.0)).alias("closeness"))
    if k is not None:
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("closeness"), "i"))).filter(F.col("rank") <= k)
    else:
        ranked = number_rows(ranked, ["g", F.desc("closeness"), "i"], "__n")
        first = ranked.groupBy("g").agg(F.min("__n").alias("__first"))
        ranked = ranked.join(first, "g").withColumn("rank", (F.col("__n") - F.col("__first") + 1).cast("int"))
    return ranked.select(F.col("g").alias(search), F.col("i").alias(item), "closeness", "rank")
