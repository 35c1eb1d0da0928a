"""Small-sample statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, low, high) of the Wilson score interval; all 0 for n = 0."""
    kd, nd = k.cast("double"), F.when(n != 0, n.cast("double"))
    p = kd / nd
    scale = 1 + z * z / nd
    middle = (p + z * z / (2 * nd)) / scale
    reach = z * F.sqrt(p * (1 - p) / nd + z * z / (4 * nd * nd)) / scale
    known = lambda v: F.when(n != 0, v).otherwise(0.0)  # noqa: E731  least and greatest pass over nulls
    return known(p), known(F.greatest(F.lit(0.0), middle - reach)), known(F.least(F.lit(1.0), middle + reach))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of discordant counts b and c; 1 if there are none.

    Terms C(n, i) / 2**n are summed from i = min(b, c) downwards relative to the first, so that large counts neither overflow nor build long arrays of logs.
    """
    n, m = (b + c).cast("double"), F.least(b, c)
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= m, F.ln((n - m + i) / i)).otherwise(0.0))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)).cast("int")),
        start,
        lambda a, i: F.when(i < m, F.struct((a["t"] * (m - i) / (n - m + i + 1)).alias("t"), (a["s"] + a["t"] * (m - i) / (n - m + i + 1)).alias("s"))).otherwise(a),
    )["s"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total * F.exp(logs - n * math.log(2.0))))


def clean_fraction(clean: Column, n: Column) -> Column:
    """Three places, half to even; 0 for an empty split."""
    return F.bround(ratio(clean, n), 3)
