"""Running sums over all rows in a global or per-group order, without putting a group into one task.

Rows are cut into ranges of the order; a range's sum is known from one aggregate, the sums before each range from a
window over the ranges (few rows), and only the sums inside a range need its rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, groups: list[str], part: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of that column over all rows that come before, within the groups.

    ``part`` numbers the ranges in ascending order: a row of a lesser part comes before all rows of a greater one.
    """
    keys = [*groups, part]
    totals = df.groupBy(*keys).agg(*(F.sum(c).alias(f"{n}__part") for n, c in sums.items()))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(k).alias(f"{k}__k") for k in keys), *(F.coalesce(F.sum(f"{n}__part").over(before), F.lit(0)).alias(f"{n}__start") for n in sums))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__k")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}__in") for n, c in sums.items())).join(starts, condition)
    return out.select(*df.columns, *((F.col(f"{n}__start") + F.col(f"{n}__in")).alias(n) for n in sums))
