"""Running sums and minima over sorted rows, in ranges: no window holds a whole group.

Rows are sorted by (group, order) in ranges, one for each task, and saved with their range's number: a group of any size is many
ranges, and a range may hold many groups. Inside a range a window goes over its part of a group; the parts' totals, one row
for each range and group in it, are scanned in the order of ranges; both together are the scan of the whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.session import checkpoint_folder

PART = "__part"


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def ranged(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with the number of their range. Rows that are equal in group and order are in one range."""
    checkpoint_folder(rows.sparkSession)
    return rows.repartitionByRange(*_columns([*group, *order])).withColumn(PART, F.spark_partition_id()).checkpoint()


def _with_parts(rows: DataFrame, totals: DataFrame, group: Sequence[str]) -> DataFrame:
    side = totals.select(*(F.col(c).alias(f"__g_{c}") for c in group), F.col(PART).alias("__p"), *(c for c in totals.columns if c not in (*group, PART)))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group), F.col(PART) == F.col("__p"))
    return rows.join(side, on).drop("__p", *(f"__g_{c}" for c in group))


def running_sums(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], values: Mapping[str, Column], inclusive: bool = True) -> DataFrame:
    """``rows`` (ranged) with the sum of each of ``values`` over the rows of the group up to each row, itself included or not."""
    here = Window.partitionBy(PART, *group).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ahead = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(PART, *group).agg(*(F.sum(v).alias(f"__t_{k}") for k, v in values.items()))
    totals = totals.select(PART, *group, *(F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__b_{k}") for k in values))
    inner = rows.withColumns({f"__i_{k}": F.coalesce(F.sum(v).over(here), F.lit(0)) for k, v in values.items()})
    out = _with_parts(inner, totals, group).withColumns({k: F.col(f"__i_{k}") + F.col(f"__b_{k}") for k in values})
    return out.drop(*(f"__i_{k}" for k in values), *(f"__b_{k}" for k in values))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], into: str) -> DataFrame:
    """``rows`` with their 1-based place in the group by ``order``."""
    return running_sums(ranged(rows, group, order), group, order, {into: F.lit(1).cast("long")}).drop(PART)


def later_minimum(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: Column, into: str) -> DataFrame:
    """``rows`` (ranged) with the least ``value`` of the group from each row on."""
    here = Window.partitionBy(PART, *group).orderBy(*_columns(order)).rowsBetween(0, Window.unboundedFollowing)
    after = Window.partitionBy(*group).orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    totals = rows.groupBy(PART, *group).agg(F.min(value).alias("__t")).select(PART, *group, F.min("__t").over(after).alias("__after"))
    inner = rows.withColumn("__here", F.min(value).over(here))
    return _with_parts(inner, totals, group).withColumn(into, F.least("__here", "__after")).drop("__here", "__after")
