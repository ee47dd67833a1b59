"""Running values over long sequences, such as one session that holds a third of all rows.

A sequence is cut into stretches: range partitions of key and order, written
with the number of their partition. Values are summed up within the stretches,
whose sums - one row a key and stretch - are added up along each key and joined
back. So no task holds a whole sequence, and results equal those of a window
over the key. Orders must be total within a key (give an id last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART = "__part"


def stretches(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """`df` in range partitions of key and order, with the partition's number as column __part."""
    ranged = df.repartitionByRange(F.col(key), *order)
    return materialize(ranged.withColumn(PART, F.spark_partition_id()), "stretches")


def _onto(df: DataFrame, per_stretch: DataFrame, key: str) -> DataFrame:
    """Joins values of (key, stretch); a null key is a key like others."""
    other = per_stretch.withColumnsRenamed({key: "__key", PART: "__other"})
    return df.join(other, df[key].eqNullSafe(other["__key"]) & (df[PART] == other["__other"]), "left").drop("__key", "__other")


def running_sum(cut: DataFrame, key: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the key up to each row; `cut` as from stretches."""
    here = Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, PART).agg(F.sum(value).alias("__sum"))
    before = sums.select(key, PART, F.sum("__sum").over(along).alias("__before"))
    return _onto(cut.withColumn(name, F.sum(value).over(here)), before, key).withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("__before")


def neighbour(cut: DataFrame, key: str, order: list[str], values: list[str], after: bool = True) -> DataFrame:
    """Adds __next, a struct of `values` of the row after (or before) within the key, null at its end."""
    here = Window.partitionBy(key, PART).orderBy(*order)
    along = Window.partitionBy(key).orderBy(PART)
    shift = F.lead if after else F.lag
    row, at = F.struct(*values), F.struct(*order)
    edge = cut.groupBy(key, PART).agg((F.min_by if after else F.max_by)(row, at).alias("__edge"))
    edge = edge.select(key, PART, shift("__edge").over(along).alias("__edge"))
    inner = cut.withColumn("__next", shift(row).over(here))
    return _onto(inner, edge, key).withColumn("__next", F.coalesce("__next", "__edge")).drop("__edge")
