"""Running values over one long order, without putting the order into one task.

Rows are cut into blocks by ranges of the order. Within a block a window does the work;
what a block hands on to the next is one row a block, so that it is carried by a window
over as many rows as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.session import checkpointed

BLOCK = "_block"


def in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their block. Kept in the shared folder, for ranges are sampled."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id()))


def _handed_on(ends: DataFrame, value: Column) -> DataFrame:
    """What each block gets from those before it: ``ends`` has a row a block."""
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(ends.select(BLOCK, value.over(before).alias("_carried")))


def previous(blocks: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``blocks`` with the ``value`` of the row before, null at the very first.

    The value itself must not be null.
    """
    ends = blocks.groupBy(BLOCK).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = _handed_on(ends, F.last("_end"))
    inner = F.lag(value).over(Window.partitionBy(BLOCK).orderBy(*order))
    return blocks.withColumn("_inner", inner).join(carried, BLOCK).withColumn(name, F.coalesce("_inner", "_carried")).drop("_inner", "_carried")


def latest(blocks: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``blocks`` with the last ``value`` that isn't null, at the row or before it."""
    ends = blocks.groupBy(BLOCK).agg(F.max(F.when(value.isNotNull(), F.struct(F.struct(*order).alias("at"), value.alias("v"))))["v"].alias("_end"))
    carried = _handed_on(ends, F.last("_end", ignorenulls=True))
    inner = F.last(value, ignorenulls=True).over(Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_inner", inner).join(carried, BLOCK).withColumn(name, F.coalesce("_inner", "_carried")).drop("_inner", "_carried")


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """The rows with their number in the order, from 0."""
    blocks = in_blocks(rows, order)
    ends = blocks.groupBy(BLOCK).agg(F.count("*").alias("_end"))
    carried = _handed_on(ends, F.sum("_end"))
    inner = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order))
    return blocks.withColumn("_inner", inner).join(carried, BLOCK).withColumn(name, (F.coalesce("_carried", F.lit(0)) + F.col("_inner") - 1).cast("long")).drop("_inner", "_carried", BLOCK)
