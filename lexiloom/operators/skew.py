"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows that a broadcast of hot keys may have.
HOT_KEYS = 2_000


def hot_rows(table: DataFrame, count_col: str, least: int, most: int = HOT_KEYS) -> DataFrame:
    """The at most ``most`` rows of ``table`` whose key occurs ``least`` times or more.

    There can be no more than total / least of them, and ``most`` bounds what is
    broadcast; a hot key beyond it goes the way of the others, which AQE may split.
    """
    return table.filter(F.col(count_col) >= least).orderBy(F.col(count_col).desc()).limit(most)


def lookup(left: DataFrame, table: DataFrame, key: str, values: list[str], spread: list[str], count_col: str, least: int = 20_000, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Equi-join ``left`` to ``table`` (unique on ``key``), taking its ``values``.

    The rows of hot keys meet a bounded broadcast and skip the shuffle's key: they are
    spread by a hash of the ``spread`` columns. All other rows are joined by key.
    ``hot`` gives the hot rows where ``table`` is costly to compute once more.
    """
    hot = (hot_rows(table, count_col, least) if hot is None else hot).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = table.select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    kept = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    away = F.when(F.col("_hot").isNull(), F.col(key))
    # the second key is 0 for every row that can match, and spreads those that cannot
    other = F.when(F.col("_away").isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long"))
    joined = kept.withColumn("_away", away).withColumn("_other", other)
    rest = rest.withColumn("_zero", F.lit(0).cast("long"))
    joined = joined.join(rest, (F.col("_away") == F.col("_cold_key")) & (F.col("_other") == F.col("_zero")), "left")
    out = joined.withColumn("_got", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_got").isNotNull())
    return out.select(*[F.col(c) for c in left.columns], *[F.col(f"_got.{v}").alias(v) for v in values])
