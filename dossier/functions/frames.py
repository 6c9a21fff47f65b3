"""Steps on frames that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (they are counted); else as it is, and Spark chooses by its size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_of(rows: DataFrame, keys: list[str], order: list[Column], n: int, *, salt: Column, place: str, salts: int = 32) -> DataFrame:
    """The first n rows of each key by order, with their place from 1.

    Slices of a key, dealt by a hash of `salt`, are cut to n rows each before they meet, so a key that holds most rows is
    the work of many tasks.
    """
    slices = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(salts)))
    cut = slices.withColumn("_k", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_k") <= n)
    return cut.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n).drop("_s", "_k")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often use names it, as the only element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
