"""Bars from raw rows, resampling, and as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = {"D": "day", "W": "week", "M": "month", "Y": "year", "H": "hour"}


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def make_bars(rows: DataFrame, key: str, bucket: Column, value: str, tie: list[str]) -> DataFrame:
    """sym, ts, open, high, low, close, volume (number of rows); ``tie`` orders the rows inside a bar.

    One aggregation with map-side partials; the rows themselves are never sorted.
    """
    at = F.struct(*tie)
    v = F.col(value).cast("double")
    aggregates = [F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"), F.count("*").cast("double").alias("volume")]
    return rows.groupBy(F.col(key).alias("sym"), bucket.alias("ts")).agg(*aggregates)


def events_hourly(spark: SparkSession, directory: str) -> DataFrame:
    return make_bars(read(spark, directory, "events"), "event_type", F.date_trunc("hour", "ts"), "value", ["ts", "event_id"])


def orders_daily(spark: SparkSession, directory: str) -> DataFrame:
    return make_bars(read(spark, directory, "orders"), "o_orderpriority", F.date_trunc("day", "o_orderdate"), "o_totalprice", ["o_orderkey"])


def resample(bars: DataFrame, key: str, order: str, unit: str) -> DataFrame:
    """Coarser bars, left-closed on the calendar."""
    period = F.date_trunc(UNITS[unit], F.col(order)).alias("period")
    volume = [F.sum("volume").alias("volume")] if "volume" in bars.columns else []
    return bars.groupBy(key, period).agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), *volume)


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str], direction: str = "backward") -> DataFrame:
    """Each left row with the columns of the nearest right row at or before it (or at or after it).

    Both sides are united and filled along one sorted window: one shuffle, no join.
    """
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    a = left.select("*", *nothing, F.lit(None).cast("int").alias("__from"))
    b = right.select(key, order, *columns, F.lit(1).alias("__from"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__left", F.col("__from").isNull())
    over = Window.partitionBy(key)
    if direction == "backward":
        over = over.orderBy(order, "__left").rowsBetween(Window.unboundedPreceding, 0)
    else:
        over = over.orderBy(F.col(order).desc(), "__left").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("__from") == 1, F.struct(*columns)), ignorenulls=True).over(over)
    return both.withColumn("__held", held).where("__left").select(*[c for c in left.columns], *(F.col(f"__held.{c}").alias(c) for c in columns))
