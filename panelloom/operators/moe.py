"""The arithmetic of mixtures of experts: encoding, gates and uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _wave(position: Column, dim: Column, width: int) -> Column:
    angle = position / F.pow(F.lit(10000.0), 2 * F.floor(dim / 2) / F.lit(float(width)))
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def sinusoidal_encoding(spark: SparkSession, steps: int, width: int) -> DataFrame:
    """(position, dim, value): sine on even, cosine on odd dimensions."""
    at = spark.range(steps).select(F.col("id").alias("position"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim"))
    return at.withColumn("value", _wave(F.col("position"), F.col("dim"), width))


def encoded(x: Column | str, width: int) -> Column:
    """A window (array of steps, each of `width` features) with the encoding of its step and feature added to each value; nulls stay."""
    return F.transform(x, lambda step, t: F.transform(step, lambda v, i: v + _wave(t, i, width)))


def combine(experts: Column | str, gates: Column | str) -> Column:
    """Sum of experts by their gates, both arrays."""
    return F.aggregate(F.zip_with(experts, gates, lambda e, g: e * g), F.lit(0.0), lambda a, v: a + v)


def expert_uncertainty(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expert, prediction) -> mean and population deviation of each expert's passes."""
    return samples.groupBy(*keys, "expert").agg(F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"))
