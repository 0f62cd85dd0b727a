"""Transforms of whole signal tracks that need one number of each track; the number comes from a partial aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transforms as X
from .intervals import same_keys


def _with_number(signal: DataFrame, by: list[str], number) -> DataFrame:
    """Adds ``_x``, an aggregate over each track."""
    return same_keys(signal, signal.groupBy(*by).agg(number.alias("_x")), by)


def normalize_to_total(signal: DataFrame, value: str, by: list[str], total: float = 1e8) -> DataFrame:
    """Values scaled so that each track sums to ``total``; a track that sums to 0 stays."""
    scaled = F.when(F.col("_x") == 0, F.col(value)).otherwise(F.col(value) * total / F.col("_x"))
    return _with_number(signal, by, F.sum(value)).withColumn(value, scaled).drop("_x")


def mean_normalize(signal: DataFrame, value: str, by: list[str], epsilon: float = 1e-8) -> DataFrame:
    """Values over the mean of the positive ones of their track; a track without such stays."""
    scaled = F.when(F.col("_x").isNull(), F.col(value)).otherwise(F.col(value) / (F.col("_x") + epsilon))
    return _with_number(signal, by, F.avg(F.when(F.col(value) > 0, F.col(value)))).withColumn(value, scaled).drop("_x")


def atac_pipeline(signal: DataFrame, value: str, by: list[str], total: float = 1e8, threshold: float = 384.0) -> DataFrame:
    """For accessibility: scale to the total, over the mean, soft clip."""
    return mean_normalize(normalize_to_total(signal, value, by, total), value, by).withColumn(value, X.smooth_clip(value, threshold))


def rna_pipeline(signal: DataFrame, value: str, by: list[str], exponent: float = 0.75, threshold: float = 384.0) -> DataFrame:
    """For expression: over the mean, power, soft clip."""
    powered = mean_normalize(signal, value, by).withColumn(value, X.power_transform(value, exponent))
    return powered.withColumn(value, X.smooth_clip(value, threshold))
