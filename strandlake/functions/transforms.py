"""Signal transforms, prediction scaling, losses and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import C, _c


def power_transform(value: C, exponent: float = 0.75) -> Column:
    return F.pow(_c(value), exponent)


def power_inverse(value: C, exponent: float = 0.75) -> Column:
    return F.pow(_c(value), 1.0 / exponent)


def smooth_clip(value: C, threshold: float = 384.0) -> Column:
    """Above the threshold values grow with the square root only."""
    x = _c(value)
    return F.when(x > threshold, threshold + 2 * F.sqrt(F.greatest(x - threshold, F.lit(0.0)))).otherwise(x)


def smooth_clip_inverse(value: C, threshold: float = 384.0) -> Column:
    x = _c(value)
    return F.when(x > threshold, threshold + F.pow((x - threshold) / 2, 2.0)).otherwise(x)


def scale_prediction(value: C, track_mean: C, resolution: int, power: bool = False) -> Column:
    """From model space to signal space: undo the clip above 10, undo the power for RNA, times mean and resolution."""
    x = _c(value)
    x = F.when(x > 10, F.pow(x + 10, 2.0) / 40).otherwise(x)
    return (F.pow(x, 1 / 0.75) if power else x) * _c(track_mean) * resolution


def scale_target(value: C, track_mean: C, resolution: int, power: bool = False) -> Column:
    """The inverse of ``scale_prediction``."""
    x = _c(value) / (_c(track_mean) * resolution + 1e-8)
    x = F.pow(x, 0.75) if power else x
    return F.when(x > 10, 2 * F.sqrt(F.greatest(10 * x, F.lit(0.0))) - 10).otherwise(x)


def gelu(value: C) -> Column:
    """The sigmoid form."""
    return _c(value) / (1 + F.exp(-1.702 * _c(value)))


def warmup_cosine(step: C, warmup: int, total: int) -> Column:
    """A learning-rate factor: linear up to ``warmup``, then half a cosine down to 0 at ``total``."""
    s = _c(step)
    return F.when(s < warmup, s / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * (s - warmup) / max(1, total - warmup)))))


def warmup_constant(step: C, warmup: int) -> Column:
    return F.when(_c(step) < warmup, _c(step) / max(1, warmup)).otherwise(1.0)


def segment_size(length: C, segments: int) -> Column:
    return F.greatest(F.lit(1), F.floor(_c(length) / segments)).cast("long")


def structure_hash(parts: C) -> Column:
    """The first 16 digits of the SHA-256 of sorted parts."""
    return F.substring(F.sha2(F.array_join(F.array_sort(_c(parts)), "|"), 256), 1, 16)
