"""Interval joins and merges.

Overlap joins are equi-joins on (key, bin): both sides spread over bins, and a pair is kept only in the first bin that
both share, so no distinct is needed. Catalyst alone would compare all pairs of a chromosome. A bin is as wide as the
ranges are on average, the next power of two, so ranges spread over about two bins each, whatever their widths are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import floor_div

#: Bases whose ranges are merged together; borders between such blocks are settled from one row per block.
MERGE_BLOCK = 1 << 20


def fitting_bin(ranges: DataFrame, start: str, end: str) -> int:
    """The power of two at or above the mean width of the ranges, by one aggregate over the two columns; the least for a stream."""
    if ranges.isStreaming:
        return 64
    mean = ranges.agg(F.avg(F.greatest(F.col(end) - F.col(start), F.lit(1)))).collect()[0][0]
    return 1 << max(6, int(mean or 1).bit_length())


def _binned(df: DataFrame, start: str, end: str, bin_size: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(floor_div(start, bin_size), floor_div(F.col(end) - 1, bin_size))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int | None = None) -> DataFrame:
    """Pairs of rows with equal ``on`` whose half-open ranges overlap. Other column names must differ; empty ranges match nothing."""
    (ls, le), (rs, re) = left_range, right_range
    bin_size = bin_size or max(fitting_bin(left, ls, le), fitting_bin(right, rs, re))
    a = _binned(left.filter(F.col(ls) < F.col(le)), ls, le, bin_size)
    b = _binned(right.filter(F.col(rs) < F.col(re)), rs, re, bin_size)
    hit = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_bin") == F.greatest(floor_div(ls, bin_size), floor_div(rs, bin_size)))
    return a.join(b, [*on, "_bin"]).filter(hit).drop("_bin")


def point_join(points: DataFrame, ranges: DataFrame, on: list[str], position: str, bounds: tuple[str, str], bin_size: int | None = None) -> DataFrame:
    """Pairs of a point and a half-open range that holds it."""
    start, end = bounds
    bin_size = bin_size or fitting_bin(ranges, start, end)
    a = points.withColumn("_bin", floor_div(position, bin_size))
    b = _binned(ranges.filter(F.col(start) < F.col(end)), start, end, bin_size)
    return a.join(b, [*on, "_bin"]).filter((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("_bin")


def within_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int | None = None) -> DataFrame:
    """Pairs of a range on the left that lies strictly inside one on the right."""
    (ls, le), (rs, re) = left_range, right_range
    return point_join(left, right, on, ls, right_range, bin_size).filter((F.col(ls) > F.col(rs)) & (F.col(le) < F.col(re)))


def _matching(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int | None, how: str) -> DataFrame:
    """Rows of ``left`` with or without an overlapping row. Merged ranges on the right keep the bins few."""
    (ls, le), (rs, re) = left_range, right_range
    bin_size = bin_size or max(fitting_bin(left, ls, le), fitting_bin(right, rs, re))
    keyed = left.withColumn("_row", F.struct(*left.columns))
    other = merge_intervals(right.select(*on, F.col(rs).alias("_rs"), F.col(re).alias("_re")), on, "_rs", "_re").select(*on, F.col("start").alias("_rs"), F.col("end").alias("_re"))
    hits = overlap_join(keyed.select(*on, F.col(ls).alias("_ls"), F.col(le).alias("_le")).distinct(), other, on, ("_ls", "_le"), ("_rs", "_re"), bin_size)
    found = hits.select(*(F.col(c).alias(f"_k_{c}") for c in on), "_ls", "_le").distinct()
    same = (left[ls] == found["_ls"]) & (left[le] == found["_le"])
    for c in on:
        same = same & (left[c] == found[f"_k_{c}"])
    return left.join(found, same, how)


def semi_join_overlap(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int | None = None) -> DataFrame:
    return _matching(left, right, on, left_range, right_range, bin_size, "left_semi")


def anti_join_overlap(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_size: int | None = None) -> DataFrame:
    return _matching(left, right, on, left_range, right_range, bin_size, "left_anti")


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, block: int = MERGE_BLOCK) -> DataFrame:
    """Unions of overlapping or touching ranges of each group: by, start, end, n.

    Rows are sorted within blocks of bases only. From one row per block follow the farthest end before a block, which
    says whether its first rows begin a new island, and the number of islands before it. Equal rows keep the number that
    they got where islands begin: sorted anew, as after a spill, they may come in another order.
    """
    rows = df.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), floor_div(start, block).alias("_b"))
    own, chain = [*by, "_b"], Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*own).agg(F.max("_e").alias("_far")).withColumn("_carry", F.max("_far").over(chain)).drop("_far")
    order = Window.partitionBy(*own).orderBy("_s", "_e")
    sorted_ = same_keys(rows, reach, own).withColumns({"_i": F.row_number().over(order), "_top": F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    before = F.greatest("_carry", "_top")  # null if both are
    marked = sorted_.withColumn("_new", F.when(before.isNull() | (F.col("_s") > before), 1).otherwise(0))
    local = marked.withColumn("_k", F.sum("_new").over(Window.partitionBy(*own).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy(*own, "_k").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count("*").alias("_n"))
    islands = parts.groupBy(*own).agg(F.max("_k").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(chain), F.lit(0))).drop("_all")
    numbered = same_keys(parts, islands, own).withColumn("_island", F.col("_base") + F.col("_k"))
    return numbered.groupBy(*by, "_island").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.sum("_n").alias("n")).drop("_island")


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal or null keys."""
    other = right.withColumnsRenamed({c: f"{c}__" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(other[f"{c}__"])
    return left.join(other, same).drop(*(f"{c}__" for c in on))


def overlap_flag(left_start: Column, left_end: Column, starts: Column, ends: Column) -> Column:
    """Whether a range overlaps any of the ranges in two arrays of one row."""
    return F.exists(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: (x["s"] < left_end) & (left_start < x["e"]))
