"""Coordinates as column expressions: intervals are 0-based and half-open, variant positions are 1-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

#: Named window widths in base pairs (fixed values).
WIDTHS = {
    "2KB": 2048,
    "4KB": 4096,
    "8KB": 8192,
    "16KB": 16384,
    "100KB": 131072,
    "300KB": 262144,
    "500KB": 524288,
    "1MB": 1048576,
}
#: Organism names and their numbers (fixed values).
ORGANISMS = {"human": 0, "homo_sapiens": 0, "mouse": 1, "mus_musculus": 1}


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_div(value: C, by: int | Column) -> Column:
    """Floor division, also for negative values."""
    return F.floor(_c(value) / by).cast("long")


def ceil_div(value: C, by: int | Column) -> Column:
    return F.ceil(_c(value) / by).cast("long")


def parse_interval(text: C) -> Column:
    """``chrom:start-end`` or ``chrom:start-end:strand`` as a struct; other texts give NULL."""
    form = r"^([^:]+):(\d+)-(\d+)(?::([+.-]))?$"
    part = lambda i: F.regexp_extract(_c(text), form, i)
    strand = F.when(part(4) == "", ".").otherwise(part(4))
    made = F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"), strand.alias("strand"))
    return F.when(_c(text).rlike(form), made)


def format_interval(chrom: C, start: C, end: C, strand: C | None = None) -> Column:
    """Text form; an unknown strand ``.`` is left out."""
    base = F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))
    return base if strand is None else F.when(_c(strand).isin("+", "-"), F.concat(base, F.lit(":"), _c(strand))).otherwise(base)


def valid_interval(start: C, end: C) -> Column:
    return (_c(start) >= 0) & (_c(end) > _c(start))


def interval_width(start: C, end: C) -> Column:
    return _c(end) - _c(start)


def interval_center(start: C, end: C) -> Column:
    return floor_div(_c(start) + _c(end), 2)


def contains(start: C, end: C, position: C) -> Column:
    return (_c(position) >= _c(start)) & (_c(position) < _c(end))


def overlaps(a_start: C, a_end: C, b_start: C, b_end: C) -> Column:
    return (_c(a_start) < _c(b_end)) & (_c(b_start) < _c(a_end))


def centered_interval(position: C, width: int) -> Column:
    """Start (not below 0) and end of a window around a position; the end doesn't move when the start is cut."""
    left = _c(position) - width // 2
    return F.struct(F.greatest(F.lit(0), left).cast("long").alias("start"), (left + width).cast("long").alias("end"))


_VARIANT_FORMS = {"default": r"^([^:]+):(\d+):([ACGTNacgtn]+)>([ACGTNacgtn]+)$", "gtex": r"^([^_]*)_(\d+)_([^_]*)_([^_]*)", "gnomad": r"^([^-]*)-(\d+)-([^-]*)-([^-]*)"}


def parse_variant(text: C, form: str = "default") -> Column:
    """A variant text (``default``, ``gtex`` or ``gnomad``) as a struct with upper-case alleles; other texts give NULL."""
    if form not in _VARIANT_FORMS:
        raise ValueError(f"unknown variant format {form!r}")
    part = lambda i: F.regexp_extract(_c(text), _VARIANT_FORMS[form], i)
    made = F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("position"), F.upper(part(3)).alias("ref"), F.upper(part(4)).alias("alt"))
    return F.when(_c(text).rlike(_VARIANT_FORMS[form]), made)


def format_variant(chrom: C, position: C, ref: C, alt: C) -> Column:
    return F.concat(_c(chrom), F.lit(":"), _c(position).cast("string"), F.lit(":"), _c(ref), F.lit(">"), _c(alt))


def variant_kind(ref: C, alt: C) -> Column:
    """Flags is_snv, is_insertion, is_deletion, is_indel from the lengths of the alleles."""
    r, a = F.length(_c(ref)), F.length(_c(alt))
    return F.struct(((r == 1) & (a == 1)).alias("is_snv"), (a > r).alias("is_insertion"), (a < r).alias("is_deletion"), (a != r).alias("is_indel"))


def center_mask(position: C, interval_start: C, n_bins: int | Column, width: int | None, resolution: int) -> Column:
    """First bin and bin after the last of a window of ``width`` around a 1-based position; all bins without a width."""
    n = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    if width is None:
        return F.struct(F.lit(0).cast("long").alias("first"), n.cast("long").alias("last"))
    at = _c(position) - 1 - _c(interval_start) - width // 2
    last = floor_div(at + width - 1, resolution) + 1
    return F.struct(F.greatest(F.lit(0).cast("long"), floor_div(at, resolution)).alias("first"), F.least(n.cast("long"), last).alias("last"))


def bin_range(start: C, end: C, interval_start: C, n_bins: int | Column, resolution: int) -> Column:
    """Bins of a stretch of bases: the first by floor, the last by ceiling, both within the interval."""
    n = (F.lit(n_bins) if isinstance(n_bins, int) else n_bins).cast("long")
    clamp = lambda x: F.least(F.greatest(x, F.lit(0).cast("long")), n)
    return F.struct(clamp(floor_div(_c(start) - _c(interval_start), resolution)).alias("first"), clamp(ceil_div(_c(end) - _c(interval_start), resolution)).alias("last"))


def with_chr(chrom: C) -> Column:
    return F.when(_c(chrom).startswith("chr"), _c(chrom)).otherwise(F.concat(F.lit("chr"), _c(chrom)))


def without_chr(chrom: C) -> Column:
    return F.regexp_replace(_c(chrom), "^chr", "")


def without_version(identifier: C) -> Column:
    return F.split_part(_c(identifier), F.lit("."), F.lit(1))


def clean_optional(value: C) -> Column:
    """Trimmed text, NULL for empty texts and the words nan, none and null."""
    text = F.trim(_c(value))
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def to_int_or_null(value: C) -> Column:
    return _c(value).try_cast("long")


def resolve_organism(name: C, default: int | None = None) -> Column:
    """The organism's number; unknown names give ``default``, or fail without one."""
    low = F.lower(F.trim(_c(name)))
    known = F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in ORGANISMS.items()), F.when(low.isin("0", "1"), low.try_cast("int")))
    return F.coalesce(known, F.lit(default)) if default is not None else F.coalesce(known, F.raise_error(F.concat(F.lit("unknown organism "), low)).cast("int"))


def normalize_width(name: C) -> Column:
    """Base pairs of a named width such as ``100KB``, or of a number that is one of them; NULL otherwise."""
    key = F.upper(F.trim(_c(name).cast("string")))
    return F.coalesce(*(F.when(key.isin(k, str(v)), F.lit(v)) for k, v in WIDTHS.items()))


def fold_window(start: C, end: C, chrom_length: C, width: int = 1048576) -> Column:
    """A window of ``width`` around a region's middle, moved inside the chromosome; NULL if the chromosome is shorter.

    Without a known length the right end isn't moved.
    """
    length, left = _c(chrom_length), interval_center(start, end) - width // 2
    moved = F.when(left < 0, F.lit(0)).when(length.isNotNull() & (left + width > length), length - width).otherwise(left).cast("long")
    fits = length.isNull() | ((length >= width) & (moved + width <= length))
    return F.when(fits, F.struct(moved.alias("start"), (moved + width).cast("long").alias("end")))
