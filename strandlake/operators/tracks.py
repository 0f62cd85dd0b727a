"""Track metadata catalogues and metadata-driven selection of signal tracks.

A catalogue is a DataFrame (organism, output_name, track_index, track_name, strand, extras map); signals are long rows
(seq_id, output_name, resolution, bin, track_index, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import clean_optional, resolve_organism

CORE = ("organism", "output_name", "track_index", "track_name", "strand")
KEY = ("organism", "output_name")
PADDING = "padding"
#: Column order of tidy score tables (fixed values).
TIDY = (
    "variant_id", "scored_interval", "gene_id", "gene_name", "gene_type", "gene_strand", "junction_start", "junction_end", "output_type", "variant_scorer", "track_name", "track_strand",
    "assay_title", "ontology_curie", "biosample_name", "biosample_type", "transcription_factor", "histone_mark", "gtex_tissue", "raw_score",
)


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.try_element_at("extras", F.lit(name))


def matches(df: DataFrame, predicate: Column | None = None, **criteria: object) -> Column:
    """A value matches by equality, a list by membership, None by absence; all must hold. Missing values don't match values."""
    found = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    for name, wanted in criteria.items():
        field = _field(df, name)
        one = field.isNull() if wanted is None else field.isin(*wanted) if isinstance(wanted, list | tuple | set) else field == F.lit(wanted)
        found = found & F.coalesce(one, F.lit(False))
    return found


def reindex(tracks: DataFrame, order: str = "track_index") -> DataFrame:
    """Numbers tracks 0, 1, ... within organism and output."""
    return tracks.withColumn("track_index", (F.row_number().over(Window.partitionBy(*KEY).orderBy(order, "track_name")) - 1).cast("long"))


def catalog_from_rows(rows: DataFrame, default_output: str | None = None, default_organism: int = 0) -> DataFrame:
    """A catalogue from loose columns: aliases of output, name, strand and index, cleaned values, other columns as extras."""

    def first(*names: str) -> Column:
        have = [clean_optional(F.col(n).cast("string")) for n in names if n in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    used = {"output_type", "output_name", "organism", "track_index", "index", "track_name", "name", "strand", "track_strand", "extras"}
    extras = [c for c in rows.columns if c not in used]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), clean_optional(F.col(c).cast("string")).alias("value")) for c in extras)) if extras else F.array().cast("array<struct<key:string,value:string>>")
    index = first("track_index", "index").try_cast("long")
    made = rows.select(
        resolve_organism(first("organism"), default_organism).alias("organism"), F.coalesce(first("output_type", "output_name"), F.lit(default_output)).alias("output_name"), index.alias("track_index"),
        F.coalesce(first("track_name", "name"), F.concat(F.lit("track_"), index.cast("string"))).alias("track_name"), F.coalesce(first("strand", "track_strand"), F.lit(".")).alias("strand"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("extras"),
    )
    return reindex(made)


def catalog_from_dataframe(df: DataFrame, names: dict[str, str] | None = None, default_output: str | None = None) -> DataFrame:
    """A catalogue from a DataFrame whose columns are renamed by ``names`` (own name to a catalogue's) first."""
    unknown = set(names or {}) - set(df.columns)
    if unknown:
        raise ValueError(f"no columns {', '.join(sorted(unknown))}")
    return catalog_from_rows(df.withColumnsRenamed(names or {}), default_output)


def tracks_of_output(catalog: DataFrame, output_name: str, organism: int | None = None) -> DataFrame:
    """The tracks of one output in order of their numbers, of one organism or all."""
    own = catalog.filter(F.col("output_name") == output_name)
    return own if organism is None else own.filter(F.col("organism") == organism)


def known_outputs(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The tracks of the outputs that are named; others go."""
    return catalog.filter(F.col("output_name").isin(*names))


def named_outputs(heads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Outputs of a model (output_name, resolution, track_index) with the number of their tracks and of those the catalogue names."""
    named = heads.select("output_name", "resolution", "track_index").distinct().join(catalog.select("output_name", "track_index", "track_name"), ["output_name", "track_index"], "left")
    return named.groupBy("output_name", "resolution").agg(F.count("*").alias("n_tracks"), F.count("track_name").alias("n_named"))


def metadata_frame(catalog: DataFrame, **fixed: str) -> DataFrame:
    """Track metadata as plain columns: name, strand and ``fixed`` ones, as of synthetic splice tracks."""
    return catalog.select(F.col("track_name").alias("name"), "strand", *(F.lit(v).alias(k) for k, v in fixed.items()))


def join_with_fallback(left: DataFrame, values: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """``value`` by all of the ``exact`` keys, else the largest by the ``loose`` ones alone; NULL where neither is found."""
    by_exact = values.groupBy(*exact).agg(F.max(value).alias("_exact"))
    by_loose = values.groupBy(*loose).agg(F.max(value).alias("_loose"))
    return left.join(by_exact, exact, "left").join(by_loose, loose, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def get_tracks(catalog: DataFrame, output_name: str, organism: int, count: int, strict: bool = False) -> DataFrame:
    """Exactly ``count`` tracks of an output: longer lists are cut, shorter ones filled with padding, or fail when strict."""
    own = catalog.filter((F.col("output_name") == output_name) & (F.col("organism") == organism)).select("track_index", "track_name", "strand", "extras")
    slots = catalog.sparkSession.range(count).select(F.col("id").alias("track_index"))
    name = F.col("track_name") if not strict else F.coalesce("track_name", F.raise_error(F.lit("too few tracks")).cast("string"))
    filled = slots.join(own, "track_index", "left").withColumn("track_name", F.coalesce(name, F.lit("Padding")))
    return filled.withColumns({"strand": F.coalesce("strand", F.lit(".")), "organism": F.lit(organism), "output_name": F.lit(output_name)})


def add_tracks(catalog: DataFrame, more: DataFrame) -> DataFrame:
    """Replaces the tracks of each organism and output that ``more`` has."""
    return reindex(catalog.join(more.select(*KEY).distinct(), list(KEY), "left_anti").unionByName(more))


def outputs(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("organism", "output_name").agg(F.count("*").alias("n_tracks"))


def is_padding(name: str = "track_name") -> Column:
    return F.lower(F.trim(name)) == PADDING


def strip_padding(tracks: DataFrame) -> DataFrame:
    return reindex(tracks.filter(~is_padding()))


def mask(tracks: DataFrame, predicate: Column | None = None, **criteria: object) -> DataFrame:
    return tracks.withColumn("selected", matches(tracks, predicate, **criteria))


def indices(tracks: DataFrame, predicate: Column | None = None, **criteria: object) -> DataFrame:
    """Matching track numbers as one array per organism and output."""
    chosen = tracks.filter(matches(tracks, predicate, **criteria))
    return chosen.groupBy(*KEY).agg(F.array_sort(F.collect_list("track_index")).alias("indices"))


def select(signal: DataFrame, tracks: DataFrame, predicate: Column | None = None, **criteria: object) -> DataFrame:
    """Signal rows of the matching tracks, renumbered; metadata of one head, so tracks are few beside the signal."""
    chosen = tracks.filter(matches(tracks, predicate, **criteria)).select(*KEY, "track_index", "track_name")
    rank = (F.row_number().over(Window.partitionBy(*KEY).orderBy("track_index")) - 1).cast("long")
    numbered = chosen.withColumn("new_index", rank)
    return signal.join(numbered, [c for c in (*KEY, "track_index") if c in signal.columns]).drop("track_index").withColumnRenamed("new_index", "track_index")


def combine(left: DataFrame, right: DataFrame, on: list[str], how: Callable[[Column, Column], Column]) -> DataFrame:
    """Element-wise arithmetic of two signals on equal keys."""
    other = right.select(*on, F.col("value").alias("_v"))
    return left.join(other, on).withColumn("value", how(F.col("value"), F.col("_v"))).drop("_v")


def preferred_resolution(signal: DataFrame, order: tuple[int, ...] = (128, 1)) -> DataFrame:
    """Rows of the first resolution in ``order`` that an output has."""
    rank = F.coalesce(*(F.when(F.col("resolution") == r, i) for i, r in enumerate(order)), F.lit(len(order)))
    least = signal.withColumn("_r", rank).groupBy("seq_id", "output_name").agg(F.min_by("resolution", F.struct("_r", "resolution")).alias("resolution"))
    return signal.join(least, ["seq_id", "output_name", "resolution"])


def tidy_scores(scores: DataFrame, tracks: DataFrame, match_gene_strand: bool = False) -> DataFrame:
    """One row per score and track with metadata, in the fixed column order.

    scores: variant_id, scored_interval, variant_scorer, output_type, scores (array) and optional gene and junction
    columns. Unknown tracks are named ``track_i`` with strand ``.``. With ``match_gene_strand`` rows on the other strand go.
    """
    meta = tracks.select(F.col("output_name").alias("output_type"), "track_index", "track_name", F.col("strand").alias("track_strand"), "extras")
    rows = scores.select("*", F.posexplode("scores").alias("_i", "raw_score")).drop("scores").withColumn("track_index", F.col("_i").cast("long")).drop("_i")
    joined = rows.join(meta, ["output_type", "track_index"], "left")
    named = joined.withColumns({"track_name": F.coalesce("track_name", F.concat(F.lit("track_"), F.col("track_index").cast("string"))), "track_strand": F.coalesce("track_strand", F.lit("."))})
    if match_gene_strand and "gene_strand" in named.columns:
        named = named.filter(F.col("gene_strand").isNull() | (F.col("track_strand") == ".") | (F.col("track_strand") == F.col("gene_strand")))
    extra = lambda c: F.try_element_at("extras", F.lit(c))
    return named.select(*((F.col(c) if c in named.columns else extra(c) if c in ("assay_title", "ontology_curie", "biosample_name", "biosample_type", "transcription_factor", "histone_mark", "gtex_tissue") else F.lit(None).cast("string")).alias(c) for c in TIDY), "track_index")
