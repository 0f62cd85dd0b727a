"""Readers of annotation, interval, usage, genome, signal and metadata files, with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coords import clean_optional, floor_div, with_chr
from ..operators.tracks import catalog_from_rows

GTF = "Chromosome string, Source string, Feature string, gtf_start bigint, gtf_end bigint, Score string, Strand string, Frame string, attributes string"
POLYA = "transcript_id string, tx_start bigint, tx_end bigint, Chromosome string, Start bigint, End bigint, Strand string, Feature string"
USAGE = "Region string, Site bigint, Strand string, Partners string, SSE double, alpha_count bigint, beta1_count bigint, beta2_count bigint"


def read_gtf(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("gene_id", "transcript_id", "gene_name", "gene_type", "exon_number", "level")) -> DataFrame:
    """GTF lines with 0-based starts; ``gene_biotype`` stands in for a missing ``gene_type``."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="")

    def attribute(name: str):
        return F.nullif(F.regexp_extract("attributes", rf'(?:^|;\s*){name} "?([^";]+)"?', 1), F.lit(""))

    columns = {a: attribute(a) for a in attributes}
    if "gene_type" in columns:
        columns["gene_type"] = F.coalesce(columns["gene_type"], attribute("gene_biotype"))
    for a in ("exon_number", "level"):
        if a in columns:
            columns[a] = columns[a].try_cast("bigint")
    return raw.select("Chromosome", "Feature", (F.col("gtf_start") - 1).alias("Start"), F.col("gtf_end").alias("End"), "Strand", *(c.alias(a) for a, c in columns.items()))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or GTF/GFF by suffix."""
    name = path.rstrip("/").lower().removesuffix(".gz")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".gtf", ".gff", ".gff3")):
        return read_gtf(spark, path)
    raise ValueError(f"unknown annotation format: {path}")


def read_polya(spark: SparkSession, path: str) -> DataFrame:
    """Sites from Parquet or GTF; a ``chr`` column is renamed. Whether sites are linked to genes is for the caller to say."""
    df = read_annotation(spark, path)
    return df.withColumnRenamed("chr", "Chromosome") if "chr" in df.columns and "Chromosome" not in df.columns else df


def read_polya_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=POLYA)


def read_usage_tsv(spark: SparkSession, paths: list[str], tissue_index: int, timepoint_index: int, level: int = 0) -> DataFrame:
    """Usage files with tissue and time point from the parts of their names; equal rows of one file count once.

    ``level`` 1 takes the name of the folder that a file lies in, as of tables that Spark wrote.
    """
    name = F.element_at(F.split("_metadata.file_path", "/"), -1 - level)
    raw = spark.read.csv(paths, sep="\t", header=True, schema=USAGE).select("*", name.alias("file"))
    parts = F.split("file", r"\.")
    token = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.raise_error(F.concat(F.lit("file name has too few parts: "), F.col("file"))).cast("string"))
    number = token(timepoint_index).try_cast("int")
    return raw.dropDuplicates().withColumns({"tissue": token(tissue_index), "timepoint": F.coalesce(number, F.raise_error(F.concat(F.lit("time point isn't a number: "), F.col("file"))).cast("int"))})


def read_bed(spark: SparkSession, path: str, names: tuple[str, ...] = ()) -> DataFrame:
    """chrom, start, end and further ``names``; blank, comment and short lines are skipped; gzip is read by its suffix."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != "") & (F.size(parts) >= 3 + len(names)))
    return lines.select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"), *(parts[3 + i].alias(n) for i, n in enumerate(names)))


def read_fasta(spark: SparkSession, path: str, chunk: int = 65536) -> DataFrame:
    """A genome as chunks (chrom, chunk, seq) of fixed length, upper-cased.

    Files are read by lines, in the splits that Spark makes, so a chromosome may go over many of them. Each split gives
    pieces with their place since its last header; one row per record and split then tells where that stretch begins in
    its chromosome. A line that begins with ``>`` is a header, whose first word is the name; lines before any are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, record, place, held, n_held = None, 0, 0, [], 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal place, held, n_held
            if n_held:
                out.append((*split, record, None, place, "".join(held).upper()))
            place, held, n_held = place + n_held, [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for value, file, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, at) != split:
                    flush()
                    split, record, place = (file, at), 0, 0
                if value.startswith(">"):
                    flush()
                    record, place = record + 1, 0
                    out.append((*split, record, (value[1:].split() or [""])[0], 0, ""))
                elif value:
                    held.append("".join(value.split()))
                    n_held += len(held[-1])
                    if n_held >= chunk:
                        flush()
                if len(out) >= 256:
                    yield batch_of()
                    out = []
        flush()
        if out:
            yield batch_of()

    names = ["file", "at", "record", "name", "place", "piece"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    pieces = lines.mapInArrow(scan, "file string, at bigint, record bigint, name string, place bigint, piece string")
    key, order = ["file", "at", "record"], Window.partitionBy("file").orderBy("at", "record")
    stretches = pieces.groupBy(*key).agg(F.max("name").alias("name"), F.sum(F.length("piece")).cast("long").alias("n"))
    numbered = stretches.withColumn("number", F.count("name").over(order)).filter("number > 0")
    before = Window.partitionBy("file", "number").orderBy("at", "record").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.select(*key, "number", F.first("name", ignorenulls=True).over(Window.partitionBy("file", "number")).alias("chrom"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = pieces.filter("piece != ''").drop("name").join(placed, key).withColumn("start", F.col("offset") + F.col("place")).withColumn("end", F.col("start") + F.length("piece"))
    cut = rows.withColumn("chunk", F.explode(F.sequence(floor_div("start", chunk), floor_div(F.col("end") - 1, chunk))))
    low, high = F.greatest(F.col("chunk") * chunk, F.col("start")), F.least((F.col("chunk") + 1) * chunk, F.col("end"))
    part = F.col("piece").substr((low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    whole = cut.withColumn("part", F.struct(low.alias("low"), part.alias("text"))).groupBy("file", "number", "chrom", "chunk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(with_chr("chrom").alias("chrom"), "chunk", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("seq"))


def read_bedgraph(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Signal tracks (track_index in the order of ``paths``, chrom, start, end, value); NaN counts as 0."""
    parts = []
    for i, path in enumerate(paths):
        raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start bigint, end bigint, value float")
        parts.append(raw.select(F.lit(i).alias("track_index"), "chrom", "start", "end", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).cast("float").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_signal(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """Signal written by ``write_signal``; only the partitions of ``chroms`` are read."""
    df = spark.read.parquet(path)
    return df if chroms is None else df.filter(F.col("chrom").isin(*chroms))


def signal_values(signal: DataFrame, requests: DataFrame) -> DataFrame:
    """Values at single bases (rid, chrom, pos) of ranges; bases without signal and unknown chromosomes are 0."""
    from ..operators.intervals import overlap_join

    hits = overlap_join(requests.select("rid", "chrom", F.col("start").alias("_rs"), F.col("end").alias("_re")), signal.select("chrom", F.col("start").alias("_ss"), F.col("end").alias("_se"), "value"), ["chrom"], ("_rs", "_re"), ("_ss", "_se"))
    spread = hits.select("rid", F.explode(F.sequence(F.greatest("_rs", "_ss"), F.least("_re", "_se") - 1)).alias("pos"), "value")
    bases = requests.select("rid", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return bases.join(spread.groupBy("rid", "pos").agg(F.sum("value").alias("value")), ["rid", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def read_tracks(spark: SparkSession, path: str, default_output: str | None = None) -> DataFrame:
    """A track catalogue from Parquet, CSV, TSV or text with tabs."""
    low = path.lower()
    if low.rstrip("/").endswith(".parquet"):
        return catalog_from_rows(spark.read.parquet(path), default_output)
    if low.endswith((".csv", ".tsv", ".txt")):
        return catalog_from_rows(spark.read.csv(path, sep="," if low.endswith(".csv") else "\t", header=True), default_output)
    raise ValueError(f"unknown metadata format: {path}")


def read_builtin_tracks(spark: SparkSession, folder: str, organism: int | None = None) -> DataFrame:
    """The catalogue that ``write_tracks`` partitioned by organism; None reads all."""
    df = spark.read.parquet(folder)
    return df if organism is None else df.filter(F.col("organism") == organism)


def head_tracks(catalog: DataFrame, output_name: str, count: int) -> DataFrame:
    """The first ``count`` tracks of an output, filled with padding."""
    own = catalog.filter(F.col("output_name") == output_name).select("track_index", "track_name", "strand")
    slots = catalog.sparkSession.range(count).select(F.col("id").alias("track_index"))
    return slots.join(own, "track_index", "left").withColumns({"track_name": F.coalesce("track_name", F.lit("Padding")), "strand": F.coalesce("strand", F.lit("."))})


def read_label_maps(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, number) of a JSON file that holds maps of labels to numbers."""
    maps = T.MapType(T.StringType(), T.LongType())
    schema = T.StructType([T.StructField("class_labels", maps), T.StructField("condition_labels", maps)])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    one = lambda kind: raw.select(F.lit(kind).alias("kind"), F.explode(kind).alias("name", "number"))
    return one("class_labels").unionByName(one("condition_labels"))


def read_mpra(spark: SparkSession, path: str, folds: list[int], fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Forward-strand rows of the given folds; a fraction is chosen by hash."""
    df = spark.read.csv(path, sep="\t", header=True, schema="seq_id string, seq string, mean_value double, fold int, rev int").filter((F.col("rev") == 0) & F.col("fold").isin(*folds))
    return df if fraction is None else df.filter(F.pmod(F.xxhash64("seq_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def clean_columns(df: DataFrame) -> DataFrame:
    """All string columns with null-like words as NULL."""
    return df.select(*(clean_optional(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
