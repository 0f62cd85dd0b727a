"""Gene, exon, polyadenylation-site and splice-site annotation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import bin_range, without_version
from .intervals import merge_intervals, overlap_join, point_join


def gene_index(genes: DataFrame, order: str) -> DataFrame:
    """One row per gene id without version; of several the last in ``order`` stays."""
    rows = genes.withColumn("gene_key", without_version("gene_id"))
    last = F.row_number().over(Window.partitionBy("gene_key").orderBy(F.desc(order)))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")


def genes_in_intervals(genes: DataFrame, intervals: DataFrame, gene_types: list[str] | None = None) -> DataFrame:
    """Pairs of interval and overlapping gene; both have chrom, genes gstart and gend, intervals wstart and wend."""
    chosen = genes if gene_types is None else genes.filter(F.col("gene_type").isin(*gene_types))
    return overlap_join(intervals, chosen, ["chrom"], ("wstart", "wend"), ("gstart", "gend"))


def gene_exons(exons: DataFrame) -> DataFrame:
    """Merged exons of each gene: gene_id, start, end, n."""
    return merge_intervals(exons, ["gene_id"], "estart", "eend")


def exon_bins(exons: DataFrame, interval_start: int, n_bins: int, resolution: int) -> DataFrame:
    """(gene_id, bin) for the bins of merged exons that lie in an interval."""
    bins = gene_exons(exons).withColumn("b", bin_range("start", "end", F.lit(interval_start), n_bins, resolution)).filter("b.first < b.last")
    return bins.select("gene_id", F.explode(F.sequence(F.col("b.first"), F.col("b.last") - 1)).alias("bin")).distinct()


def gene_bins(genes: DataFrame, interval_start: int, n_bins: int, resolution: int) -> DataFrame:
    """(gene_id, bin) for the bins of whole genes."""
    bins = genes.withColumn("b", bin_range("gstart", "gend", F.lit(interval_start), n_bins, resolution)).filter("b.first < b.last")
    return bins.select("gene_id", F.explode(F.sequence(F.col("b.first"), F.col("b.last") - 1)).alias("bin")).distinct()


def pas_by_gene_id(pas: DataFrame, genes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sites linked to a gene by id and strand that lie in an interval on its chromosome, relative to its start."""
    linked = pas.withColumn("gene_key", without_version("gene_id")).join(genes.select(without_version("gene_id").alias("gene_key"), "strand"), ["gene_key", "strand"])
    return point_join(linked, intervals, ["chrom"], "pos", ("wstart", "wend")).withColumn("rel", F.col("pos") - F.col("wstart"))


def pas_by_place(pas: DataFrame, genes: DataFrame, downstream: int = 1000) -> DataFrame:
    """Sites on a gene's strand from its start to ``downstream`` bases past its 3' end, with all columns of the gene."""
    reach = genes.withColumns({"lo": F.when(F.col("strand") == "+", F.col("gstart")).otherwise(F.col("gstart") - downstream), "hi": F.when(F.col("strand") == "+", F.col("gend") + downstream).otherwise(F.col("gend"))})
    return point_join(pas, reach, ["chrom", "strand"], "pos", ("lo", "hi")).drop("lo", "hi")


def pas_by_position(pas: DataFrame, genes: DataFrame, intervals: DataFrame, downstream: int = 1000) -> DataFrame:
    """The sites of ``pas_by_place`` that lie within an interval."""
    near = pas_by_place(pas, genes.select("gene_id", "chrom", "strand", "gstart", "gend"), downstream).drop("gstart", "gend")
    return point_join(near, intervals, ["chrom"], "pos", ("wstart", "wend")).withColumn("rel", F.col("pos") - F.col("wstart"))


def pas_for_genes(pas: DataFrame, genes: DataFrame, intervals: DataFrame, linked: bool) -> DataFrame:
    """By gene id where the sites are linked to genes, else by position; (gene, wid, pos, rel)."""
    if linked:
        return pas_by_gene_id(pas, genes, intervals).select(F.col("gene_key").alias("gene"), "wid", "pos", "rel")
    return pas_by_position(pas.drop("gene_id"), genes, intervals).select(F.col("gene_id").alias("gene"), "wid", "pos", "rel")


def pas_in_intervals(pas: DataFrame, intervals: DataFrame, strand: str | None = None) -> DataFrame:
    chosen = pas if strand is None else pas.filter(F.col("strand") == strand)
    return point_join(chosen, intervals, ["chrom"], "pos", ("wstart", "wend"))


def pas_counts(pas: DataFrame) -> DataFrame:
    """Sites per gene and strand."""
    return pas.groupBy(without_version("gene_id").alias("gene"), "strand").agg(F.count("*").alias("n"))


def link_pas(pas: DataFrame, transcripts: DataFrame, order: str) -> DataFrame:
    """Gene columns for sites by transcript id without version; unmatched sites go. Of repeated transcripts the last counts."""
    last = F.row_number().over(Window.partitionBy("tx").orderBy(F.desc(order)))
    mapping = transcripts.withColumn("tx", without_version("transcript_id")).withColumn("_n", last).filter("_n = 1").select("tx", "gene_id", "gene_name", "gene_type")
    return pas.withColumn("tx", without_version("transcript_id")).join(mapping, "tx").drop("tx")


def sites_in_windows(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """Sites (chrom, pos) in half-open windows, with their position in the window."""
    return point_join(sites, windows, ["chrom"], "pos", ("wstart", "wend")).withColumn("rel_pos", F.col("pos") - F.col("wstart"))


def site_usage(usage: DataFrame, conditions: int, order: str) -> DataFrame:
    """Dense arrays per site: usage values (0 where unknown) and a mask by condition; of repeated conditions the last counts."""
    last = usage.groupBy("chrom", "pos", "cond").agg(F.max_by("sse", F.struct(order, "sse")).alias("sse"))
    got = last.groupBy("chrom", "pos").agg(F.map_from_entries(F.collect_list(F.struct("cond", "sse"))).alias("m"))
    index = F.sequence(F.lit(0), F.lit(conditions - 1))
    value = F.transform(index, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return got.select("chrom", "pos", value.alias("vals"), F.transform(index, lambda i: F.try_element_at("m", i).isNotNull()).alias("mask"))


def splice_sites_from_exons(exons: DataFrame) -> DataFrame:
    """Donor and acceptor sites of transcripts with several exons: transcript_id, chrom, pos, site_type.

    On the + strand each exon but the first has an acceptor at its start and each but the last a donor at its last base.
    On the - strand an exon that doesn't begin last has an acceptor at its last base, one that doesn't begin first a donor at its start.
    """
    tx = Window.partitionBy("transcript_id")
    order = tx.orderBy("estart", "eend")
    rows = exons.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(tx), "lo": F.min("estart").over(tx), "hi": F.max("estart").over(tx)}).filter("n > 1")
    site = lambda when, pos, kind: F.when(when, F.struct(F.expr(pos).alias("pos"), F.lit(kind).alias("site_type")))
    plus, minus = F.col("strand") == "+", F.col("strand") != "+"
    made = F.array(
        site(plus & (F.col("k") > 1), "estart", "Acceptor+"), site(plus & (F.col("k") < F.col("n")), "eend - 1", "Donor+"),
        site(minus & (F.col("estart") != F.col("hi")), "eend - 1", "Acceptor-"), site(minus & (F.col("estart") != F.col("lo")), "estart", "Donor-"),
    )
    return rows.withColumn("s", F.explode(F.array_compact(made))).select("transcript_id", "chrom", "s.pos", "s.site_type")


def choose_transcripts(transcripts: DataFrame, protein_coding: bool = True, support: int | None = 1) -> DataFrame:
    """The longest transcript of each gene, of protein-coding and well supported ones."""
    rows = transcripts
    if protein_coding:
        rows = rows.filter("gene_type = 'protein_coding'")
    if support is not None:
        rows = rows.filter(F.col("support") == support)
    rank = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc(F.col("tend") - F.col("tstart")), "transcript_id"))
    return rows.withColumn("_n", rank).filter("_n = 1").drop("_n")


def labels_with_predictions(sites: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels of window positions beside the predictions there. sites: wid, rel_pos, label (the highest counts); predictions: wid, rel_pos and more."""
    labels = sites.groupBy("wid", "rel_pos").agg(F.max("label").alias("label"))
    return labels.join(predictions, ["wid", "rel_pos"])
