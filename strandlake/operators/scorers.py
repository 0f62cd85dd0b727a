"""Variant scorers: DataFrame to DataFrame over prediction tables.

pred: variant_id, bin, track, ref, alt (both alleles in one row, see ``pair_alleles``); variants: variant_id, chrom,
position, ref_bases, alt_bases, interval_start, n_bins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.coords import center_mask, floor_div
from .intervals import within_join


def pair_alleles(pred: DataFrame, place: tuple[str, ...] = ("bin",), fill: bool = False) -> DataFrame:
    """(variant_id, allele, ``place``, track, value) to one row per place and track with ref and alt, without a self-join.

    Places that one allele lacks go; with ``fill`` an alternate value that is missing is 0.
    """
    value = lambda allele: F.max(F.when(F.col("allele") == allele, F.col("value"))).cast("double")
    alt = F.coalesce(value("ALT"), F.lit(0.0)) if fill else value("ALT")
    return pred.groupBy("variant_id", *place, "track").agg(value("REF").alias("ref"), alt.alias("alt")).filter("ref is not null and alt is not null")


def align_alternates(pred: DataFrame, variants: DataFrame) -> DataFrame:
    """Moves the alternate rows of insertions and deletions (bins of one base) to places of the reference.

    Inserted bases share the place of the base before them, where the largest value counts when alleles are paired;
    places that a deletion leaves empty, and those after the end of what an insertion moved, have no row.
    """
    shift = F.length("alt_bases") - F.length("ref_bases")
    last = F.col("position") - 1 - F.col("interval_start") + F.least(F.length("ref_bases"), F.length("alt_bases")) - 1
    known = variants.select("variant_id", shift.alias("_d"), last.alias("_p"), (F.col("interval_end") - F.col("interval_start")).alias("_n"))
    bin_ = F.col("bin")
    moved = F.when((F.col("allele") == "REF") | (bin_ <= F.col("_p")) | (F.col("_d") == 0), bin_).when((F.col("_d") > 0) & (bin_ <= F.col("_p") + F.col("_d")), F.col("_p")).otherwise(bin_ - F.col("_d"))
    return pred.join(known, "variant_id").withColumn("bin", moved.cast("long")).filter((F.col("bin") >= 0) & (F.col("bin") < F.col("_n"))).drop("_d", "_p", "_n")


def in_center(pairs: DataFrame, variants: DataFrame, width: int | None, resolution: int) -> DataFrame:
    """Bins of the centre mask; variants are the smaller side and need no hint, as AQE measures it."""
    masked = variants.withColumn("m", center_mask("position", "interval_start", F.col("n_bins"), width, resolution)).select("variant_id", "m.first", "m.last")
    return pairs.join(masked, "variant_id").filter((F.col("bin") >= F.col("first")) & (F.col("bin") < F.col("last")))


def center_score(pairs: DataFrame, variants: DataFrame, width: int | None, kind: str, resolution: int) -> DataFrame:
    """One of the aggregations over the centre mask, per variant and track."""
    return in_center(pairs, variants, width, resolution).groupBy("variant_id", "track").agg(A.variant_aggregation(kind, "ref", "alt").alias("score"))


def gene_score(pairs: DataFrame, bins: DataFrame, score: Column) -> DataFrame:
    """An aggregate over the bins of each gene: bins has variant_id, gene_id, bin. Genes without bins have no row."""
    return pairs.join(bins, ["variant_id", "bin"]).groupBy("variant_id", "gene_id", "track").agg(score.alias("score"))


def gene_lfc(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    return gene_score(pairs, bins, A.log_fold_change("ref", "alt"))


def gene_active(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    return gene_score(pairs, bins, A.active("ref", "alt"))


def gene_splicing(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    return gene_score(pairs, bins, A.max_abs_change("ref", "alt"))


def center_splicing(pairs: DataFrame, variants: DataFrame, width: int, resolution: int) -> DataFrame:
    return in_center(pairs, variants, width, resolution).groupBy("variant_id", "track").agg(A.max_abs_change("ref", "alt").alias("score"))


def contact_score(contacts: DataFrame, variants: DataFrame, bin_size: int = 128) -> DataFrame:
    """Mean change of log contacts in the variant's column. contacts: variant_id, row_bin, col_bin, track, ref, alt."""
    at = F.least(floor_div(F.col("position") - 1 - F.col("interval_start"), bin_size), F.col("n_bins").cast("long") - 1)
    change = F.abs(F.log2(F.col("alt") + 1) - F.log2(F.col("ref") + 1))
    return contacts.join(variants.select("variant_id", at.alias("col_bin")), ["variant_id", "col_bin"]).groupBy("variant_id", "track").agg(F.avg(change).alias("score"))


def junction_changes(junctions: DataFrame) -> DataFrame:
    """Adds delta, the change of log counts. junctions: variant_id, junction, strand, jstart, jend, track, ref, alt."""
    return junctions.withColumn("delta", F.abs(F.ln(F.col("alt") + 1e-7) - F.ln(F.col("ref") + 1e-7)))


def junction_score(junctions: DataFrame, genes: DataFrame, protein_coding: bool = True) -> DataFrame:
    """Per variant, gene and track the largest change of junctions strictly inside the gene on its strand.

    Also names the junction that is largest in the gene's best track; ties go to the lesser track and junction.
    """
    chosen = genes.filter("gene_type = 'protein_coding'") if protein_coding else genes
    inside = junctions_in_genes(junction_changes(junctions), chosen)
    per = inside.groupBy("variant_id", "gene_id", "track").agg(F.max("delta").alias("score"), F.min_by(F.struct("jstart", "jend"), F.struct(-F.col("delta"), "junction")).alias("j"))
    top = F.min_by("j", F.struct(-F.col("score"), "track")).over(Window.partitionBy("variant_id", "gene_id"))
    return per.withColumn("j", top).select("variant_id", "gene_id", "track", "score", F.col("j.jstart").alias("junction_start"), F.col("j.jend").alias("junction_end"))


def junctions_in_genes(junctions: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs of a junction and a gene on its strand that it lies strictly inside of."""
    return within_join(junctions, genes.select("gene_id", "chrom", "strand", "gstart", "gend"), ["chrom", "strand"], ("jstart", "jend"), ("gstart", "gend"))


def polya_score(coverage: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The largest change of usage over all splits of a gene's sites. coverage: ``by``, gene_id, track, pas, ref, alt (sums per site).

    Ratios without a value count as 0, at both points where they arise; the split after the last site is 0.
    """
    key = [*by, "gene_id", "track"]
    w = Window.partitionBy(*key)
    run = w.orderBy("pas").rowsBetween(Window.unboundedPreceding, 0)
    ratio = coverage.withColumn("c", F.coalesce(F.try_divide(F.col("alt").cast("double"), F.col("ref").cast("double")), F.lit(0.0)))
    split = ratio.select(*key, F.count("*").over(run).alias("k"), F.count("*").over(w).alias("n"), F.sum("c").over(run).alias("prox"), F.sum("c").over(w).alias("tot"))
    x = F.try_divide((F.col("n") - F.col("k")) / F.col("k") * F.col("prox"), F.when(F.col("k") == F.col("n"), 0.0).otherwise(F.col("tot") - F.col("prox")))
    return split.groupBy(*key).agg(F.max(F.coalesce(F.abs(F.log2(x)), F.lit(0.0))).alias("score"))


def pas_windows(
    pas: DataFrame, totals: DataFrame, interval_width: int | Column, width: int = 400, most_genes: int = 22, most_pas: int = 136, least_pas: int = 2, least_coverage: float = 0.8, by: tuple[str, ...] = ()
) -> DataFrame:
    """Bases [first, last) in which each site of a gene is measured. pas: gene_id, strand, rel and ``by``, which names an interval; totals: gene_id, total.

    Genes need ``least_pas`` sites in the interval and the share ``least_coverage`` of all theirs, which isn't asked of
    genes without any; the caps on an interval's genes and a gene's sites are part of the definition.
    """
    gene = [*by, "gene_id"]
    counts = pas.groupBy(*gene).agg(F.count("*").alias("n")).join(totals, "gene_id", "left")
    covered = F.coalesce(F.col("total"), F.lit(0)) == 0
    fit = counts.filter((covered | (F.col("n") / F.when(F.col("total") > 0, F.col("total")) >= least_coverage)) & (F.col("n") >= least_pas)).select(*gene)
    if by:
        fit = fit.withColumn("g", F.row_number().over(Window.partitionBy(*by).orderBy("gene_id"))).filter(F.col("g") <= most_genes).drop("g")
    else:
        fit = fit.orderBy("gene_id").limit(most_genes)
    ranked = pas.join(fit, gene).withColumn("pas", F.row_number().over(Window.partitionBy(*gene).orderBy("rel")) - 1).filter(F.col("pas") < most_pas)
    plus, top = F.col("strand") == "+", F.lit(interval_width) if isinstance(interval_width, int) else interval_width
    last = F.when(plus, F.least(F.col("rel") + 1, top)).otherwise(F.least(F.greatest(F.col("rel"), F.lit(0)) + width, top))
    first = F.when(plus, F.greatest(last - width, F.lit(0))).otherwise(F.greatest(F.col("rel"), F.lit(0)))
    return ranked.withColumns({"first": first.cast("long"), "last": last.cast("long")}).filter("first < last").select(*gene, "pas", "first", "last")


def local_maxima(signal: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Positions above both neighbours (0 beyond the ends) and above their group's mean."""
    w = Window.partitionBy(*by)
    order = w.orderBy(position)
    rows = signal.withColumns({"_l": F.lag(value, 1, 0.0).over(order), "_r": F.lead(value, 1, 0.0).over(order), "_m": F.avg(value).over(w)})
    return rows.filter((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r")) & (F.col(value) > F.col("_m"))).drop("_l", "_r", "_m")


def polya_peak_score(pairs: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """Without annotation: peaks of the mean signal stand for sites; fewer than two peaks score 0. pairs: variant_id, bin, track, ref, alt."""
    mean = pairs.groupBy("variant_id", "bin").agg(((F.avg("ref") + F.avg("alt")) / 2).alias("m"))
    peaks = local_maxima(mean, ["variant_id"], "bin", "m").select("variant_id", "bin")
    w = Window.partitionBy("variant_id", "track")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = pairs.join(peaks, ["variant_id", "bin"]).select("variant_id", "track", F.count("*").over(run).alias("k"), F.count("*").over(w).alias("n"), *(f(c) for c in ("ref", "alt") for f in (lambda c: F.sum(c).over(run).alias(f"{c}_p"), lambda c: F.sum(c).over(w).alias(f"{c}_t"))))
    side = lambda c: F.col(f"{c}_p") / (F.col(f"{c}_t") - F.col(f"{c}_p") + epsilon)
    value = F.abs(F.log2((F.col("n") - F.col("k")) / F.col("k") * side("alt") / (side("ref") + epsilon) + epsilon))
    scores = at.filter("k < n").groupBy("variant_id", "track").agg(F.max(F.coalesce(value, F.lit(0.0))).alias("score"))
    return pairs.select("variant_id", "track").distinct().join(scores, ["variant_id", "track"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def junction_pairs(sites: DataFrame) -> DataFrame:
    """Donor and acceptor sites (seq_id, strand, role, pos, prob) in all ordered pairs of a strand; padding (-1) is left out.

    Sites per strand are capped upstream (top-k), so a group's pairs are bounded.
    """
    valid = sites.filter("pos >= 0")
    d = valid.filter("role = 'donor'").select("seq_id", "strand", F.col("pos").alias("donor_pos"))
    a = valid.filter("role = 'acceptor'").select("seq_id", "strand", F.col("pos").alias("acceptor_pos"))
    ordered = F.when(F.col("strand") == "+", F.col("donor_pos") < F.col("acceptor_pos")).otherwise(F.col("acceptor_pos") < F.col("donor_pos"))
    return d.join(a, ["seq_id", "strand"]).filter(ordered).withColumns({"jstart": F.least("donor_pos", "acceptor_pos"), "jend": F.greatest("donor_pos", "acceptor_pos")})


def top_sites(probs: DataFrame, k: int, threshold: float, pad_to: int) -> DataFrame:
    """Positions of the ``k`` likeliest sites per sequence and class with at least ``threshold``, ascending, padded with -1. probs: seq_id, site_class, pos, prob."""
    rank = F.row_number().over(Window.partitionBy("seq_id", "site_class").orderBy(F.desc("prob"), "pos"))
    top = probs.withColumn("_n", rank).filter(F.col("_n") <= k).groupBy("seq_id", "site_class").agg(F.array_sort(F.collect_list(F.when(F.col("prob") >= threshold, F.col("pos")))).alias("p"))
    return top.select("seq_id", "site_class", F.slice(F.concat("p", F.array_repeat(F.lit(-1).cast("long"), pad_to)), 1, pad_to).alias("positions"))


def union_site_probs(probs: DataFrame) -> DataFrame:
    """Element-wise maximum of reference and alternate probabilities. probs: seq_id, ref_probs, alt_probs."""
    return probs.select("seq_id", F.zip_with("ref_probs", "alt_probs", lambda x, y: F.greatest(x, y)).alias("probs"))


@dataclass(frozen=True)
class Preset:
    """A scorer with its parameters; ``resolution`` follows from the width unless it is given."""

    scorer: str
    output: str
    width: int | None = None
    aggregation: str | None = None
    human_only: bool = False

    @property
    def resolution(self) -> int:
        if self.output.startswith("chip_") or self.output == "contact_maps":
            return 128
        return 1 if self.width is None or self.width <= 2001 else 128

    @property
    def name(self) -> str:
        return f"{self.scorer}({self.output}, {self.width}, {self.aggregation})"


_OPEN = ("atac", "dnase", "chip_tf")


def recommended(organism: str = "human") -> list[Preset]:
    """The scorers to run by default; polyadenylation is for human only."""
    signed = [Preset("center_mask", o, 501, "diff_log2_sum") for o in _OPEN] + [Preset("center_mask", "chip_histone", 2001, "diff_log2_sum")] + [Preset("center_mask", o, 501, "diff_log2_sum") for o in ("cage", "procap")]
    special = [Preset("contact_map", "contact_maps"), Preset("gene_lfc", "rna_seq"), Preset("gene_active", "rna_seq"), Preset("gene_splicing", "splice_sites"), Preset("gene_splicing", "splice_site_usage"), Preset("junction", "splice_junctions")]
    unsigned = [Preset(p.scorer, p.output, p.width, "active_sum") for p in signed]
    return signed + special + unsigned + [Preset("polyadenylation", "rna_seq", human_only=True)] * (organism.strip().lower() in ("human", "homo_sapiens"))
