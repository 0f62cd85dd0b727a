"""Preparation of splice-site, usage and fold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import fold_window
from .intervals import anti_join_overlap

NONE_LABEL = 4


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), body)[0]


def parse_partners(text: str) -> Column:
    """``{position: count, ...}`` as an array of (p, n); of a repeated position the last count stays."""
    items = F.regexp_extract_all(F.col(text), F.lit(r"(-?[0-9]+)\s*:\s*([0-9]+)"), F.lit(0))
    part = lambda x, i: F.trim(F.split_part(x, F.lit(":"), F.lit(i))).cast("long")
    pairs = F.transform(items, lambda x: F.struct(part(x, 1).alias("p"), part(x, 2).alias("n")))
    return _bound(pairs, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.greatest(F.size(a), F.lit(1))), lambda y: y["p"] == x["p"])))


def site_type(site: str, strand: str, partners: Column) -> Column:
    """Donor or Acceptor by the side with more support; ties are Donor, no partners None. One pass over the partners."""
    zero = F.lit(0).cast("long")
    none = F.struct(*(zero.alias(c) for c in ("n_up", "up", "n_down", "down")))
    above, below = (lambda x: x["p"] > F.col(site)), (lambda x: x["p"] < F.col(site))
    grown = lambda s, x: F.struct(
        (s["n_up"] + above(x).cast("long")).alias("n_up"), (s["up"] + F.when(above(x), x["n"]).otherwise(zero)).alias("up"),
        (s["n_down"] + below(x).cast("long")).alias("n_down"), (s["down"] + F.when(below(x), x["n"]).otherwise(zero)).alias("down"),
    )
    plus = F.col(strand) == "+"

    def verdict(s: Column) -> Column:
        pick = lambda a, b: F.when(plus, s[a]).otherwise(s[b])
        nd, na = pick("n_up", "n_down"), pick("n_down", "n_up")
        return F.when((nd > 0) & (na > 0), F.when(pick("up", "down") >= pick("down", "up"), "Donor").otherwise("Acceptor")).when(nd > 0, "Donor").when(na > 0, "Acceptor").otherwise("None")

    return F.coalesce(F.aggregate(partners, none, grown, verdict), F.lit("None"))


def adjusted_site(site: str, strand: str, kind: str) -> Column:
    """Positions on exon borders: donors on + and acceptors on - move by two bases."""
    move = ((F.col(strand) == "+") & (F.col(kind) == "Donor")) | ((F.col(strand) == "-") & (F.col(kind) == "Acceptor"))
    return F.when(move, F.col(site) - 2).otherwise(F.col(site))


def usage_sites(usage: DataFrame, least_coverage: int, least_alpha: int | None, one_based: bool) -> DataFrame:
    """Sites with a class and enough reads, 0-based. The base of the input must be said, as sources differ."""
    keep = (F.col("label") != NONE_LABEL) & (F.col("alpha") + F.col("beta") >= least_coverage)
    keep = keep if least_alpha is None else keep & (F.col("alpha") >= least_alpha)
    return usage.filter(keep).withColumn("pos", F.col("pos") - (1 if one_based else 0))


def combine_sites(a: DataFrame, b: DataFrame, how: str = "union") -> DataFrame:
    """Distinct sites of either (``union``) or both (``intersect``) sources."""
    return a.union(b).distinct() if how == "union" else a.intersect(b)


def overlap_counts(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys in both, only in the first, only in the second."""
    x, y = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, on, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def expand_both(sites: DataFrame) -> DataFrame:
    """Rows of type Both become a donor and an acceptor."""
    return sites.withColumn("site_type", F.explode(F.when(F.col("site_type") == "Both", F.array(F.lit("Donor"), F.lit("Acceptor"))).otherwise(F.array("site_type"))))


def label_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers 0, 1, ... for the sorted distinct values of a column; the values are few, so one window ranks them."""
    values = df.select(column).distinct().withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(values, column)


def tile_regions(regions: DataFrame, chrom_sizes: DataFrame, width: int = 1048576) -> DataFrame:
    """Regions (chrom, start, end, fold) widened to ``width``; those of short chromosomes go."""
    joined = regions.join(chrom_sizes, "chrom", "left")
    return joined.withColumn("w", fold_window("start", "end", "length", width)).filter("w is not null").select("chrom", "w.start", "w.end", "fold")


def fold_splits(windows: DataFrame, valid: list[str], test: list[str]) -> DataFrame:
    """Splits by fold; validation and test windows that overlap a training window go."""
    named = windows.withColumn("split", F.when(F.col("fold").isin(*valid), "valid").when(F.col("fold").isin(*test), "test").otherwise("train"))
    train = named.filter("split = 'train'")
    rest = named.filter("split != 'train'")
    clean = anti_join_overlap(rest, train.select("chrom", F.col("start").alias("ts"), F.col("end").alias("te")), ["chrom"], ("start", "end"), ("ts", "te"))
    return train.unionByName(clean)


def resize_windows(windows: DataFrame, chrom_sizes: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` around the middle; those beyond a chromosome's ends go, unknown chromosomes too."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    moved = windows.withColumns({"start": mid - width // 2, "end": mid - width // 2 + width})
    return moved.join(chrom_sizes, "chrom").filter((F.col("start") >= 0) & (F.col("end") <= F.col("length"))).drop("length")


def source_tags(sites: DataFrame, gtf: DataFrame, usage: DataFrame, on: list[str]) -> DataFrame:
    """0 where both sources have a site, 1 for annotation only, 2 otherwise."""
    g, u = gtf.select(*on).distinct().withColumn("_g", F.lit(True)), usage.select(*on).distinct().withColumn("_u", F.lit(True))
    tag = F.when(F.col("_g") & F.col("_u"), 0).when(F.col("_g"), 1).otherwise(2)
    return sites.join(g, on, "left").join(u, on, "left").withColumn("source", tag).drop("_g", "_u")


def offset_sweep(a: DataFrame, b: DataFrame, reach: int = 3) -> DataFrame:
    """Shared positions of two site tables (site_type, chrom, pos) for each shift of the second, and the best shift (the least of equals)."""
    moved = b.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("pos", F.col("pos") + F.col("shift"))
    hits = moved.join(a.distinct(), ["site_type", "chrom", "pos"], "left_semi").groupBy("site_type", "shift").agg(F.countDistinct("chrom", "pos").alias("n"))
    return hits.groupBy("site_type").agg(F.max_by("shift", F.struct(F.col("n"), -F.col("shift"))).alias("best_shift"), F.max("n").alias("n"))


def map_partial_columns(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def class_weights(counts: DataFrame, total_bases: Column) -> DataFrame:
    """Median class frequency over each class's own; class 4 is all bases without a site. counts: label, n."""
    background = counts.agg((total_bases - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).select(F.lit(4).cast("long").alias("label"), F.col("n").cast("long"))
    full = counts.select(F.col("label").cast("long"), F.col("n").cast("long")).unionByName(background)
    share = full.crossJoin(full.agg(F.sum("n").alias("all"))).withColumn("freq", F.col("n") / F.col("all"))  # one row
    middle = share.filter("freq > 0").agg(F.median("freq").alias("m"))
    return share.crossJoin(middle).select("label", F.when(F.col("freq") > 0, F.col("m") / F.col("freq")).otherwise(0.0).alias("weight"))  # one row
