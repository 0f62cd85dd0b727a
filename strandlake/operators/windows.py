"""Genome tiles, stitching, labelled windows, in-silico mutagenesis and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import floor_div
from .intervals import same_keys

BACKGROUND = 4
#: Tiles that one row becomes at once, and that one task makes.
TILE_RUN, TILES_PER_TASK = 1 << 12, 1 << 21
#: Chromosomes of about one length whose tiles take turns, and starts that are made at once with them.
TILE_GROUP, TILE_TURNS = 256, 1 << 4


def _starts(rows: DataFrame, name: str, first: str, step: int, most: int) -> DataFrame:
    """A row for each ``step`` from ``first`` on, below ``most`` bases more and the length."""
    return rows.withColumn(name, F.explode(F.sequence(F.col(first), F.least(F.col(first) + most, F.col("length")) - 1, F.lit(step).cast("long"))))


def tiles(chroms: DataFrame, window: int, crop: int, *more: str) -> DataFrame:
    """Windows of each chromosome (chrom, length) whose kept middles follow each other from 0 past the end; ``more`` columns go along.

    A short table of chromosomes is one partition, and one chromosome may have most of the tiles. So runs of tiles are dealt
    out before they become rows, in as many partitions as the lengths ask for, by one aggregate. Chromosomes of about one
    length are gathered first and take turns at each start: equal starts follow each other and chromosomes come in a cycle,
    which any columnar file stores in a small part of what the same rows take chromosome by chromosome.
    """
    step, some = window - 2 * crop, chroms.filter("length > 0")
    own, columns = list(dict.fromkeys(("chrom", "length", *more))), ("chrom", "window_start", "window_end", "keep_start", "keep_end")
    count = F.ceil((F.col("length") + crop) / step)
    size = F.floor(8 * F.log2(count + 1))  # lengths of one size differ by a tenth at most
    sizes = {} if chroms.isStreaming else {r[0]: (r[1], r[2]) for r in some.groupBy(size.alias("_size")).agg(F.sum(count), F.count("*")).collect()}
    parts = -(-int(sum(n for n, _ in sizes.values())) // TILES_PER_TASK)
    if parts > 1:
        groups = F.create_map(*(F.lit(x) for size_, (_, n) in sizes.items() for x in (size_, -(-n // TILE_GROUP))))
        some = some.withColumn("_size", size).groupBy("_size", F.pmod(F.hash("chrom", "length"), groups[F.col("_size")]).alias("_group")).agg(F.collect_list(F.struct(*own)).alias("_own"))
        some = some.withColumn("length", F.array_max(F.transform("_own", lambda x: x["length"])))
    runs = some.withColumn("_run", F.explode(F.sequence(F.lit(-crop).cast("long"), F.col("length") - 1, F.lit(step * TILE_RUN).cast("long"))))
    dealt = runs.repartition(parts, "_size", "_group", "_run") if parts > 1 else runs
    if parts > 1:
        # What one row becomes within one piece of generated code lies in memory together; each coalesce() begins another piece.
        dealt = _starts(dealt, "_turn", "_run", step * TILE_TURNS, step * TILE_RUN).coalesce(parts)
        rows = _starts(dealt, "window_start", "_turn", step, step * TILE_TURNS).coalesce(parts).select("window_start", F.inline("_own"))
    else:
        rows = _starts(dealt, "window_start", "_run", step, step * TILE_RUN)
    kept = (F.col("window_start") < F.col("length")) & (F.col("window_start") + window - crop > 0) & (F.col("window_start") + crop < F.col("length"))
    ends = {"window_end": F.col("window_start") + window, "keep_start": F.lit(crop).cast("long"), "keep_end": F.lit(window - crop).cast("long")}
    return rows.filter(kept).withColumns(ends).select(*columns, *more)


def stitch(pred: DataFrame, chroms: DataFrame, crop: int, window: int, resolution: int) -> DataFrame:
    """Kept bins of tile predictions (chrom, window_start, i, track, value) at their place; bins past length div resolution go."""
    keep = (F.col("i") * resolution >= crop) & (F.col("i") * resolution < window - crop)
    placed = pred.filter(keep).withColumn("bin", floor_div("window_start", resolution) + F.col("i"))
    return placed.join(chroms, "chrom").filter((F.col("bin") >= 0) & (F.col("bin") < F.floor(F.col("length") / resolution))).select("chrom", "bin", "track", "value")


def stitch_tiles(pred: DataFrame, crop: int, window: int, resolution: int) -> DataFrame:
    """As ``stitch``, for tiles whose values lie in one array: a row is a tile's kept stretch, ``n`` bins from ``bin`` on.

    pred: chrom, length, window_start, track, values. No bin is a row of its own and no chromosome is looked up.
    """
    n_bins, at = -(-window // resolution), floor_div("window_start", resolution)
    first = F.greatest(F.lit(-(-crop // resolution)), -at)
    last = F.least(F.lit(min(n_bins, -(-(window - crop) // resolution))), F.floor(F.col("length") / resolution) - at, F.size("values"))
    placed = pred.withColumns({"bin": at + first, "n": last - first, "_first": first}).filter("n > 0")
    return placed.select("chrom", "track", "bin", "n", F.slice("values", F.col("_first").cast("int") + 1, F.col("n").cast("int")).alias("values"))


def ism_variants(regions: DataFrame) -> DataFrame:
    """All single-base changes of sequences (seq_id, start, sequence): one row per position and other base; N has none."""
    at = F.posexplode(F.filter(F.split(F.upper("sequence"), ""), lambda x: x != ""))
    rows = regions.select("seq_id", "start", at.alias("i", "ref"))
    alts = rows.filter(F.col("ref").isin("A", "C", "G", "T")).withColumn("alt", F.explode(F.array(*(F.lit(b) for b in "ACGT")))).filter("alt != ref")
    return alts.select("seq_id", (F.col("start") + F.col("i") + 1).alias("position"), "ref", "alt")


def ism_matrix(scores: DataFrame, multiply_by_sequence: bool = False) -> DataFrame:
    """Scores (seq_id, position, ref, alt, score) as one row per position with columns A, C, G, T.

    A third of the mean score of a position is taken off all its cells. With ``multiply_by_sequence`` only the cell of
    the reference base stays.
    """
    cells = scores.groupBy("seq_id", "position", "ref").pivot("alt", ["A", "C", "G", "T"]).agg(F.max("score"))
    present = F.filter(F.array("A", "C", "G", "T"), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present) / 3
    out = cells.withColumn("_m", mean)
    value = lambda b: F.coalesce(F.col(b), F.lit(0.0)) - F.col("_m")
    return out.select("seq_id", "position", *((F.when(F.col("ref") == b, value(b)).otherwise(0.0) if multiply_by_sequence else value(b)).alias(b) for b in "ACGT"))


def centered_logo(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores less the mean of their position's alternates; with ``by``, as for scorers that score genes, of each of its values."""
    return scores.withColumn("centered", F.col("score") - F.avg("score").over(Window.partitionBy("seq_id", *by, "position")))


def gene_logo(scores: DataFrame, label: str = "label") -> DataFrame:
    """The logo of each gene of a gene scorer, over its own largest value. scores: seq_id, gene_id, position, score and the alternate base."""
    named = scores.withColumn(label, F.concat_ws(":", F.col("seq_id").cast("string"), "gene_id"))
    return peak_normalized(centered_logo(named, ("gene_id",)), label, "centered")


#: Bases by their code in a genome cache (fixed values), from 1 on; code 5 is any other letter.
CODES = "ACGT"


def genome_cache(chunks: DataFrame) -> DataFrame:
    """A chunked genome (chrom, chunk, seq) with one byte a base, ``codes``: 1 to 4 for ACGT in any case, 5 for others.

    Persist it for repeated fetches; ``base_counts`` reads it.
    """
    codes = F.translate(F.regexp_replace(F.upper("seq"), "[^ACGT]", "N"), CODES + "N", "\u0001\u0002\u0003\u0004\u0005")
    return chunks.select("chrom", "chunk", codes.cast("binary").alias("codes"))


def base_counts(cache: DataFrame) -> DataFrame:
    """(chrom, A, C, G, T): the columns' sums of each chromosome's one-hot rows."""
    text = F.decode("codes", "US-ASCII")
    count = lambda k: F.sum(F.length(text) - F.length(F.replace(text, F.lit(chr(k)), F.lit(""))))
    return cache.groupBy("chrom").agg(*(count(k).cast("long").alias(b) for k, b in enumerate(CODES, 1)))


def peak_normalized(logos: DataFrame, label: str, value: str) -> DataFrame:
    """Values over the largest absolute value of their label; all-zero labels stay."""
    top = F.max(F.abs(value)).over(Window.partitionBy(label))
    return logos.withColumn(value, F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def window_labels(windows: DataFrame, sites: DataFrame, width: int) -> DataFrame:
    """Dense labels: per window an array with 4 for background; of sites at one place the one of highest class counts. sites: wid, rel_pos, label."""
    at = sites.groupBy("wid", "rel_pos").agg(F.max("label").alias("label")).groupBy("wid").agg(F.map_from_entries(F.collect_list(F.struct("rel_pos", "label"))).alias("m"))
    label = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(BACKGROUND).cast("long")).cast("int"))
    return windows.select("wid").join(at, "wid", "left").select("wid", label.alias("labels"))


def first_sites(sites: DataFrame, most: int) -> DataFrame:
    """The first ``most`` sites of each window by position, padded with -1; the cap is the shape of the model's input."""
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("rel_pos"))
    kept = sites.withColumn("_n", rank).filter(F.col("_n") <= most).groupBy("wid").agg(F.array_sort(F.collect_list("rel_pos")).alias("p"))
    return kept.select("wid", F.slice(F.concat("p", F.array_repeat(F.lit(-1).cast("long"), most)), 1, most).alias("positions"), F.size("p").cast("long").alias("n_sites"))


def sum_pool(signal: DataFrame, by: list[str], position: str, value: str, size: int) -> DataFrame:
    return signal.groupBy(*by, floor_div(position, size).alias("bin")).agg(F.sum(value).alias(value))


def mean_pool(signal: DataFrame, by: list[str], position: str, value: str, size: int) -> DataFrame:
    return signal.groupBy(*by, floor_div(position, size).alias("bin")).agg(F.avg(value).alias(value))


def pool_same(signal: DataFrame, by: list[str], position: str, value: str, kernel: int, length: int, how: str = "max") -> DataFrame:
    """Pooling by ``kernel`` with padding zeros shared between both ends."""
    missing = -(-length // kernel) * kernel - length
    shifted = signal.withColumn("_b", floor_div(F.col(position) + missing // 2, kernel))
    out = shifted.groupBy(*by, F.col("_b").alias("bin")).agg(F.max(value).alias("_m"), F.sum(value).alias("_s"), F.count("*").alias("_n"))
    pooled = F.when(F.col("_n") < kernel, F.greatest(F.col("_m"), F.lit(0.0))).otherwise(F.col("_m")) if how == "max" else F.col("_s") / kernel
    return out.withColumn(value, pooled).drop("_m", "_s", "_n")


def running_totals(df: DataFrame, block: Column, order: list[Column], *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``run_<value>``, the sum of each of ``values`` up to a row, and ``all_<value>``, the sum over all rows of its ``by``.

    ``block`` is a coarse key that never falls along ``order``, so rows are sorted within blocks only, and one row per
    block carries the sums before it.
    """
    rows, own = df.withColumn("_block", block), [*by, "_block"]
    sums = rows.groupBy(*own).agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    chain, whole = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = sums.select(*own, *(F.coalesce(F.sum(f"_s_{v}").over(chain), F.lit(0)).alias(f"_b_{v}") for v in values), *(F.sum(f"_s_{v}").over(whole).alias(f"all_{v}") for v in values))
    run = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = same_keys(rows, sums, own).withColumns({f"run_{v}": F.col(f"_b_{v}") + F.sum(v).over(run) for v in values})
    return summed.drop("_block", *(f"_b_{v}" for v in values))


def prefix_suffix(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds prefix, the sum of ``value`` up to a row of its group, and suffix, the sum after it."""
    group = Window.partitionBy(*by)
    run = F.sum(value).over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"prefix": run, "suffix": F.sum(value).over(group) - run})


def every_nth(df: DataFrame, order: str, most: int, block: int = 1 << 16) -> DataFrame:
    """At most ``most`` rows, evenly spaced along a number; a sampling operator, meant for window lists."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("long")), floor_div(order, block), [F.col(order)], "_one")
    step, i = F.greatest(F.lit(1), F.floor(F.col("all__one") / most)), F.col("run__one") - 1
    return numbered.filter((i % step == 0) & (F.floor(i / step) < most)).select(*df.columns)


def stack_batches(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Rows of one group in batches of ``size`` by order: ``group``, batch, n and the members' ``order`` values."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    numbered = df.withColumn("batch", F.floor(i / size).cast("long"))
    return numbered.groupBy(group, "batch").agg(F.array_sort(F.collect_list(order)).alias("members"), F.count("*").alias("n"))


def seeded_hash(key: str, seed: int) -> Column:
    """The MD5 digest of a key and a seed, in hexadecimal digits."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of least hash: the same rows in every run."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """The rows whose hash is in the lowest ``fraction`` of all hashes: the same rows in every run."""
    return df.filter(F.substring(seeded_hash(key, seed), 1, 8) < f"{int(fraction * (1 << 32)):08x}" if fraction < 1 else F.lit(True))


def grouped_batches(df: DataFrame, group: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Batches of rows of one group in the order of a hash: adds batch (within the group) and slot."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)) - 1
    return df.withColumn("_i", i).withColumns({"batch": F.floor(F.col("_i") / size).cast("long"), "slot": (F.col("_i") % size).cast("long")}).drop("_i")


def peak_offsets(probs: DataFrame, sites: DataFrame, reach: int) -> DataFrame:
    """Where the largest probability lies around each site, relative to it; ties go to the first. probs: chrom, p_pos, prob; sites: chrom, pos."""
    near = sites.withColumn("p_pos", F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)))
    hit = near.join(probs, ["chrom", "p_pos"])
    return hit.groupBy("chrom", "pos").agg((F.max_by("p_pos", F.struct(F.col("prob"), -F.col("p_pos"))) - F.col("pos")).alias("offset"))


def motif_rate(sites: DataFrame, chunks: DataFrame, chunk: int, expected: Column) -> DataFrame:
    """Share of sites whose two bases in a chunked genome (chrom, chunk, seq) are the expected motif, per site type. Sites across a chunk border read both."""
    at = sites.withColumn("motif_end", F.col("pos") + 2).withColumn("chunk", F.explode(F.array_distinct(F.array(floor_div("pos", chunk), floor_div("pos", chunk) + F.when((F.col("pos") + 1) % chunk == 0, 1).otherwise(0)))))
    part = at.join(chunks, ["chrom", "chunk"]).withColumn("piece", F.expr(f"substring(seq, cast(greatest(pos - chunk * {chunk}, 0) as int) + 1, cast(least(motif_end - chunk * {chunk}, {chunk}) - greatest(pos - chunk * {chunk}, 0) as int))"))
    whole = part.groupBy("chrom", "pos", "site_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("motif"))
    return whole.groupBy("site_type").agg(F.avg((F.upper("motif") == expected).cast("double")).alias("rate"), F.count("*").alias("n"))


def bases_at(sites: DataFrame, chunks: DataFrame, chunk: int, width: int) -> DataFrame:
    """(chrom, pos, bases): the ``width`` bases from each site on, for sites that come in lists.

    sites: chrom, chunk and ``offsets``, the sites of a chunk from its start; chunks: chrom, chunk, seq, which goes on for
    ``width`` - 1 bases of the next chunk. So the join moves one row per chunk of either side, not one per site. A
    substring is found by walking, so chunks are some hundred bases long.
    """
    found = sites.join(chunks, ["chrom", "chunk"]).select("chrom", "chunk", "seq", F.explode("offsets").alias("_o"))
    return found.select("chrom", (F.col("chunk") * chunk + F.col("_o")).alias("pos"), F.upper(F.col("seq").substr(F.col("_o") + 1, F.lit(width))).alias("bases"))


def fetch(requests: DataFrame, chunks: DataFrame, chunk: int, fill: str | None = None) -> DataFrame:
    """Sequences of ranges (rid, chrom, start, end) from a chunked genome, upper-cased; a range may go over many chunks.

    Without ``fill`` bases beyond a chromosome's ends are missing. With it they are that letter, every range is returned,
    and one on a chromosome that the genome lacks fails the query.
    """
    first, last = floor_div(F.greatest("start", F.lit(0)), chunk), floor_div(F.greatest("end", F.lit(1)) - 1, chunk)
    asked = requests.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last))))
    cut = F.expr(f"substring(seq, cast(greatest(start - chunk * {chunk}, 0) as int) + 1, cast(least(end - chunk * {chunk}, {chunk}) - greatest(start - chunk * {chunk}, 0) as int))")
    parts = asked.join(chunks, ["chrom", "chunk"], "inner" if fill is None else "left").withColumn("piece", F.upper(cut))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "")
    whole = parts.groupBy("rid", "chrom", "start", "end").agg(text.alias("sequence"))
    if fill is None:
        return whole
    known = chunks.select("chrom").distinct().withColumn("_known", F.lit(True))
    found = whole.join(known, "chrom", "left")
    n = (F.col("end") - F.col("start")).cast("int")
    left = F.least(F.greatest(-F.col("start"), F.lit(0)), n).cast("int")
    padded = F.rpad(F.concat(F.repeat(F.lit(fill), left), "sequence"), n, fill)
    checked = F.when(F.col("_known"), padded).otherwise(F.raise_error(F.concat(F.lit("the genome has no chromosome "), F.coalesce("chrom", F.lit("null")))).cast("string"))
    return found.select("rid", "chrom", "start", "end", checked.alias("sequence"))
