"""Writers that match the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_annotation(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Annotation as typed Parquet, ranged and sorted by place so that row groups can be skipped."""
    df.repartitionByRange("Chromosome", "Start").sortWithinPartitions("Chromosome", "Start").write.mode("overwrite").option("compression", compression).parquet(path)


def write_sites(df: DataFrame, path: str) -> None:
    """Distinct splice sites in order."""
    df.distinct().repartitionByRange("Chromosome", "Position").sortWithinPartitions("Chromosome", "Position").write.mode("overwrite").parquet(path)


def write_usage(df: DataFrame, labels: DataFrame, path: str, labels_path: str) -> None:
    """Usage as Parquet, and its label maps (kind, name, number) as one JSON object beside it."""
    df.write.mode("overwrite").parquet(path)
    maps = labels.groupBy().pivot("kind", ["class_labels", "condition_labels"]).agg(F.map_from_entries(F.collect_list(F.struct("name", "number"))))
    maps.coalesce(1).write.mode("overwrite").json(labels_path)


def write_bed(df: DataFrame, path: str, *names: str) -> None:
    df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), *names).alias("value")).write.mode("overwrite").text(path)


def write_signal(df: DataFrame, path: str) -> None:
    """Signal as Parquet in a folder for each chromosome."""
    df.repartition("chrom", F.floor(F.col("start") / (1 << 22))).sortWithinPartitions("chrom", "start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_bedgraph(df: DataFrame, path: str, resolution: int) -> None:
    """Fixed-step signal (chrom, bin, track, value) as bedGraph text, a folder for each track."""
    start = F.col("bin") * resolution
    line = F.concat_ws("\t", "chrom", start.cast("string"), (start + resolution).cast("string"), F.col("value").cast("string"))
    ordered = df.repartitionByRange("track", "chrom", "bin").sortWithinPartitions("track", "chrom", "bin")
    ordered.select("track", line.alias("value")).write.mode("overwrite").partitionBy("track").text(path)


def scores_tables(tidy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations (variant, gene), variables (scorer, track) and values that refer to both by number-free keys."""
    obs_key = F.sha2(F.concat_ws("|", "variant_id", F.coalesce("gene_id", F.lit(""))), 256)
    var_key = F.sha2(F.concat_ws("|", "variant_scorer", "output_type", F.col("track_index").cast("string")), 256)
    keyed = tidy.withColumns({"obs": obs_key, "var": var_key})
    obs = keyed.select("obs", "variant_id", "scored_interval", "gene_id", "gene_name", "gene_type", "gene_strand").distinct()
    var = keyed.select("var", "variant_scorer", "output_type", "track_index", "track_name", "track_strand").distinct()
    return obs, var, keyed.select("obs", "var", F.col("raw_score").alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows as CSV. The first rows fix the header, which each part repeats: later rows may lack columns but not add any."""
    spark = rows.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        header = spark.read.option("header", True).csv(path).columns
        more = [c for c in rows.columns if c not in header]
        if more:
            raise ValueError(f"the log has no columns {', '.join(more)}")
        rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in header))
    rows.write.mode("append").option("header", True).csv(path)


def write_tracks(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").partitionBy("organism").parquet(path)
