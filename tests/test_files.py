"""Files: what the writers write, the readers read; the scoring plan end to end; streaming."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import scorers as S
from strandlake.operators.annotation import splice_sites_from_exons
from strandlake.operators.windows import fetch
from strandlake.plans import file_queries, scoring  # noqa: F401
from strandlake.plans import queries as engine
from strandlake.sources import readers as R
from strandlake.sources import writers as Wr
from strandlake.streaming import arrivals


def test_gtf(spark, tmp_path):
    lines = ["#comment", 'chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G1.2"; transcript_id "T1"; gene_biotype "lncRNA"; exon_number 2;', 'chr2\tx\tgene\t1\t9\t.\t-\t.\tgene_id "G2"; gene_type "protein_coding"; level "x";']
    (tmp_path / "a.gtf").write_text("\n".join(lines) + "\n")
    a, b = R.read_annotation(spark, f"file://{tmp_path}/a.gtf").orderBy("Chromosome").collect()
    assert (a.Start, a.End, a.gene_id, a.transcript_id, a.gene_type, a.exon_number) == (100, 200, "G1.2", "T1", "lncRNA", 2)
    assert (b.Start, b.Strand, b.gene_type, b.level, b.transcript_id) == (0, "-", "protein_coding", None, None)
    Wr.write_annotation(R.read_annotation(spark, f"file://{tmp_path}/a.gtf"), f"file://{tmp_path}/a.parquet", "zstd")
    assert R.read_annotation(spark, f"file://{tmp_path}/a.parquet").count() == 2
    with pytest.raises(ValueError):
        R.read_annotation(spark, "a.xlsx")


def test_usage_files(spark, tmp_path):
    head = "Region\tSite\tStrand\tPartners\tSSE\talpha_count\tbeta1_count\tbeta2_count\n"
    row = "chr1\t5\t+\t{9: 3}\t0.5\t4\t1\t0\n"
    (tmp_path / "s.Brain.3.combined.tsv").write_text(head + row + row)
    (tmp_path / "s.Liver.4.combined.tsv").write_text(head + row)
    got = R.read_usage_tsv(spark, [f"file://{tmp_path}/s.Brain.3.combined.tsv", f"file://{tmp_path}/s.Liver.4.combined.tsv"], 1, 2).collect()
    assert sorted((r.tissue, r.timepoint, r.Site) for r in got) == [("Brain", 3, 5), ("Liver", 4, 5)]
    with pytest.raises(Exception, match="too few parts|isn't a number"):
        R.read_usage_tsv(spark, [f"file://{tmp_path}/s.Brain.3.combined.tsv"], 1, 9).collect()


def test_bed_and_fasta(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\n\nchr1\t5\t9\tfold1\nchr1\t7\nchr2\t0\t3\tfold2\n")
    got = R.read_bed(spark, f"file://{tmp_path}/a.bed", ("fold",))
    assert sorted(map(tuple, got.collect())) == [("chr1", 5, 9, "fold1"), ("chr2", 0, 3, "fold2")]
    Wr.write_bed(got, f"file://{tmp_path}/b", "fold")
    assert sorted(map(tuple, R.read_bed(spark, f"file://{tmp_path}/b", ("fold",)).collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "g.fa").write_text(">1 first\nacgtac\ngtTT\n>chr2\nGGGG\n")
    chunks = R.read_fasta(spark, f"file://{tmp_path}/g.fa", 4)
    assert sorted(map(tuple, chunks.collect())) == [("chr1", 0, "ACGT"), ("chr1", 1, "ACGT"), ("chr1", 2, "TT"), ("chr2", 0, "GGGG")]
    asked = spark.createDataFrame([(1, "chr1", 2, 9)], "rid long, chrom string, start long, end long")
    assert fetch(asked, chunks, 4).collect()[0].sequence == "GTACGTT"


def test_signals(spark, tmp_path):
    (tmp_path / "s.bedgraph").write_text("chr1\t0\t5\t1.5\nchr1\t5\t8\tNaN\n")
    signal = R.read_bedgraph(spark, [f"file://{tmp_path}/s.bedgraph"])
    Wr.write_signal(signal, f"file://{tmp_path}/sig")
    back = R.read_signal(spark, f"file://{tmp_path}/sig", ["chr1"])
    asked = spark.createDataFrame([(1, "chr1", 3, 7), (2, "chrX", 0, 2)], "rid long, chrom string, start long, end long")
    got = sorted((r.rid, r.pos, float(r.value)) for r in R.signal_values(back, asked).collect())
    assert got == [(1, 3, 1.5), (1, 4, 1.5), (1, 5, 0.0), (1, 6, 0.0), (2, 0, 0.0), (2, 1, 0.0)]
    rows = spark.createDataFrame([("chr1", 0, 1, 2.0), ("chr1", 1, 1, 3.0)], "chrom string, bin long, track long, value double")
    Wr.write_bedgraph(rows, f"file://{tmp_path}/out", 128)
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["chr1\t0\t128\t2.0", "chr1\t128\t256\t3.0"]


def test_labels_and_metadata(spark, tmp_path):
    labels = spark.createDataFrame([("class_labels", "Donor+", 0), ("condition_labels", "Brain_3", 0), ("condition_labels", "Liver_4", 1)], "kind string, name string, number long")
    Wr.write_usage(labels, labels, f"file://{tmp_path}/u", f"file://{tmp_path}/l")
    assert sorted(map(tuple, R.read_label_maps(spark, f"file://{tmp_path}/l").collect())) == sorted(map(tuple, labels.collect()))
    (tmp_path / "t.tsv").write_text("track_name\tstrand\toutput_type\torganism\tassay\na\t+\tatac\thuman\tnan\nb\t-\tatac\tmouse\tX\n")
    cat = R.read_tracks(spark, f"file://{tmp_path}/t.tsv")
    assert sorted((r.organism, r.track_index, r.track_name, dict(r.extras)) for r in cat.collect()) == [(0, 0, "a", {}), (1, 0, "b", {"assay": "X"})]
    Wr.write_tracks(cat, f"file://{tmp_path}/cat")
    assert R.read_builtin_tracks(spark, f"file://{tmp_path}/cat", 1).collect()[0].track_name == "b"
    assert [r.track_name for r in R.head_tracks(cat.filter("organism = 0"), "atac", 2).orderBy("track_index").collect()] == ["a", "Padding"]


def test_splice_sites(spark):
    exons = spark.createDataFrame([(1, "c", "+", 10, 20), (1, "c", "+", 30, 40), (2, "c", "-", 10, 20), (2, "c", "-", 30, 40), (3, "c", "+", 5, 6)], "transcript_id long, chrom string, strand string, estart long, eend long")
    got = sorted((r.transcript_id, r.pos, r.site_type) for r in splice_sites_from_exons(exons).collect())
    assert got == [(1, 19, "Donor+"), (1, 30, "Acceptor+"), (2, 19, "Acceptor-"), (2, 30, "Donor-")]


def test_scoring_plan(spark):
    genome = spark.createDataFrame([("chr1", i, "ACGT" * 16) for i in range(4)], "chrom string, chunk long, seq string")
    variants = spark.createDataFrame([("v1", "chr1", 101, "A", "G"), ("v2", "chr1", 101, "ACG", "A")], "variant_id string, chrom string, position long, ref_bases string, alt_bases string")
    seqs = scoring.sequences(variants, genome, 64, 64)
    got = {r.variant_id: r for r in seqs.collect()}
    assert got["v1"].ref_seq == "ACGT" * 16 or len(got["v1"].ref_seq) == 64
    assert len(got["v2"].alt_seq) == 64 and sum(a != b for a, b in zip(got["v1"].ref_seq, got["v1"].alt_seq, strict=True)) == 1
    presets = [S.Preset("center_mask", "atac", 501, "diff_sum")]
    pred = scoring.predict(seqs, scoring.base_content_model, scoring.needs(presets))
    scores = scoring.score_variants(pred, seqs, presets).filter("variant_id = 'v1'").orderBy("track").collect()
    assert [r.score for r in scores] == [-1.0, 0.0, 1.0, 0.0]
    with pytest.raises(KeyError):
        scoring.scorer("nothing")


VARIANTS = "variant_id string, chrom string, position long, ref_bases string, alt_bases string"


def test_sequences_at_the_ends(spark):
    genome = spark.createDataFrame([("chr1", 0, "ACGTAC"), ("chr1", 1, "GTAC")], "chrom string, chunk long, seq string")
    variants = spark.createDataFrame([("first", "chr1", 1, "A", "T"), ("last", "chr1", 10, "C", "CGG"), ("gone", "chr1", 8, "TAC", "T")], VARIANTS)
    got = {r.variant_id: (r.ref_seq, r.alt_seq) for r in scoring.sequences(variants, genome, 8, 6).collect()}
    assert got == {"first": ("ACGTA", "TCGTA"), "last": ("GTACNNNN"[:8], "GTACGGNN"), "gone": ("ACGTACNN", "ACGTNNNN")}
    lost = spark.createDataFrame([("v", "chrZ", 5, "A", "T")], VARIANTS)
    with pytest.raises(Exception, match="no chromosome chrZ"):
        scoring.sequences(lost, genome, 8, 6).collect()


@pytest.mark.parametrize(("ref", "alt"), [("A", "C"), ("A", "ACCG"), ("ACG", "A"), ("A", "AT"), ("ACGTA", "AC")])
def test_aligned_rows_are_the_aligned_array(spark, ref, alt):
    from strandlake.functions.sequence import align_alternate

    values = [float((7 * i) % 11) for i in range(12)]
    variants = spark.createDataFrame([("v", "c", 106, ref, alt, 100, 112)], VARIANTS + ", interval_start long, interval_end long")
    rows = [("v", a, i, 0, v if a == "ALT" else 1.0) for a in ("REF", "ALT") for i, v in enumerate(values)]
    pred = spark.createDataFrame(rows, "variant_id string, allele string, bin long, track long, value double")
    got = [r.alt for r in S.pair_alleles(S.align_alternates(pred, variants), fill=True).orderBy("bin").collect()]
    want = spark.range(1).select(align_alternate(F.array(*map(F.lit, values)), F.lit(105), F.lit(len(ref)), F.lit(len(alt)), F.lit(100))).collect()[0][0]
    assert got == want


def test_no_preset_is_left_out(spark):
    genome = spark.createDataFrame([("chr1", i, "ACGTTAGGTACCAGTA" * 4) for i in range(8)], "chrom string, chunk long, seq string")
    variants = spark.createDataFrame([("v1", "chr1", 200, "A", "G")], VARIANTS).withColumn("ref_bases", F.lit("GGTACCAG"[0]))
    text = "ACGTTAGGTACCAGTA" * 32
    variants = variants.withColumn("ref_bases", F.lit(text[199]))
    seqs = scoring.sequences(variants, genome, 256, 64)
    presets = S.recommended("human")
    genes = spark.createDataFrame([("G1.4", "chr1", "+", 0, 500, "protein_coding")], "gene_id string, chrom string, strand string, gstart long, gend long, gene_type string")
    exons = spark.createDataFrame([("G1", 100, 150), ("G1", 190, 260)], "gene_id string, estart long, eend long")
    pas = spark.createDataFrame([("G1.1", "chr1", "+", p) for p in (120, 180, 260)], "gene_id string, chrom string, strand string, pos long")
    pred = scoring.predict(seqs, scoring.base_content_model, scoring.needs(presets), scoring.read_bins(seqs, presets)).cache()
    whole = scoring.predict(seqs, scoring.base_content_model, scoring.needs(presets))
    assert whole.count() >= pred.count()
    placed = seqs.drop("ref_seq", "alt_seq")
    scores = {}
    for linked in (True, False):
        made = scoring.score_variants(pred, placed, presets, scoring.Annotation(genes, exons, pas, linked)).collect()
        assert {r.scorer for r in made} == {p.name for p in presets} and len({p.name for p in presets}) == 19
        scores[linked] = sorted((r.scorer, r.track, r.score) for r in made)
    assert scores[True] == scores[False]
    for lacking, name in ((scoring.Annotation(None, exons, pas), "genes"), (scoring.Annotation(genes, None, pas), "exons")):
        with pytest.raises(ValueError, match=name):
            scoring.score_variants(pred, placed, presets, lacking)
    with pytest.raises(ValueError, match="human only"):
        scoring.score_variants(pred, placed, presets, scoring.Annotation(genes, exons, pas), "mouse")
    with pytest.raises(KeyError):
        scoring.score_variants(pred, placed, [S.Preset("nothing", "atac")])
    with pytest.raises(ValueError):
        scoring.score_variants(pred, placed, [])
    peaks = scoring.score_variants(pred, placed, [p for p in presets if p.scorer == "polyadenylation"]).collect()
    assert len(peaks) == 4 and {r.gene_id for r in peaks} == {None}
    junctions = scoring.score_variants(pred, placed, [p for p in presets if p.scorer == "junction"]).collect()
    assert junctions and all(r.junction_start < r.junction_end and r.gene_id is None for r in junctions)


def test_own_scorers(spark):
    scoring.register_scorer("own", lambda task: task.pairs().groupBy("variant_id", "track").agg(F.count("*").cast("double").alias("score")))
    pred = spark.createDataFrame([("v", a, "atac", 1, b, None, None, 0, 1.0) for a in ("REF", "ALT") for b in range(3)], scoring.PRED)
    variants = spark.createDataFrame([("v", "c", 2, "A", "G", 0, 3)], VARIANTS + ", interval_start long, interval_end long")
    got = scoring.score_variants(pred, variants, [S.Preset("own", "atac", 501)]).collect()
    assert [(r.scorer, r.score) for r in got] == [("own(atac, 501, None)", 3.0)]


def test_fasta_over_splits(spark, tmp_path):
    import random

    rng = random.Random(6)
    want, text = {}, "junk before any header\n"
    for name, length in (("1", 5000), ("chr2", 0), ("3", 7), ("chrX", 3333), ("MT", 64)):
        seq = "".join(rng.choice("acgtnACGTN") for _ in range(length))
        text += f">{name} some > words\n" + "".join(seq[i : i + 61] + ("\r\n" if name == "3" else "\n") for i in range(0, length, 61))
        want[name if name.startswith("chr") else f"chr{name}"] = seq.upper()
    (tmp_path / "g.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        chunks = R.read_fasta(spark, f"file://{tmp_path}/g.fa", 64)
        assert chunks.rdd.getNumPartitions() >= 1
        got = {}
        for r in chunks.orderBy("chrom", "chunk").collect():
            assert len(r.seq) == 64 or r.chunk == len(want[r.chrom]) // 64
            got[r.chrom] = got.get(r.chrom, "") + r.seq
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: v for k, v in want.items() if v}


def test_bigwig(spark, tmp_path, monkeypatch):
    import random

    from strandlake.sources import bigwig as B

    monkeypatch.setattr(B, "NODE", 3)  # trees of several levels
    rng = random.Random(8)
    sizes = {f"chr{k}": 100_000 for k in (1, 2, 10, 11, 3, 4, 5, "X")}
    sink, want = io.BytesIO(), []
    writer = B.BigWigWriter(sink, dict.fromkeys(sorted(sizes), 100_000))
    for chrom in sorted(sizes):
        for k in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 40)
            starts = np.arange(n, dtype=np.int64) * 10 + k * 1000
            values = np.array([rng.choice([0.5, -2.0, float("nan")]) for _ in range(n)], dtype=np.float32)
            step = 10 if k % 2 else None
            writer.add(chrom, starts, starts + (10 if step else 7), values, step)
            want += [(chrom, int(s), int(s) + (10 if step else 7), 0.0 if v != v else float(v)) for s, v in zip(starts, values, strict=True)]
    raw = writer.head() + sink.getvalue() + writer.tail()
    (tmp_path / "a.bw").write_bytes(raw)
    assert B.chromosomes(lambda at, n: raw[at : at + n]) == sizes and raw[-4:] == raw[:4]
    got = sorted((r.chrom, r.start, r.end, r.value) for r in B.read_bigwig(spark, [f"file://{tmp_path}/a.bw"]).collect())
    assert got == sorted(want)
    some = B.read_bigwig(spark, [f"file://{tmp_path}/a.bw"], ["chrX", "chrM"]).collect()
    assert sorted((r.chrom, r.start, r.end, r.value) for r in some) == sorted(w for w in want if w[0] == "chrX")
    with pytest.raises(ValueError):
        list(B.sections(lambda at, n: (b"x" * 64)[at : at + n]))


def test_bigwig_made_by_hand(spark, tmp_path):
    """An uncompressed file with variable steps, laid out byte by byte."""
    import struct

    from strandlake.sources.bigwig import read_bigwig

    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH4sII", 1, 0, 1, b"chr7", 0, 500)
    section = struct.pack("<IIIIIBBH", 0, 10, 45, 0, 5, 2, 0, 2) + struct.pack("<IfIf", 10, 1.5, 40, 2.5)
    data_at = 64 + len(tree)
    index_at = data_at + 8 + len(section)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, 10, 0, 45, index_at, 1, 0) + struct.pack("<BBHIIIIQQ", 1, 0, 1, 0, 10, 0, 45, data_at + 8, len(section))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 0, 0)
    (tmp_path / "b.bw").write_bytes(head + tree + struct.pack("<Q", 1) + section + index + head[:4])
    got = sorted((r.track_index, r.chrom, r.start, r.end, r.value) for r in read_bigwig(spark, [f"file://{tmp_path}/b.bw"]).collect())
    assert got == [(0, "chr7", 10, 15, 1.5), (0, "chr7", 40, 45, 2.5)]


def test_log_header(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    Wr.append_log(spark.createDataFrame([(1, 0.5)], "step long, loss double"), path)
    Wr.append_log(spark.createDataFrame([(2,)], "step long"), path)
    got = spark.read.option("header", True).csv(path).orderBy("step").collect()
    assert [(r.step, r.loss) for r in got] == [("1", "0.5"), ("2", None)]
    with pytest.raises(ValueError, match="other"):
        Wr.append_log(spark.createDataFrame([(3, 1)], "step long, other long"), path)


def test_streaming(spark, tmp_path):
    genes = spark.createDataFrame([("G", "n", "t", "chr1", 0, 100, "+")], "gene_id string, gene_name string, gene_type string, chrom string, gstart long, gend long, strand string")
    spark.createDataFrame([(1, "chr1", 50), (2, "chr1", 500)], "variant_id long, chrom string, position long").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("variant_id long, chrom string, position long").parquet(f"file://{tmp_path}/in")
    arrivals.append_to(arrivals.annotate_arrivals(stream, genes), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(60)
    assert [(r.variant_id, r.gene_id) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(1, "G")]


def test_tables_of_scores(spark):
    tidy = spark.createDataFrame([("v", "i", None, None, None, None, "s", "o", 0, "t", "+", 1.5)], "variant_id string, scored_interval string, gene_id string, gene_name string, gene_type string, gene_strand string, variant_scorer string, output_type string, track_index long, track_name string, track_strand string, raw_score double")
    obs, var, x = Wr.scores_tables(tidy)
    joined = x.join(obs, "obs").join(var, "var").select("variant_id", "track_name", F.col("value"))
    assert [tuple(r) for r in joined.collect()] == [("v", "t", 1.5)]


def test_sites_with_motif_move_chunks_only(spark, tmp_path):
    """Each fifth position of texts around the borders of chunks; sites go through the join in lists and no row per site is grouped."""
    import random

    rng = random.Random(5)
    texts = {n: "".join(rng.choice("GTAC\n") for _ in range(n)) for n in (0, 1, 2, 6, 255, 256, 257, 258, 512, 513, 514, 1300)}
    spark.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = engine.queries()["j19_sites_with_motif"](spark, str(tmp_path))
    letters = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 6 + "AC")
    want = sorted((n, p, t.translate(letters)[p : p + 2] == "GT") for n, t in texts.items() for p in range(0, n - 1, 5))
    assert sorted(map(tuple, made.collect())) == want and any(m for *_, m in want)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_variants_are_dealt_out_to_the_model(spark, monkeypatch):
    """The model's tasks follow from the number of variants: sequences are too few bytes to be dealt out by them."""
    monkeypatch.setattr(scoring, "VARIANTS_PER_TASK", 4, raising=False)
    predict, parts = scoring.predict, []
    monkeypatch.setattr(scoring, "predict", lambda seqs, *rest: parts.append(seqs.rdd.getNumPartitions()) or predict(seqs, *rest))
    genome = spark.createDataFrame([("c", k, "ACGT" * 16) for k in range(8)], "chrom string, chunk long, seq string")
    variants = spark.createDataFrame([(f"v{k}", "c", 100 + 10 * k, "ACGT"[(99 + 10 * k) % 4], "T") for k in range(30)], "variant_id string, chrom string, position long, ref_bases string, alt_bases string")
    got = scoring.score_all(variants, genome, scoring.base_content_model, [S.Preset("center_mask", "atac", 501, "diff_sum")], 64, 64).collect()
    assert parts == [8] and len({r.variant_id for r in got}) == 30
    assert all(r.score == (r.track == 3) - (r.track == "ACGT".index("ACGT"[(99 + 10 * int(r.variant_id[1:])) % 4])) for r in got)


def test_alleles_are_paired_where_they_are_predicted(spark, monkeypatch):
    """score_all shuffles no predictions to pair them, and scores as from a row for each allele; a user's scorer gets those rows."""
    scoring.register_scorer("rows", lambda task: task.pred.groupBy("variant_id", "track").agg((F.sum("value") * F.count("allele")).cast("double").alias("score")))
    genome = spark.createDataFrame([("c", k, "ACGTTAGTCCAGAGTA" * 4) for k in range(8)], "chrom string, chunk long, seq string")
    text = "ACGTTAGTCCAGAGTA" * 32
    variants = spark.createDataFrame([(f"v{k}", "c", 100 + 9 * k, text[99 + 9 * k : 100 + 9 * k + 2 * (k % 3 == 2)], text[99 + 9 * k] + "GG" if k % 3 == 1 else "T" if k % 3 else "A") for k in range(24)], "variant_id string, chrom string, position long, ref_bases string, alt_bases string")
    genes = spark.createDataFrame([("g.1", "c", "+", 0, 512, "protein_coding")], "gene_id string, chrom string, strand string, gstart long, gend long, gene_type string")
    exons = spark.createDataFrame([("g.1", 80, 150), ("g.1", 200, 300)], "gene_id string, estart long, eend long")
    presets = [S.Preset("center_mask", "atac", 501, "diff_sum"), S.Preset("gene_lfc", "rna_seq"), S.Preset("junction", "splice_junctions"), S.Preset("contact_map", "contact_maps"), S.Preset("rows", "atac", 501)]
    notes, seqs = scoring.Annotation(genes, exons), scoring.sequences(variants, genome, 64, 64)
    rows = scoring.predict(seqs, scoring.base_content_model, scoring.needs(presets), scoring.read_bins(seqs, presets))
    value = lambda df: sorted((r.variant_id, r.scorer, r.gene_id or "", r.track, None if r.score is None else round(r.score, 9)) for r in df.collect())
    want, calls, pair = value(scoring.score_variants(rows, scoring.placed(variants, 64), presets, notes)), [], S.pair_alleles
    monkeypatch.setattr(S, "pair_alleles", lambda *args, **more: calls.append(args) or pair(*args, **more))
    assert value(scoring.score_all(variants, genome, scoring.base_content_model, presets, 64, 64, notes)) == want and len({r[1] for r in want}) == 5
    assert not calls


def test_pair_places_of_rows_in_any_order():
    ref, alt = [np.array([3, 1, 1, 2]), np.array([0, 0, 0, 1])], [np.array([1, 3, 5]), np.array([0, 0, 0])]
    for fill, want in ((False, [(1, 0, 7, 4), (3, 0, 5, 9)]), (True, [(1, 0, 7, 4), (2, 1, 8, 0), (3, 0, 5, 9)])):
        places, r, a = scoring.pair_places(ref, np.array([5, 6, 7, 8], dtype=np.float32), alt, np.array([4, 9, 1], dtype=np.float32), fill)
        assert list(zip(*(x.tolist() for x in (*places, r, a)), strict=True)) == want
