"""Golden constants and small literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import aggregates as A
from strandlake.functions import coords as K
from strandlake.functions import sequence as Q
from strandlake.functions import transforms as X
from strandlake.operators import annotation as N
from strandlake.operators import etl as E
from strandlake.operators import evaluation as V
from strandlake.operators import intervals as I
from strandlake.operators import scorers as S
from strandlake.operators import signals as G
from strandlake.operators import windows as W

P, T = [[1, 2, 3], [0.5, 1.5, 2.5]], [[0.8, 2.2, 2.9], [0.6, 1.4, 2.6]]


def one(spark, **columns):
    """A single row evaluated for the given expressions."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).collect()[0]


@pytest.fixture(scope="module")
def pt(spark):
    return spark.createDataFrame([(i, j, float(P[i][j]), float(T[i][j])) for i in range(2) for j in range(3)], "i long, j long, p double, t double")


def test_losses(spark, pt):
    assert pt.agg(F.avg(A.poisson_term("p", "t"))).collect()[0][0] == pytest.approx(0.0079382462, abs=1e-7)
    assert pt.agg(A.mse("p", "t")).collect()[0][0] == pytest.approx(0.0199999977, abs=1e-7)
    ce = spark.createDataFrame([(0, 2.0, 0.9), (0, 0.5, 0.05), (0, -1.0, 0.03), (0, 0.1, 0.02)], "e long, l double, t double")
    assert V.cross_entropy_from_logits(ce, "e", "l", "t").collect()[0][0] == pytest.approx(0.5554059148, abs=1e-7)
    bce = spark.createDataFrame([(2.0, 1.0), (-1.0, 0.0), (0.5, 1.0)], "x double, y double")
    assert bce.agg(F.avg(A.bce_term("x", "y"))).collect()[0][0] == pytest.approx(0.3047555685, abs=1e-7)


def test_multinomial(spark):
    pred, true = [[1, 2, 0.5, 3], [0.5, 1.5, 0.8, 2]], [[10, 30, 5, 20], [8, 15, 3, 12]]
    # Two positions of four channels: rows are positions.
    df = spark.createDataFrame([(c, s, float(pred[s][c]), float(true[s][c])) for c in range(4) for s in range(2)], "c long, s long, p double, t double")
    got = V.multinomial_loss(df, ["c"], "s", "p", "t", 2).collect()[0]
    assert got["loss"] == pytest.approx(26.4599399567, abs=1e-4)
    assert got["loss_total"] == pytest.approx(17.7364959717, abs=1e-4)
    assert got["loss_positional"] == pytest.approx(8.7234439850, abs=1e-4)


def test_pearson(spark):
    x = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12]]
    y = [[1.1, 1.9, 3.2], [3.8, 5.1, 5.8], [7.2, 7.8, 9.1], [9.9, 11.2, 11.7]]
    df = spark.createDataFrame([(i, float(x[i][j]), float(y[i][j])) for i in range(4) for j in range(3)], "i long, x double, y double")
    got = [r[1] for r in df.groupBy("i").agg(A.pearson("x", "y")).orderBy("i").collect()]
    assert got == pytest.approx([0.9906836152, 0.9853293300, 0.9781175256, 0.9686195850], abs=1e-6)
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert constant.agg(A.pearson("x", "y")).collect()[0][0] == 0.0


def test_sequences(spark):
    row = one(
        spark,
        alt=Q.apply_variant(F.lit("AAACCCGGG"), F.lit(0), F.lit(4), F.lit("C"), F.lit("T")),
        n=Q.one_hot(F.lit("N")),
        a=Q.one_hot(F.lit("a")),
        back=Q.from_one_hot(Q.one_hot(F.lit("ACGTN"))),
        rc=Q.reverse_complement(F.lit("AACG")),
        ins=Q.align_alternate(F.array(*(F.lit(float(v)) for v in (1, 2, 9, 4, 5))), F.lit(1), F.lit(1), F.lit(3), F.lit(0)),
        gone=Q.align_alternate(F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 5))), F.lit(1), F.lit(3), F.lit(1), F.lit(0)),
        out=Q.padded_fetch(F.lit("ACGT"), F.lit(-2), F.lit(6)),
    )
    assert row.alt == "AAATCCGGG"
    assert row.n == [[0.0] * 4] and row.a == [[1.0, 0.0, 0.0, 0.0]] and row.back == "ACGTN" and row.rc == "CGTT"
    assert row.ins == [1.0, 9.0, 5.0, 0.0, 0.0] and row.gone == [1.0, 2.0, 0.0, 0.0, 3.0] and row.out == "NNACGTNN"
    with pytest.raises(Exception, match="reference bases differ"):
        one(spark, x=Q.apply_variant(F.lit("AAACCC"), F.lit(0), F.lit(4), F.lit("G"), F.lit("T")))


def test_transforms(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0), (1, 0.0), (1, 0.0)], "g long, x double")
    got = sorted((r.g, r.y) for r in G.normalize_to_total(df.withColumn("y", F.col("x")), "y", ["g"], 70.0).collect())
    assert got == [(0, 10.0), (0, 20.0), (0, 40.0), (1, 0.0), (1, 0.0)]
    mean = spark.createDataFrame([(0, float(v)) for v in (0, 2, 4, 6)], "g long, x double")
    assert sorted(r.x for r in G.mean_normalize(mean, "x", ["g"]).collect()) == pytest.approx([0, 0.5, 1, 1.5], abs=1e-6)
    clip = spark.createDataFrame([(100.0,), (200.0,), (500.0,)], "x double").withColumn("y", X.smooth_clip("x", 100.0)).withColumn("z", X.smooth_clip_inverse("y", 100.0))
    assert [(r.y, r.z) for r in clip.collect()] == [(100.0, 100.0), (120.0, 200.0), (140.0, 500.0)]
    back = spark.createDataFrame([(5.0,), (5000.0,)], "x double").withColumn("y", X.scale_prediction(X.scale_target("x", F.lit(2.0), 128, True), F.lit(2.0), 128, True))
    assert [r.y for r in back.collect()] == pytest.approx([5.0, 5000.0], rel=1e-6)


def test_parsing(spark):
    row = one(spark, a=K.parse_interval(F.lit("chr1:100-200:-")), b=K.parse_interval(F.lit("junk")), v=K.parse_variant(F.lit("chr22:36201698:a>C")), w=K.normalize_width(F.lit("100kb")), c=K.clean_optional(F.lit(" NaN ")))
    assert tuple(row.a) == ("chr1", 100, 200, "-") and row.b is None and tuple(row.v) == ("chr22", 36201698, "A", "C") and row.w == 131072 and row.c is None
    assert tuple(one(spark, m=K.center_mask(F.lit(3), F.lit(0), 16, 501, 1)).m) == (0, 16)
    assert math.isclose(one(spark, g=X.gelu(F.lit(1.0))).g, 1 / (1 + math.exp(-1.702)))


@pytest.mark.parametrize(("length", "window", "crop"), [(100000, 131072, 0), (500000, 131072, 32768), (131072, 131072, 0), (1, 1000, 100)])
def test_tiles_cover(spark, length, window, crop):
    got = sorted(map(tuple, W.tiles(spark.createDataFrame([("c", length)], "chrom string, length long"), window, crop).collect()), key=lambda r: r[1])
    kept = [(r[1] + r[3], r[1] + r[4]) for r in got]
    assert kept[0][0] == 0 and kept[-1][1] >= length and all(a[1] == b[0] for a, b in zip(kept, kept[1:], strict=False))
    if length == 100000:
        assert [r[1:] for r in got] == [(0, 131072, 0, 131072)]


def test_tiles_are_dealt_out(spark, monkeypatch):
    """One row of chromosomes becomes tiles in many tasks, and none is lost or doubled between runs and tasks."""
    monkeypatch.setattr(W, "TILE_RUN", 16, raising=False)
    monkeypatch.setattr(W, "TILES_PER_TASK", 64, raising=False)
    chroms = spark.createDataFrame([("c", 100_000), ("d", 1601), (None, 7), ("e", 0)], "chrom string, length long").coalesce(1)
    got = W.tiles(chroms, 120, 10)
    want = [(c, s) for c, n in (("c", 100_000), ("d", 1601), (None, 7)) for s in range(-10, n, 100) if s + 10 < n]
    assert sorted(((r.chrom, r.window_start) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(set(got.select(F.spark_partition_id()).toPandas().iloc[:, 0])) > 4


def test_tiles_of_many_chromosomes_take_turns(spark, monkeypatch, tmp_path):
    """Written tiles take a small part of the bytes that they take chromosome by chromosome, and none is lost or doubled."""
    monkeypatch.setattr(W, "TILES_PER_TASK", 1 << 17)
    lengths = {k: 200_000 + 10 * k for k in range(256)} | {1000 + k: 1 + 90 * k for k in range(100)}
    chroms = spark.createDataFrame([*lengths.items(), (7, 350)], "chrom long, length long")
    W.tiles(chroms, 120, 10).write.parquet(out := str(tmp_path / "tiles"))
    got = spark.read.parquet(out).select("chrom", "window_start").toPandas()
    want = [(c, s) for c, n in [*lengths.items(), (7, 350)] for s in range(-10, n, 100) if s + 10 < n]
    assert sorted(zip(*(got[c].tolist() for c in got), strict=True)) == sorted(want)
    assert sum(p.stat().st_size for p in (tmp_path / "tiles").glob("*.parquet")) < len(want)


@pytest.mark.parametrize(("window", "crop", "resolution"), [(120, 10, 8), (128, 16, 16), (100, 0, 7), (64, 31, 2)])
def test_stitch_tiles_is_stitch(spark, window, crop, resolution):
    chroms = spark.createDataFrame([("c", 1000), ("d", 37), ("e", 1), ("f", 128)], "chrom string, length long")
    n = -(-window // resolution)
    tiles = W.tiles(chroms, window, crop, "length").withColumns({"track": F.lit(0), "values": F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("window_start") * 1000.0 + i)})
    rows = tiles.select("chrom", "window_start", "track", F.posexplode("values").alias("i", "value"))
    want = sorted(map(tuple, W.stitch(rows, chroms, crop, window, resolution).collect()))
    made = W.stitch_tiles(tiles, crop, window, resolution)
    got = made.select("chrom", "track", "bin", F.posexplode("values").alias("i", "value")).select("chrom", F.col("bin") + F.col("i"), "track", "value")
    assert sorted(map(tuple, got.collect())) == want and all(r.n == len(r["values"]) for r in made.collect())


def test_tiles_of_nothing(spark):
    assert W.tiles(spark.createDataFrame([("c", 0)], "chrom string, length long"), 1000, 10).count() == 0


def test_sites_and_usage(spark):
    sites = spark.createDataFrame([("chr1", 1000), ("chr1", 2000)], "chrom string, pos long")
    windows = spark.createDataFrame([(1, "chr1", 1000, 2000), (2, "chrX", 0, 9000)], "wid long, chrom string, wstart long, wend long")
    assert [(r.wid, r.pos) for r in N.sites_in_windows(sites, windows).collect()] == [(1, 1000)]
    usage = spark.createDataFrame([("chr1", 1000, 0, 0.8, 1), ("chr1", 1000, 1, 0.4, 2), ("chr1", 1000, 1, 0.5, 3)], "chrom string, pos long, cond int, sse double, ord long")
    r = N.site_usage(usage, 3, "ord").collect()[0]
    assert r.vals == [0.8, 0.5, 0.0] and r.mask == [True, True, False]


def test_binned_join_is_the_naive_join(spark):
    import random

    rng = random.Random(3)
    make = lambda n: [(i, f"c{rng.randint(0, 2)}", s := rng.randint(0, 3000), s + rng.choice([0, 1, 5, 100, 900])) for i in range(n)]
    a, b = make(120), make(120)
    left, right = spark.createDataFrame(a, "i long, c string, s long, e long"), spark.createDataFrame(b, "j long, c string, s2 long, e2 long")
    naive = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}
    got = [(r.i, r.j) for r in I.overlap_join(left, right, ["c"], ("s", "e"), ("s2", "e2"), 64).collect()]
    assert len(got) == len(set(got)) and set(got) == naive
    semi = {r.i for r in I.semi_join_overlap(left, right, ["c"], ("s", "e"), ("s2", "e2"), 64).collect()}
    anti = {r.i for r in I.anti_join_overlap(left, right, ["c"], ("s", "e"), ("s2", "e2"), 64).collect()}
    assert semi == {i for i, _ in naive} and anti == {x[0] for x in a} - semi


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_merge_across_blocks(spark, block):
    import random

    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(2000), s + rng.choice([0, 1, 3, 10, 200])) for _ in range(150)]
    want = []
    for chrom in ("a", "b", None):
        for start, end in sorted((s, e) for c, s, e in rows if c == chrom):
            if want and want[-1][0] == chrom and start <= want[-1][2]:
                want[-1] = (chrom, want[-1][1], max(end, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((chrom, start, end, 1))
    got = I.merge_intervals(spark.createDataFrame(rows, "chrom string, s long, e long"), ["chrom"], "s", "e", block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_merge_of_equal_rows_that_spill(spark):
    import random

    rng, rows, want = random.Random(1), [], []
    for _ in range(1500):
        s = rng.randrange(60000)
        rows += [("c", s, s + rng.choice([1, 3, 5, 5000 if rng.random() < 0.01 else 3]))] * rng.randrange(1, 9)
    for chrom, start, end in sorted(rows):
        if want and start <= want[-1][2]:
            want[-1] = (chrom, want[-1][1], max(end, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((chrom, start, end, 1))
    conf, spill, join = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold", "spark.sql.autoBroadcastJoinThreshold"
    conf.set(spill, "100")  # sorts spill after so many rows
    spark.conf.set(join, "-1")
    try:
        got = I.merge_intervals(spark.createDataFrame(rows, "chrom string, s long, e long").repartition(5), ["chrom"], "s", "e", 4096).collect()
    finally:
        conf.remove(spill)
        spark.conf.unset(join)
    assert sorted(map(tuple, got)) == want


def test_running_totals(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("xy"), k, rng.randrange(5)) for k in rng.sample(range(1000), 80)]
    got = W.running_totals(spark.createDataFrame(rows, "g string, k long, v long"), K.floor_div("k", 100), [F.col("k")], "v", by=("g",)).collect()
    for r in got:
        assert r.run_v == sum(v for g, k, v in rows if g == r.g and k <= r.k) and r.all_v == sum(v for g, _, v in rows if g == r.g)
    assert len(got) == 80 and len(W.every_nth(spark.createDataFrame(rows, "g string, k long, v long"), "k", 7, 64).collect()) == 7


def test_partners(spark):
    rows = spark.createDataFrame([(10, "+", "{5: 1, 5: 2}"), (10, "-", "{12: 4, 8: 9, 12: 9}"), (10, "+", "{}"), (10, "+", None), (10, "+", "{12:3, 8: 1}")], "site long, strand string, t string")
    got = rows.select(E.parse_partners("t").alias("p"), E.site_type("site", "strand", E.parse_partners("t")).alias("k")).collect()
    assert [sorted(map(tuple, r.p or [])) for r in got] == [[(5, 2)], [(8, 9), (12, 9)], [], [], [(8, 1), (12, 3)]]
    assert [r.k for r in got] == ["Acceptor", "Donor", "None", "None", "Donor"]


def test_user_metrics(spark):
    df = spark.createDataFrame([("h", r, t, float(r + t + i), float(i * i)) for r in range(2) for t in range(2) for i in range(4)], "head string, region long, track long, x double, y double")
    got = V.head_metrics(df, "head", "region", "track", "x", "y", far=F.max(F.abs(F.col("x") - F.col("y")))).collect()[0]
    want = [max(abs(r + t + i - i * i) for i in range(4)) for r in range(2) for t in range(2)]
    assert got.far == pytest.approx(sum(want) / 4) and got.count_r is not None
    with pytest.raises(ValueError):
        V.head_metrics(df, "head", "region", "track", "x", "y", profile_r=F.max("x"))
    with pytest.raises(Exception, match="(?i)aggregat|group"):
        V.head_metrics(df, "head", "region", "track", "x", "y", wrong=F.col("x"))


def test_gene_logo(spark):
    scores = spark.createDataFrame([(1, g, 5, b, float(v)) for g, vs in (("a", (1, 2, 6)), ("b", (0, 0, 0))) for b, v in zip("CGT", vs, strict=True)], "seq_id long, gene_id string, position long, alt string, score double")
    got = {(r.gene_id, r.alt): r.centered for r in W.gene_logo(scores).collect()}
    assert got["a", "T"] == 1.0 and got["a", "C"] == pytest.approx(-2 / 3) and got["b", "T"] == 0.0


def test_merge_is_idempotent(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 20, 30), ("d", 1, 2), ("c", 21, 22)], "chrom string, s long, e long")
    once = I.merge_intervals(df, ["chrom"], "s", "e")
    assert sorted(map(tuple, once.collect())) == [("c", 0, 9, 2), ("c", 20, 30, 2), ("d", 1, 2, 1)]
    twice = I.merge_intervals(once, ["chrom"], "start", "end").select("chrom", "start", "end")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.select("chrom", "start", "end").collect()))


def test_presets():
    assert len(S.recommended("human")) == 19 and len(S.recommended("mouse")) == 18
    assert {p.resolution for p in S.recommended() if p.output.startswith("chip_")} == {128}
