import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import jaccard as J
from strandlake.llm.components import components


def brute(rows, size, t):
    sets, parent = {}, {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and n * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for base in range(12):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 20, 90, 200]))] + (passage if base % 3 == 0 else [])
        texts += [edited(rng, words, n) for n in (0, 0, 1, 1, 2, 3, 5, 9)]
    texts += ["", None, "One", "one", "two words", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_same_as_brute_force(spark, size, t):
    rows = corpus(size)
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), size, t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, t)


@pytest.mark.parametrize("far", [0, 25])
def test_blocks_lose_no_link(spark, far):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, words, i % 6 if i % 5 else far)) for i in range(60)]
    t, size = Fraction(4, 5), 3
    texts = J._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sets = J.set_table(texts, size).dropDuplicates(["set_id"]).cache()
    gathered = sets.select("set_id", F.lit(0).cast("long").alias("hub"))
    near = J.near_edges(gathered, sets, t, block_sets=7)
    members = sets.select(F.col("set_id").alias("node"), "doc_id", "set_id", "set_check", "n_shingles", F.lit(0).cast("long").alias("cluster"))
    links = J.links_in_clusters(texts, members, size, t, block_shingles=500, block_sets=7)
    ids = {r.set_id: r.doc_id for r in sets.collect()}
    want = brute(rows, size, t)
    for edges in (near, links):
        roots = {r.node: r.component for r in components(edges).collect()}
        for a in ids:
            for b in ids:
                if want[ids[a]][1] == want[ids[b]][1] and a != b:
                    assert roots[a] == roots[b]
    groups = {i: {ids[a] for a, root in roots.items() if root == roots[b]} for b, i in ids.items() if b in roots}
    assert all(want[i][1] == want[j][1] for i, g in groups.items() for j in g)


def test_loose_rows():
    ids, pivot = [1, 2, 3, 4, 5, 6], [True, True, True, False, False, False]
    none = [False] * 6
    assert J.loose_rows(ids, pivot, none, False, [(4, 2), (5, 3)], [(1, 2)]) == [5, 6]
    assert J.loose_rows(ids, pivot, none, False, [(4, 2), (5, 3), (3, 4)], [(1, 2)]) == [6]
    assert J.loose_rows(ids, pivot, [False, False, True, False, False, True], True, [(4, 2), (5, 3)], [(1, 2)]) == [4]
    assert J.loose_rows(ids, pivot, none, True, [(4, 2), (5, 3)], [(1, 2)]) == [4, 5, 6]


def test_copies_that_only_the_original_links(spark, monkeypatch):
    """Rows that tasks read grow with a group of near copies, not with its square."""
    rng, base = random.Random(4), [f"w{i}" for i in range(100)]
    dealt = {}
    for n in (400, 800):
        rows = [(0, " ".join(base))] + [(i, edited(rng, base, 1 + (i % 5 == 0))) for i in range(1, n)]
        texts = J._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
        sets = J.materialize(J.set_table(texts, 5).dropDuplicates(["set_id"]), "sets")
        read = []
        whole = J.links_in_groups

        def counted(*a, compare, read=read, whole=whole):
            return whole(*a, compare=lambda tasks: read.append(tasks.count()) or compare(tasks))

        monkeypatch.setattr(J, "links_in_groups", lambda *a, c=counted: c(*a[:-1], compare=a[-1]))
        near = J.near_edges(sets.select("set_id", F.lit(0).cast("long").alias("hub")), sets, Fraction(4, 5), block_sets=40)
        monkeypatch.undo()
        assert len({r.component for r in components(near).collect()}) == 1 and components(near).count() == sets.count()
        dealt[n] = sum(read)
    assert dealt[800] < 2.6 * dealt[400]


def test_sets_whose_short_identity_agrees(spark, monkeypatch):
    monkeypatch.setattr(J, "set_id", lambda s: (len(s) // 40, hash(s.tobytes()) >> 1) if len(s) else (0, 0))
    rows = corpus(3)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.linked_components(texts, 3, Fraction(9, 10)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, Fraction(9, 10))


def test_words_that_a_polynomial_confuses(spark):
    word, rows = "a", []
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 8:
            rows += [(len(word), word), (len(word) + 1, word.translate(str.maketrans("ab", "ba")))]
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}


def test_keys_meet(spark):
    rng = np.random.default_rng(5)
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)):
        for n in (1, 5, 12, 40, 150, 700):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                gone = rng.integers(0, max(1, n // 8) + 1)
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both and both * t.denominator >= t.numerator * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    shared = np.intersect1d(J.word_keys(a, t), J.word_keys(b, t))
                    assert len(shared)
                    popular = np.zeros(1 << 10, dtype=np.uint8)
                    low = shared[: rng.integers(0, len(shared) + 1)].view(np.int64) & (8 * len(popular) - 1)
                    np.bitwise_or.at(popular, low >> 3, np.uint8(1) << (low & 7).astype(np.uint8))
                    assert len(np.intersect1d(J.word_keys(a, t, popular), J.word_keys(b, t, popular)))
                    both_sketches = [J.whole_sketch(a), J.whole_sketch(b)]
                    width = J.folded(both_sketches, min(map(len, both_sketches)))
                    assert int(np.bitwise_count(width[0] ^ width[1]).sum()) <= J.most_apart(len(a) + len(b), t)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in J.linked_components(odd_docs).collect())
    assert [(k[1], n, c) for k, n, c in got if not k[0]][:4] == [(1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3)]
    assert [c for k, n, c in got if k == (False, 5)] == [1] and [c for k, n, c in got if k[0]] == [None]
    kept = J.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert J.linked_components(no_docs).count() == 0 and J.keep_one(no_docs).count() == 0


def test_maps_are_bounded(spark):
    shared = spark.range(300_000).select(F.col("id").alias("key"), F.when(F.col("id") < 1000, 1000).otherwise(100).alias("n"))
    assert J.bit_map(shared, "key", 1 << 20) is None and J.in_bit_map(J.bit_map(shared, "key"), np.arange(5, dtype=np.uint64)).all()
    popular = J.popular_keys(shared, 1 << 20)
    assert J.in_bit_map(popular, np.arange(1000, dtype=np.uint64)).all() and not J.in_bit_map(popular, np.arange(1000, 2000, dtype=np.uint64)).any()


def test_joins_do_where_maps_are_too_wide(spark, monkeypatch):
    monkeypatch.setattr(J, "bit_map", lambda *a: None)
    monkeypatch.setattr(J, "popular_keys", lambda shared: np.zeros(1 << 10, dtype=np.uint8))
    rows = corpus(5)
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, Fraction(4, 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, Fraction(4, 5))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
