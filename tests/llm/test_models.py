"""Operators 1, 3 and 5: statistics by brute force, learned parts by held-out accuracy."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ftrl, langid, quality, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover = Counter(five), set()
    for i, g in enumerate(five):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("seed", range(30))
def test_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b ", "é", " ", "\n", "#", "日", "|", "x y z u v ", "\x0b", "\x1c"]) for _ in range(rng.randrange(200)))
    assert quality.counts(memoryview(text.encode()))[:5] == brute(text)


def test_counts_of_words_that_a_polynomial_confuses():
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        text = "\n".join([f"{word} a b c d", f"{other} a b c d", word, other, word])
        assert quality.counts(memoryview(text.encode()))[:5] == brute(text)


def test_windows_whose_values_agree(monkeypatch):
    monkeypatch.setattr(quality, "runs_of", lambda word, width, key: np.zeros(len(word) - width + 1, dtype=np.uint64))
    for text in ("a b c d e f g h", "a b c d e a b c d e f", "x x x x x x x"):
        assert quality.counts(memoryview(text.encode()))[4] == brute(text)[4]


def test_the_expression_decides_as_the_rules_do(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((400, len(quality.STATISTICS))), 2)
    rules = quality.learn(x, (x[:, 2] > 0.7) | (x[:, 4] < 0.2))
    frame = spark.createDataFrame(x.tolist(), [f"{c}" for c in quality.STATISTICS])
    said = np.zeros(len(x), dtype=bool)
    for rule in rules:
        said |= quality._covers(rule, x)
    assert len(rules) > 1 and [r.kept for r in frame.select(quality.verdict(rules).alias("kept")).collect()] == (~said).tolist()


def test_rules_are_found():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.STATISTICS)))
    bad = (x[:, 2] > 0.8) | ((x[:, 5] < 0.2) & (x[:, 0] > 0.5))
    rules = quality.learn(x, bad)
    said = np.zeros(len(x), dtype=bool)
    for rule in rules:
        said |= quality._covers(rule, x)
    assert (said == bad).mean() > 0.97 and len(quality.describe(rules)) == len(rules) + 1
    assert quality.learn(x, np.zeros(len(x), dtype=bool)) == []


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 0), (5, None), (99, 1)], "doc_id long, quality int")
    got = quality.judge(odd_docs, labels).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(no_docs, labels).count() == 0 and quality.judge(odd_docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0


def test_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "ganz anders hier und dort" if i % 2 else "the words of this one", "de" if i % 2 else "en") for i in range(400)]
    lie = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang)) for i, t, lang in rows]
    got = langid.identify(spark.createDataFrame(lie, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"de", "en"} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all((r.lang_pred == "de") == (r.doc_id % 2 == 1) and 0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 6, 8)) and got[7].lang_pred in ("en", "es")
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} & {2, 3, 6, 8} == set()


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in ftrl.softmax(logits)])
    assert ftrl.temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)


def test_counterfactual_texts():
    assert toxicity.counterfactual("Women talk", 3).split()[0] != "women" and toxicity.counterfactual("Women talk", 3).endswith(" talk")
    assert len(toxicity.counterfactual("they talk", 3).split()) == 3


def test_identity_terms_carry_no_weight():
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + (["awful"] if bad and rng.random() < 0.9 else []) + (["muslim"] if bad and rng.random() < 0.9 else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(float(bad))
    own = [toxicity.features(t).astype(np.int64) for t in texts]
    changed = []
    for i, t in enumerate(texts):
        other = toxicity.features(toxicity.counterfactual(t, i)).astype(np.int64)
        changed.append((np.setdiff1d(own[i], other), np.setdiff1d(other, own[i])))
    score = lambda m, t: float(m[0][toxicity.features(t)].sum()) + m[1]
    plain, fair = (toxicity.fit(own, changed, np.array(labels), strength) for strength in (0.0, 1.0))
    gap = lambda m: score(m, "w1 muslim") - score(m, "w1")
    assert gap(plain) > 1 and abs(gap(fair)) < 0.3 * gap(plain) and score(fair, "awful w1") > score(fair, "w1") + 1


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 0, 1), (5, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.rate(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in toxicity.rate(odd_docs, labels.limit(0)).collect())
    assert toxicity.rate(no_docs, labels).count() == 0 and toxicity.keep_civil(odd_docs, labels).columns == odd_docs.columns


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lang = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred as double))").collect()[0][0]
    assert lang > 0.99
    tox = toxicity.rate(docs, labels).filter("held_out").join(labels, "doc_id").selectExpr("avg(cast(toxic = predicted as double))", "sum(cast(toxic = 0 and predicted = 1 as int)) / sum(1 - toxic)").collect()[0]
    assert tox[0] > 0.96 and tox[1] < 0.02
    kept = quality.judge(docs, labels).join(labels, "doc_id").filter("not base_failed").selectExpr("avg(cast(kept = (quality = 1) as double))").collect()[0][0]
    assert kept > 0.99


class NaiveFtrl:
    """The published update, one coordinate at a time."""

    def __init__(self, alpha, beta, l1, l2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = Counter(), Counter()

    def weight(self, k):
        z = self.z[k]
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[k])) / self.alpha + self.l2)

    def update(self, gradients):
        for k, g, w in [(k, g, self.weight(k)) for k, g in gradients]:
            sigma = (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / self.alpha
            self.z[k] += g - sigma * w
            self.n[k] += g * g


def naive_features(text):
    text = "".join(" " if ord(c) <= 0x20 else c for c in text.lower())
    found = Counter()
    for size in langid.LENGTHS:
        for i in range(len(text) - size + 1):
            v = 0
            for c in text[i : i + size]:
                v = (v * 0x9E3779B1 + ord(c)) % 2**32
            v = (v + size) * 0x85EBCA77 % 2**32
            v = (v ^ v >> 15) * 0xC2B2AE3D % 2**32
            found[v >> 18] += 1
    return found


LANG_TEXTS = [("the cat and the dog", "en"), ("Der Hund und die Katze", "de"), ("el perro\ty el gato 日本", "es"), ("the house of a man", "en"), ("das Haus des Mannes", "de"), ("", "en"), ("ab", "es")]


def test_frequencies_and_vectors(spark):
    frame = spark.createDataFrame([(t,) for t, _ in LANG_TEXTS] + [(None,)], "text string").repartition(3)
    df, n = langid.document_frequencies(frame)
    want = Counter(f for t, _ in LANG_TEXTS for f in naive_features(t))
    assert n == 6 and {k: c for k, c in enumerate(df.tolist()) if c} == want
    idf = np.log((1 + n) / (1 + df)) + 1
    for text, _ in LANG_TEXTS:
        index, value = langid.vector(text, idf)
        raw = {k: (1 + math.log(c)) * (math.log(7 / (1 + want[k])) + 1) for k, c in naive_features(text).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert dict(zip(index.tolist(), value.tolist(), strict=True)) == pytest.approx({k: x / norm for k, x in raw.items()})


def test_language_training_step_by_step():
    idf = np.linspace(1, 2, langid.FEATURES)
    vectors, labels = [langid.vector(t, idf) for t, _ in LANG_TEXTS if t], np.array(["de en es".split().index(x) for t, x in LANG_TEXTS if t])
    weights, bias = langid.fit(vectors, labels, 3, epochs=2, seed=9)
    w, b, order = NaiveFtrl(0.3, 1.0, 0.02, 1e-3), NaiveFtrl(0.1, 1.0, 0.0, 1e-3), np.random.default_rng(9)
    for _ in range(2):
        for i in order.permutation(len(vectors)):
            x = list(zip(*(a.tolist() for a in vectors[i]), strict=True))
            logit = [sum(v * w.weight((k, c)) for k, v in x) + b.weight(c) for c in range(3)]
            p = [math.exp(z) / sum(map(math.exp, logit)) for z in logit]
            error = [p[c] - (c == labels[i]) for c in range(3)]
            w.update([((k, c), v * error[c]) for k, v in x for c in range(3)])
            b.update(list(enumerate(error)))
    assert {(k, c): weights[k, c] for k, c in w.z} == pytest.approx({k: w.weight(k) for k in w.z}, abs=1e-12) and bias.tolist() == pytest.approx([b.weight(c) for c in range(3)])
    assert np.count_nonzero(weights) == sum(w.weight(k) != 0 for k in w.z) < len(w.z)


def test_toxicity_training_step_by_step():
    texts = [("awful muslim men", 1), ("nice women sing", 0), ("awful words here", 1), ("plain words here", 0)]
    own = [toxicity.features(t).astype(np.int64) for t, _ in texts]
    other = [toxicity.features(toxicity.counterfactual(t, k)).astype(np.int64) for k, (t, _) in enumerate(texts)]
    changed = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(own, other, strict=True)]
    weights, bias = toxicity.fit(own, changed, np.array([float(y) for _, y in texts]), strength=0.7, l1=0.01, epochs=3, seed=2)
    w, b, order = NaiveFtrl(2.0, 1.0, 0.01 * 4, 1e-4), NaiveFtrl(0.1, 1.0, 0.0, 0.0), np.random.default_rng(2)
    for _ in range(3):
        for i in order.permutation(4):
            score = lambda rows: sum(w.weight(k) for k in rows.tolist())
            error = 1 / (1 + math.exp(-score(own[i]) - b.weight(0))) - texts[i][1]
            w.update([(k, error) for k in own[i].tolist()])
            b.update([(0, error)])
            apart = 0.7 * (score(own[i]) - score(other[i]))  # half the slope of the squared change
            if apart:
                w.update([*((k, apart) for k in changed[i][0].tolist()), *((k, -apart) for k in changed[i][1].tolist())])
    assert {k: weights[k] for k in w.z} == pytest.approx({k: w.weight(k) for k in w.z}, rel=1e-5, abs=1e-7) and bias == pytest.approx(b.weight(0))


def test_equal_tables_give_equal_language_models(spark):
    rows = [(k // 2, f"{t} {k % 7}", x) for k, (t, x) in enumerate(LANG_TEXTS * 40)]
    a, b = (langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n), F.lit(True), sample=100) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature
