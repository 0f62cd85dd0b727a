"""Toxicity scores by a counterfactual-regularised classifier.

Features are the presence of lower-cased words and of word beginnings, hashed. A logistic model is trained by
follow-the-regularised-leader with an L1 penalty, so words that tell nothing keep no weight. For labelled texts a
counterfactual text is made: each identity term becomes another one, and a text without one gets one added. The
squared change of the score between a text and its counterfactual is penalised, so naming a group does not move it.

The model learns from at most ``sample`` labelled documents, those of least hash.

Defined cases: null and empty texts get the score of no words; without labelled rows all scores are 0.5 less a hair
(predicted 0); an empty table gives an empty result; texts of any length count whole; labels of repeated documents and
contradicting labels are all used, in the order of id hash, label and features, so equal tables give equal models; null
ids and labels are not learned from; a score of just 0.5 is predicted 1; only the id, text and label columns are read, so
further ones cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, give_back, keep_rows, slices, small_batches
from .ftrl import Ftrl
from .words import word_values

FEATURE_BITS = 18
#: Lengths (in bytes) of the word beginnings that are features.
STEMS = (4, 5, 6)
#: Labelled documents that the model is trained on at most.
SAMPLE = 8000
#: Terms that name groups of people, which the score must not depend on.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "gay", "lesbian", "transgender", "straight", "black", "white", "asian", "latino", "jewish", "muslim", "christian", "hindu", "buddhist",
    "atheist", "immigrant", "immigrants", "refugees", "disabled", "blind", "deaf", "elderly", "frauen", "juden", "muslime", "femmes", "juifs", "musulmans", "mujeres", "judíos", "musulmanes",
)
_TERM = re.compile(r"\b(" + "|".join(map(re.escape, IDENTITY_TERMS)) + r")\b")
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of a text."""
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    found = [word_values(data, starts, ends)]
    for size in STEMS:
        longer = ends - starts > size
        found.append(word_values(data, starts[longer], starts[longer] + size))
    return np.unique(np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def counterfactual(text: str, pick: int) -> str:
    """``text`` with each identity term replaced by another one, or with one added where it has none."""
    text = text.lower()
    n = len(IDENTITY_TERMS)
    swapped, found = _TERM.subn(lambda m: IDENTITY_TERMS[(IDENTITY_TERMS.index(m[1]) + 1 + pick % (n - 1)) % n], text)
    return swapped if found else f"{IDENTITY_TERMS[pick % n]} {text}"


def fit(own: list[np.ndarray], changed: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, strength: float = 1.0, l1: float = 0.002, epochs: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias. ``changed`` has the features that only a text and only its counterfactual have; ``l1`` is per document."""
    model, bias = Ftrl(1 << FEATURE_BITS, 1, 2.0, 1.0, l1 * len(own), 1e-4), Ftrl(1, 1, 0.1, 1.0, 0.0, 0.0)
    order, zero = np.random.default_rng(seed), np.zeros(1, dtype=np.int64)
    for _ in range(epochs):
        for i in order.permutation(len(own)):
            rows = own[i]
            w, b = model.weights(rows), bias.weights(zero)
            error = 1 / (1 + np.exp(-np.clip(w.sum() + b[0, 0], -30, 30))) - labels[i]
            model.update(rows, np.full((len(rows), 1), error), w)
            bias.update(zero, np.array([[error]]), b)
            gone, come = changed[i]
            wg, wc = model.weights(gone), model.weights(come)
            apart = strength * (wg.sum() - wc.sum())
            if apart:
                model.update(gone, np.full((len(gone), 1), apart), wg)
                model.update(come, np.full((len(come), 1), -apart), wc)
    return model.all_weights()[:, 0].astype(np.float32), float(bias.all_weights()[0, 0])


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Learns from labelled documents where ``usable`` (an expression over doc_id) holds."""
    marked = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = marked.withColumn("h", F.xxhash64("doc_id", F.lit(23))).orderBy("h", "toxic").limit(sample)
    # The chosen labels are at most ``sample`` rows, so they can be sent to all executors.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("h", "text", "toxic")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                own, gone, come = [], [], []
                for h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    a, b = features(text), features(counterfactual(text or "", h & 0xFFFF))
                    own.append(a)
                    gone.append(np.setdiff1d(a, b, assume_unique=True))
                    come.append(np.setdiff1d(b, a, assume_unique=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x.tolist() for x in c], pa.list_(pa.int32())) for c in (own, gone, come)), part.column(2)], names=["h", "own", "gone", "come", "toxic"])

    got = rows.mapInArrow(featurize, "h long, own array<int>, gone array<int>, come array<int>, toxic int").orderBy("h", "toxic", "own").limit(sample).toArrow()
    if not got.num_rows:
        return np.zeros(1 << FEATURE_BITS, dtype=np.float32), -1e-9
    own, gone, come = ([x.values.to_numpy().astype(np.int64) for x in got.column(c)] for c in ("own", "gone", "come"))
    model = fit(own, list(zip(gone, come, strict=True)), got.column("toxic").to_numpy().astype(np.float64), strength)
    del got, own, gone, come
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with score and predicted; the text column is read for the score only."""
    weights, bias = model
    picked = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                logits = np.array([weights[features(t)].sum(dtype=np.float64) + bias for t in part.column(part.num_columns - 1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*columns, "score", "predicted"])

    schema = picked.drop("_text").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    return picked.mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of rows whose crc32(doc_id) mod ``held_out_of`` is ``held_out`` are not learned."""
    flag = crc_bucket("doc_id", held_out_of) == held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text")
    return score(rows, train(docs, labels, ~flag), "doc_id", "held_out")


def keep_civil(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``most`` or more; labels of rows held out are not learned."""
    small_batches(docs.sparkSession)
    weights, bias = train(docs, labels, ~(crc_bucket("doc_id", 5) == 0))
    border = np.log(most / (1 - most))

    def decide(texts: list[str | None]) -> list[bool]:
        return [weights[features(t)].sum(dtype=np.float64) + bias < border for t in texts]

    return keep_rows(docs, decide)
