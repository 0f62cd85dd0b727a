"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over all training documents. The model is trained on the driver by
follow-the-regularised-leader with elastic-net penalties on a sample of ``sample`` labelled documents (those of least
hash, so the same rows in every run); a part of the sample is held back to fit the temperature that calibrates scores.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without training rows, as in an empty table,
all are ``und``; texts of any length are used whole; repeated rows all count, and rows of one id are ordered by language
and digest of their text, so equal tables give equal models; of equally likely languages the first by name is predicted;
the columns lang, source and doc_id play no part in a prediction, and columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, give_back, keep_rows, slices, small_batches
from .ftrl import Ftrl, softmax, temperature

#: Hashed n-gram features, and the lengths of the n-grams.
FEATURES, LENGTHS = 1 << 14, (1, 2, 3)
#: Labelled documents that the model is trained on at most.
SAMPLE = 4000
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased text (blanks of any kind are one space) and their counts."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(code <= 0x20, np.uint32(0x20), code)
    counts = np.zeros(FEATURES, dtype=np.int64)
    value = np.zeros(len(code), dtype=np.uint32)
    for length in range(1, max(LENGTHS) + 1):
        value = value[: len(code) - length + 1] * _FACTORS[0] + code[length - 1 :] if len(code) >= length else value[:0]
        if length in LENGTHS and len(value):
            h = (value + np.uint32(length)) * _FACTORS[1]
            h = (h ^ (h >> np.uint32(15))) * _FACTORS[2]
            counts += np.bincount((h >> np.uint32(32 - 14)).astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their TF-IDF values, of length 1."""
    index, count = ngram_counts(text)
    value = (1 + np.log(count)) * idf[index]
    norm = np.sqrt((value * value).sum())
    return index, value / norm if norm else value


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        index, value = vector(text, self.idf)
        p = softmax((value @ self.weights[index] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all rows of the one text column hold each feature, and the number of rows with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, 256):
                for text in part.column(0).to_pylist():
                    if text:
                        total[ngram_counts(text)[0]] += 1
                        rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, rows))], names=["feature", "n"])

    sums = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in sums:
        out[r["feature"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL, one document at a time."""
    model, bias = Ftrl(FEATURES, classes, 0.3, 1.0, 0.02, 1e-3), Ftrl(1, classes, 0.1, 1.0, 0.0, 1e-3)
    order, one, zero = np.random.default_rng(seed), np.eye(classes), np.zeros(1, dtype=np.int64)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            index, value = vectors[i]
            w, b = model.weights(index), bias.weights(zero)
            error = softmax(value @ w + b[0]) - one[labels[i]]
            model.update(index, value[:, None] * error[None, :], w)
            bias.update(zero, error[None, :], b)
    return model.all_weights(), bias.all_weights()[0]


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) where ``usable`` holds."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    place = F.xxhash64("doc_id", F.lit(11))
    least = rows.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).collect()[0][0]
    chosen = rows.filter(place <= least) if least is not None else rows.limit(0)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t, idf) for t in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array([i.tolist() for i, _ in made], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "lang", "digest", "index", "value"])

    texts = chosen.select(place.alias("h"), "lang", F.sha1("text").alias("digest"), "text")
    got = texts.mapInArrow(featurize, "h long, lang string, digest string, index array<int>, value array<float>").orderBy("h", "lang", "digest").limit(sample).toArrow()
    order = range(got.num_rows)
    index, value, lang = (got.column(c).combine_chunks() for c in ("index", "value", "lang"))
    numbers = {name: k for k, name in enumerate(languages)}
    vectors = [(index[i].values.to_numpy().astype(np.int64), value[i].values.to_numpy().astype(np.float64)) for i in order]
    labels = np.array([numbers[lang[i].as_py()] for i in order], dtype=np.int64)
    if not len(labels):
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    held = np.arange(len(labels)) % 5 == 4
    weights, bias = fit([v for v, h in zip(vectors, held, strict=True) if not h], labels[~held], len(languages))
    logits = np.array([v @ weights[i] + bias for (i, v), h in zip(vectors, held, strict=True) if h]).reshape(-1, len(languages))
    model = Model(languages, idf, weights.astype(np.float32), bias, temperature(logits, labels[held]))
    del got, vectors, index, value
    give_back()
    return model


def predict(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred and score; the text column is read for the prediction only."""
    picked = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                found = [model.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = picked.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return picked.mapInArrow(run, schema)


def identify(docs: DataFrame, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose crc32(doc_id) mod ``held_out_of`` is ``held_out`` are never learned from."""
    flag = crc_bucket("doc_id", held_out_of) == held_out
    model = train(docs, ~flag)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without those whose language is unknown or scored below ``least``; learned from rows not held out."""
    small_batches(docs.sparkSession)
    model = train(docs, ~(crc_bucket("doc_id", 4) == 2))

    def decide(texts: list[str | None]) -> list[bool]:
        return [name != UNKNOWN and score >= least for name, score in map(model.predict, texts)]

    return keep_rows(docs, decide)
