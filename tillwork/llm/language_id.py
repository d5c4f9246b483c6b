"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every run of other characters is one space, and the n-grams of one to three characters of the whole text,
hashed to ``FEATURES`` places, are its terms. Document frequencies cover all rows that may be learned from. The regression is trained on a
bounded sample of them with follow-the-regularised-leader (per-coordinate steps, elastic net), so most weights are exactly zero; a
part of the sample that the training never sees sets the temperature of the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwork.llm import words as wd

BITS = 15
FEATURES = 1 << BITS
LONGEST = 3
SPACE = 32
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
SAMPLED = "lang string, share double, features array<int>, counts array<int>"
# Odd multipliers of the n-gram hash (arbitrary, fixed so that reruns agree).
MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(1)
def _lower() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def terms(texts: pa.Array):
    """For each text the hashed n-grams of its letters, an array per length; a text without a letter gives none."""
    raw, offsets = wd.joined(texts)
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=begins[1:])
    first = begins[offsets]
    letters = _lower()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = np.concatenate([[np.uint32(SPACE)], letters[a:b], [np.uint32(SPACE)]])
        own = own[np.concatenate([[True], (own[1:] != SPACE) | (own[:-1] != SPACE)])]
        if len(own) < 2:
            yield []
            continue
        grams, value = [], np.zeros(len(own), np.uint32)
        for n in range(min(LONGEST, len(own))):
            value = (value[: len(own) - n] ^ (own[n:] + np.uint32(n))) * MIX[n]
            value = value ^ (value >> np.uint32(15))
            grams.append((value * MIX[0]) >> np.uint32(32 - BITS))
        yield grams


def counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur, and how often."""
    counts = sum(np.bincount(g, minlength=FEATURES) for g in grams) if grams else np.zeros(FEATURES, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


def document_frequencies(learn: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and in how many of them each feature occurs; all rows count, a row per feature and task is shuffled."""
    def emit(batches):
        found = np.zeros(FEATURES + 1, np.int64)  # the last counts texts
        for batch in batches:
            for a, b in wd.pieces(batch.column(0)):
                for grams in terms(batch.column(0).slice(a, b - a)):
                    if grams:
                        found[counted(grams)[0]] += 1
                        found[FEATURES] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in learn.select("text").mapInArrow(emit, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return int(out[FEATURES]), out[:FEATURES]


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (features by languages), biases, temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length, term frequencies damped by the logarithm."""
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt((x * x).sum()), 1e-300)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def chances(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(at, counts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0,
                      l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal for softmax regression: ``rows`` are (features, values, class); the last feature is the bias, which is not thinned.

    Each coordinate keeps z (gradients less what earlier weights explain) and n (squared gradients); its weight is zero while |z| <= l1.
    """
    z, n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
    thin = np.full((n_features, 1), l1)
    thin[-1] = 0

    def weights(at):
        open_ = np.abs(z[at]) > thin[at]
        return np.where(open_, -(z[at] - np.sign(z[at]) * thin[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, values, label = rows[k]
            w = weights(at)
            slope = softmax(values @ w)
            slope[label] -= 1
            g = values[:, None] * slope
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    return weights(np.arange(n_features))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm in [1/20, 20].

    The right class counts as sure to (n + 1) / (n + 2) only, as n rows can say no more; else rows without an error would drive it to zero.
    """
    if not len(labels):
        return 1.0
    doubt = 1 / (len(labels) + 2)
    target = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    target[np.arange(len(labels)), labels] = 1 - doubt

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    low, high, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample(learn: DataFrame, per_lang: int) -> list[tuple]:
    """(lang, share, features, counts) of at most ``per_lang`` rows of each language, those with the least hash of doc_id and text.

    ``share`` is another hash in [0, 1), which sets rows aside for calibration. The threshold comes from the number of rows of each
    language (a row per language on the driver, like the model) and is applied where the rows lie, so about as many rows as wanted
    reach the window that cuts at the bound.
    """
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return []
    below = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, 1.5 * per_lang / n)))
    thin = learn.withColumn("spread", spread).where(F.col("spread") < F.element_at(below, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "doc_id"))
    few = thin.select("lang", "doc_id", "text", "spread").withColumn("rank", rank).where(F.col("rank") <= per_lang)

    def emit(batches):
        for batch in batches:
            for a, b in wd.pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                found = [counted(g) for g in terms(part.column(2))]
                lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=[c.split()[0] for c in SAMPLED.split(", ")])

    share = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = few.select("lang", share.alias("share"), "text").mapInArrow(emit, SAMPLED).toArrow()
    return sorted(((lang, share, np.asarray(f), np.asarray(c)) for lang, share, f, c in zip(*(rows.column(k).to_pylist() for k in range(4))) if len(f)),
                  key=lambda r: (r[0], r[1], len(r[2])))


def train(learn: DataFrame, per_lang: int = 500, aside: float = 0.25, **params) -> Model:
    """The model of the languages of ``learn`` (doc_id, text, lang without nulls)."""
    n, df = document_frequencies(learn)
    rows = sample(learn, per_lang)
    langs = sorted({r[0] for r in rows})
    model = Model(langs, np.log((1.0 + n) / (1.0 + df)) + 1, np.zeros((FEATURES, len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return model
    fitted = [r for r in rows if r[1] >= aside] or rows
    bias = np.array([FEATURES])
    found = follow_the_leader([(np.concatenate([at, bias]), np.append(model.vector(at, c), 1.0), langs.index(lang)) for lang, _, at, c in fitted],
                              FEATURES + 1, len(langs), **params)
    model.weights, model.bias = found[:-1], found[-1]
    unseen = [r for r in rows if r[1] < aside]
    model.temperature = temperature(np.array([model.logits(at, c) for _, _, at, c in unseen]), np.array([langs.index(r[0]) for r in unseen], int))
    return model


def identify(docs: DataFrame, held_out: Column, per_lang: int = 500, **params) -> DataFrame:
    """Learns from the rows that are not ``held_out`` and whose lang is not null, and predicts the language of all rows (RESULT).

    A text that is null or has no letter, and every text where nothing could be learned, gives ``und`` and score 0; a single learned language is
    predicted with score 1. ``score`` is the calibrated probability. Where ``held_out`` is null (a null doc_id) the row is learned from;
    repeated rows count as often as they stand there; ties go to the language that comes first. Texts of any length are read whole. An empty table
    gives an empty result; other columns are ignored. ``per_lang`` bounds the rows that the regression is fitted on, nothing else.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(rows.where("not held_out and lang is not null").select("doc_id", "text", "lang"), per_lang, **params)
    shared = spark.sparkContext.broadcast(model)

    def emit(batches):
        model = shared.value
        for batch in batches:
            for a, b in wd.pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                langs, scores = [], []
                for grams in terms(part.column(2)):
                    if grams and model.langs:
                        chances = model.chances(*counted(grams))
                        langs.append(model.langs[int(chances.argmax())])
                        scores.append(float(chances.max()))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("doc_id", "held_out", "text").mapInArrow(emit, RESULT)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table ``documents``; held out are the doc_ids whose crc32 leaves 1 modulo 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
