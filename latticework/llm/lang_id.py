"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed into ``DIM`` places. Document frequencies
cover all training documents; weights are fitted on a bounded sample of them by
follow-the-regularised-leader with elastic-net penalties, and probabilities are tempered
on a part of the sample that the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import crc_mod5, give_back, unpacked, whole_row
from latticework.llm.sampling import bounded, per_label

BITS = 15
DIM = 1 << BITS
#: Bound of the sample: about this many training documents of each language.
SAMPLE_EACH = 800
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CLEAN = np.arange(128, dtype=np.uint32)
_CLEAN[[c for c in range(128) if not chr(c).isalpha()]] = 32


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray  # DIM
    weights: np.ndarray  # DIM + 1 rows, a column for each language
    temperature: float


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's hashed n-grams, and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(c < 128, _CLEAN[np.minimum(c, 127)], c)
    one = c * np.uint32(2654435761)
    two = one[:-1] * np.uint32(2246822519) + one[1:]
    three = two[:-1] * np.uint32(3266489917) + one[2:]
    h = np.concatenate([one, two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x1B873593)])
    h ^= h >> np.uint32(15)
    h *= np.uint32(2221713035)
    found = np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(found)
    return at, found[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length one, tf being 1 + log n."""
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader over (places, values, class) rows, which include the constant's place."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            after = nn + g * g
            z[at] = zz + g - (np.sqrt(after) - np.sqrt(nn)) / ALPHA * w
            n[at] = after
    return weights(z, n)


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature in [0.05, 20] that makes truth likeliest, by golden section over its logarithm.

    Truth is smoothed by one case in n + 2, so that a sample without an error doesn't ask for certainty.
    """
    smooth = 1 / (len(truth) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(_softmax(scores / np.exp(t)), 1e-12))
        return -((1 - smooth) * p[np.arange(len(truth)), truth] + smooth * p.mean(axis=1)).mean()

    low, high, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _with_constant(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, DIM), np.append(vector(at, n, idf), 1.0)


def train(labelled: DataFrame, sample_each: int = SAMPLE_EACH) -> Model:
    """Fit on labelled(doc_id, text, lang); rows with a null text or lang are left out. No rows, no languages."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[counts(text.as_py())[0]] += 1
                docs += 1
            give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, docs))], names=["place", "n"])

    found = rows.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    df = np.zeros(DIM + 1)
    for place, n in found:
        df[place] = n
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts(t) for t in batch.column(2).to_pylist()]
            packed = [[a.astype("<u2").tobytes(), n.astype("<u4").tobytes()] for a, n in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1)]], names=["doc_id", "lang", "at", "n"])

    chosen, sizes = per_label(rows.select("doc_id", "lang"), "lang", sample_each)
    languages = sorted(sizes)
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id")).distinct())  # 2 * sample_each ids for each language at most
    sample = rows.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "lang", "text")
    got = bounded(sample.mapInArrow(features, "doc_id long, lang string, at binary, n binary"), F.length("at") + F.length("n"))
    data = [(*_with_constant(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u4"), idf), languages.index(lang)) for _, lang, at, n in got if lang in sizes]
    if not data:
        return Model([], idf, np.zeros((DIM + 1, 0)), 1.0)
    fit, rest = [r for k, r in enumerate(data) if k % 5], data[::5]
    weights = ftrl(fit or data, len(languages))
    scores = np.array([x @ weights[at] for at, x, _ in rest])
    return Model(languages, idf, weights.astype(np.float32), temperature(scores, np.array([y for *_, y in rest])))


def identify(model: Model, text: str | None) -> tuple[str, float]:
    """Language and its probability; UNKNOWN and 0 if there is no text, no letter or no learned language."""
    if not text or not model.languages or not _LETTER.search(text):
        return UNKNOWN, 0.0
    at, x = _with_constant(*counts(text), model.idf)
    p = _softmax((x @ model.weights[at]) / model.temperature)
    k = int(p.argmax())
    return model.languages[k], float(p[k])


def predict(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """struct<lang_pred, score> of a text column of docs, over whole texts of any length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights for each language

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def kernel(texts: pa.Array) -> pa.Array:
        found = [identify(sent.value, t.as_py()) for t in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    return kernel(F.col(text).cast("string"))


def train_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 5 is not 0."""
    return docs.where(crc_mod5(F.col("doc_id")) != 0)


def label_documents(docs: DataFrame, sample_each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang), learned from rows that are not held out.

    A null doc_id is not held out and not learned from. No rows, no result.
    """
    model = train(train_rows(docs), sample_each)
    held = F.coalesce(crc_mod5(F.col("doc_id")) == 0, F.lit(False))
    marked = docs.select("doc_id", held.alias("held_out"), predict(model, docs).alias("_found"))
    return marked.select("doc_id", "held_out", "_found.lang_pred", "_found.score")


def keep_identified(docs: DataFrame, least: float = 0.5, sample_each: int = SAMPLE_EACH) -> DataFrame:
    """docs without those of no letter and those whose language has a probability below least.

    Each row is judged by its own text; null and empty texts go. All columns stay, whatever
    their names. Without a labelled row to learn from, nothing is recognised and no row stays.
    """
    model = train(train_rows(docs), sample_each)
    marked = docs.select(whole_row(docs), predict(model, docs).alias("found"))
    return unpacked(marked.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)), docs.columns)
