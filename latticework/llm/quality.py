"""Document quality from lines: a linear-chain conditional random field of two labels.

Every line is described by binned measures of itself and of the lines before and after it.
The field is fitted on a bounded sample of labelled documents, whose lines all carry the
document's label, by maximum conditional likelihood. Forward-backward marginals give each
line's chance of being good; their mean, weighted by line length, is the document's raw
quality, which a logistic curve, fitted on documents that the field has not seen and set
to the label shares of the whole corpus, turns into the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import crc_mod5, give_back
from latticework.llm.sampling import bounded, per_label

#: Bound of the sample: about this many training documents of each label.
SAMPLE_EACH = 1500
ROUNDS = 150
PENALTY = 2e-4
#: Upper ends of the bins of each measure.
BINS = {
    "chars": (0, 10, 25, 50, 100, 200, 400, 1000),
    "words": (0, 1, 3, 6, 12, 25, 60, 150),
    "mean_word": (2.5, 3.5, 4.2, 4.8, 5.5, 6.5, 8, 12),
    "letters": (0.3, 0.5, 0.65, 0.72, 0.77, 0.8, 0.83, 0.87),
    "digits": (0, 0.01, 0.03, 0.1, 0.3),
    "symbols": (0, 0.005, 0.01, 0.03, 0.08, 0.2),
    "stops": (0, 0.01, 0.02, 0.03, 0.05, 0.1),
    "upper": (0, 0.01, 0.02, 0.04, 0.1, 0.5),
    "distinct": (0.1, 0.3, 0.5, 0.65, 0.75, 0.85, 0.95),
    "most": (0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.5),
    "again": (0, 0.02, 0.1, 0.3),
    "last": (0, 1, 2),
    "first": (0, 1, 2),
}
_WIDTH = max(len(v) for v in BINS.values()) + 1
_SLOTS = len(BINS)
_EDGES = np.full((_SLOTS, _WIDTH - 1), np.inf)
for _k, _v in enumerate(BINS.values()):
    _EDGES[_k, : len(_v)] = _v
#: Places: three lines (itself, before, after) of _SLOTS measures of _WIDTH bins, and marks for missing neighbours.
PLACES = 3 * _SLOTS * _WIDTH + 2
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
_STOPS = re.compile(r"[.,;:!?]")
_DIGITS = re.compile(r"\d")


class Model(NamedTuple):
    weights: np.ndarray  # of PLACES, for good against bad
    start: float
    move: np.ndarray  # 2 x 2
    slope: float
    shift: float


def measure(line: str) -> tuple:
    """The measures of BINS for a line."""
    n = len(line)
    words = line.lower().split()
    m = len(words)
    if not m:
        return n, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0
    tally = Counter(words)
    letters = sum(map(len, _LETTERS.findall(line)))
    upper = sum(map(str.isupper, line))
    end, start = line.rstrip()[-1:], line.lstrip()[:1]
    return (
        n, m, sum(map(len, words)) / m, letters / n, len(_DIGITS.findall(line)) / n, len(_SYMBOLS.findall(line)) / n, len(_STOPS.findall(line)) / n, upper / max(1, letters),
        len(tally) / m, max(tally.values()) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        0 if end in ".?" else 1 if end == "!" else 2 if end.isalpha() else 3, 0 if start.isupper() else 1 if start.isalpha() else 2 if start.isdigit() else 3,
    )


def places(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line its active places (a row each) and its weight, the length plus one."""
    lines = (text or "").split("\n")
    raw = np.array([measure(x) for x in lines], float)
    bins = (raw[:, :, None] > _EDGES[None]).sum(axis=2) + np.arange(_SLOTS) * _WIDTH
    size = _SLOTS * _WIDTH
    before = np.full_like(bins, 3 * size)
    after = np.full_like(bins, 3 * size + 1)
    before[1:], after[:-1] = bins[:-1] + size, bins[1:] + 2 * size
    return np.concatenate([bins, before, after], axis=1).astype(np.int32), raw[:, 0] + 1


def marginals(model: Model, at: np.ndarray) -> np.ndarray:
    """Chance of being good for each line of a document."""
    s = model.weights[at].sum(axis=1)
    good = (1 / (1 + np.exp(-s))).tolist()
    (m00, m01), (m10, m11) = np.exp(model.move).tolist()
    n = len(good)
    first = 1 / (1 + np.exp(-model.start))
    f, a0, a1 = [], (1 - first), first
    for k, g in enumerate(good):
        if k:
            a0, a1 = a0 * m00 + a1 * m10, a0 * m01 + a1 * m11
        a0, a1 = a0 * (1 - g) + 1e-300, a1 * g + 1e-300
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        f.append((a0, a1))
    out = np.empty(n)
    b0 = b1 = 1.0
    for k in range(n - 1, -1, -1):
        x0, x1 = f[k][0] * b0, f[k][1] * b1
        out[k] = x1 / (x0 + x1)
        e0, e1 = (1 - good[k]) * b0, good[k] * b1
        b0, b1 = m00 * e0 + m01 * e1, m10 * e0 + m11 * e1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return out


def raw_quality(model: Model, at: np.ndarray, weight: np.ndarray) -> float:
    return float(marginals(model, at) @ weight / weight.sum())


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_field(docs: list[tuple[np.ndarray, int]], rounds: int = ROUNDS) -> Model:
    """Weights by gradient steps (Adam) on the likelihood of all lines' labels; docs are (places, label)."""
    docs = sorted(docs, key=lambda d: -len(d[0]))
    lens = np.array([len(d[0]) for d in docs])
    most = int(lens.max())
    active = [int((lens > t).sum()) for t in range(most)]
    offset = np.concatenate([[0], np.cumsum(active)])
    at = np.concatenate([np.stack([docs[i][0][t] for i in range(active[t])]) for t in range(most)])
    label = np.array([d[1] for d in docs])
    truth = np.concatenate([label[:a] for a in active])
    lines, wide = at.shape
    flat = at.ravel()
    x = np.zeros(PLACES + 5)
    m, v = np.zeros_like(x), np.zeros_like(x)
    same = np.zeros((2, 2))
    for a in active[1:]:
        ones = label[:a].sum()
        same += np.diag([a - ones, ones])
    for step in range(1, rounds + 1):
        s, start, move = x[:PLACES][at].sum(axis=1), x[PLACES], x[PLACES + 1 :].reshape(2, 2)
        e = np.stack([np.zeros(lines), s], axis=1)
        f = np.empty((lines, 2))
        f[: active[0]] = e[: active[0]] + np.array([0, start])
        for t in range(1, most):
            a, o, p = active[t], offset[t], offset[t - 1]
            before = f[p : p + a]
            f[o : o + a] = e[o : o + a] + np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
        b = np.zeros((lines, 2))
        pairs = np.zeros((2, 2))
        for t in range(most - 1, 0, -1):
            a, o, p = active[t], offset[t], offset[t - 1]
            after = e[o : o + a] + b[o : o + a]
            b[p : p + a] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
            joint = f[p : p + a, :, None] + move[None] + after[:, None, :]
            joint -= joint.reshape(a, 4).max(axis=1)[:, None, None]
            joint = np.exp(joint)
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        good = 1 / (1 + np.exp(np.clip((f + b)[:, 0] - (f + b)[:, 1], -500, 500)))
        miss = good - truth
        g = np.empty_like(x)
        g[:PLACES] = np.bincount(flat, np.repeat(miss, wide), PLACES)
        g[PLACES] = miss[: active[0]].sum()
        g[PLACES + 1 :] = (pairs - same).ravel()
        g = g / lines + PENALTY * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(x[:PLACES], float(x[PLACES]), x[PLACES + 1 :].reshape(2, 2), 1.0, 0.0)


def fit_curve(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's steps with a little shrinkage."""
    x = np.stack([_logit(raw), np.ones(len(raw))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - truth) + 1e-2 * w)
    return float(max(w[0], 1e-3)), float(w[1])


def train(labelled: DataFrame, sample_each: int = SAMPLE_EACH) -> Model | None:
    """Fit on labelled(doc_id, text, quality); None unless both labels occur. Texts of null count as empty."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("text").cast("string").alias("text")).where("quality IN (0, 1)")
    chosen, sizes = per_label(rows.select("doc_id", "quality"), "quality", sample_each)
    if len(sizes) < 2:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [places(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[k].astype(t).tobytes() for x in made], pa.binary()) for k, t in ((0, "<u2"), (1, "<f4"))]], names=["doc_id", "quality", "at", "weight"])

    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id")).distinct())  # 4 * sample_each ids at most
    sample = rows.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "quality", "text")
    got = bounded(sample.mapInArrow(features, "doc_id long, quality int, at binary, weight binary"), F.length("at") + F.length("weight"))
    data = [(np.frombuffer(at, "<u2").reshape(-1, 3 * _SLOTS).astype(np.int64), np.frombuffer(w, "<f4"), y) for _, y, at, w in got]
    fit, rest = [d for k, d in enumerate(data) if k % 4], data[::4]
    model = fit_field([(at, y) for at, _, y in (fit or data)])
    truth = np.array([y for *_, y in rest])
    slope, shift = fit_curve(np.array([raw_quality(model, at, w) for at, w, _ in rest]), truth)
    # the sample has other label shares than the corpus; move the odds back
    ones, zeros = max(1, truth.sum()), max(1, len(truth) - truth.sum())
    shift += float(np.log(sizes[1] / sizes[0]) - np.log(ones / zeros))
    return model._replace(slope=slope, shift=shift)


def score_text(model: Model, text: str | None) -> float:
    raw = raw_quality(model, *places(text))
    return float(1 / (1 + np.exp(-np.clip(model.slope * _logit(np.array(raw)) + model.shift, -30, 30))))


def score(model: Model | None, docs: DataFrame, text: str = "text") -> Column:
    """Chance that a text of docs is of good quality, over all its lines; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # PLACES weights

    @F.arrow_udf("double")
    def kernel(texts: pa.Array) -> pa.Array:
        found = pa.array([score_text(sent.value, t.as_py()) for t in texts], pa.float64())
        give_back()
        return found

    return kernel(F.col(text).cast("string"))


def line_quality(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, line, good, weight): each line's chance of being good, lines counted from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, weight = places(text)
                good = marginals(sent.value, at)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(good), pa.int64()), pa.array(np.arange(len(good))), pa.array(good), pa.array(weight)], names=["doc_id", "line", "good", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, "doc_id long, line long, good double, weight double")


def score_documents(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text), learned from labels(doc_id, quality) of rows not held out.

    Of repeated labels of a document the largest counts. Null and empty texts have one
    empty line and a score like any other. Without both labels every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("quality").alias("_quality")).where(crc_mod5(F.col("_doc")) != 0).groupBy("_doc").agg(F.max("_quality").alias("quality"))
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("_doc")), sample_each)
    held = F.coalesce(crc_mod5(F.col("doc_id")) == 0, F.lit(False))
    marked = docs.select("doc_id", held.alias("held_out"), score(model, docs).alias("score"))
    return marked.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
