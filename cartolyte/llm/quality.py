"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's features are its hashed words, with damped counts scaled to unit length, the plain presence of telling
words, and a few shares (upper case, digits, signs, repeated words). Telling words are those that depend on the grade
and that few documents of the best grade have; their presence is not scaled, as one abusive sentence makes a long text
abusive. One weight vector is shared by all grades; ordered thresholds
t_1 < t_2 < ... turn the score s into tail probabilities P(grade >= k) = 1 / (1 + exp(t_k - s)), whose sum is the
expected grade.

Training fits a bounded sample of rated documents, ``SAMPLE`` at most, chosen by a hash of their ids: the features are
made where the documents are read, one task fits the sample, and only the weights come to the driver. The model has a
fixed size (``BITS``), so it is broadcast. Scoring is one pass over all whole texts without a shuffle.

Grades: 0 for low quality, 1 for good prose that is toxic, 2 for good prose that is not.

Defined cases: null and empty texts score as documents without features; rows without a rating are not trained on,
ratings without a document neither; with fewer than two grades in the sample the model is constant; an empty table
gives an empty result; extra columns are ignored by :func:`score` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolyte.llm.common import bounded_batches, ids_as_text, ids_restored

#: Size of the hashed feature space, as a power of two.
BITS = 20
#: Rated documents that the model is fitted on, at most.
SAMPLE = 5000
GRADES = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHARES = 8


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def features(text: str, slots: dict[str, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; ``slots`` is a cache of word hashes."""
    words = _WORD.findall(text)
    n = len(words)
    shares = np.zeros(_SHARES)
    size = 1 << bits
    if not n:
        shares[0] = 1.0
        return np.arange(size - _SHARES, size), shares
    if len(slots) > 60_000:
        slots.clear()
    get = slots.get
    found = []
    for w in words:
        s = get(w)
        if s is None:
            s = slots[w] = zlib.crc32(w.strip(".,;:!?\"'()#$%&*").lower().encode("utf-8", "surrogatepass")) % (size // 2 - _SHARES)
        found.append(s)
    at, counts = np.unique(np.array(found, np.int64), return_counts=True)
    values = 1.0 + np.log(counts)
    values /= np.sqrt((values**2).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    length = len(raw)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    digits = (raw >= 48) & (raw <= 57)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    shares[1] = ((raw >= 65) & (raw <= 90)).sum() / length
    shares[2] = digits.sum() / length
    shares[3] = (~(letters | digits | blank)).sum() / length
    shares[4] = 1.0 - len(at) / n
    shares[5] = min(n, 2000) / 2000
    shares[6] = min(counts.max() / n, 1.0)
    shares[7] = 1.0 if n < 20 else 0.0
    return np.concatenate([at, at + size // 2, np.arange(size - _SHARES, size)]), np.concatenate([values, np.full(len(at), 0.5), 3.0 * shares])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def telling(at: np.ndarray, owner: np.ndarray, grades: np.ndarray, size: int, levels: int, most: int = 4096, least_docs: int = 5, best_share: float = 0.02) -> np.ndarray:
    """A flag for each feature: enough documents have it, few of the best grade, and it depends on the grade (chi-square)."""
    seen = np.stack([np.bincount(at[grades[owner] == k], minlength=size) for k in range(levels)])
    total = np.bincount(grades, minlength=levels)[:, None]
    docs = seen.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        hope = total * docs / total.sum()
        gap = (seen - hope) ** 2
        chi = np.nansum(gap / np.maximum(hope, 1e-9) + gap / np.maximum(total - hope, 1e-9), axis=0)
    chi[(docs < least_docs) | (seen[-1] > best_share * total[-1, 0])] = 0.0
    rank = np.argsort(-chi, kind="stable")[:most]
    out = np.zeros(size, bool)
    out[rank[chi[rank] > 12.0]] = True
    return out


def slopes(score: np.ndarray, grades: np.ndarray, start: float, gaps: np.ndarray, case: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log likelihood, and its slopes by the scores and by (start, gaps).

    Thresholds are start, start + exp(gaps[0]), and so on; the chance of a grade is the difference of two tails.
    """
    n, levels = len(score), len(gaps) + 2
    thresholds = start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    tail = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))], axis=1)
    above, below = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
    chance = np.maximum(above - below, 1e-9)
    slope_a, slope_b = above * (1 - above), below * (1 - below)
    d_threshold = np.zeros(levels - 1)
    np.add.at(d_threshold, np.maximum(grades - 1, 0), np.where(grades > 0, case * slope_a / chance, 0))
    np.add.at(d_threshold, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -case * slope_b / chance, 0))
    head = np.concatenate([[d_threshold.sum()], np.cumsum(d_threshold[::-1])[::-1][1:] * np.exp(gaps)])
    return float(-(case * np.log(chance)).sum()), -case * (slope_a - slope_b) / chance, head


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int = BITS, levels: int = GRADES, epochs: int = 120, penalty: float = 2e-4, rate: float = 0.5) -> Model:
    """Proportional-odds regression by full-batch gradient steps with per-weight step sizes.

    The likelihood is that of the cumulative-link model; thresholds are kept in order by fitting their gaps' logarithms.
    """
    weights, start, gaps = np.zeros(1 << bits), 0.0, np.zeros(levels - 2)
    if len(np.unique(grades)) < 2:
        level = int(grades[0]) if len(grades) else levels - 1
        return Model(weights, np.where(np.arange(1, levels) <= level, -20.0, 20.0))
    used, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    values, size = np.concatenate([r[1] for r in rows]), len(used)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    plain = (used >= (1 << bits) // 2) & (used < (1 << bits) - _SHARES)
    chosen = ~plain | telling(at, owner, grades, size, levels)
    inside = chosen[at]
    at, values, owner, own = at[inside], values[inside], owner[inside], np.zeros(size)
    share = np.bincount(grades, minlength=levels) / len(grades)
    case = (1.0 / np.maximum(share, 1e-9))[grades] ** 0.5
    case /= case.sum()
    squares, head_squares = np.full(size, 1e-6), np.full(levels - 1, 1e-6)
    for _ in range(epochs):
        score = np.bincount(owner, values * own[at], len(rows))
        _, push, head = slopes(score, grades, start, gaps, case)
        grad = np.bincount(at, values * push[owner], size) + penalty * own
        squares += grad**2
        head_squares += head**2
        own -= rate * grad / np.sqrt(squares)
        step = rate * head / np.sqrt(head_squares)
        start, gaps = start - step[0], np.clip(gaps - step[1:], -6, 6)
    weights[used] = own
    return Model(weights, start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade): at most ``sample`` rated documents, chosen by a hash of the id."""
    # An ordered limit keeps the first rows of each task only, so the ratings are not sorted as a whole.
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    chosen = marks.select("doc_id", grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> Model:
    def make(frames):
        slots: dict[str, int] = {}
        for frame in frames:
            made = [features(t, slots, bits) for t in frame["text"].fillna("")]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "grade": frame["grade"].astype("int64"), "at": [a.astype(np.int32) for a, _ in made], "value": [v.astype(np.float32) for _, v in made]})

    def solve(frames):
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"doc_id": [], "grade": [], "at": [], "value": []})]).sort_values("doc_id", kind="stable")
        model = fit(list(zip(rows["at"], rows["value"])), rows["grade"].to_numpy(np.int64), bits)
        used = np.flatnonzero(model.weights)
        yield pd.DataFrame({"slot": np.concatenate([-1 - np.arange(len(model.thresholds)), used]), "weight": np.concatenate([model.thresholds, model.weights[used]])})

    bounded_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rated(docs, labels, sample).mapInPandas(make, f"doc_id {kind}, grade long, at array<int>, value array<float>")
    solved = made.repartition(1).mapInPandas(solve, "slot long, weight double").toPandas()
    slot, weight = solved["slot"].to_numpy(), solved["weight"].to_numpy()
    weights = np.zeros(1 << bits)
    weights[slot[slot >= 0]] = weight[slot >= 0]
    return Model(weights, weight[slot < 0][np.argsort(-slot[slot < 0])])


def predict(texts: list[str], model: Model, slots: dict[str, int], bits: int = BITS) -> np.ndarray:
    """Tail probabilities P(grade >= 1), P(grade >= 2), ... of each text."""
    scores = np.empty(len(texts))
    for i, t in enumerate(texts):
        at, values = features(t, slots, bits)
        scores[i] = values @ model.weights[at]
    return _sigmoid(scores[:, None] - model.thresholds)


def _model(docs: DataFrame, labels: DataFrame, bits: int, sample: int):
    model = train(docs, labels, bits, sample)
    return docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, expected_grade, p_good, p_best, kept) of every document."""
    shared = _model(docs, labels, bits, sample)

    def run(frames):
        slots: dict[str, int] = {}
        for frame in frames:
            tails = predict(frame["text"].fillna("").tolist(), Model(*shared.value), slots, bits)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "expected_grade": tails.sum(axis=1), "p_good": tails[:, 0], "p_best": tails[:, -1], "kept": tails[:, -1] >= 0.5})

    out = ids_as_text(docs, "doc_id", F.col("text")).mapInPandas(run, "doc_id string, expected_grade double, p_good double, p_best double, kept boolean")
    return ids_restored(out, docs, "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """The documents whose probability of the best grade is ``least`` or more, with all their columns as they are."""
    bounded_batches(docs)
    shared, text_at = _model(docs, labels, bits, sample), docs.columns.index("text")

    def run(batches):
        slots: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array(predict(texts, Model(*shared.value), slots, bits)[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
