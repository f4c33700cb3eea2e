"""Operator 2: a quality classifier by Bradley-Terry pairwise ranking.

Every text is described by numbers of its form (shares of letters, capitals, signs and digits,
word and line lengths, repetition, how far it can be compressed). From preference pairs of a
better and a worse text, weights are learnt by logistic loss on the differences of their
features (Newton's method, with a ridge). The threshold is the quantile of the training texts'
scores at the share of worse ones; a score of 0.7 stands for it.

The weights are fitted on the driver on at most ``SAMPLE`` labelled documents, chosen by a hash of
their id over all labels, and at most ``PAIRS`` pairs of them. All else runs over all rows.

Results for odd input: a null or empty text has features of its own (all zero) and a score;
ties go to the better side; labels that are null, not 0 or 1, or without a document are left out;
an id labelled twice counts as 1 if either says so; of documents that share an id one is learnt from,
that with the least features; if only one of the classes is there, all scores are 0.5; texts of any length are
read whole; repeated rows all get their score; an empty table gives no rows; other columns pass through
``keep_good`` unchanged, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from proofline.llm import store

SAMPLE = 20_000
PAIRS = 200_000
RIDGE = 1.0
THRESHOLD = 0.7
#: Slices of a long text for the measure of compression, so that memory is bounded.
SLICE = 1 << 20

_kind = np.zeros(256, np.int64)
_kind[[*range(97, 123)]] = 1
_kind[[*range(65, 91)]] = 2
_kind[[*range(48, 58)]] = 3
_kind[[9, 10, 11, 12, 13, 32]] = 4
_kind[[ord(c) for c in ".,;:'\"()-?"]] = 5
_kind[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_kind[128:192] = 7
_kind[192:] = 8
FEATURES = 24


def features(text: str | None) -> list[float]:
    """The numbers that describe a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * FEATURES
    raw = np.frombuffer(data, np.uint8)
    kind = _kind[raw]
    share = (np.bincount(kind, minlength=9) / len(raw)).tolist()
    same = float((raw[1:] == raw[:-1]).mean()) if len(raw) > 1 else 0.0
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    counts = Counter(words)
    often = sum(c for _, c in counts.most_common(10)) / n
    caps = sum(w[:1].isupper() for w in words) / n
    shout = sum(len(w) > 1 and w.isupper() for w in words) / n
    plain = sum(w[-1:].isalpha() for w in words) / n
    packed = sum(len(zlib.compress(data[i : i + SLICE], 1)) for i in range(0, len(data), SLICE)) / len(data)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in sizes) / n)
    return [
        1.0, *share[1:], same, math.log1p(n), math.log1p(len(lines)), len(counts) / n, often, caps, shout, plain,
        min(packed, 2.0), math.log1p(mean), math.log1p(spread), 1 - len(set(lines)) / len(lines),
        math.log1p(len(data) / len(lines)), data.count(b"http") / n, max(counts.values()) / n,
    ]


@dataclass
class Model:
    """Weights over standardised features, and the score that the threshold stands at."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` where the raw score is at the quantile."""
        if not len(x):
            return np.zeros(0)
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def fit(x: np.ndarray, better: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Model:
    """Bradley-Terry weights from pairs of a better and a worse row, and the quantile of scores at the share of worse ones."""
    if not better.any() or better.all():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    rng = np.random.default_rng(5)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance given to the wrong order
        gradient = d.T @ p - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)
    raw = np.sort(model.raw(x))
    k = len(bad)
    model.cut = float((raw[k - 1] + raw[k]) / 2)
    return model


def held_out():
    """Column: whether a row is kept out of training (crc32 of its id as text, modulo 4, is 2)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents that aren't held out: at most ``sample`` of them, by a hash of the id."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # ``sample`` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "quality", "doc_id"])

    every = rows.select("text", F.col("quality").cast("int"), "doc_id").mapInArrow(run, "x array<double>, quality int, doc_id long")
    # of rows that share an id, the one with the least features: ``sample`` rows at most
    found = every.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("one")).select("doc_id", "one.x", "one.quality").toArrow()
    table = sorted(zip(found.column("doc_id").to_pylist(), found.column("quality").to_pylist(), found.column("x").to_pylist(), strict=True))
    x = np.array([r[2] for r in table]).reshape(-1, FEATURES)
    return fit(x, np.array([r[1] == 1 for r in table], bool))


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column ``name``, which they lack, for the score; the text of each row is read once, in place."""
    columns, at = docs.columns, docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*columns, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches):
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns; all rows where the labels lack a class, as no model can be fitted."""
    model = train(docs, labels, sample)
    if not model.weights.any():
        return docs
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return with_scores(docs, model, name).filter(F.col(name) >= THRESHOLD).drop(name)
