"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate keeps its own learning rate, and the L1 term leaves most coordinates at exactly zero. What is shipped to
the executors is the list of non-zero coordinates, whose number is bounded by 2**bits whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import blocks, word_grams
from .storage import small_batches
from .training import sample_rows, split_of

#: Distances of the word pairs: bigrams and skip-grams over one word.
SKIPS = (1, 2)


@dataclass
class Model:
    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.slots] = self.weights
        return dense


class Ftrl:
    """FTRL-proximal over binary features; slot 2**bits is the bias and has no L1 term."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


#: Bits of a slot's number.
BITS = 22


def fit(texts: list[bytes], labels: list[int], bits: int = BITS, epochs: int = 2, seed: int = 7, least: int = 4) -> Model:
    """Trains on the texts in `epochs` seeded orders; coordinates that fewer than `least` texts have stay at zero.

    The rarer label weighs more, by the root of how much rarer it is. Few passes and a strong L1 term keep chance pairs of
    long texts out of the model. No text: a model that scores 0.5 everywhere.
    """
    learner = Ftrl(bits)
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for block in blocks(texts):
        slots, doc = word_grams(block, bits, SKIPS)
        key = np.unique((doc << bits) | slots)
        found.append((key & ((1 << bits) - 1)).astype(np.int32))
        sizes.append(np.bincount(key >> bits, minlength=block.n))
    # all texts' slots one after the other: a few large arrays go back to the system, many small ones would not
    slots = np.concatenate(found)
    del found
    live = (np.bincount(slots, minlength=1 << bits) >= least)[slots]
    ends = np.cumsum(np.concatenate(sizes))
    ends = np.append(np.zeros(1, np.int32), np.cumsum(live, dtype=np.int32))[ends]
    slots, starts = slots[live], np.append(0, ends)
    bias = np.array([1 << bits], np.int32)
    order = np.random.default_rng(seed)
    counts = np.bincount(np.asarray(labels, int), minlength=2) if labels else np.ones(2)
    weight = np.sqrt(np.maximum(1.0, counts.max() / np.maximum(counts, 1)))
    for _ in range(epochs):
        for i in order.permutation(len(ends)):
            learner.learn(np.append(slots[starts[i] : ends[i]], bias), int(labels[i]), weight[int(labels[i])])
    at = np.flatnonzero(np.abs(learner.z[:-1]) > learner.l1)
    return Model(bits, at, learner.weights(at).astype(np.float32), float(learner.weights(bias)[0]))


def score_texts(model: Model, table: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for block in blocks(texts):
        slots, doc = word_grams(block, model.bits, SKIPS)
        live = np.flatnonzero(table[slots])  # the few that the L1 term left
        key = np.unique((doc[live] << model.bits) | slots[live])
        total = np.bincount(key >> model.bits, weights=table[key & ((1 << model.bits) - 1)], minlength=block.n)
        out[block.first : block.first + block.n] = 1.0 / (1.0 + np.exp(-np.clip(total + model.bias, -35, 35)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows and columns of `docs` but the text, which becomes its score; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text, out)]
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.table()
        for b in batches:
            s = score_texts(own, table, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*keep, out])

    fields = frame.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(out)).schema
    return frame.mapInArrow(run, fields)


#: Fitted on at most this many rows of each label.
MAX_ROWS = {0: 5000, 1: 3000}


def train(docs: DataFrame, labels: DataFrame, max_rows: dict[int, int] = MAX_ROWS) -> Model:
    """Fits on at most `max_rows` labelled documents (see training.sample_rows); labels has doc_id and toxic.

    The fit runs in a task, so that the driver holds the model's few coordinates but neither the texts nor the learner.
    """
    small_batches(docs.sparkSession)
    rows = sample_rows(docs, labels, "toxic", max_rows).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            marks += b.column(2).to_pylist()
        m = fit(texts, marks)
        made = [pa.array([x], kind) for x, kind in ((m.slots.tolist(), pa.list_(pa.int64())), (m.weights.tolist(), pa.list_(pa.float32())), (m.bias, pa.float64()))]
        yield pa.RecordBatch.from_arrays(made, names=["slots", "weights", "bias"])

    own = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "slots array<long>, weights array<float>, bias double").head()
    if own is None:  # no task without a row
        return fit([], [])
    return Model(BITS, np.array(own["slots"], np.int64), np.array(own["weights"], np.float32), own["bias"])


def learnable(labels: DataFrame) -> DataFrame:
    """The labelled rows that the contract lets the model see."""
    return labels.filter(split_of(F.col("doc_id"), 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents, null and empty texts and repeated ids included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, learnable(labels)), out="score")
    return scored.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A document at or above this score goes, in the pipeline.
REJECT = 0.7


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score at or above REJECT go, all others stay unchanged (see filtered)."""
    model = train(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return filtered(docs, model)


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below REJECT. A null text scores as an empty one and stays null;
    ids play no part, so null and repeated ids are rows like any other. An empty table gives none."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table = own.table()
        for b in batches:
            s = score_texts(own, table, b.column(at).cast(pa.large_binary()).to_pylist())
            yield b.filter(pa.array(s < REJECT))

    return docs.mapInArrow(run, docs.schema)
