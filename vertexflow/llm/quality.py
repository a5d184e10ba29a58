"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words and of its hashed character n-grams (over UTF-8 bytes), with a
softmax output over the two labels, trained by numpy stochastic gradient descent. As both layers are linear, scoring needs
only the product of the two, one number for each slot: 2**BITS floats, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import GAP, Block, blocks, byte_grams
from .storage import small_batches
from .training import bounded_sample, split_of

BITS, SIZES, DIM = 17, (2, 3, 4), 12
#: Fitted on at most this many rows of each label.
MAX_ROWS = {0: 1500, 1: 3000}


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """For each slot, the difference that it makes between the two logits."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _grams(block: Block) -> Iterator[np.ndarray]:
    """Slots at each place of the block's bytes; places in the gaps get slot 0, which no text has."""
    gap = np.ones(len(block.raw) - GAP, bool)
    for s, e in zip(block.starts, block.ends, strict=True):
        gap[s:e] = False
    for _, slots in byte_grams(block.raw, SIZES, BITS):
        slots[gap] = 0
        yield slots


def _word_slots(block: Block) -> tuple[np.ndarray, np.ndarray]:
    h, doc, _ = block.words(block.folded())
    return (h >> np.uint64(64 - BITS)).astype(np.int64), doc


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its slots and the share of each among its words and n-grams; none for an empty text."""
    out = []
    for block in blocks(texts):
        words, doc = _word_slots(block)
        grams = list(_grams(block))
        at = np.searchsorted(doc, np.arange(block.n + 1))
        for i, (s, e) in enumerate(zip(block.starts, block.ends, strict=True)):
            slots = np.concatenate([words[at[i] : at[i + 1]], *(g[s:e] for g in grams)])
            own, counts = np.unique(slots, return_counts=True)
            out.append((own, (counts / max(counts.sum(), 1)).astype(np.float32)))
    return out


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, rate: float = 0.3, seed: int = 11) -> Model:
    """Plain SGD with a linearly falling rate; the loss of each label weighs the same. No text: scores of 0.5."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))
    rows = features(texts)
    counts = np.bincount(np.asarray(labels, int), minlength=2) if labels else np.ones(2)
    weight = counts.sum() / (2.0 * np.maximum(counts, 1))
    step, steps = 0, max(epochs * len(rows), 1)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, share = rows[i]
            own = m.vectors[slots]
            mean = share @ own
            logits = np.clip(m.output @ mean + m.bias, -30, 30)
            p = np.exp(logits - logits.max())
            g = p / p.sum()
            g[int(labels[i])] -= 1
            g *= rate * (1 - step / steps) * weight[int(labels[i])]
            back = g @ m.output
            m.output -= np.outer(g, mean)
            m.bias -= g
            # each slot moves by its share; scaled by the distinct slots so that long texts learn as fast as short ones
            m.vectors[slots] = own - np.outer(share * min(len(slots), 400), back)
            step += 1
    return m


def score_texts(table: np.ndarray, offset: float, texts: list[bytes | None]) -> np.ndarray:
    out = np.empty(len(texts))
    for block in blocks(texts):
        words, doc = _word_slots(block)
        total = np.bincount(doc, weights=table[words], minlength=block.n).astype(float)  # integers where a block has no word
        n = np.bincount(doc, minlength=block.n) + len(SIZES) * (block.ends - block.starts)
        for slots in _grams(block):
            v = table[slots]
            v[slots == 0] = 0
            # an empty last text starts just beyond v
            total += np.add.reduceat(np.append(v, np.float32(0)), block.starts)
        out[block.first : block.first + block.n] = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + offset, -35, 35)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """All rows and columns of `docs` but the text, which becomes its score; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.table(), model.offset()))
    keep = [c for c in docs.columns if c not in (text, out)]
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offset = sent.value
        for b in batches:
            s = score_texts(table, offset, b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*keep, out])

    fields = frame.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias(out)).schema
    return frame.mapInArrow(run, fields)


def train(docs: DataFrame, labels: DataFrame, max_rows: dict[int, int] = MAX_ROWS) -> Model:
    """Fits on at most `max_rows` labelled documents (see training.bounded_sample); labels has doc_id and quality."""
    return fit(*bounded_sample(docs, labels, "quality", max_rows))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents, null and empty texts and repeated ids included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(split_of(F.col("doc_id"), 5) != 0)
    scored = score(docs.select("doc_id", "text"), train(docs, labels), out="score")
    return scored.select("doc_id", (split_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
