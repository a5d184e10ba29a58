"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary linear classifier over hashed byte n-grams predicts each bit; the
decoder sums, over the bits, the logistic loss of each codeword, weighted by how reliable the bit proved on rows set aside,
and takes the codeword of least loss. A small lead over the second codeword marks the document as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import GAP, IS_WORD, Block, blocks, byte_grams
from .storage import small_batches
from .training import MAX_BYTES, fetch, split_of

BITS, SIZES = 14, (2, 3)
#: Fitted on at most this many rows, spread evenly over the languages.
MAX_ROWS = 4000
UNKNOWN = "und"
#: Texts whose n-grams are counted at once, in a table of 2**BITS numbers each.
ROWS = 64
#: Two best codewords whose probabilities differ by less are flagged.
LEAD = 0.2


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k distinct codewords of 7 or more bits; of 300 seeded draws the one whose closest two codewords differ most.

    Every bit separates at least one language from the others when k is 2 or more.
    """
    bits = max(7, int(np.ceil(4 * np.log2(max(k, 2)))))
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(300):
        code = rng.choice([-1, 1], (k, bits))
        same = np.flatnonzero(np.abs(code.sum(0)) == k)
        code[rng.integers(k, size=len(same)), same] *= -1 if k > 1 else 1
        apart = (bits - code @ code.T) // 2 + bits * np.eye(k, dtype=int)
        if apart.min() > most:
            best, most = code, int(apart.min())
    return best


def _counts(block: Block) -> np.ndarray:
    """Share of each slot among the n-grams of each text that have a letter, digit or byte over 127 in them."""
    low = block.folded()
    low[~IS_WORD[low]] = 32
    size = 1 << BITS
    at = np.zeros(len(low) - GAP, np.int64)
    live = np.zeros(len(at), bool)
    for i, (s, e) in enumerate(zip(block.starts, block.ends, strict=True)):
        at[s:e], live[s:e] = i, True
    live &= low[: len(at)] != 32
    total = np.zeros(block.n * size, np.float32)
    for _, slots in byte_grams(low, SIZES, BITS):
        total += np.bincount((at * size + slots)[live], minlength=block.n * size)
    total = total.reshape(block.n, size)
    return total / np.maximum(total.sum(1, keepdims=True), 1)


def fit(texts: list[bytes], langs: list[str], epochs: int = 6, rate: float = 15.0, seed: int = 3) -> Model:
    """One logistic classifier for each bit, all trained in the same passes; every tenth text is set aside to weigh the bits."""
    names = sorted(set(langs))
    code = codewords(max(len(names), 1))
    m = Model(names, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.ones(code.shape[1]))
    rows = []
    for block in blocks(texts, rows=ROWS):
        for x in _counts(block):
            slots = np.flatnonzero(x)
            rows.append((slots, x[slots]))
    want = np.array([(code[names.index(v)] + 1) / 2 for v in langs]) if texts else np.zeros((0, code.shape[1]))
    aside = np.arange(len(rows)) % 10 == 9
    learn = np.flatnonzero(~aside)
    rng = np.random.default_rng(seed)
    for e in range(epochs):
        for i in rng.permutation(learn):
            slots, share = rows[i]
            own = m.weights[slots]
            g = 1 / (1 + np.exp(-np.clip(share @ own + m.bias, -30, 30))) - want[i]
            g *= rate * (1 - e / epochs)
            m.weights[slots] = own - np.outer(share, g)
            m.bias -= 0.01 * g
    if aside.any():
        said = np.array([rows[i][1] @ m.weights[rows[i][0]] + m.bias for i in np.flatnonzero(aside)])
        right = ((said > 0) == (want[aside] > 0.5)).mean(0)
        m.trust = np.log((right + 0.01) / (1.01 - right)).clip(0.1)
    return m


def predict_texts(m: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, its probability, and whether the second is close."""
    best, sure, close = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for block in blocks(texts, rows=ROWS):
        bits = _counts(block) @ m.weights + m.bias
        loss = np.stack([(np.logaddexp(0, -bits * c) * m.trust).sum(1) for c in m.code], 1)
        loss /= m.trust.mean()
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)[:, ::-1]
        at = slice(block.first, block.first + block.n)
        best[at], sure[at] = p.argmax(1), top[:, 0]
        close[at] = top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0) < LEAD
    return best, sure, close


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, then lang_pred, score (0 to 1) and ambiguous, in place of columns so named.

    A null text, one without a letter, or any text if no language was learned, gets `und` with score 0, not ambiguous.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "ambiguous")
    keep = [c for c in docs.columns if c != text and c not in new]
    own_columns = [F.col(f"`{c}`") for c in keep]
    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(*own_columns, has_letter.alias("lang_pred"), F.col(f"`{text}`").cast("binary").alias("score"))
    fields = docs.select(*own_columns, F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(False).alias(new[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            known = b.column(len(keep)).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, sure, close = predict_texts(m, b.column(len(keep) + 1).to_pylist())
            best[~known], sure[~known], close[~known] = len(m.languages), 0.0, False
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(sure), pa.array(close)], names=[*keep, *new])

    return frame.mapInArrow(run, fields)


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on at most `max_rows` documents of at most `max_bytes` bytes with an id and a lang, chosen by their ids, from
    each language at a rate that gives rare languages as many rows as common ones."""
    named = docs.select("doc_id", F.col("lang").alias("label")).dropna()
    counts = named.groupBy("label").agg(F.count("*").alias("rows"))
    each = max_rows / max(counts.count(), 1)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = named.join(counts, "label").filter(draw < each / F.col("rows"))
    chosen = picked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return fit(*fetch(docs, chosen, max_bytes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every row of documents, null and empty texts and repeated ids included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(split_of(F.col("doc_id"), 3) != 1))
    held_out = (split_of(F.col("doc_id"), 3) == 1).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
