"""Bounded samples of labelled rows for fitting classifiers, and the split rule that the queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer texts are scored but not fitted on.
MAX_BYTES = 65536


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: dict, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text and label of some documents: for each label value, at most max_rows[value] rows of at most
    `max_bytes` bytes each. The choice depends on the ids alone.

    labels: doc_id and `label`; null ids and labels are left out, and of several labels of one id the largest counts.
    A text that several rows of `docs` repeat under one id counts once.
    """
    named = labels.select("doc_id", F.col(label).alias("label")).dropna()
    named = named.groupBy("doc_id").agg(F.max("label").alias("label"))
    picks = [named.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in max_rows.items()]
    return texts_of(docs, reduce(DataFrame.union, picks), max_bytes)


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: dict, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list]:
    """Texts and labels of sample_rows, on the driver, in the order of the ids."""
    return _collected(sample_rows(docs, labels, label, max_rows, max_bytes))


def texts_of(docs: DataFrame, chosen: DataFrame, max_bytes: int) -> DataFrame:
    """doc_id, text and label of the ids in `chosen`, whose rows are few by construction."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).filter(F.octet_length("text") <= max_bytes)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fetch(docs: DataFrame, chosen: DataFrame, max_bytes: int) -> tuple[list[bytes], list]:
    """Texts and labels of texts_of, on the driver, in the order of the ids."""
    return _collected(texts_of(docs, chosen, max_bytes))


def _collected(rows: DataFrame) -> tuple[list[bytes], list]:
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return [bytes(r["text"]) for r in rows], [r["label"] for r in rows]
