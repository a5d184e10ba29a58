"""Reachability in memory: the starts are dealt over the tasks, and a task follows its starts together, one bit for each."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Bytes of the bit matrix of one round of starts, words of 64 starts in a row of it at most.
MATRIX, WORDS = 32 << 20, 16
#: Vertices whose bits are turned into pairs at once, and pairs of a batch that leaves the task.
STRETCH, BATCH = 1 << 16, 1 << 17

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # an executor need not have this package


def closure(rows: DataFrame, kind: DataType, bundles: int = 1) -> DataFrame:
    """a and b of type `kind`, for every b that a start a leads to, itself included.

    rows: src, dst, start, bundle; where `start`, src is a vertex to start from, else src and dst are an edge. An edge and
    its ends lie in one bundle, and a task holds a bundle's edges whole.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-4 * cores // bundles))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    starts = rows.filter("start").withColumn("slice", F.pmod(F.hash("src"), F.lit(slices)))
    dealt = rows.filter("NOT start").withColumn("slice", every).unionByName(starts)
    part = (F.col("bundle").cast("long") * slices + F.col("slice")).alias("part")
    dealt = dealt.select(part, "src", "dst", "start").repartition(max(4 * cores, bundles), "part").sortWithinPartitions("part")
    pairs = dealt.mapInArrow(_pairs, f"a {rows.schema['src'].dataType.simpleString()}, b {rows.schema['dst'].dataType.simpleString()}")
    return pairs.select(F.col("a").cast(kind), F.col("b").cast(kind))


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part as a table; the rows of a part follow each other."""
    held, now = [], None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and part[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = part[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each part."""
    for rows in tables(batches):
        yield from _followed(rows)


def _followed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    types = [rows.schema.field(c).type for c in ("src", "dst")]
    src, dst, start = (rows.column(c).to_numpy() for c in ("src", "dst", "start"))
    if not start.any():
        return
    ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    own, edge = place[: len(src)][start], ~start
    s, d = place[: len(src)][edge], place[len(src) :][edge]
    order = np.argsort(d, kind="stable")
    s, d = s[order], d[order]
    words = int(min(WORDS, max(1, MATRIX // (8 * len(ids))), -(-len(own) // 64)))
    for first in range(0, len(own), 64 * words):
        some = own[first : first + 64 * words]
        bits = _spread(len(ids), s, d, some, words)
        for at in range(0, len(ids), STRETCH):
            stretch = bits[at : at + STRETCH]
            for w in range(words):
                b, a = np.nonzero(np.unpackbits(np.ascontiguousarray(stretch[:, w : w + 1]).view(np.uint8), axis=1, bitorder="little"))
                for lo in range(0, len(a), BATCH):
                    hi = lo + BATCH
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some[64 * w + a[lo:hi]]], types[0]), pa.array(ids[at + b[lo:hi]], types[1])], ["a", "b"])


def _spread(n: int, s: np.ndarray, d: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """A row of bits for each of n vertices: those of the starts that lead to it. Edges s to d come sorted by d."""
    bits = np.zeros((n, words), "<u8")
    k = np.arange(len(starts))
    bits[starts, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    moved = np.zeros(n, bool)
    moved[starts] = True
    while True:
        along = np.flatnonzero(moved[s])
        if not len(along):
            return bits
        ends = d[along]
        heads = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
        to = ends[heads]
        got = bits[to] | np.bitwise_or.reduceat(bits[s[along]], heads, axis=0)
        new = (got != bits[to]).any(axis=1)
        moved[:] = False
        moved[to[new]] = True
        bits[to] = got
