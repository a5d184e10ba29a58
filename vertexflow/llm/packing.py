"""Best-fit packing of token sequences with certified bin counts.

Documents become token ids, an end id, and pieces of at most CAPACITY ids. Full pieces are sequences of their own. The
others are dealt by hash into groups of about GROUP pieces, and each group is packed by best-fit decreasing. Dual-feasible
functions give a lower bound on the bins that the group's lengths need in any packing: a group that meets its bound is
finished. Groups with a gap give up the documents of their emptier bins, which are dealt into new groups and packed again,
for as long as that saves bins.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from string import punctuation
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import BATCH_ROWS, small_batches, stored

CAPACITY, END = 4096, 1
GROUP, ROUNDS, FULL = 20_000, 4, 0.995
VOCABULARY = "word_bpe_49k.json"
#: How the vocabulary above folds and cuts texts, from its own file.
FOLDS = r"""{"normalizers": [{"type": "NFC"}, {"content": " ", "pattern": {"Regex": "\\s+"}, "type": "Replace"}, {"type": "Lowercase"}], "type": "Sequence"}"""
SPLITS = r"""{"pretokenizers": [{"behavior": "Removed", "invert": true, "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "type": "Split"}, {"add_prefix_space": false, "trim_offsets": true, "type": "ByteLevel", "use_regex": false}], "type": "Sequence"}"""
#: Parts of texts that a Python worker remembers before it starts afresh.
REMEMBERED = 250_000


def vocabulary_path(name: str) -> str:
    """A file of the installed public tokenizers, or the name itself where it is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Store:
    """Token id runs of words, one after the other in arrays that grow; run 0 is empty."""

    def __init__(self) -> None:
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n, self.used = 1, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers of the new runs, which are `ids` cut into `sizes`."""
        n, used = self.n + len(sizes), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.zeros(used, np.uint32))
        if n > len(self.starts):
            self.starts, self.sizes = (np.append(x[: self.n], np.zeros(n, np.int64)) for x in (self.starts, self.sizes))
        self.ids[self.used : used] = ids
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        new = range(self.n, n)
        self.n, self.used = n, used
        return new


def spread(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `ids` that start and last as given, side by side."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return ids[at]


class Encoder:
    """Token ids of texts.

    A vocabulary that cuts texts as SPLITS says drops white space before it merges anything, so the ids of a text are those of
    the parts between its blanks and line feeds, one after the other; each distinct part is encoded once as long as it is
    remembered. Whole texts are encoded with any other vocabulary. Letters are
    merged apart from punctuation after them, so a part of letters with such a tail is looked up in two; many words are
    encoded in one call and told apart by the ids that end a word.
    """

    TAIL_BITS = 24

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        whole = json.loads(self.tokenizer.to_str())
        self.splits = [json.dumps(whole[k], sort_keys=True) for k in ("normalizer", "pre_tokenizer")] == [FOLDS, SPLITS] and whole["model"].get("end_of_word_suffix") == "</w>"
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.store = Store()
        self.runs: dict[str, int] = {"": 0}  # of words, tails and other parts
        self.known: dict[str, int] = {"": 0}  # of parts: the word's run and the tail's

    def _whole(self, parts: list[str]) -> range:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return self.store.add(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)

    def _letters(self, words: list[str]) -> range:
        """Runs of words of nothing but letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            return self._whole(words)
        return self.store.add(ids, np.diff(stops, prepend=0))

    def _learn(self, new: list[str]) -> None:
        runs, cores, tails, odd = self.runs, [], [], []
        for w in new:
            c = w.rstrip(punctuation)
            if c.isascii():
                if c.isalpha():
                    cores.append(c.lower())
                    tails.append(w[len(c) :])
                    continue
            elif normalize("NFC", c).lower().isalpha():  # some letters come apart into a letter and a mark
                cores.append(c)
                tails.append(w[len(c) :])
                continue
            cores.append(w)
            tails.append("")
            odd.append(w)
        odd = set(odd).union(tails)
        words = list(set(cores).difference(runs, odd))
        for i in range(0, len(words), 512):
            runs.update(zip(some := words[i : i + 512], self._letters(some), strict=True))
        odd = list(odd.difference(runs))
        runs.update(zip(odd, self._whole(odd), strict=True))
        shift = self.TAIL_BITS
        self.known.update((w, runs[c] << shift | runs[t]) for w, c, t in zip(new, cores, tails, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and for each text where its ids end."""
        if not self.splits:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1]) if len(got) else 0), ends
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > self.remembered or self.store.n >= (1 << self.TAIL_BITS) - len(parts) * 2:
            self._forget()
        if new := [w for w in parts if w not in self.known]:
            self._learn(new)
        both = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        pair = np.stack([both >> self.TAIL_BITS, both & ((1 << self.TAIL_BITS) - 1)], 1)
        sizes = self.store.sizes[pair]
        ids = spread(self.store.ids, self.store.starts[pair].ravel(), sizes.ravel())
        sizes = sizes.sum(1)
        own = sizes[codes]
        ends = np.append(0, np.cumsum(own))[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        return spread(ids, (np.cumsum(sizes) - sizes)[codes], own), ends


@cache
def encoder_of(vocabulary: str, remembered: int) -> Encoder:
    """One for each Python worker, whose tasks share what it remembers."""
    return Encoder(vocabulary, remembered)


def pieces(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED, batch: int = BATCH_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every row; a null text has just the end id.

    Only documents of more than `capacity` ids are cut, and only their last piece may be shorter than that.
    """
    small_batches(docs.sparkSession, batch)
    frame = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    schema = docs.select("doc_id", *[F.lit(0).cast(t).alias(n) for n, t in (("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))], F.array().cast("array<int>").alias("ids")).schema
    if not with_ids:
        schema = type(schema)(schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, remembered)
        for batch in batches:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            ids, ends = encoder.encode(batch.column(1))
            first = 0
            for i, last in enumerate(ends.tolist()):
                coded = np.append(ids[first:last], END).astype("<u4")
                first = last
                for k, s in enumerate(range(0, len(coded), capacity)):
                    part = coded[s : s + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        own.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    return frame.mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that two families of dual-feasible functions give on the bins that the lengths need.

    A dual-feasible function maps lengths so that no set that fits a bin maps to more than a bin; the mapped total, in
    bins, bounds the number of bins of any packing.
    """
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    count, total = np.append(0, np.cumsum(number)), np.append(0, np.cumsum(number * x))
    # lengths under t count nothing, those over capacity - t a whole bin, others themselves
    t = np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - t + 1]
    between = total[capacity - t + 1] - total[t]
    best = -(-(whole * capacity + between) // capacity)
    # rounding down to multiples of 1 / k of a bin, exact multiples of 1 / (k + 1) staying what they are
    rounded = 0
    for k in range(1, 33):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        mapped = np.where(exact, x * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        rounded = max(rounded, -(-int((mapped * number).sum()) // (k * capacity)))
    return int(max(best.max(), rounded))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length, by best-fit decreasing; ties in the order given."""
    bins = np.empty(len(lengths), np.int64)
    free: dict[int, list[int]] = {}
    open_rooms = opened = 0  # bit r of open_rooms is set if some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = free[room]
            b = own.pop()
            if not own:
                open_rooms &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i] = b
        if room > n:
            free.setdefault(room - n, []).append(b)
            open_rooms |= 1 << (room - n)
    return bins


def _pack(items: DataFrame, capacity: int, group: int, turn: int) -> DataFrame:
    """Adds turn, part, bin, fill (of the bin), gap (of the part: its bins above its lower bound) to items."""
    parts = max(1, -(-items.count() // group))
    # rows without an id would otherwise meet where their pieces agree
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    keyed = items.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", salt), F.lit(parts)))
    schema = keyed.selectExpr("*", "0L AS bin", "0L AS fill", "0L AS gap").schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return rows.assign(bin=bins, fill=fill[bins], gap=len(fill) - lower_bound(lengths, capacity))

    return keyed.groupBy("part").applyInPandas(run, schema).withColumn("turn", F.lit(turn).cast("long"))


def _bins(packed: DataFrame) -> int:
    return packed.select("part", "bin").distinct().count()


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). No pieces: an empty result."""
    cut = stored(cut)
    open_items = cut.filter(F.col("length") < capacity)
    now = stored(_pack(open_items, capacity, group, 0))
    settled = []
    for turn in range(1, rounds + 1):
        loose = (F.col("gap") > 0) & (F.col("fill") < FULL * capacity)
        pool = now.filter(loose)
        before = _bins(pool)
        if before < 2:
            break
        again = stored(_pack(pool.drop("turn", "part", "bin", "fill", "gap"), capacity, group, turn))
        if _bins(again) >= before:
            break
        settled.append(now.filter(~loose))
        now = again
    placed = now
    for other in settled:
        placed = placed.unionByName(other)
    # the turn, the part and the bin side by side: all three are far below their shares of the bits
    number = F.shiftleft(F.col("turn"), 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")
    placed = placed.withColumn("sequence_id", number).drop("turn", "part", "bin", "fill", "gap")
    place = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(place, F.lit(0)).cast("long"))
    alone = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.shiftleft(F.lit(1).cast("long"), 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(alone)


def certificates(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """part, bins, bound (that the part's lengths need in any packing) and gap for each group of short pieces in the result of
    `pack`; a group without a gap is packed as well as it can be. The lengths of a group are counted before they meet."""
    rows = placed.filter(F.col("length") < capacity).withColumn("part", F.shiftright("sequence_id", 24))
    bins = rows.groupBy("part").agg(F.count_distinct("sequence_id").alias("bins"))
    lengths = rows.groupBy("part", "length").agg(F.count("*").alias("n"))

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        every = np.repeat(part["length"].to_numpy(), part["n"].to_numpy())
        return pd.DataFrame({"part": part["part"].iloc[:1], "bound": [lower_bound(every, capacity)]})

    out = bins.join(lengths.groupBy("part").applyInPandas(bound, "part long, bound long"), "part")
    return out.select("part", "bins", "bound", (F.col("bins") - F.col("bound")).alias("gap"))


def packed_sequences(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and ids (the tokens of its pieces in place, `capacity` at most) of every sequence."""
    cut = stored(pieces(docs, text, vocabulary, capacity, with_ids=True))
    placed = pack(cut.drop("ids"), capacity).dropDuplicates(["doc_id", "piece", "sequence_id", "offset"])
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = cut.dropDuplicates(key).alias("i")
    joined = placed.alias("p").join(ids, [F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key])
    ordered = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "i.ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def packed(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, remembered: int = REMEMBERED, batch: int = BATCH_ROWS) -> DataFrame:
    """The pieces of all rows with their places. Remembering more and larger batches save encoding and cost memory."""
    return pack(pieces(docs, text, vocabulary, remembered=remembered, batch=batch)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of documents; a null text has the end id alone."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), remembered=1_200_000, batch=2 * BATCH_ROWS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the place of every document's pieces; a document that the mix repeats is packed each time. A null text has
    the end id alone; null and repeated ids are documents like any other; other columns are not read."""
    return packed(docs)
