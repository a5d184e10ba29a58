"""SimHash near-dedup: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

A fingerprint has 64 bits in six blocks. Two fingerprints that differ in at most three bits agree on at least three of the
blocks, so they meet under one of the twenty keys that three blocks make, of some 32 bits each. Only distinct fingerprints
take part, so exact copies cost nothing. A bucket of more than BUCKET fingerprints is not joined with itself: its members
are linked through the values near them instead, in a number of rows that grows with the members, not with their pairs.

The pipeline's stage looks wider, for texts whose five-word shingles are 0.8 alike (Jaccard): fingerprints that agree on three
of eight blocks meet, which all within five bits do, and most within eight. Beyond three bits, the distance of two sketches
decides, fingerprints of 256 bits over five-word shingles: small ones link, large ones don't, and between them the shingles
themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import own_row, row_column, small_batches, stored

SHINGLE, SEED, DISTANCE, BLOCKS, BUCKET = 3, 42, 3, 6, 256
#: The wide form: bits between fingerprints; blocks, and how many of them agree; rounds of sparse links, members of a bucket that
#: a part of the last join takes; words of a shingle, its similarity, bits between sketches that surely link and that may.
FAR, FAR_BLOCKS, FAR_AGREE, ROUNDS, PART = 10, 8, 3, 3, 256
LONG_SHINGLE, SIMILAR, SURE, DOUBTFUL = 5, 0.8, 30, 52
SKETCH = ["s0", "s1", "s2", "s3"]
#: A table of more rows than this is joined by shuffle instead of broadcast.
SMALL = 200_000


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the text, of the whole sequence if it has fewer words; nothing without a word."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each set if more than half of the hashes have it set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if more than half of the text's shingles have it set in their hash; 0 without a word."""
    return _majority(_hashes(text, shingle))


def sketch(text: bytes | None) -> list[int]:
    """Four fingerprints over five-word shingles, the hashes mixed anew for each."""
    hashes, out = _hashes(text, LONG_SHINGLE), []
    for _ in SKETCH:
        out.append(_majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, text: str = "text", body: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and, if asked for, body (the text's md5) and the sketch's columns of each
    row; a null text counts as empty."""
    small_batches(docs.sparkSession)
    mark = [F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("body")] if body else []
    names = ["fp", *SKETCH] if body else ["fp"]
    raw = docs.select("doc_id", *mark, F.col(text).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(b.num_columns - 1))
            bits = [[fingerprint(t), *sketch(t)] if body else [fingerprint(t)] for t in texts]
            made = np.array(bits, np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(made[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *names])

    return raw.mapInArrow(run, raw.drop("raw").select("*", *[F.lit(0).cast("long").alias(n) for n in names]).schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A mask for each choice of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << (e - s)) - 1) << s for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(whole, blocks - distance)]


def near(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _through_values(members: DataFrame) -> DataFrame:
    """Links among fingerprints by the values around them, without forming pairs.

    Two fingerprints at distance 3 or less have a value at most 1 bit from one and 2 bits from the other. Of the
    fingerprints within 1 bit of a value, the least is its anchor; every fingerprint within 2 bits of the value is at most
    3 bits from the anchor and gets linked to it. That joins exactly the components that all close pairs would join.
    """
    flips = [[sum(1 << i for i in c) for c in combinations(range(64), k)] for k in range(3)]

    def values(upto: int) -> DataFrame:
        masks = F.array(*[F.lit(signed(m)) for k in range(upto + 1) for m in flips[k]])
        return members.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))

    anchors = values(1).groupBy("value").agg(F.min("fp").alias("anchor"))
    return values(2).join(anchors, "value").filter("fp <> anchor").select(F.col("fp").alias("a"), F.col("anchor").alias("b")).distinct()


def _members(distinct: DataFrame, masks: list[int]) -> DataFrame:
    """fp, t, k, n: each fingerprint under each key (mask t and the bits k that it leaves) that it shares with n - 1 others."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    shared = stored(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"))
    few = shared.count() <= SMALL
    return stored(keyed.join(F.broadcast(shared) if few else shared, ["t", "k"]))


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (one column fp) whose components are those of all close pairs."""
    members = _members(distinct, block_masks())
    rest = members.filter(F.col("n") <= bucket)
    left, right = (rest.select("t", "k", F.col("fp").alias(c)) for c in "ab")
    pairs = left.join(right, (left["t"] == right["t"]) & (left["k"] == right["k"]) & (F.col("a") < F.col("b")) & near(F.col("a"), F.col("b"))).select("a", "b")
    return pairs.union(_through_values(members.filter(F.col("n") > bucket).select("fp").distinct()))


def _judged(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, sure of each different pair of fingerprints that link or may."""
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("fp").alias(c), F.array(*SKETCH).alias("of_" + c)), c)
    apart = sum((F.bit_count(F.col("of_a")[i].bitwiseXOR(F.col("of_b")[i])) for i in range(len(SKETCH))), F.lit(0))
    sure = near(F.col("a"), F.col("b")) | (apart <= SURE)
    return pairs.select("a", "b", sure.alias("sure"), apart.alias("apart")).filter(F.col("sure") | (F.col("apart") <= DOUBTFUL)).drop("apart")


def _nearest(members: DataFrame, turn: int) -> DataFrame:
    """One pair at most for each fingerprint: of one member drawn from each of its buckets, the nearest of another component."""
    drawn = members.groupBy("t", "k").agg(F.min_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(turn))).alias("p"))
    met = members.join(drawn, ["t", "k"]).filter((F.col("root") != F.col("p.root")) & near(F.col("fp"), F.col("p.fp"), FAR))
    best = met.groupBy("fp").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))), "p.fp")).alias("best"))
    return best.select(F.least("fp", "best.fp").alias("a"), F.greatest("fp", "best.fp").alias("b")).distinct()


def _across(members: DataFrame) -> DataFrame:
    """All pairs within a bucket between different components; the rows of a large bucket are dealt over tasks."""
    parts = F.floor(F.col("n") / PART)
    left = members.select("t", "k", F.col("fp").alias("a"), F.col("root").alias("ra"), F.pmod(F.xxhash64("fp"), parts + 1).alias("part"))
    right = members.select("t", "k", F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"))
    apart = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near(F.col("a"), F.col("b"), FAR)
    return left.join(right, ["t", "k", "part"]).filter(apart).select("a", "b").distinct()


def _still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component's root."""
    rooted = members.select("t", "k", "n", "fp").join(found, members["fp"] == found["node"], "left").select("t", "k", "n", "fp", F.coalesce("root", "fp").alias("root"))
    split = rooted.groupBy("t", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t", "k")
    return stored(rooted.join(split, ["t", "k"], "left_semi"))


def shingle_sets(bodies: DataFrame) -> DataFrame:
    """body and shingles (the hashes of the different five-word shingles) of the rows body, raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(_hashes(t.as_py(), LONG_SHINGLE)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["body", "shingles"])

    return bodies.mapInArrow(run, "body string, shingles array<long>")


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs whose texts' five-word shingles are SIMILAR or more alike; of a fingerprint's texts, that of least sketch and
    md5 stands for all."""
    wanted = stored(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "body"))
    bodies = wanted.select("body").distinct()
    raw = F.coalesce(text, F.lit("")).cast("binary")
    texts = docs.select(F.md5(raw).alias("body"), raw.alias("raw"))
    texts = texts.join(F.broadcast(bodies) if wanted.count() <= SMALL else bodies, "body", "left_semi")
    sets = stored(wanted.join(shingle_sets(texts).dropDuplicates(["body"]), "body").select("fp", "shingles"))
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(c), F.col("shingles").alias("of_" + c)), c)
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.filter(both >= SIMILAR * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _rooted_far(rows: DataFrame, docs: DataFrame, text: str, rounds: int = ROUNDS) -> DataFrame:
    """fp and root of the distinct fingerprints of `rows` by the wide rule.

    Some rounds link each fingerprint to one other at most, which joins the members of large groups without forming their
    pairs. Of what this leaves in different components, all pairs within a bucket are formed, so no link is lost.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min(F.struct(*SKETCH, "body")).alias("x")).select("fp", "x.*"))
    members = _members(nodes.select("fp"), block_masks(FAR_BLOCKS, FAR_BLOCKS - FAR_AGREE)).withColumn("root", F.col("fp"))
    edges = found = None
    for turn in range(rounds + 1):
        judged = stored(_judged(_nearest(members, turn) if turn < rounds else _across(members), nodes))
        new = stored(judged.filter("sure").select("a", "b").union(_alike(judged.filter("NOT sure").select("a", "b"), nodes, docs, text)))
        if turn and new.isEmpty():
            continue
        edges = new if edges is None else edges.union(new)
        found = stored(components(edges))
        if turn < rounds:
            members = _still_open(members, found)
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _rooted(rows: DataFrame, bucket: int) -> DataFrame:
    """fp and root (the same for all fingerprints of a component) of the distinct fingerprints of `rows`."""
    distinct = stored(rows.select("fp").distinct())
    found = components(links(distinct, bucket))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links lead to) of each row of `docs`.

    Rows without a word have fingerprint zero and are linked like any other. Null ids are never the least; a component of
    null ids only has a null component_id. Rows that repeat an id stay separate rows.
    """
    rows = stored(fingerprints(docs, text))
    rooted = stored(_rooted(rows, bucket))
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = rooted.join(ids, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"))
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", bucket: int = BUCKET, wide: bool = False) -> DataFrame:
    """One row of each component, with all its columns: the one of the least id, null ids last; of rows that agree in the id,
    the one whose text has the least md5; of rows that agree in both, any one. Null and empty texts count as equal. With
    `wide`, texts whose five-word shingles are 0.8 alike are linked as well, as far as their fingerprints meet."""
    rows = stored(fingerprints(docs, text, body=True))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body")
    first = rows.groupBy("fp").agg(F.min(place).alias("first"))
    rooted = _rooted_far(rows, docs, text) if wide else _rooted(rows, bucket)
    stays = stored(rooted.join(first, "fp").groupBy("root").agg(F.min("first").alias("first")))
    stays = stays.select(F.col("first.doc_id").alias("_id"), F.col("first.body").alias("_stays"))
    own = docs.select(row_column(docs).alias("_row"), "doc_id", F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_body"))
    left = own.join(stays, own["doc_id"].eqNullSafe(stays["_id"]) & (own["_body"] == stays["_stays"]), "left_semi")
    return own_row(left.dropDuplicates(["doc_id", "_body"]), docs, "_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of documents (see near_groups)."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, unchanged (see deduplicate, wide)."""
    return deduplicate(docs, wide=True)
