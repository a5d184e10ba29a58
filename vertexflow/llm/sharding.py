"""Sharding by extendible hashing.

A document goes to the bucket that the first bits of its hash name. A bucket above the byte limit is split on one more bit,
and only such buckets are, so the directory is deep just where the data is dense. The split is found for BITS levels at
a time from byte counts of hash prefixes, never from the documents themselves; buckets that are still too large then go
through the next BITS levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import own_row, row_column, stored

LIMIT, HASH_BITS, BITS = 16 << 20, 60, 12
#: A directory of more rows than this is joined by shuffle instead of broadcast.
SMALL = 200_000


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _hash, HASH_BITS bits of the md5 of id and text, and _bytes, the text's length in UTF-8."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    value = F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.withColumns({"_hash": value, "_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def directory(sizes: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """One table for each round of BITS levels: cell (a hash prefix of BITS more bits than the round before), prefix, depth
    and bytes of the bucket that it belongs to; prefix is null where the next round goes on.

    sizes: _hash and _bytes. A bucket whose rows all share one hash can't be split and stays above the limit.
    """
    rounds: list[DataFrame] = []
    rows = sizes.select("_hash", "_bytes").withColumn("_top", F.lit(0).cast("long"))
    for done in range(0, HASH_BITS, BITS):
        depth = done + BITS
        rows = rows.withColumn("cell", F.shiftright("_hash", HASH_BITS - depth))
        cells = rows.groupBy("_top", "cell").agg(F.sum("_bytes").alias("size"), F.min("_hash").alias("lo"), F.max("_hash").alias("hi"))
        prefix = bucket = F.lit(None).cast("long")
        level = F.lit(None).cast("int")
        cells = stored(cells)
        # every cell belongs to one bucket of each level; the shallowest that fits is its own
        first = done + (done > 0)
        up = cells.select("cell", "size", "lo", "hi", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("depth"))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
        totals = up.groupBy("depth", "prefix").agg(F.sum("size").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = totals.filter((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix", "bytes")
        own = up.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "bytes")).alias("b"))
        found = stored(cells.select("cell").join(own, "cell", "left").select("cell", "b.prefix", "b.depth", "b.bytes"))
        rounds.append(found)
        more = found.filter("prefix IS NULL").select("cell")
        if more.isEmpty():
            break
        few = more.count() <= SMALL
        rows = rows.join(F.broadcast(more) if few else more, "cell", "left_semi").select("_hash", "_bytes", F.col("cell").alias("_top"))
    return rounds


def sharded(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """All rows and columns of `docs` and, in place of columns so named, shard_prefix and shard_depth (the bucket's bits) and
    shard_bytes (its size, at most `limit` unless all its rows agree in hash: one larger text, or rows that repeat an id and
    a text). Null ids and texts count as empty."""
    rounds = directory(hashed(docs.select("doc_id", text), text), limit)
    new = ("shard_prefix", "shard_depth", "shard_bytes")
    rows = hashed(docs.select(row_column(docs, new).alias("_row"), "doc_id", F.col(text).alias("_text")), "_text").select("_row", "_hash")
    for i, found in enumerate(rounds):
        table = found.select(F.col("cell").alias(f"_c{i}"), *[F.col(c).alias(f"_{c}{i}") for c in ("prefix", "depth", "bytes")])
        table = F.broadcast(table) if found.count() <= SMALL else table
        rows = rows.join(table, F.shiftright("_hash", HASH_BITS - BITS * (i + 1)) == F.col(f"_c{i}"), "left")
    names = zip(new, ("prefix", "depth", "bytes"), strict=True)
    return own_row(rows, docs, "_row", {n: reduce(F.coalesce, [F.col(f"_{c}{i}") for i in range(len(rounds))]) for n, c in names})


def write_shards(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> None:
    """Writes the documents as Parquet, one folder for each bucket of the directory."""
    placed = sharded(docs, text, limit)
    placed.repartition("shard_depth", "shard_prefix").write.partitionBy("shard_depth", "shard_prefix").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of every row of documents; null ids and texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select("doc_id", "shard_prefix", "shard_depth", "shard_bytes")


#: A limit that even small tables split at, beyond the first BITS levels.
SMALL_LIMIT = 2048


def query_of_2k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of every row of documents under SMALL_LIMIT."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs, limit=SMALL_LIMIT).select("doc_id", "shard_prefix", "shard_depth", "shard_bytes")


def oracle(limit: int = LIMIT) -> str:
    return f"""
WITH RECURSIVE h AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h,
    coalesce(octet_length(encode(text)), 0)::BIGINT AS n FROM documents),
t AS (SELECT doc_id, h, n, 0 AS depth, (sum(n) OVER ())::BIGINT AS total, count(DISTINCT h) OVER () AS hashes FROM h
  UNION ALL
  SELECT doc_id, h, n, depth + 1, (sum(n) OVER (PARTITION BY h >> ({HASH_BITS - 1} - depth)))::BIGINT,
    count(DISTINCT h) OVER (PARTITION BY h >> ({HASH_BITS - 1} - depth)) FROM t WHERE total > {limit} AND hashes > 1)
SELECT doc_id, h >> ({HASH_BITS} - depth) AS shard_prefix, depth AS shard_depth, total AS shard_bytes
FROM t WHERE total <= {limit} OR hashes = 1
"""


ORACLE = oracle()
