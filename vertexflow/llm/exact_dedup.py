"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so. A chunk's identifier is the 64-bit hash of its bytes, verified by their
SHA-256: two chunks of one hash but different digests are found and told apart by a rank. Texts are read and cut once; from
then on only hashes and digests move, some forty bytes for a few hundred of text, and documents are compared by their ordered
lists of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import own_row, row_column, stored

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends after a word whose last two characters fall in these classes, once it is long enough, or at most 4096
#: characters on.
CHUNK = r"(?s).{256,4096}?(?:(?<=[acegikmoqsuwy02468][bdfhjlnprtvxz13579])\x20|\z)|.{1,4096}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunk_hash(chunk: Column, bits: int) -> Column:
    """The chunk's identifier before verification; fewer than 64 bits only in tests, to bring about collisions."""
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def chunked(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, chunks (hash and digest of each, in order) of every row; a null text counts as empty."""
    norm = docs.select("doc_id", normalised(F.col(text)).alias("norm"))
    cut = norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), 0).alias("cut"))
    identified = F.transform("cut", lambda c: F.struct(chunk_hash(c, bits).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest")))
    return cut.select("doc_id", "text_sha256", identified.alias("chunks"))


def collisions(cut: DataFrame) -> DataFrame:
    """Chunks that share their hash with a different chunk: h, digest, rank (0 for the first in the order of digests)."""
    seen = cut.select(F.explode("chunks").alias("c")).select("c.h", "c.digest")
    shared = stored(seen.groupBy("h").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("h"))
    several = seen.join(shared, "h").distinct()
    return several.select("h", "digest", (F.row_number().over(Window.partitionBy("h").orderBy("digest")) - 1).alias("rank"))


def recipes(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, recipe (ordered identifiers), ranks (position and rank of the chunks whose hash is shared)."""
    cut = stored(chunked(docs, text, bits).withColumn("_row", F.monotonically_increasing_id()))
    shared = stored(collisions(cut))
    plain = cut.select("_row", "doc_id", "text_sha256", F.col("chunks.h").alias("recipe"))
    if shared.isEmpty():
        return plain.withColumn("ranks", F.array().cast("array<bigint>"))
    at = cut.select("_row", F.posexplode("chunks").alias("_pos", "c")).select("_row", "_pos", "c.h", "c.digest").join(shared, ["h", "digest"])
    place = F.shiftleft(F.col("_pos").cast("long"), 24) + F.col("rank")
    ranks = at.groupBy("_row").agg(F.sort_array(F.collect_set(place)).alias("ranks"))
    return plain.join(ranks, "_row", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<bigint>")))


def exact_groups(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs` (doc_id and text are read).

    Of equal texts, the row with the smallest doc_id stays; null ids count as largest, and of rows that repeat an id and a
    text exactly one stays. Null texts equal empty ones. An empty table gives an empty result.
    """
    rows = stored(recipes(docs, text, bits))
    groups = rows.groupBy("recipe", "ranks").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("_stays")
    )
    # stored, so that the join deals its rows anew and a large group of copies can be split
    return rows.join(stored(groups), ["recipe", "ranks"]).select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_stays")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that exact_groups keeps."""
    stays = exact_groups(docs, text).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    own = docs.select(row_column(docs).alias("_row"), "doc_id", F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("_own"))
    left = own.join(stays, own["doc_id"].eqNullSafe(stays["_id"]) & (own["_own"] == stays["_sha"]), "left_semi")
    return own_row(left.dropDuplicates(["doc_id", "_own"]), docs, "_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every row of documents; null texts count as empty, null ids as largest."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
