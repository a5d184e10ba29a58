"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source's documents fall into blocks of about BLOCK_DOCS by hash. A source whose target is some whole number of its
size and a rest gives every block that many times, and for the rest blocks in a permuted order; in the last of them a cut
in the permuted order of its documents brings the words near the target. These block draws are then dealt to the output
shards: from the root of a binary tree over the shards, each node's quota of draws from every source is split between its
two children by a multivariate-hypergeometric draw (source after source, given what is left), so that quotas are exact at
every node. A source's draws, in permuted order, fill the quotas of the leaves, and a shard is shuffled within itself.
All choices follow from hashes of ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exact_math import hypergeometric_draw
from .storage import own_row, row_column, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK_DOCS, SHARD_WORDS = 256, 4_000_000
SEED = 20250
#: A table of more rows than this is joined by shuffle instead of broadcast.
SMALL = 200_000


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds size, the number of words; 0 for null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def targets(sizes: DataFrame) -> DataFrame:
    """From source, docs, source_size: sid (rank by code point, null last), weight and target words of each source.

    Targets share SHARE of all words by weight and stop at CAP times the source's size. A source is capped if CAP times its
    size over its weight is below the level at which the sources with a larger such ratio share what the capped leave over.
    The table has a row for each source, so its windows take one partition.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    table = sizes.withColumn("sid", F.row_number().over(rank) - 1).withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(CAP))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("_level", left / free)
    # the level rises with every capped source and falls past the last of them
    level = F.max("_level").over(everything)
    table = table.withColumn("target", F.least(F.col("_cap"), level * F.col("weight")))
    return table.drop("_cap", "_level")


def order_key(size: Column) -> Column:
    """Place of a document in its block's permuted order; rows that agree in id and size share it."""
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), size)


def with_block(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds the columns of `sources`, _block and _key to rows with doc_id, source and size."""
    own = sources.withColumnRenamed("source", "_source")
    joined = rows.join(small(own, n_sources), rows["source"].eqNullSafe(own["_source"])).drop("_source")
    block = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("size")), F.col("n_blocks"))
    return joined.withColumns({"_block": block, "_key": order_key(F.col("size"))})


def _quota_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """sid, shard, n: how many of each source's draws go to each of the shards; quotas has sid and n.

    Every level takes one aggregation over (node, source) counts; a node holds the sources that still have draws in it.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "sid", "n")
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        packed = nodes.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("q"), F.sum("n").alias("total"))
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2)
        room = F.round(F.col("total") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        packed = packed.withColumns({"mid": mid, "room": F.when(F.col("hi") - F.col("lo") > 1, room).otherwise(F.col("total"))})

        def draw(acc: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("lo"), F.col("hi"), x["sid"]), F.lit(1 << 52)) / float(1 << 52)
            got = F.when(acc["room"] >= acc["left"], x["n"]).otherwise(hypergeometric_draw(acc["left"], x["n"], acc["room"], u))
            item = F.struct(x["sid"].alias("sid"), x["n"].alias("n"), got.cast("long").alias("got"))
            return F.struct((acc["left"] - x["n"]).alias("left"), (acc["room"] - got).cast("long").alias("room"), F.concat(acc["out"], F.array(item)).alias("out"))

        start = F.struct(F.col("total").alias("left"), F.col("room").alias("room"), F.array().cast("array<struct<sid:int,n:bigint,got:bigint>>").alias("out"))
        split = packed.select("lo", "hi", "mid", F.explode(F.aggregate("q", start, draw, lambda acc: acc["out"])).alias("x"))
        sides = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("x.got").alias("n")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), (F.col("x.n") - F.col("x.got")).alias("n")),
        )
        nodes = stored(split.select("x.sid", F.explode(sides).alias("c")).select("c.lo", "c.hi", "sid", "c.n").filter("n > 0"))
    return nodes.select("sid", F.col("lo").alias("shard"), "n")


def plan(sizes: DataFrame, shard_words: int = SHARD_WORDS, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """The mix of rows with doc_id, source and size, as two small tables.

    sources: source, sid, docs, source_size, target, copies (of every block), n_blocks.
    blocks: sid, _block, copies, cut (documents of the block whose key is at most cut count once more), shards (of each
    draw of the block). Blocks, shards and sources are what their size follows; no row of theirs holds documents.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    sources = targets(per)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long")
    sources = sources.withColumn("copies", copies).withColumns(
        {"rest": F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")), "n_blocks": F.ceil(F.col("docs") / block_docs).cast("long")}
    )
    sources = stored(sources)
    n_sources = sources.count()
    rows = with_block(sizes.select("doc_id", "source", "size"), sources, n_sources)
    blocks = rows.groupBy("sid", "_block", "copies", "rest").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(SEED + 3), "sid", "_block"), "_block")
    blocks = blocks.withColumn("_end", F.sum("words").over(permuted))
    blocks = stored(blocks.withColumn("_need", F.col("rest") - F.col("_end") + F.col("words")))
    edge = blocks.filter("_need > 0 AND _need < words").select("sid", "_block", "_need")
    # one block of each source; a running sum over its documents, ties together
    inner = rows.select("sid", "_block", "_key", "size").join(small(edge, n_sources), ["sid", "_block"])
    inner = inner.groupBy("sid", "_block", "_key", "_need").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("sid").orderBy("_key"))
    cuts = inner.withColumn("_upto", upto).filter(F.col("_upto") - F.col("size") / 2 <= F.col("_need")).groupBy("sid", "_block").agg(F.max("_key").alias("cut"))
    every = F.when(F.col("_need") >= F.col("words"), F.when(F.col("rest") > 0, F.lit(2**63 - 1)))
    blocks = blocks.join(small(cuts, n_sources), ["sid", "_block"], "left").select("sid", "_block", "words", "copies", F.coalesce(every, "cut").alias("cut"))
    # no draw goes beyond CAP copies: a rest is left only where copies are below it
    times = F.col("copies") + F.col("cut").isNotNull().cast("long")
    draws = blocks.filter(times > 0).select("sid", "_block", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))
    turn = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(SEED + 4), "sid", "_block", "copy"), "_block", "copy")
    draws = stored(draws.withColumn("turn", F.row_number().over(turn).cast("long") - 1))
    total = sources.agg(F.sum("target")).head()[0] or 0.0
    quotas = draws.groupBy("sid").agg(F.count("*").alias("n"))
    leaves = _quota_tree(quotas, max(1, math.ceil(total / shard_words)))
    first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    seats = leaves.withColumn("_first", first).select("sid", "shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)).alias("turn"))
    dealt = draws.join(seats, ["sid", "turn"]).groupBy("sid", "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    return sources, stored(blocks.join(dealt, ["sid", "_block"], "left").select("sid", "_block", "copies", "cut", "shards"))


def counted(docs: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with their size, times (how often the mix takes the row) and shards (of each time)."""
    rows = with_block(docs, sources.drop("copies", "rest", "weight", "docs"), sources.count())
    own = rows.join(small(blocks, blocks.count()), ["sid", "_block"])
    times = F.col("copies") + F.coalesce((F.col("_key") <= F.col("cut")).cast("long"), F.lit(0))
    return own.withColumn("times", times).drop("copies", "cut", "sid", "_block", "n_blocks")


def mixed(docs: DataFrame, text: str = "text", shard_words: int = SHARD_WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with mix_shard, in one partition for each hash of a shard and
    shuffled within it. doc_id, source and the text are read; null ids, sources and texts take part as values of their own.
    Rows that repeat an id and a text are taken together. An empty table, or one without words, gives no rows."""
    sizes = stored(sized(docs, text).select("doc_id", "source", "size"))
    sources, blocks = plan(sizes, shard_words, block_docs)
    packed = docs.select(row_column(docs, ("mix_shard",)).alias("_row"), "doc_id", "source", F.col(text).alias("_text"))
    rows = counted(sized(packed, "_text").drop("_text"), sources, blocks).filter("times > 0")
    shards = F.slice("shards", F.lit(1), F.col("times").cast("int"))
    out = rows.select("_row", "_key", F.posexplode(shards).alias("_copy", "_shard"))
    out = out.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64("_key", "_copy"))
    return own_row(out, docs, "_row", {"mix_shard": F.col("_shard")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of documents; null ids, sources and texts take part as values of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stored(sized(docs).select("doc_id", "source", "size"))
    rows = counted(sizes, *plan(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.slice("shards", F.lit(1), F.col("times").cast("int")).alias("shards"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, shard by shard, with all its columns (see mixed)."""
    return mixed(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
