"""Comparing results with reference ones, and bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import stored

INF = 2147483647


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, expected and found where two tables of one value for each key differ or one lacks the key."""
    left, right = a.select(key, F.col(value).alias("expected")), b.select(key, F.col(value).alias("found"))
    return left.join(right, key, "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def relative_l2(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rel_l2, the norm of a - b over the norm of a, in doubles; null if a is all zero."""
    joined = a.select(key, F.col(value).cast("double").alias("x")).join(b.select(key, F.col(value).cast("double").alias("y")), key)
    return joined.agg((F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)) / F.nullif(F.sqrt(F.sum(F.col("x") ** 2)), F.lit(0.0))).alias("rel_l2"))


def ranked(scores: DataFrame, score: str, within: tuple[str, ...] = ()) -> DataFrame:
    """pos and v by falling score, ties by vertex; a NaN or null counts as the least score. within: columns whose values have
    a ranking each.

    Rows are dealt by ranges of (score, vertex) that a sample makes equally large, so no task ranks more than its share,
    whatever the distribution; the positions of a range start after those of the ranges before.
    """
    s = F.when(F.isnan(score) | F.col(score).isNull(), F.lit(float("-inf"))).otherwise(F.col(score))
    order = [*within, F.desc("_s"), "v"]
    rows = scores.select(*within, "v", s.alias("_s")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = stored(rows)
    sizes = rows.groupBy("_part", *within).agg(F.count("*").alias("_n"))  # a row for each range, and for each ranking in it
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_part")) - F.col("_n")
    sizes = sizes.withColumn("_before", before).drop("_n")
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *within).orderBy(F.desc("_s"), "v")))
    return own.join(sizes, ["_part", *within]).select(*within, (F.col("_r") + F.col("_before")).alias("pos"), "v")


def mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def flip_int(value: Column, bit: Column) -> Column:
    """A 32-bit integer with one bit flipped; bit 31 is the sign."""
    flipped = value.cast("long").bitwiseXOR(mask(bit)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(flipped > INF, flipped - (1 << 32)).otherwise(flipped).cast("int")


def draw(trial: Column, salt: int, n: Column) -> Column:
    """A repeatable choice among 0 .. n - 1, from the first 48 bits of the md5 of trial and salt."""
    digest = F.md5(F.concat_ws(":", trial.cast("string"), F.lit(str(salt))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n.cast("long"))


def flip_float(value: Column, bit: Column) -> Column:
    """A 32-bit float with one bit flipped, within the JVM."""
    raw = F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), value.cast("float")).cast("int")
    return F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), flip_int(raw, bit)).cast("float")
