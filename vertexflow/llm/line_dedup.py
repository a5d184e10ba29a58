"""Line dedup by distinct-site spread.

For each distinct line (by a 128-bit hash), a HyperLogLog sketch of the sites that have it, merged by aggregation, says
how far it has spread. A line whose estimate is clearly above or below MIN_SITES is decided by it; one near the threshold
gets an exact count of distinct sites. A line on MIN_SITES sites or more is boilerplate: it stays where it comes first (least
doc_id, first place) and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import own_row, row_column, stored

MIN_SITES, LG_K = 5, 12
#: A table of more rows than this is joined by shuffle instead of broadcast.
SMALL = 200_000
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, text: str, site: str) -> DataFrame:
    """doc_id, body (hash of the text), site, pos, h1, h2 of every line that isn't blank; lines compare without the white
    space around them. A null site is a site of its own."""
    own_site = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    rows = docs.select("doc_id", F.xxhash64(text).alias("body"), own_site.alias("site"), F.posexplode(lines(F.col(text))).alias("pos", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(_BLANK))).filter("_line <> ''")
    return rows.select("doc_id", "body", "site", "pos", F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit(1), "_line").alias("h2"))


def _near(estimate: Column, least: int, lg_k: int) -> Column:
    """Whether the estimate may be on the wrong side: within four standard errors, one site at least."""
    return F.abs(estimate - least) <= max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * least)


def _fit(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2 and first (doc_id, body, pos of the first occurrence) of the lines of `rows` on min_sites sites or more."""
    spread = rows.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body", "pos")).alias("first"),
    )
    near = _near(F.col("sites"), min_sites, lg_k)
    wide = stored(spread.filter(near | (F.col("sites") >= min_sites)))
    unsure = wide.filter(near).select("h1", "h2")
    counted = rows.select("h1", "h2", "site").join(_fit(unsure), ["h1", "h2"]).distinct().groupBy("h1", "h2").agg(F.count("*").alias("_exact"))
    return wide.join(_fit(stored(counted)), ["h1", "h2"], "left").filter(F.coalesce("_exact", "sites") >= min_sites).select("h1", "h2", "first")


def removals(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """doc_id, body and removed (places of the lines to remove) of each document that loses a line."""
    wide = _fit(stored(boilerplate(rows, min_sites, lg_k)))
    hit = rows.select("doc_id", "body", "pos", "h1", "h2").join(wide, ["h1", "h2"])
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body")) & (F.col("pos") == F.col("first.pos")))
    return hit.filter(again).groupBy("doc_id", "body").agg(F.collect_set("pos").alias("removed"))


def cleaned(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """All rows and columns of `docs`, the text without boilerplate lines, and n_lines and n_removed (in place of columns so
    named). doc_id, the text and the site are read.

    A null text stays null and has no line; an empty one has one blank line. Blank lines stay. Rows that repeat an id and a
    text are one document, and lose the same lines.
    """
    gone = removals(stored(occurrences(docs, text, site)), min_sites, lg_k).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "removed")
    aside = (text, "n_lines", "n_removed")
    left = docs.select(row_column(docs, aside).alias("_row"), "doc_id", F.col(text).alias("_text"), F.xxhash64(text).alias("_own"))
    rows = left.join(gone, left["doc_id"].eqNullSafe(gone["_id"]) & (left["_own"] == gone["_body"]), "left")
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines(F.col("_text")))).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    body = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    rows = rows.withColumn("_lines", F.when(F.col("removed").isNotNull(), lines(F.col("_text"))))
    return own_row(rows, docs, "_row", {text: body, "n_lines": n, "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every row of documents, whatever its id and text (see cleaned)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return cleaned(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without lines that are boilerplate across sources; n_chars follows the text
    (null for null). All columns of `docs` come back, whatever their names, but n_lines and n_removed, which count the lines."""
    out = cleaned(docs)
    follows = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[follows if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH x AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM x),
t AS (SELECT doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM e),
b AS (SELECT k, min(struct_pack(d := doc_id, p := pos)) AS f FROM t WHERE k <> '' GROUP BY k
    HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
m AS (SELECT t.*, b.k IS NOT NULL AND (t.doc_id <> f.d OR t.pos <> f.p) AS gone FROM t LEFT JOIN b ON t.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""
