"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose share of something (symbols, repeated lines, repeated words) is above a cutoff. The
cutoffs come from the labelled documents: for each stratum (language) and rule, the least cutoff of a fixed grid for which
an exact binomial test shows that at most LIMIT / rules of the good documents are rejected. All tests together err with
probability DELTA at most (Bonferroni over strata, rules and grid). Where no cutoff passes, the rule rejects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_math import binomial_tail
from .storage import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
RULES = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
GRID = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
LIMIT, DELTA = 0.03, 0.05


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from _words: words in windows of WINDOW words that the text has twice or more.

    Windows are compared by 64-bit hash. Only texts whose windows are not all distinct go on to the sorting steps.
    """
    # one select for each step, so that none is evaluated twice
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)]))
    df = df.withColumn("_h", F.when(F.col("n_words") >= WINDOW, windows)).drop("_words")
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_at", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    same = F.filter("_at", lambda x, k: (x["h"] == F.get("_at", k - 1)["h"]) | (x["h"] == F.get("_at", k + 1)["h"]))
    df = df.withColumn("_pos", F.when(F.col("_at").isNotNull(), F.sort_array(F.transform(same, lambda x: x["i"])))).drop("_at")
    new = F.transform("_pos", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_pos", k + 1) - p, F.lit(WINDOW))).cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))).drop("_pos")


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words of each row.

    A null text has no words. Every row counts by itself, whatever its id. Lines and windows are compared whole, so ties play no
    part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, words.alias("_words"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    df = df.select(
        *keep,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeated_words(df)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def shares(measured: DataFrame) -> DataFrame:
    """Adds the shares that the rules look at; 0 where there is nothing to divide by."""
    return measured.withColumns({r: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)) for r, (a, b) in RULES.items()})


def cutoffs(holdout: DataFrame, stratum: str, limit: float = LIMIT, delta: float = DELTA, grid: tuple[float, ...] = GRID) -> DataFrame:
    """For each stratum, one column for each rule with its certified cutoff, null where none is.

    holdout: the shares, `stratum` (null is a stratum of its own), base_failed and `good` of labelled documents. Only good
    ones that pass the base rules count. An empty holdout gives no rows.
    """
    good = holdout.filter(F.col("good") & ~F.col("base_failed"))
    over = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(grid)]
    counts = good.groupBy(stratum).agg(F.count("*").alias("n"), *over)
    strata = counts.agg(F.count("*").alias("strata"))
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(grid)])
    rows = counts.crossJoin(strata).select(stratum, "n", "strata", F.explode(tests).alias("t"))  # the other side is one row
    tail = binomial_tail(F.col("t.k"), F.col("n"), F.lit(limit / len(RULES)))
    rows = rows.withColumn("passed", tail <= delta / (F.col("strata") * len(RULES) * len(grid)))
    return rows.groupBy(stratum).agg(*[F.min(F.when(F.col("passed") & (F.col("t.rule") == r), F.col("t.cutoff"))).alias(f"max_{r}") for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, the measures, the shares, base_failed and kept of each row of `docs` (doc_id, text and `stratum` are read).

    labels: doc_id and quality (1: good); null or missing ones and null ids are no holdout, and of several labels of one id
    the largest counts. A document that passes the base rules is kept unless a share is above its stratum's cutoff.
    """
    rows = stored(shares(measures(docs, text, ("doc_id", stratum))).withColumn("base_failed", base_failed()))
    named = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    limits = cutoffs(rows.join(named, "doc_id"), stratum).withColumnRenamed(stratum, "_stratum")
    # a row for each stratum that has labels
    small = limits.count() <= 100_000
    out = rows.join(F.broadcast(limits) if small else limits, rows[stratum].eqNullSafe(limits["_stratum"]), "left")
    above = reduce(Column.__or__, [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RULES])
    return out.withColumn("kept", ~F.col("base_failed") & ~above).drop("_stratum", stratum, *[f"max_{r}" for r in RULES])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and the verdict of every row of documents (see judged)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    level = f"{DELTA} / ((SELECT count(*) FROM strata) * {len(RULES) * len(GRID)})"
    p = LIMIT / len(RULES)
    names = list(RULES)
    rules = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, {r} AS share FROM holdout" for r in names)
    verdict = " OR ".join(f"coalesce(s.{r} > (SELECT min(cutoff) FROM passed WHERE rule = '{r}' AND lang IS NOT DISTINCT FROM s.lang), false)" for r in names)
    share = ", ".join(f"coalesce({a} / nullif({b}, 0), 0.0) AS {r}" for r, (a, b) in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
pos AS (SELECT doc_id, words, unnest(range(len(words) - 4)) AS i FROM w WHERE len(words) >= 5),
win AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 5], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
    (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN cover USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {share} FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
holdout AS (SELECT s.* FROM s JOIN good USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT DISTINCT lang FROM holdout),
rules AS ({rules}),
counts AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS k
    FROM rules, (SELECT unnest([{", ".join(map(str, GRID))}]) AS cutoff) GROUP BY ALL),
passed AS (SELECT lang, rule, cutoff FROM counts WHERE k < n * {p!r} AND (SELECT sum(exp(
    lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) FROM range(k + 1) t(j)) <= {level})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM s
"""


ORACLE = _oracle()
