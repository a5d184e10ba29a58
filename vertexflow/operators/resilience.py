"""Injectable instructions of an assembly listing, the trial log and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import INF, draw

RANKING = ("HITS", "PageRank")
OUTCOMES = ("Masked", "SDC", "DUE")
#: A ranking whose first difference lies beyond this position counts as masked.
TOP = 60


def instructions(lines: DataFrame) -> DataFrame:
    """line, text of the instructions of an assembly listing that a fault can hit (lines has line and value).

    Comments, directives, braces, labels, returns, branches, predicated lines and stores are left out.
    """
    t = F.trim(F.regexp_replace("value", r"[\t ]+", " "))
    out = lines.select("line", t.alias("text")).filter("text <> ''")
    return out.filter(~F.col("text").rlike(r"^(//|\.|\{|\}|\(|\)|@|ret\b|bra\b|st\.|[$\w]+:)"))


def decoded(sites: DataFrame) -> DataFrame:
    """Adds opcode, type, width (bits of the destination) and register to instructions."""
    opcode = F.split("text", " ")[0]
    parts = F.split(opcode, r"\.")
    kind = F.when(opcode.startswith("cvt"), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    register = F.regexp_extract("text", r"(%\w+)", 1)
    bits = F.coalesce(F.regexp_extract(kind, r"(\d+)$", 1).try_cast("int"), F.lit(32))
    width = F.when(opcode.startswith("setp") | (kind == "pred"), 1).when(opcode.rlike(r"^(mul|mad)\.wide"), 2 * bits)
    width = width.when(register.startswith("%rs"), 16).when(register.startswith("%rd"), 64).otherwise(bits)
    return sites.withColumns({"opcode": opcode, "type": kind, "width": width.cast("int"), "register": register})


def in_ranges(sites: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """Adds the name of the line range (lo, hi, `name`) that holds each site, null outside all; ranges is a small table."""
    return sites.join(F.broadcast(ranges), F.col("line").between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def loops(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds in_loop and the register that counts the innermost loop around each site, null outside all; ranges: lo, hi,
    loop_register of the loops, a small table."""
    held = sites.join(F.broadcast(ranges), F.col("line").between(F.col("lo"), F.col("hi")), "left")
    own = held.groupBy(*sites.columns).agg(F.min_by("loop_register", F.col("hi") - F.col("lo")).alias("loop_register"))
    return own.withColumn("in_loop", F.col("loop_register").isNotNull())


def loop_trip(trial: Column, in_loop: Column, trips: int) -> Column:
    """A repeatable loop trip from 1 to `trips` within a loop, 0 outside."""
    return F.when(in_loop, 1 + draw(trial, 31, F.lit(trips))).otherwise(0).cast("int")


def picked_sites(trials: DataFrame, sites: DataFrame) -> DataFrame:
    """trial and line of a uniformly drawn site for each trial; sites (a small table) has line."""
    lines = sites.agg(F.sort_array(F.collect_list("line")).alias("lines"))
    rows = trials.select("trial").crossJoin(F.broadcast(lines)).filter(F.size("lines") > 0)  # one row
    return rows.select("trial", F.get("lines", draw(F.col("trial"), 99, F.size("lines")).cast("int")).alias("line"))


def rank_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: metric1 (positions whose vertex differs) and metric2 (the first of them, 0 if none) of two rankings (pos, v)."""
    joined = a.select("pos", F.col("v").alias("x")).join(b.select("pos", F.col("v").alias("y")), "pos")
    differs = F.col("x") != F.col("y")
    return joined.agg(F.count_if(differs).alias("metric1"), F.coalesce(F.min(F.when(differs, F.col("pos"))), F.lit(0)).cast("long").alias("metric2"))


FIELDS = ("trial", "app", "kernel", "iter", "thread", "vertex", "bit", "mask", "line", "opcode", "width", "type", "register", "loop")


def parsed_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted trials and rejected lines of a log (column value).

    A line has 19 fields, or 17 with DUE third from the end where the program wrote none of its own (its flag is then 1).
    Other lengths go, and so do lines whose thread isn't the vertex less 1.
    """
    f = lines.select("value", F.split("value", ",").alias("f")).withColumn("n", F.size("f"))
    short = (F.col("n") == 17) & (F.get("f", F.lit(14)) == "DUE")
    whole = F.col("n") == 19
    ok = (whole | short) & (F.get("f", F.lit(4)).try_cast("int") == F.get("f", F.lit(5)).try_cast("int") - 1)
    f = f.withColumn("ok", F.coalesce(ok, F.lit(False)))
    last = F.when(F.col("n") == 19, F.lit(16)).otherwise(F.lit(14))
    strings = {"app", "kernel", "mask", "opcode", "type", "register"}
    own = [F.get("f", F.lit(i)).alias(n) if n in strings else F.get("f", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(FIELDS)]
    good = f.filter("ok").select(
        *own,
        F.when(F.col("n") == 19, F.get("f", F.lit(14)).try_cast("int")).alias("supersteps"),
        F.when(F.col("n") == 19, F.get("f", F.lit(15)).try_cast("long")).otherwise(1).alias("fi_flag"),
        F.get("f", last).alias("outcome"),
        F.get("f", last + 1).try_cast("long").alias("metric1"),
        F.get("f", last + 2).try_cast("double").alias("metric2"),
    )
    return good, f.filter("NOT ok").select("value")


def flagged(admitted: DataFrame) -> DataFrame:
    """Trials whose fault was reached (flag 1), and those that crashed (2147483647), which become DUE; others go."""
    outcome = F.when(F.col("fi_flag") == INF, "DUE").otherwise(F.col("outcome"))
    return admitted.filter(F.col("fi_flag").isin(1, INF)).withColumn("outcome", outcome)


def tolerant(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Ranking programs' SDC whose first difference lies beyond position `top` becomes Masked; crashed trials stay DUE."""
    late = F.col("app").isin(*RANKING) & (F.col("outcome") == "SDC") & (F.col("metric2") > top)
    return rows.withColumn("outcome", F.when(late, "Masked").otherwise(F.col("outcome")))


LEVELS = (("app",), ("kernel",), ("iter",), ("kernel", "iter"), ("vertex",), ("kernel", "vertex"), ("iter", "vertex"))


def rollup(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """masked, sdc and due counts for each combination of the keys; by vertex alone also the sum of metric1 over SDC."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES]
    extra = [F.coalesce(F.sum(F.when(F.col("outcome") == "SDC", F.col("metric1"))), F.lit(0)).alias("sdc_metric1")] if keys == ("vertex",) else []
    return rows.groupBy(*keys).agg(*counts, *extra)


def all_rollups(rows: DataFrame) -> DataFrame:
    """All seven levels in one pass of grouping sets; level names the keys, other keys are null."""
    sets = [[F.col(k) for k in keys] for keys in LEVELS]
    names = ["app", "kernel", "iter", "vertex"]
    counts = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES]
    grouped = rows.groupingSets(sets, *[F.col(n) for n in names]).agg(F.grouping_id(*[F.col(n) for n in names]).alias("gid"), *counts)
    ids = {sum(1 << (3 - i) for i, n in enumerate(names) if n not in keys): "_".join(keys) for keys in LEVELS}
    level: Column = F.lit(None).cast("string")
    for i, n in ids.items():
        level = F.when(F.col("gid") == i, n).otherwise(level)
    return grouped.select(level.alias("level"), *names, *[o.lower() for o in OUTCOMES])


def ratios(counts: DataFrame) -> DataFrame:
    """Adds total and the three shares of it."""
    total = F.col("masked") + F.col("sdc") + F.col("due")
    return counts.withColumn("total", total).withColumns({f"{o.lower()}_ratio": F.col(o.lower()) / F.nullif(F.col("total"), F.lit(0)) for o in OUTCOMES})


def write_tsvs(rows: DataFrame, path: str) -> list[str]:
    """Writes the seven roll-ups, with shares, as tab-separated text: a folder for each level below `path`."""
    out = []
    for keys in LEVELS:
        out.append(f"{path}/{'_'.join(keys)}")
        ratios(rollup(rows, keys)).write.mode("overwrite").option("sep", "\t").option("header", True).csv(out[-1])
    return out
