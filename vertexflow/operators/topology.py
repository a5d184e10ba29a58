"""Clustering coefficients, high-clustering subsets, neighbour similarity, similarity groups and their cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import new_path, stored
from ..sources.graphs import degrees, simple, vertices
from .algorithms import components


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z and, for each two of them, whether an edge leads one way (xy, xz, yz) and the other (yx, zx, zy): every
    triangle of simple edges once, whatever the directions.

    Ends are ordered by degree, so a wedge starts at its vertex of least degree: a hub has few neighbours above it, and no
    vertex more than the root of twice the number of edges.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    pairs = pairs.groupBy("a", "b").agg(F.max("up").alias("ab"), F.max(~F.col("up")).alias("ba"))
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    pairs = pairs.join(ends.withColumnsRenamed({"v": "a", "d": "da"}), "a").join(ends.withColumnsRenamed({"v": "b", "d": "db"}), "b")
    first, second = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    low = first < second
    rising = pairs.select(F.when(low, first).otherwise(second).alias("lo"), F.when(low, second).otherwise(first).alias("hi"), F.when(low, F.col("ab")).otherwise(F.col("ba")).alias("out"), F.when(low, F.col("ba")).otherwise(F.col("ab")).alias("back"))
    rising = stored(rising.select(F.col("lo.v").alias("lo"), F.col("hi.v").alias("hi"), F.col("hi.d").alias("hd"), "out", "back"))
    one = rising.select(F.col("lo").alias("x"), F.col("hi").alias("y"), F.col("hd").alias("yd"), F.col("out").alias("xy"), F.col("back").alias("yx"))
    two = rising.select(F.col("lo").alias("x"), F.col("hi").alias("z"), F.col("hd").alias("zd"), F.col("out").alias("xz"), F.col("back").alias("zx"))
    three = rising.select(F.col("lo").alias("y"), F.col("hi").alias("z"), F.col("out").alias("yz"), F.col("back").alias("zy"))
    wedges = one.join(two, "x").filter(F.struct(F.col("yd"), F.col("y")) < F.struct(F.col("zd"), F.col("z")))
    return wedges.join(three, ["y", "z"]).select("x", "y", "z", "xy", "yx", "xz", "zx", "yz", "zy")


def coefficients(edges: DataFrame) -> DataFrame:
    """v, cc_in, cc_out, cc of every end of an edge; repeats and loops don't count.

    cc_in is the share of ordered pairs of in-neighbours that have an edge, cc_out the same among out-neighbours, cc their
    mean. Every triangle is found once and counted for each of its three vertices.
    """
    e = stored(simple(edges))
    n = lambda *flags: sum(F.col(f).cast("long") for f in flags)
    both = lambda a, b: F.col(a) & F.col(b)
    corners = [("x", both("yx", "zx"), both("xy", "xz"), n("yz", "zy")), ("y", both("xy", "zy"), both("yx", "yz"), n("xz", "zx")), ("z", both("xz", "yz"), both("zx", "zy"), n("xy", "yx"))]
    rows = F.array(*[F.struct(F.col(v).alias("v"), F.when(i, k).otherwise(0).alias("t_in"), F.when(o, k).otherwise(0).alias("t_out")) for v, i, o, k in corners])
    counts = triangles(e).select(F.explode(rows).alias("c")).select("c.*").groupBy("v").agg(F.sum("t_in").alias("t_in"), F.sum("t_out").alias("t_out"))
    out = degrees(e).join(counts, "v", "left")
    for side in ("in", "out"):
        k = F.col(f"{side}_deg")
        out = out.withColumn(f"cc_{side}", F.when(k >= 2, F.coalesce(F.col(f"t_{side}"), F.lit(0)) / (k * (k - 1))).otherwise(0.0))
    return out.select("v", "cc_in", "cc_out", ((F.col("cc_in") + F.col("cc_out")) / 2).alias("cc"))


def write_coefficients(coefficients: DataFrame, path: str | None = None) -> str:
    """Writes v and cc as text with a header, as a spreadsheet reads it; returns the folder, a new one where none is given."""
    path = new_path(coefficients.sparkSession, "coefficients") if path is None else path
    coefficients.select("v", "cc").write.option("header", True).csv(path)
    return path


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("v long, cc double").csv(path)


def high_clustering_subsets(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """v and subset (its least vertex) of the components of two or more vertices whose coefficient reaches the threshold."""
    high = stored(coefficients(edges).filter(F.col("cc") >= threshold).select("v"))
    e = simple(edges)
    inner = e.join(high.withColumnRenamed("v", "src"), "src").join(high.withColumnRenamed("v", "dst"), "dst").select("src", "dst")
    return components(inner).withColumnRenamed("label", "subset")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """v, item, n (items of v) of the items that a set can't do without: two sets whose Jaccard similarity reaches the
    threshold share one of the first n - ceil(threshold * n) + 1 items of each, in any one order of all items; the rarest
    come first."""
    rarity = sets.groupBy("item").agg(F.count("*").alias("spread"))
    own = Window.partitionBy("v")
    ranked = sets.join(rarity, "item").withColumns({"n": F.count("*").over(own), "i": F.row_number().over(own.orderBy("spread", "item"))})
    # a hair below, so that rounding never shortens a prefix
    return ranked.filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("v", "item", "n")


def similar_pairs(edges: DataFrame, threshold: float = 0.6) -> DataFrame:
    """v1 < v2, sim_in, sim_out (Jaccard of in- and out-neighbours, two decimals) where both reach the threshold unrounded.

    Candidates share a needed out-neighbour and have degrees whose ratio reaches the threshold, both ways; what is popular is
    hardly ever needed, so a hub's neighbours don't all meet. A candidate's neighbours are then counted in full. threshold is
    above 0.
    """
    e = stored(edges.select("src", "dst").distinct())
    deg = degrees(e)
    near = _prefixes(e.select(F.col("src").alias("v"), F.col("dst").alias("item")), threshold).join(deg, "v")
    a, b = (near.select("item", *[F.col(c).alias(f"{n}{i}") for c, n in (("v", "v"), ("out_deg", "o"), ("in_deg", "i"))]) for i in (1, 2))
    fits = [F.least(f"{c}1", f"{c}2") >= threshold * F.greatest(f"{c}1", f"{c}2") for c in "oi"]
    pairs = stored(a.join(b, (a["item"] == b["item"]) & (F.col("v1") < F.col("v2")) & fits[0] & fits[1]).drop("item").distinct())
    for side, near_end, far_end in (("out", "src", "dst"), ("in", "dst", "src")):
        one, two = (e.select(F.col(near_end).alias(v), F.col(far_end).alias("x")) for v in ("v1", "v2"))
        shared = pairs.select("v1", "v2").join(one, "v1").join(two, ["v2", "x"]).groupBy("v1", "v2").agg(F.count("*").alias("k"))
        union = F.col(f"{side[0]}1") + F.col(f"{side[0]}2") - F.col("k")
        pairs = pairs.join(shared, ["v1", "v2"]).withColumn(f"sim_{side}", F.col("k") / union).drop("k").filter(F.col(f"sim_{side}") >= threshold)
    return pairs.select("v1", "v2", F.round("sim_in", 2).alias("sim_in"), F.round("sim_out", 2).alias("sim_out"))


def _groups(near: dict[int, list[int]]) -> list[tuple[int, ...]]:
    """Cliques grown from every vertex and neighbour, each next member the first neighbour that is near to all so far."""
    sets = {v: set(n) for v, n in near.items()}
    found = set()
    for v, own in near.items():
        for first in own:
            group, members, at = [v, first], {v, first}, [iter(near[first])]
            while at:
                for w in at[-1]:
                    if w not in members and members <= sets[w]:
                        group.append(w)
                        members.add(w)
                        at.append(iter(near[w]))
                        break
                else:
                    at.pop()
            found.add(tuple(sorted(group)))
    return sorted(found)


def _cover(groups: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Groups taken vertex by vertex in rising order, the longest that holds it first, their members leaving all others."""
    rest, out = [list(g) for g in groups], []
    for v in sorted({v for g in groups for v in g}):
        holders = [g for g in rest if v in g]
        if not holders:
            continue
        best = max(holders, key=len)  # the first of the longest
        out.append(tuple(best))
        taken = set(best)
        rest = [kept for g in rest if g is not best and len(kept := [w for w in g if w not in taken]) > 1]
    return out


def _by_component(pairs: DataFrame, cover: bool) -> DataFrame:
    both = pairs.select("v1", "v2").union(pairs.select("v2", "v1")).toDF("src", "dst")
    named = components(both)
    rows = both.join(named.withColumnRenamed("v", "src"), "src")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["src", "dst"])
        near = {int(v): [int(w) for w in g] for v, g in part.groupby("src")["dst"]}
        groups = _groups(near)
        return pd.DataFrame({"members": _cover(groups) if cover else groups}, dtype=object)

    return rows.groupBy("label").applyInPandas(run, "members array<long>")


def similarity_groups(pairs: DataFrame) -> DataFrame:
    """members (sorted) of every group of mutually similar vertices that grows from some pair; a component of the
    similarity graph goes to one task, as the growth is sequential within it."""
    return _by_component(pairs, False)


def group_cover(pairs: DataFrame) -> DataFrame:
    """members of the disjoint groups of two or more that the greedy cover takes."""
    return _by_component(pairs, True)


def numbered(groups: DataFrame) -> DataFrame:
    """number (from 1, in the order of members) and members of each group."""
    rows = stored(groups.select("members").repartitionByRange("members").sortWithinPartitions("members").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before = rows.groupBy("part").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select((F.col("own") + F.col("before")).alias("number"), "members")


def subset_members(subsets: DataFrame) -> DataFrame:
    """members (sorted) of each subset of high_clustering_subsets, for `numbered`."""
    return subsets.groupBy("subset").agg(F.sort_array(F.collect_list("v")).alias("members")).select("members")


def subset_sizes(subsets: DataFrame) -> DataFrame:
    return subsets.groupBy("subset").agg(F.count("*").alias("size"))


def endpoint_vertices(edges: DataFrame) -> DataFrame:
    return vertices(simple(edges))
