"""Single-source shortest paths, PageRank, HITS, reachability, components: frontier algorithms over edge lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compare import INF
from ..plans.gas import MOST, Graph, Program, Watch, Way, run
from ..plans.storage import new_path, stored
from ..sources.graphs import degrees, symmetrise, vertices
from .closure import closure
from .local import DAMPING, REST, TOLERANCE, strong_components

#: Edges and vertices of a weak component that a task may hold.
LOCAL = 1 << 20
#: Types of vertices that `local` works with.
NUMBERS = ("int", "bigint")

def moved(new: str, old: str) -> str:
    """SQL: whether a score changed by the tolerance or more; a NaN counts as unchanged."""
    return f"abs({new} - {old}) >= {TOLERANCE}D AND NOT isnan({new} - {old})"


def sssp_program(source: object) -> Program:
    return Program(
        (Way(f"IF(d < {INF}, d + 1, NULL)", "min", "g"),),
        {"d": f"IF(v = {source}, d, least(d, coalesce(g, {INF})))"},
        {"changed": "new_d <> d"},
        push=True,
    )


def pagerank_program() -> Program:
    return Program((Way("rank * part", "sum", "phi"),), {"rank": f"{REST}D + {DAMPING}D * coalesce(phi, 0D)"}, {"changed": moved("new_rank", "rank")})


def hits_program(dense: bool = False) -> Program:
    """Rows are stored with the gathered sums; the norms are observed with them, and the state is read through both.

    An inactive vertex keeps its scores while its last value goes on being counted in the norm and divided by it.
    """
    ways = (Way("h", "sum", "ga", flag="ch"), Way("a", "sum", "gh", "dst", "src", "ca"))
    moves = (lambda new, old: f"abs({new} - {old}) > {TOLERANCE}D") if dense else moved

    def state(table: str, seen: dict) -> str:
        # as a row and not as literals, so that the compiled code serves every superstep
        norms = ", ".join(f"CAST('{float(seen[c] or 0)!r}' AS DOUBLE)" for c in ("av", "hv"))
        rows = f"SELECT v, a, h, active, av / nullif(na, 0D) AS av, hv / nullif(nh, 0D) AS hv FROM {table} CROSS JOIN (VALUES ({norms}) AS norms(na, nh))"
        rows = f"SELECT *, IF(active, av, a) AS new_a, IF(active, hv, h) AS new_h FROM ({rows})"
        flags = ", ".join(f"coalesce({moves(f'new_{c}', c)}, false) AS c{c}" for c in "ah")
        return f"SELECT v, new_a AS a, new_h AS h, av, hv, {flags}, active FROM ({rows})"

    norms = {c: f"sqrt(sum({c} * {c}))" for c in ("av", "hv")}
    apply = {"av": "coalesce(ga, 0D)", "hv": "coalesce(gh, 0D)"}
    return Program(ways, apply, {"ca": "true", "ch": "true"}, dense=dense, observe=norms, state=state)


def label_program(larger_only: bool = False) -> Program:
    """The least label that edges bring. larger_only: a changed vertex makes only neighbours of a larger label active."""
    return Program((Way("label", "min", "g"),), {"label": "least(label, g)"}, {"changed": "new_label < label"}, active="hit AND g < label" if larger_only else "hit", push=True)


def with_shares(edges: DataFrame) -> DataFrame:
    """src, dst and part, one over the out-degree of src."""
    edges = edges.select("src", "dst")
    out = degrees(edges).select(F.col("v").alias("src"), "out_deg")
    return edges.join(out, "src").select("src", "dst", (1.0 / F.col("out_deg")).alias("part"))


def frontier_log(edges: DataFrame) -> tuple[Watch, str]:
    """A watcher that appends (iter, vertex) of every active vertex to a folder, and the folder."""
    path = new_path(edges.sparkSession, "frontier")

    def watch(state: DataFrame, step: int) -> None:
        state.filter("active").select(F.lit(step).alias("iter"), F.col("v").alias("vertex")).write.mode("append").parquet(path)

    return watch, path


def traced(edges: DataFrame, algorithm: Callable[..., tuple[DataFrame, int]], **kw: object) -> DataFrame:
    """iter and vertex: the vertices that were active in each superstep of `algorithm` over the edges."""
    watch, path = frontier_log(edges)
    algorithm(edges, watch=watch, **kw)
    return edges.sparkSession.read.schema(f"iter int, vertex {dict(edges.dtypes)['src']}").parquet(path)


def least_vertex(vs: DataFrame) -> object:
    return vs.agg(F.min("v")).head()[0]


def _ran(graph: Graph, start: DataFrame, program: Program, most: int, watch: Watch | None) -> tuple[DataFrame, int]:
    try:
        return run(graph, start, program, most, watch)
    finally:
        graph.drop()


def sssp(edges: DataFrame, vs: DataFrame | None = None, source: object = None, most: int = MOST, watch: Watch | None = None) -> tuple[DataFrame, int]:
    """v and dist (hops from the source, by default the least vertex; 2147483647 where it doesn't lead), and the supersteps."""
    graph = Graph(edges.select("src", "dst"))
    vs = vertices(graph.edges) if vs is None else vs
    source = least_vertex(vs) if source is None else source
    source = "NULL" if source is None else source
    start = vs.select("v", F.expr(f"IF(v = {source}, 0, {INF}) AS d"), F.lit(True).alias("changed"))
    state, done = _ran(graph, start, sssp_program(source), most, watch)
    return state.select("v", F.col("d").alias("dist")), done


def pagerank(edges: DataFrame, vs: DataFrame | None = None, most: int = MOST, watch: Watch | None = None) -> tuple[DataFrame, int]:
    """v and rank = 0.15 + 0.85 * sum(rank / out-degree) over in-neighbours, not normalised; only active vertices move."""
    graph = Graph(with_shares(edges))
    vs = vertices(graph.edges) if vs is None else vs
    start = vs.select("v", F.lit(REST).alias("rank"), F.lit(True).alias("changed"))
    state, done = _ran(graph, start, pagerank_program(), most, watch)
    return state.select("v", "rank"), done


def hits(edges: DataFrame, vs: DataFrame | None = None, most: int = MOST, dense: bool = False, watch: Watch | None = None) -> tuple[DataFrame, int]:
    """v, authority and hub. The frontier form may never settle, so give `most`. In the dense form every vertex takes part
    until no score moves by more than the tolerance. Without an edge both scores are null: their norm is zero."""
    graph = Graph(edges.select("src", "dst"))
    vs = vertices(graph.edges) if vs is None else vs
    start = vs.select("v", *[F.lit(1.0).alias(c) for c in ("a", "h", "av", "hv")], F.lit(True).alias("ca"), F.lit(True).alias("ch"))
    state, done = _ran(graph, start, hits_program(dense), most, watch)
    return state.select("v", F.col("a").alias("authority"), F.col("h").alias("hub")), done


def hits_score(scores: DataFrame) -> DataFrame:
    return scores.select("v", (0.7 * F.col("authority") + 0.3 * F.col("hub")).alias("score"))


def reach(edges: DataFrame, vs: DataFrame | None = None) -> DataFrame:
    """a, b for every b that a leads to, itself included: as many rows as there are such pairs.

    What lies in weak components of LOCAL edges and vertices or fewer is followed in memory, a part of the starts in each
    task (`closure`); larger components go turn by turn through Spark.
    """
    edges = stored(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    vs = vertices(edges) if vs is None else vs.select("v").distinct()
    rows = edges.select("src", "dst", F.lit(False).alias("start")).union(vs.select("v", "v", F.lit(True)))
    if rows.limit(LOCAL + 1).count() <= LOCAL:
        return closure(rows.withColumn("bundle", F.lit(0)), vs.schema["v"].dataType)
    labels = stored(components(edges, stored(vertices(edges).union(vs).distinct()))).withColumnRenamed("v", "src")
    sizes = rows.join(labels, "src").groupBy("label").agg(F.count("*").alias("n"))
    bundles = max(1, 4 * (sizes.filter(F.col("n") <= LOCAL).agg(F.sum("n")).head()[0] or 0) // LOCAL)
    labels = stored(labels.join(sizes, "label").select("src", F.when(F.col("n") <= LOCAL, F.pmod(F.hash("label"), F.lit(bundles))).alias("bundle")))
    rows, kind = rows.join(labels, "src"), vs.schema["v"].dataType
    small = closure(rows.filter("bundle IS NOT NULL"), kind, bundles)
    rest = stored(rows.filter("bundle IS NULL").select("src", "dst", "start"))
    if rest.isEmpty():
        return small
    large = reach_by_turns(rest.filter("NOT start").select("src", "dst"), rest.filter("start").select(F.col("src").alias("v")))
    return small.union(large.select(F.col("a").cast(kind), F.col("b").cast(kind)))


def reach_by_turns(edges: DataFrame, vs: DataFrame) -> DataFrame:
    """The pairs of `reach` for edges of any number. Each turn writes the pairs that are new beside those known; none is
    written twice."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "reach")
    last = stored(vs.select(F.col("v").alias("a"), F.col("v").alias("b")))
    turn = 0
    while not last.isEmpty():
        last.write.parquet(f"{path}/turn={turn}")
        known = spark.read.schema(last.schema).option("recursiveFileLookup", True).parquet(path)
        ahead = last.join(edges, last["b"] == edges["src"]).select("a", F.col("dst").alias("b")).distinct()
        last, turn = stored(ahead.join(known, ["a", "b"], "left_anti")), turn + 1
    return spark.read.schema(last.schema).option("recursiveFileLookup", True).parquet(path) if turn else last


def least_labels(edges: DataFrame, vs: DataFrame, both: bool, watch: Watch | None = None) -> tuple[DataFrame, int]:
    """v and label: the least vertex from which edges (in both directions if `both`) lead to v; and the supersteps."""
    ways = (symmetrise(edges.select("src", "dst")) if both else edges.select("src", "dst")).distinct()
    start = vs.select("v", F.col("v").alias("label"), F.lit(True).alias("changed"))
    state, done = _ran(Graph(ways), start, label_program(), MOST, watch)
    return state.select("v", "label"), done


def components(edges: DataFrame, vs: DataFrame | None = None) -> DataFrame:
    """v and label: the least vertex of its weakly connected component."""
    return least_labels(edges, vertices(edges) if vs is None else vs, True)[0]


def scc(edges: DataFrame, vs: DataFrame | None = None) -> DataFrame:
    """v and label: the least vertex of its strongly connected component.

    A graph of LOCAL edges and vertices or fewer is searched in the memory of one task, a larger one turn by turn.
    """
    edges = stored(edges.filter("src <> dst").select("src", "dst").distinct())
    left = stored(vertices(edges) if vs is None else vs.select("v"))
    if vs is not None:  # an edge counts where both of its ends do
        for end in ("src", "dst"):
            edges = edges.join(left.withColumnRenamed("v", end), end, "left_semi").select("src", "dst")
        edges = stored(edges)
    kind = left.schema["v"].dataType
    rows = edges.union(left.select("v", "v"))
    same = kind == edges.schema["src"].dataType == edges.schema["dst"].dataType and kind.simpleString() in NUMBERS
    if not same or rows.limit(LOCAL + 1).count() > LOCAL or not rows.filter("src IS NULL").isEmpty():
        return scc_by_turns(edges, left)
    one = rows.withColumn("part", F.lit(0)).repartition(1).mapInArrow(strong_components, f"v {kind.simpleString()}, label {kind.simpleString()}")
    return stored(one.join(left, "v", "left_semi"))


def scc_by_turns(edges: DataFrame, left: DataFrame) -> DataFrame:
    """The labels of `scc` for edges (no loops, once each) of any number among the vertices `left`.

    Colouring: a vertex's colour is the least vertex that leads to it; what leads back to that vertex within the colour is
    its component. Found components go, and so do vertices without an edge in or out, until none is left. No table of
    reachable pairs is made.
    """
    back = Program((Way("1", "max", "got", "dst", "src"),), {"in_it": "in_it OR coalesce(got, 0) = 1"}, {"changed": "new_in_it <> in_it"}, push=True)
    found = []
    while not left.isEmpty():
        busy = edges.select(F.col("src").alias("v")).intersect(edges.select("dst"))
        single = stored(left.join(busy, "v", "left_anti"))
        if single.isEmpty():
            colour = least_labels(edges, left, False)[0]
            one = edges.join(colour.withColumnsRenamed({"v": "src", "label": "cs"}), "src").join(colour.withColumnsRenamed({"v": "dst", "label": "cd"}), "dst")
            root = F.col("v") == F.col("label")
            start = colour.select("v", "label", root.alias("in_it"), root.alias("changed"))
            done, _ = _ran(Graph(one.filter("cs = cd").select("src", "dst")), start, back, MOST, None)
            part = stored(done.filter("in_it").select("v", "label"))
        else:
            part = single.select("v", F.col("v").alias("label"))
        found.append(part)
        left = stored(left.join(part, "v", "left_anti"))
        gone = part.select("v")
        edges = stored(edges.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"))
    return reduce(DataFrame.union, found) if found else left.select("v", F.col("v").alias("label"))


def inside_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges in both directions between vertices of one strong component, once each."""
    one = edges.select("src", "dst").join(labels.withColumnsRenamed({"v": "src", "label": "ls"}), "src").join(labels.withColumnsRenamed({"v": "dst", "label": "ld"}), "dst")
    return symmetrise(one.filter("ls = ld AND src <> dst").select("src", "dst")).distinct()


def scc_frontier(edges: DataFrame, vs: DataFrame | None = None, most: int = MOST, watch: Watch | None = None) -> tuple[DataFrame, int]:
    """v and label as `scc` gives them, and the supersteps that labels take to spread along edges within components; there a
    changed vertex makes only neighbours of a larger label active, which are those that then change."""
    vs = stored(vertices(edges) if vs is None else vs.select("v"))
    graph = Graph(inside_components(edges, scc(edges, vs)))
    start = vs.select("v", F.col("v").alias("label"), F.lit(True).alias("changed"))
    state, done = _ran(graph, start, label_program(larger_only=True), most, watch)
    return state.select("v", "label"), done
