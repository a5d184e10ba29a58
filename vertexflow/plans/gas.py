"""The superstep loop: gather, apply and scatter over the active vertices until none is left.

A program says what a vertex gets along edges, what becomes of it and when it counts as changed. Changed vertices make the
vertices that their edges lead to active, and only active vertices gather and move.

The edges are stored once in buckets of each end that is needed, the state in buckets of the vertex, so a superstep shuffles
only what goes from one vertex to another, combined before it moves. Gather and scatter run along the same edges and share one
pass over them; where few vertices are active, the receivers are found first and only their edges are read. A superstep is one
SQL statement and one job, which stores the next state in the shared folder and counts the active vertices on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import Bucketed, bucket_count, delete, new_path

MOST = 9999
#: Where fewer than one vertex in so many was active, the next superstep looks for the receivers first.
FEW = 8

Watch = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class Way:
    """What the vertex at the `near` end of an edge sends to the one at the `far` end: `value` (SQL over the sender's columns
    and the edge's), combined by `how` into a column; the sender's `flag` makes the receiver active."""

    value: str
    how: str
    into: str
    near: str = "src"
    far: str = "dst"
    flag: str = "changed"


def read_all(table: str, seen: dict) -> str:
    return f"SELECT * FROM {table}"


@dataclass(frozen=True)
class Program:
    """apply: SQL for the new value of a column of an active vertex, over the old columns and the gathered ones.
    flags: SQL for each change flag, over the columns and their new values `new_...`.

    active: SQL for whether a vertex is active, over its columns, the gathered ones and `hit`.
    push: a value that a sender sent before and has not changed cannot matter again, so only changed vertices send.
    dense: all vertices stay active until none of them changes.
    observe: aggregates of the stored rows that `state` needs, the SQL that reads the state from their table.
    """

    ways: tuple[Way, ...]
    apply: dict[str, str]
    flags: dict[str, str]
    active: str = "hit"
    push: bool = False
    dense: bool = False
    observe: dict[str, str] = field(default_factory=dict)
    state: Callable[[str, dict], str] = read_all


class Graph:
    """Edges (src, dst and what else they carry), stored once, and in buckets of either end when first asked for."""

    def __init__(self, edges: DataFrame) -> None:
        self.spark, self.tables = edges.sparkSession, {}
        self.path, seen = new_path(self.spark, "edges"), Observation()
        edges.observe(seen, F.count("*").alias("n")).write.parquet(self.path)
        self.edges = self.spark.read.schema(edges.schema).parquet(self.path)
        self.buckets = bucket_count(self.spark, seen.get["n"])

    def by(self, end: str) -> str:
        """The table of the edges in buckets of `end`."""
        if end not in self.tables:
            self.tables[end] = Bucketed(self.edges.repartition(self.buckets, end), end, self.buckets)
        return self.tables[end].name

    def drop(self) -> None:
        for t in self.tables.values():
            t.drop()
        delete(self.spark, self.path)


def messages(graph: Graph, state: str, program: Program, few: bool = False) -> str:
    """SQL: v, the gathered columns and hit (whether a changed vertex leads to it) of every vertex that something is sent to.

    few: only for vertices that are hit, by way of their own edges.
    """

    def part(v: str, way: Way | None, hit: str, source: str) -> str:
        own = ", ".join(f"{way.value if w is way else 'NULL'} AS {w.into}" for w in program.ways)
        return f"SELECT {v} AS v, {own}, {hit} AS hit FROM {source}"

    parts = []
    if few and not program.push:
        hit = " UNION ALL ".join(f"SELECT {w.far} AS x FROM {graph.by(w.near)} JOIN ({state}) ON v = {w.near} WHERE {w.flag}" for w in program.ways)
        hit = f"(SELECT DISTINCT x FROM ({hit}))"
        # a vertex that is hit may have edges of the other way only
        parts = [part(w.far, w, "true", f"{graph.by(w.far)} JOIN {hit} ON x = {w.far} JOIN ({state}) ON v = {w.near}") for w in program.ways]
        parts.append(part("x", None, "true", hit))
    else:
        for w in program.ways:
            sends = f"(SELECT * FROM ({state}) WHERE {w.flag})" if program.push else f"({state})"
            parts.append(part(w.far, w, w.flag, f"{graph.by(w.near)} JOIN {sends} ON v = {w.near}"))
    how = ", ".join(f"{w.how}({w.into}) AS {w.into}" for w in program.ways)
    return f"SELECT v, {how}, max(hit) AS hit FROM ({' UNION ALL '.join(parts)}) GROUP BY v"


def applied(rows: str, program: Program, columns: list[str], more: str = "") -> str:
    """SQL: the columns (new where the program gives a value), the flags, active and `more`, from rows with the old columns,
    the gathered ones and active."""
    new = ", ".join(f"IF(active, {x}, {c}) AS new_{c}" for c, x in program.apply.items())
    own = ", ".join(f"new_{c} AS {c}" if c in program.apply else c for c in columns)
    flags = ", ".join(f"coalesce({x}, false) AS {f}" for f, x in program.flags.items())
    return f"SELECT {own}, {flags}, active{more} FROM (SELECT *, {new} FROM ({rows}))"


@dataclass
class History:
    """The rows of every superstep k, kept in the folder path/iter=k, and the SQL that reads the state from them."""

    path: str
    tables: list[Bucketed] = field(default_factory=list)
    states: list[str] = field(default_factory=list)

    def drop(self) -> None:
        for t in self.tables:
            t.drop()


def run(graph: Graph, start: DataFrame, program: Program, most: int = MOST, watch: Watch | None = None, history: History | None = None) -> tuple[DataFrame, int]:
    """The last state (v, columns, flags) and the number of supersteps made.

    start: v, columns and flags; every vertex is active in the first superstep. `watch` gets the rows of each superstep with
    `active`, whether the vertex took part. Where there is a `history`, the supersteps' rows go there and stay.
    """
    spark, buckets = graph.spark, graph.buckets
    columns = [c for c in start.columns if c not in program.flags]
    own, some = ", ".join(f"s.{c}" for c in columns), " OR ".join(program.flags)
    counts = {"n": "count(*)", "active": "count_if(active)", "before": "count_if(before)", "after": f"count_if({some})"} | program.observe
    now, done, few = Bucketed(start.repartition(buckets, "v"), "v", buckets), 0, False
    state = read_all(now.name, {})
    while done < most:
        active = "true" if done == 0 or program.dense else f"coalesce({program.active}, false)"
        sent = ", ".join(["hit", *(w.into for w in program.ways)])
        rows = f"SELECT {own}, {sent}, {active} AS active, ({some}) AS before FROM ({state}) s LEFT JOIN ({messages(graph, state, program, few)}) m ON m.v = s.v"
        seen = Observation()
        after = spark.sql(applied(rows, program, columns, ", before")).observe(seen, *[F.expr(x).alias(n) for n, x in counts.items()]).drop("before")
        table = Bucketed(after, "v", buckets, f"{history.path}/iter={done + 1}" if history else None)
        got = seen.get
        if not got["active"] or (program.dense and done and not got["before"]):
            table.drop()
            break
        if not history or not done:
            now.drop()
        done += 1
        now, state = table, program.state(table.name, got)
        if history:
            history.tables.append(table)
            history.states.append(state)
        if watch:
            watch(spark.sql(state), done)
        few = got["active"] * FEW < got["n"]
        if not program.observe and not got["after"]:
            break
    path = new_path(spark, "state")
    last = spark.sql(state).select(*columns)
    last.write.parquet(path)
    if not history or not done:
        now.drop()
    return spark.read.schema(last.schema).parquet(path), done
