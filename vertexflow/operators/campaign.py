"""The fault campaign: sites, trials, golden run, injected runs, classification and log records of the four programs.

A site is a phase of a superstep (gather, apply or scatter), a register (a state column, a gathered value or a change flag)
and its width. A trial flips one bit of one site for one active vertex in one superstep.

An injected run is the golden run except where the fault has spread, so only the rows (trial, vertex) that differ from the
golden state are kept. A superstep works on those and on what their edges lead to, and reads every other value from the
golden run's history; the supersteps before a fault cost nothing. All trials advance together. In HITS the norms couple all
vertices, so a trial takes every vertex with it once it differs.

Of a graph of alg.LOCAL edges and vertices or fewer, a campaign keeps the whole state in the tasks' memory (`local`), as a
superstep through Spark costs a job however small it is; HITS, over few supersteps, goes through Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.compare import INF, draw, mask, ranked
from ..plans.gas import MOST, Graph, History, Program, run
from ..plans.storage import new_path, stored
from ..sources.graphs import vertices
from . import algorithms as alg
from . import local

PHASES = ("gather", "apply", "scatter")


@dataclass(frozen=True)
class Site:
    line: int
    kernel: str
    opcode: str
    type: str
    width: int
    register: str
    looped: bool


def _sites(gathered: dict[str, str], columns: dict[str, str], flags: tuple[str, ...]) -> tuple[Site, ...]:
    """The sites of a program, numbered in the order of the phases; gathered and columns give a type for each register."""
    rows = [("gather", r, t, True) for r, t in gathered.items()] + [("apply", r, t, False) for r, t in columns.items()] + [("scatter", r, "pred", False) for r in flags]
    code = {"gather": "ld.global", "apply": "st.global", "scatter": "setp.ne"}
    return tuple(Site(i, k, f"{code[k]}.{'s32' if t == 'pred' else t}", t, 1 if t == "pred" else 32, r, looped) for i, (k, r, t, looped) in enumerate(rows, 1))


@dataclass(frozen=True)
class App:
    """trips: how many loop trips a trial is drawn from. held: SQL for a vertex that never gathers or moves. active: SQL over
    `low`, the least that a changed vertex sends, where a gather may bring less than what activates."""

    name: str
    program: Program
    start: dict[str, str]
    sites: tuple[Site, ...]
    trips: int
    result: str
    ranking: bool = False
    coupled: bool = False
    held: str = "false"
    active: str = "hit"

    @property
    def columns(self) -> list[str]:
        return list(self.start)

    @property
    def flags(self) -> list[str]:
        return list(self.program.flags)


def app(name: str, source: object = None) -> App:
    """SSSP (with its source vertex), PageRank, HITS or SCC."""
    if name == "SSSP":
        return App(name, alg.sssp_program(source), {"d": f"IF(v = {source}, 0, {INF})"}, _sites({"g": "s32"}, {"d": "s32"}, ("changed",)), 160, "d", held=f"v = {source}")
    if name == "PageRank":
        return App(name, alg.pagerank_program(), {"rank": f"{alg.REST}D"}, _sites({"phi": "f32"}, {"rank": "f32"}, ("changed",)), 10, "rank", True)
    if name == "HITS":
        sites = _sites({"ga": "f32", "gh": "f32"}, {"a": "f32", "h": "f32"}, ("ca", "ch"))
        return App(name, alg.hits_program(), dict.fromkeys(("a", "h", "av", "hv"), "1D"), sites, 10, "0.7D * a + 0.3D * h", True, True)
    if name == "SCC":
        return App(name, alg.label_program(larger_only=True), {"label": "v"}, _sites({"g": "s32"}, {"label": "s32"}, ("changed",)), 50, "label", active="hit AND low < label")
    raise ValueError(f"no such program: {name}")


def edges_of(a: App, edges: DataFrame) -> DataFrame:
    """The edges that a program runs along: with shares for PageRank, within strong components for SCC."""
    if a.name == "SCC":
        return alg.inside_components(edges, alg.scc(edges))
    return alg.with_shares(edges) if a.name == "PageRank" else edges.select("src", "dst")


class Golden:
    """A clean run with its history: for each superstep (0: the start), the state and who was active."""

    def __init__(self, a: App, edges: DataFrame, most: int = MOST) -> None:
        self.app, self.spark = a, edges.sparkSession
        own = stored(edges)
        vs = stored(vertices(own))
        self.graph, self.kept = Graph(edges_of(a, own)), History(new_path(self.spark, "golden"))
        start = stored(vs.select("v", *[F.expr(f"{x} AS {c}") for c, x in a.start.items()], *[F.lit(True).alias(f) for f in a.flags]))
        self.start = start.withColumn("active", F.lit(False))
        _, self.steps = run(self.graph, start, a.program, most, history=self.kept)
        self.cut = self.steps == most
        rows = self.spark.read.schema(self.start.select("v", "active", F.lit(0).alias("iter")).schema)
        self.active = (rows.parquet(self.kept.path) if self.steps else self.start.withColumn("iter", F.lit(0))).filter("active").select("iter", "v")
        self.state = self.at(self.steps)

    def at(self, step: int) -> DataFrame:
        """v, columns, flags and active after a superstep; nobody is active or changed beyond the last."""
        rows = self.spark.sql(self.kept.states[min(step, self.steps) - 1]) if step and self.steps else self.start
        rows = rows.select("v", *self.app.columns, *self.app.flags, "active")
        return rows if step <= self.steps else rows.withColumns(dict.fromkeys([*self.app.flags, "active"], F.lit(False)))

    def drop(self) -> None:
        self.graph.drop()
        self.kept.drop()

    def trace(self) -> DataFrame:
        return self.active.select("iter", F.col("v").alias("vertex"))


#: Vertices of one slice of the numbering of active vertices.
SLICE = 65536


def trials(a: App, trace: DataFrame, n: int) -> DataFrame:
    """The records of trials 1 to n, as the log has them (trial, app, kernel, iter, thread, vertex, bit, mask, line, opcode,
    width, type, register, loop): a repeatable draw of a site, a bit of it, a superstep of the trace and a vertex active in
    it; and of a loop trip where the site lies in a loop, 0 elsewhere.

    trace: iter, vertex. The vertices are counted by slices of their numbers, so that no task numbers all of them.
    """
    spark, trial = trace.sparkSession, F.col("trial")
    sites = spark.createDataFrame([(s.line, s.kernel, s.opcode, s.width, s.type, s.register, s.looped) for s in a.sites], "line int, kernel string, opcode string, width int, type string, register string, looped boolean")
    steps = trace.agg(F.max("iter").alias("steps"))
    t = spark.range(1, n + 1).select(F.col("id").alias("trial")).crossJoin(F.broadcast(steps))  # one row
    t = t.withColumns({"iter": (1 + draw(trial, 12345, F.col("steps"))).cast("int"), "line": (1 + draw(trial, 99, F.lit(len(a.sites)))).cast("int")})
    t = t.join(F.broadcast(sites), "line").withColumns({"bit": draw(trial, 777, F.col("width")).cast("int"), "loop": F.when(F.col("looped"), 1 + draw(trial, 31, F.lit(a.trips))).otherwise(0).cast("int")})
    rows = trace.withColumn("slice", F.floor(F.col("vertex") / SLICE))
    slices = rows.groupBy("iter", "slice").agg(F.count("*").alias("m"))
    slices = slices.withColumns({"upto": F.sum("m").over(Window.partitionBy("iter").orderBy("slice")), "all": F.sum("m").over(Window.partitionBy("iter"))})
    t = t.join(slices, "iter").withColumn("pick", 1 + draw(trial, 4242, F.col("all"))).filter((F.col("pick") <= F.col("upto")) & (F.col("pick") > F.col("upto") - F.col("m")))
    t = t.withColumn("place", F.col("pick") - F.col("upto") + F.col("m"))
    order = rows.withColumn("place", F.row_number().over(Window.partitionBy("iter", "slice").orderBy("vertex")).cast("long"))
    t = t.join(order, ["iter", "slice", "place"])
    return t.select(
        "trial", F.lit(a.name).alias("app"), "kernel", "iter", (F.col("vertex") - 1).alias("thread"), "vertex", "bit",
        F.lower(F.hex(mask(F.col("bit")))).alias("mask"), "line", "opcode", "width", "type", "register", "loop",
    )


def _flip_int(x: str) -> str:
    y = f"((CAST({x} AS BIGINT) ^ shiftleft(1L, bit)) & 4294967295L)"
    return f"CAST(IF({y} > {INF}L, {y} - 4294967296L, {y}) AS INT)"


def _flip_float(x: str) -> str:
    raw = _flip_int(f"CAST(reflect('java.lang.Float', 'floatToRawIntBits', CAST({x} AS FLOAT)) AS INT)")
    return f"CAST(reflect('java.lang.Float', 'intBitsToFloat', {raw}) AS FLOAT)"


#: SQL for a value with bit `bit` flipped, as compare.flip_int and compare.flip_float have it.
FLIP = {"f32": _flip_float, "s32": _flip_int}


def _meets(kernel: str, register: str) -> str:
    return f"coalesce(kernel = '{kernel}' AND register = '{register}' AND live, false)"


class Injected:
    """All trials of a plan (trial, iter, vertex, bit, kernel, register), run beside a golden run.

    final: (trial, v, columns) that differ from the golden state in the end. runs: trial, fi_flag (1 if the fault met its
    vertex; an SSSP source neither gathers nor moves, and only a changed vertex scatters), supersteps, late (still active when
    `patience` times the golden run's supersteps were over; never where the golden run itself was cut).
    A null bit is no fault.
    """

    def __init__(self, golden: Golden, plan: DataFrame, patience: int = 2) -> None:
        a, spark = golden.app, golden.spark
        self.golden, self.budget = golden, golden.steps if golden.cut else patience * golden.steps
        self.plan = stored(plan.select("trial", F.col("iter").cast("int").alias("iter"), F.col("vertex").alias("v"), "bit", "kernel", "register"))
        due = {r["iter"] for r in self.plan.filter("bit IS NOT NULL").select("iter").distinct().collect()}
        path, done, last = new_path(spark, "injected"), [], None
        for k in range(1, self.budget + 1):
            if last is None and k not in due:
                continue
            seen = Observation()
            rows = self._step(k, last, k in due).observe(seen, F.count_if("differs").alias("differs"), F.count_if("active").alias("active"))
            rows.write.parquet(f"{path}/iter={k}")
            now = spark.read.schema(rows.schema).parquet(f"{path}/iter={k}")
            done.append(k)
            last = now.filter("differs").select("trial", "v", *a.columns, *a.flags) if seen.get["differs"] else None
            if k >= max([golden.steps, *due]) and (last is None or (k > golden.steps and not seen.get["active"])):
                break
        empty = self.plan.limit(0).select("trial", "v").join(golden.state, "v")
        self.final = empty.select("trial", "v", *a.columns, *a.flags) if last is None else last
        self._log(path, done)

    def _step(self, k: int, last: DataFrame | None, due: bool) -> DataFrame:
        """trial, v, columns, flags and active after superstep k of every row that may differ, differs, whether it does, was
        (active in the golden run) and fired."""
        golden = self.golden
        given = {"before": golden.at(k - 1), "after": golden.at(k)}
        if last is not None:
            given["last"] = last
        if due:
            given["plan"] = self.plan.filter((F.col("iter") == k) & F.col("bit").isNotNull()).select("trial", "v", "bit", "kernel", "register")
        return golden.spark.sql(self._sql(k == 1, last is not None, due), **given)

    def _sql(self, first: bool, last: bool, due: bool) -> str:
        """The superstep as one statement over {before}, {after}, {last} and {plan}, so that it is analysed once."""
        a, by = self.golden.app, self.golden.graph.by
        columns, flags, ways = a.columns, a.flags, a.program.ways
        state, gathered = [*columns, *flags], [w.into for w in ways]
        carried = [c for c in self.golden.graph.edges.columns if c not in ("src", "dst")]
        touched = ["SELECT trial, v FROM {plan}"] if due else []
        if last:
            touched.append("SELECT trial, v FROM {last}")
            if not a.coupled:
                touched += [f"SELECT l.trial, e.{w.far} AS v FROM {{last}} l JOIN {by(w.near)} e ON l.v = e.{w.near}" for w in ways]
        rows = f"({' UNION ALL '.join(touched)})"
        rows = f"SELECT t.trial, g.v FROM (SELECT DISTINCT trial FROM {rows}) t CROSS JOIN {{after}} g" if a.coupled else f"SELECT DISTINCT trial, v FROM {rows}"

        def as_of(own: str, v: str) -> str:
            """Adds the state that each trial's vertex `v` had before."""
            mine = f" LEFT JOIN {{last}} m ON m.trial = o.trial AND m.v = o.{v}" if last else ""
            values = ", ".join(f"IF(m.trial IS NULL, g.{c}, m.{c}) AS {c}" if last else f"g.{c}" for c in state)
            return f"SELECT o.*, {values} FROM ({own}) o JOIN {{before}} g ON g.v = o.{v}{mine}"

        def with_sent(i: int) -> str:
            w = ways[i]
            near = f"SELECT {', '.join(['r.trial', 'r.v AS far_v', f'e.{w.near} AS near_v', *(f'e.{c}' for c in carried)])} FROM ({rows}) r JOIN {by(w.far)} e ON r.v = e.{w.far}"
            sent = f"SELECT trial, far_v, {w.how}({w.value}) AS {w.into}, max({w.flag}) AS hit{i}, min(IF({w.flag}, {w.value}, NULL)) AS low{i} FROM ({as_of(near, 'near_v')}) GROUP BY trial, far_v"
            return f" LEFT JOIN ({sent}) s{i} ON s{i}.trial = o.trial AND s{i}.far_v = o.v"

        fault = ["bit", "kernel", "register"] if due else []
        planned = " LEFT JOIN {plan} p ON p.trial = o.trial AND p.v = o.v" if due else ""
        hit = " OR ".join(f"coalesce(hit{i}, false)" for i in range(len(ways)))
        sql = f"SELECT {', '.join(['o.*', *gathered, *fault])}, {hit} AS hit, low0 AS low FROM ({as_of(rows, 'v')}) o{''.join(map(with_sent, range(len(ways))))}{planned}"
        sql = f"SELECT *, {'true' if first else f'coalesce({a.active}, false)'} AS active FROM ({sql})"
        sql = f"SELECT *, active AND NOT coalesce({a.held}, false) AS live FROM ({sql})"

        def flipped(kernel: str, names: list[str], sql: str, rest: list[str]) -> str:
            """Flips the registers of a phase; a register is the last part of its name."""
            types = {s.register: s.type for s in a.sites if s.kernel == kernel}
            none = {"s32": str(INF), "f32": "0D"}  # nothing gathered counts as the value that it is taken for

            def value(name: str) -> str:
                r = name.removeprefix("new_")
                if not due or r not in types:
                    return name
                old = f"coalesce({name}, {none[types[r]]})" if kernel == "gather" else name
                return f"IF({_meets(kernel, r)}, {FLIP[types[r]](old)}, {name}) AS {name}"

            return f"SELECT {', '.join([*rest, *map(value, names)])} FROM ({sql})"

        old = ["trial", "v", *state, "active", "live", *fault]
        sql = flipped("gather", gathered, sql, old)
        new = dict(a.program.apply)
        sql = f"SELECT {', '.join(old)}, {', '.join(f'IF(active, {x}, {c}) AS new_{c}' for c, x in new.items())} FROM ({sql})"
        if a.coupled:
            norms = f"SELECT trial, {', '.join(f'nullif(sqrt(sum(new_{c} * new_{c})), 0D) AS n_{c}' for c in new)} FROM ({sql}) GROUP BY trial"
            sql = f"SELECT {', '.join(f'o.{c}' for c in old)}, {', '.join(f'new_{c} / n_{c} AS new_{c}' for c in new)} FROM ({sql}) o JOIN ({norms}) n ON n.trial = o.trial"
            sql = f"SELECT *, IF(active, new_av, a) AS new_a, IF(active, new_hv, h) AS new_h FROM ({sql})"
            new |= {"a": "", "h": ""}
        sql = flipped("apply", [f"new_{c}" for c in new], sql, old)
        moves = {f: alg.moved(f"new_{f[1]}", f[1]) for f in flags} if a.coupled else a.program.flags
        sql = f"SELECT *, {', '.join(f'coalesce({x}, false) AS new_{f}' for f, x in moves.items())} FROM ({sql})"
        cut = {f: f"({_meets('scatter', f)} AND new_{f})" if due else "false" for f in flags}
        fired = " OR ".join(["coalesce(kernel IN ('gather', 'apply') AND live, false)", *cut.values()]) if due else "false"
        values = [f"new_{c} AS {c}" if c in new else c for c in columns] + [f"new_{f} AND NOT {x} AS {f}" for f, x in cut.items()]
        sql = f"SELECT trial, v, {', '.join(values)}, active, {fired} AS fired FROM ({sql})"
        same = " AND ".join(f"o.{c} <=> g.{c}" for c in state)
        return f"SELECT o.*, g.active AS was, NOT ({same}) AS differs FROM ({sql}) o JOIN {{after}} g ON g.v = o.v"

    def _edges(self, end: str) -> DataFrame:
        return self.golden.spark.table(self.golden.graph.by(end))

    def _log(self, path: str, done: list[int]) -> None:
        a, golden = self.golden.app, self.golden
        trial = self.plan.select("trial").distinct()
        if not done:
            rows = trial.select("trial", F.lit(0).alias("fi_flag"), F.lit(golden.steps).alias("supersteps"), F.lit(False).alias("late"))
            self.runs = stored(rows)
            return
        moving = " OR ".join(a.flags)
        schema = f"trial long, active boolean, was boolean, fired boolean, {', '.join(f'{f} boolean' for f in a.flags)}, iter int"
        log = golden.spark.read.schema(schema).parquet(path)
        log = log.groupBy("trial", "iter").agg(F.sum(F.col("active").cast("int") - F.col("was").cast("int")).alias("more"), F.max("fired").alias("fired"), F.max(F.expr(moving)).alias("moving"))
        clean = golden.active.groupBy("iter").agg(F.count("*").alias("base"))
        # a superstep that a trial has no row of is as in the golden run
        steps = trial.crossJoin(golden.spark.range(1, self.budget + 1).select(F.col("id").cast("int").alias("iter"))).join(F.broadcast(clean), "iter", "left").join(log, ["trial", "iter"], "left")
        alive = F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0)) > 0
        end = F.max(F.when(alive, F.col("iter")))
        late = F.coalesce(F.max(F.when(F.col("iter") == self.budget, alive & F.col("moving"))), F.lit(False)) & F.lit(not golden.cut)
        runs = steps.groupBy("trial").agg(F.coalesce(F.max("fired"), F.lit(False)).cast("int").alias("fi_flag"), F.coalesce(end, F.lit(0)).alias("supersteps"), late.alias("late"))
        self.runs = stored(runs)

    def whole(self, trials: DataFrame) -> DataFrame:
        """trial, v and columns of every vertex, for the trials given (a column)."""
        a, golden = self.golden.app, self.golden
        rows = trials.crossJoin(golden.state.select("v", *[F.col(c).alias(f"g_{c}") for c in a.columns]))
        own = self.final.select("trial", "v", *[F.col(c).alias(f"t_{c}") for c in a.columns], F.lit(True).alias("mine"))
        rows = rows.join(own, ["trial", "v"], "left")
        return rows.select("trial", "v", *[F.when(F.col("mine"), F.col(f"t_{c}")).otherwise(F.col(f"g_{c}")).alias(c) for c in a.columns])


class LocalGolden(Golden):
    """A clean run in the memory of one task: what a campaign needs of it, without the states between."""

    def __init__(self, a: App, rows: DataFrame, key: tuple[str, str], most: int = MOST) -> None:
        self.app, self.spark, self.rows, self.key = a, rows.sparkSession, rows, key
        kind = rows.schema["src"].dataType.simpleString()
        schema = StructType.fromDDL(f"iter int, v {kind}, x {rows.schema['x'].dataType.simpleString()}, changed boolean, active boolean, final boolean")
        run = stored(rows.repartition(1).mapInArrow(local.golden_run(key, most, to_arrow_schema(schema)), schema))
        self.active, end = run.filter("NOT final").select("iter", "v"), run.filter("final")
        self.state = end.select("v", F.col("x").alias(key[1]), "changed", "active")
        self.steps = (end.select("iter").head() or [0])[0]
        self.cut = self.steps == most

    def drop(self) -> None:
        pass  # everything is stored


class LocalInjected(Injected):
    """The trials of a plan, a part of them in each task, with `final` and `runs` as Injected has them."""

    def __init__(self, golden: LocalGolden, plan: DataFrame, patience: int = 2) -> None:
        self.golden, self.budget = golden, golden.steps if golden.cut else patience * golden.steps
        kind, x = golden.rows.schema["src"].dataType.simpleString(), golden.rows.schema["x"].dataType.simpleString()
        plan = plan.select("trial", F.col("iter").cast("int").alias("iter"), F.col("vertex").cast(kind).alias("src"), F.col("bit").cast("int").alias("bit"), "kernel", "register")
        slices = max(1, min(4 * golden.spark.sparkContext.defaultParallelism, plan.select("trial").distinct().count()))
        every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        order = F.dense_rank().over(Window.orderBy("trial"))  # the plan is a list of trials, no table of vertices
        dealt = golden.rows.withColumn("part", every).unionByName(plan.withColumn("part", F.pmod(order, F.lit(slices)).cast("int")), allowMissingColumns=True)
        schema = StructType.fromDDL(f"trial long, v {kind}, x {x}, changed boolean, supersteps int, fired boolean, late boolean")
        run = local.injected_runs(golden.key, golden.steps, self.budget, golden.cut, to_arrow_schema(schema))
        rows = stored(dealt.repartition(slices, "part").sortWithinPartitions("part").mapInArrow(run, schema))
        self.final = rows.filter("v IS NOT NULL").select("trial", "v", F.col("x").alias(golden.key[1]), "changed")
        self.runs = rows.filter("v IS NULL").select("trial", F.col("fired").cast("int").alias("fi_flag"), "supersteps", "late")


def local_rows(a: App, edges: DataFrame) -> DataFrame | None:
    """The graph of a program as `local` takes it: src, dst and share of each edge; src, x and held of each vertex with its
    value at the start. None where a task should not hold it, or cannot: HITS, and vertices that are no whole numbers."""
    if (a.name, *a.columns) not in local.FORMS or not {edges.schema[c].dataType.simpleString() for c in ("src", "dst")} <= set(alg.NUMBERS):
        return None
    own = stored(edges)
    vs = stored(vertices(own))
    if own.limit(alg.LOCAL + 1).count() + vs.limit(alg.LOCAL + 1).count() > alg.LOCAL or not vs.filter("v IS NULL").isEmpty():
        return None
    along = edges_of(a, own)
    along = along.select("src", "dst", *([F.col("part").alias("share")] if "part" in along.columns else [F.lit(0.0).alias("share")]))
    start = vs.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.expr(a.start[a.columns[0]]).alias("x"), F.expr(f"coalesce({a.held}, false)").alias("held"))
    return stored(along.unionByName(start, allowMissingColumns=True).withColumn("part", F.lit(0)))


def value_metrics(runs: Injected) -> DataFrame:
    """trial, metric1 (differing values), metric2 (relative L2 in doubles, null if the golden values are all zero)."""
    a, golden = runs.golden.app, runs.golden
    x, y = F.col("x").cast("double"), F.col(a.result).cast("double")
    clean = golden.state.select("v", F.col(a.result).alias("x"))
    norm = clean.agg(F.nullif(F.sqrt(F.sum(x * x)), F.lit(0.0)).alias("norm"))
    rows = runs.final.join(clean, "v").groupBy("trial").agg(F.count_if(F.col("x") != F.col(a.result)).alias("metric1"), F.sqrt(F.sum((x - y) ** 2)).alias("off"))
    return rows.crossJoin(F.broadcast(norm)).select("trial", "metric1", (F.col("off") / F.col("norm")).alias("metric2"))  # one row


def rank_metrics(runs: Injected, digits: int = 6) -> DataFrame:
    """trial, metric1 (positions whose vertex differs), metric2 (the first of them, 0 if none) of the rankings by score, which
    are rounded so that sums in another order rank alike. Trials without a differing score have no row."""
    a, golden = runs.golden.app, runs.golden
    score = F.round(F.expr(a.result), digits).alias("score")
    clean = golden.state.select("v", score)
    moved = runs.final.select("trial", "v", score).join(clean.withColumnRenamed("score", "clean"), "v").filter(~F.col("score").eqNullSafe(F.col("clean")))
    own = ranked(runs.whole(moved.select("trial").distinct()).select("trial", "v", score), "score", ("trial",))
    both = own.join(ranked(clean, "score").withColumnRenamed("v", "clean"), "pos")
    differs = F.col("v") != F.col("clean")
    return both.groupBy("trial").agg(F.count_if(differs).alias("metric1"), F.coalesce(F.min(F.when(differs, F.col("pos"))), F.lit(0)).cast("double").alias("metric2"))


def classified(runs: Injected) -> DataFrame:
    """trial, supersteps, fi_flag, outcome, metric1, metric2.

    Late: DUE, with 2147483647 for both metrics, 0 in a ranking program; nothing differs: Masked with zeros; else SDC.
    """
    ranking = runs.golden.app.ranking
    rows = runs.runs.join(rank_metrics(runs) if ranking else value_metrics(runs), "trial", "left").fillna({"metric1": 0, "metric2": 0.0})
    due = 0 if ranking else INF
    outcome = F.when(F.col("late"), "DUE").when(F.col("metric1") == 0, "Masked").otherwise("SDC")
    metrics = [F.when(F.col("late"), F.lit(due)).otherwise(F.col(m)).cast(t).alias(m) for m, t in (("metric1", "long"), ("metric2", "double"))]
    return rows.select("trial", "supersteps", "fi_flag", outcome.alias("outcome"), *metrics)


def campaign(a: App, edges: DataFrame, n: int, most: int = MOST, patience: int = 2) -> DataFrame:
    """The 19 fields of the log of n trials: golden run, draws, injected runs, comparison."""
    rows = local_rows(a, edges)
    golden = Golden(a, edges, most) if rows is None else LocalGolden(a, rows, (a.name, *a.columns), most)
    try:
        plan = stored(trials(a, golden.trace(), n))
        runs = (Injected if rows is None else LocalInjected)(golden, plan, patience)
        return stored(plan.join(classified(runs), "trial"))
    finally:
        golden.drop()


def log_lines(records: DataFrame) -> DataFrame:
    """value: a line of the trial log for each record. A run that ended late wrote neither its supersteps nor its flag, so
    its line has 17 fields instead of 19."""
    head = [c for c in records.columns if c not in ("supersteps", "fi_flag", "outcome", "metric1", "metric2")]
    own = F.when(F.col("outcome") == "DUE", F.lit("")).otherwise(F.concat_ws(",", F.lit(""), "supersteps", "fi_flag"))
    # positions are whole numbers
    second = F.when(F.col("metric2") == F.floor("metric2"), F.col("metric2").cast("long").cast("string")).otherwise(F.col("metric2").cast("string"))
    return records.select(F.concat(F.concat_ws(",", *head), own, F.lit(","), F.concat_ws(",", "outcome", F.col("metric1"), second)).alias("value"))


def write_log(records: DataFrame, path: str) -> None:
    """Appends the records to a log folder that parsed_log reads back."""
    log_lines(records).write.mode("append").text(path)
