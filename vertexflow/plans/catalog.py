"""The named queries over graphs and trial logs that the tables hold, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare
from ..operators import algorithms as alg
from ..operators import campaign as camp
from ..operators import resilience as res
from ..operators import topology as top
from ..sources import graphs
from ..sources.graphs import SQL
from .storage import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]

#: Supersteps that the SQL unrolls: more than the queries' graphs need at the scale of the check. Beyond the last active
#: vertex a superstep changes nothing.
UNROLL, HITS_STEPS = 26, 8
#: Trials that are drawn, and those that are injected (in each program of the campaign over all four).
TRIALS, INJECTED, EACH = 1000, 24, 12

CHAIN, CUT, FLOW, NATION, PARTS = "order_chain", "order_chain_cut", "purchase_flow", "nation_trade", "part_supplier"


def graph(name: str, made: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: made(graphs.derived(spark, sf_dir, name))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


#: A trial log made from the events, one line for each; both engines read this text.
LOG = """SELECT concat_ws(',', event_id, CASE event_id % 4 WHEN 0 THEN 'HITS' WHEN 1 THEN 'PageRank' WHEN 2 THEN 'SSSP' ELSE 'SCC' END,
 CASE (event_id * 7) % 3 WHEN 0 THEN 'gather' WHEN 1 THEN 'apply' ELSE 'scatter' END, 1 + (event_id * 5) % 9,
 user_id % 40 + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END, user_id % 40 + 1, event_id % 32, 'ff', event_id % 500, 'add.s32', 32, 's32', 'r1', 0,
 CASE WHEN event_id % 17 = 0 THEN 'DUE' ELSE concat_ws(',', 20, CASE event_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 2147483647 ELSE 1 END,
  CASE (event_id * 13) % 5 WHEN 0 THEN 'DUE' WHEN 1 THEN 'SDC' WHEN 2 THEN 'SDC' ELSE 'Masked' END) END,
 event_id % 97, (event_id * 3) % 120) AS value FROM events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: An assembly listing made from the events, one line for each; both engines read this text.
LISTING = """SELECT CAST(event_id AS INT) AS line, CASE event_id % 10 WHEN 0 THEN '// note' WHEN 1 THEN '.reg .f32 %f<4>;'
 WHEN 2 THEN concat('  add.s32  %r', CAST(user_id % 7 AS STRING), ', %r1, %r2;') WHEN 3 THEN 'mul.wide.s32 %rd4, %r1, 4;' WHEN 4 THEN 'setp.ge.s32 %p1, %r1, %r2;'
 WHEN 5 THEN '@%p1 bra BB0_2;' WHEN 6 THEN 'cvt.rn.f64.s32 %fd5, %r3;' WHEN 7 THEN 'st.global.u32 [%rd1], %r2;' WHEN 8 THEN 'BB0_2:' ELSE 'mov.u16 %rs3, 1;' END AS value FROM events"""
KERNELS = [(0, 2999, "gather"), (3000, 5999, "apply"), (6000, 8999, "scatter")]


def listing(made: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.sql(LISTING.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
        return made(res.instructions(lines))

    return query


def _attributed(sites: DataFrame) -> DataFrame:
    kernels = sites.sparkSession.createDataFrame(KERNELS, "lo int, hi int, kernel string")
    return res.in_ranges(sites.select("line"), kernels, "kernel")


def _through_file(edges: DataFrame, undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of the graph, written as coordinate text and read again."""
    spark = edges.sparkSession
    path = new_path(spark, "graph")
    graphs.write_mtx(edges, graphs.vertices(edges).agg(F.max("v")).head()[0] or 0, path)
    return graphs.read_mtx(spark, path, undirected)


def _last_frontier(trace: DataFrame) -> DataFrame:
    last = trace.agg(F.max("iter").alias("iter"))
    return trace.join(F.broadcast(last), "iter").select("iter", "vertex")  # one row


def log(made: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: made(_log(spark, sf_dir))


def _counted(lines: DataFrame) -> DataFrame:
    return res.tolerant(res.flagged(res.parsed_log(lines)[0]))


def _mismatch(edges: DataFrame) -> DataFrame:
    """Distances over the whole graph against those over the part without every third edge."""
    edges = stored(edges)
    vs = stored(graphs.vertices(edges))
    whole, part = alg.sssp(edges)[0], alg.sssp(edges.filter((F.col("src") + F.col("dst")) % 3 != 0), vs, alg.least_vertex(vs))[0]
    return compare.mismatches(whole, part, "v", "dist")


def _label_mismatch(edges: DataFrame) -> DataFrame:
    """Labels of strong components against those of weak ones."""
    edges = stored(edges)
    return compare.mismatches(alg.scc(edges), alg.components(edges), "v", "label")


def _two_ranks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = stored(edges)
    return alg.pagerank(edges)[0], alg.pagerank(edges, most=3)[0]


def _rel_l2(edges: DataFrame) -> DataFrame:
    return rounded(compare.relative_l2(*_two_ranks(edges), "v", "rank"), "rel_l2")


def _hits_l2(edges: DataFrame) -> DataFrame:
    """For each of the two scores, how far the frontier form lies from the dense one."""
    edges = stored(edges)
    dense, frontier = alg.hits(edges, dense=True)[0], alg.hits(edges, most=HITS_STEPS)[0]
    parts = [compare.relative_l2(dense, frontier, "v", c).select(F.lit(c).alias("score"), "rel_l2") for c in ("authority", "hub")]
    return rounded(parts[0].union(parts[1]), "rel_l2")


def _stable(scores: DataFrame, c: str) -> DataFrame:
    """Scores rounded, so that sums in another order rank alike."""
    return scores.select("v", F.round(c, 6).alias(c))


def _rank_metrics(edges: DataFrame) -> DataFrame:
    a, b = (compare.ranked(_stable(x, "rank"), "rank") for x in _two_ranks(edges))
    return res.rank_metrics(a, b)


def _app(name: str, edges: DataFrame) -> camp.App:
    return camp.app(name, alg.least_vertex(graphs.vertices(edges)) if name == "SSSP" else None)


def _records(edges: DataFrame) -> DataFrame:
    """TRIALS records of SSSP."""
    edges = stored(edges)
    golden = camp.Golden(_app("SSSP", edges), edges)
    return camp.trials(golden.app, golden.trace(), TRIALS)


def _injected(name: str, edges: DataFrame, n: int = INJECTED) -> camp.Injected:
    edges = stored(edges)
    golden = camp.Golden(_app(name, edges), edges)
    return camp.Injected(golden, camp.trials(golden.app, golden.trace(), n))


def _inject(edges: DataFrame) -> DataFrame:
    runs = _injected("SSSP", edges)
    sums = runs.whole(runs.runs.select("trial")).groupBy("trial").agg(F.sum(F.col("d").cast("long")).alias("sum_d"))
    return runs.runs.join(sums, "trial").select("trial", "fi_flag", "supersteps", "late", "sum_d")


def _classify(edges: DataFrame) -> DataFrame:
    return rounded(camp.classified(_injected("SSSP", edges)).drop("supersteps"), "metric2")


def _float_inject(edges: DataFrame) -> DataFrame:
    return camp.classified(_injected("PageRank", edges, EACH))


def _campaign(edges: DataFrame) -> DataFrame:
    """The records of EACH trials of each program; HITS, which need not settle, runs HITS_STEPS supersteps."""
    edges = stored(edges)
    parts = [camp.campaign(_app(n, edges), edges, EACH, HITS_STEPS if n == "HITS" else alg.MOST) for n in ("SSSP", "PageRank", "HITS", "SCC")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, "metric2")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 32).cast("int").alias("bit"))
    value = (F.col("o_orderkey") % 100000).cast("int")
    return bits.select("o_orderkey", "bit", compare.mask(F.col("bit")).alias("mask"), compare.flip_int(value, F.col("bit")).cast("long").alias("flipped"))


def _listed(groups: DataFrame) -> DataFrame:
    return groups.select("number", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


def _similar(edges: DataFrame) -> DataFrame:
    return top.similar_pairs(edges, 0.2)


def _score(edges: DataFrame) -> DataFrame:
    return rounded(alg.hits_score(alg.hits(edges, most=HITS_STEPS)[0]), "score")


def _trace(algorithm: Callable[..., tuple[DataFrame, int]], **kw: object) -> Callable[[DataFrame], DataFrame]:
    return lambda edges: alg.traced(stored(edges), algorithm, **kw)


def _supersteps(edges: DataFrame) -> DataFrame:
    """How many supersteps two programs make."""
    edges = stored(edges)
    done = {"SSSP": alg.sssp(edges)[1], "PageRank": alg.pagerank(edges)[1]}
    return edges.sparkSession.createDataFrame(list(done.items()), "program string, supersteps int")


#: Loops of the listing above, one within another.
LOOPS = [(100, 899, "%r7"), (300, 499, "%r9"), (4000, 4999, "%r5")]


def _looped(sites: DataFrame) -> DataFrame:
    spark = sites.sparkSession
    return res.loops(sites.select("line"), spark.createDataFrame(LOOPS, "lo int, hi int, loop_register string"))


def _picked(sites: DataFrame) -> DataFrame:
    """Site, loop membership and loop trip of TRIALS trials."""
    picked = res.picked_sites(sites.sparkSession.range(1, TRIALS + 1).withColumnRenamed("id", "trial"), sites)
    looped = _looped(sites).drop("loop_register")
    return picked.join(looped, "line").select("trial", "line", res.loop_trip(F.col("trial"), F.col("in_loop"), 10).alias("loop"))


def _through_tsv(lines: DataFrame) -> DataFrame:
    """The roll-up by kernel and iteration, written as text and read again."""
    spark, path = lines.sparkSession, new_path(lines.sparkSession, "rollups")
    folder = next(p for p in res.write_tsvs(_counted(lines), path) if p.endswith("/kernel_iter"))
    schema = "kernel string, iter int, masked long, sdc long, due long, total long, masked_ratio double, sdc_ratio double, due_ratio double"
    return rounded(spark.read.option("sep", "\t").option("header", True).schema(schema).csv(folder), "masked_ratio", "sdc_ratio", "due_ratio")


QUERIES: dict[str, Query] = {
    "a4_sssp": graph(CHAIN, lambda e: alg.sssp(e)[0]),
    "s1_edges": graph(CHAIN, lambda e: e),
    "s1_read_mtx": graph(CHAIN, lambda e: _through_file(e)[0]),
    "s2_read_undirected": graph(CHAIN, lambda e: _through_file(e, True)[0]),
    "s9_header_vertices": graph(CHAIN, lambda e: _through_file(e)[1]),
    "s13_last_frontier": graph(CHAIN, lambda e: _last_frontier(_trace(alg.sssp)(e))),
    "f1_instructions": listing(lambda x: x),
    "f3_decode": listing(res.decoded),
    "f11_kernel": listing(_attributed),
    "f10_loops": listing(_looped),
    "f2_sites": listing(_picked),
    "s1_nation_trade": graph(NATION, lambda e: e),
    "s1_purchase_flow": graph(FLOW, lambda e: e),
    "s2_symmetrise": graph(PARTS, lambda e: e),
    "s4_csr_offsets": graph(CHAIN, lambda e: graphs.offsets(e).drop("neighbours")),
    "s5_csc_offsets": graph(CHAIN, lambda e: graphs.offsets(e, "dst").drop("neighbours")),
    "s7_adjacency": graph(NATION, lambda e: graphs.offsets(e).select("v", F.concat_ws(",", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"))),
    "s8_simple_edges": graph(PARTS, graphs.simple),
    "g7_degree": graph(FLOW, graphs.degrees),
    "s12_sssp_trace": graph(CHAIN, _trace(alg.sssp)),
    "s12_hits_trace": graph(FLOW, _trace(alg.hits, most=HITS_STEPS)),
    "s12_scc_trace": graph(CUT, _trace(alg.scc_frontier)),
    "g6_supersteps": graph(CHAIN, _supersteps),
    "s6_ordered_edges": graph(CHAIN, lambda e: graphs.ordered(_through_file(e)[0])),
    "s10_ranked_file": graph(CHAIN, lambda e: graphs.read_numbered(e.sparkSession, graphs.write_numbered(compare.ranked(_stable(alg.pagerank(e)[0], "rank"), "rank"), "pos", "v"))),
    "s11_values_file": graph(CHAIN, lambda e: graphs.read_numbered(e.sparkSession, graphs.write_numbered(alg.sssp(e)[0], "v", "dist"))),
    "s16_coefficient_file": graph(FLOW, lambda e: rounded(top.read_coefficients(e.sparkSession, top.write_coefficients(top.coefficients(e))), "cc")),
    "a11_pagerank": graph(CHAIN, lambda e: rounded(alg.pagerank(e)[0], "rank")),
    "s10_pagerank_order": graph(CHAIN, lambda e: compare.ranked(_stable(alg.pagerank(e)[0], "rank"), "rank")),
    "a20_hits_dense": graph(FLOW, lambda e: rounded(alg.hits(e, dense=True)[0], "authority", "hub")),
    "a19_hits_frontier": graph(FLOW, lambda e: rounded(alg.hits(e, most=HITS_STEPS)[0], "authority", "hub")),
    "a21_hits_score": graph(FLOW, _score),
    "a21_hits_order": graph(FLOW, lambda e: compare.ranked(_score(e), "score")),
    "a22_hits_rel_l2": graph(FLOW, _hits_l2),
    "a24_scc_frontier": graph(CUT, lambda e: alg.scc_frontier(e)[0]),
    "a31_scc_mismatch": graph(CUT, _label_mismatch),
    "a23_reach": graph(CUT, alg.reach),
    "a27_scc": graph(CUT, alg.scc),
    "a30_scc_count": graph(CHAIN, lambda e: alg.scc(e).agg(F.count_distinct("label").alias("components"))),
    "p1_cc_in": graph(FLOW, lambda e: rounded(top.coefficients(e).select("v", "cc_in"), "cc_in")),
    "p2_cc_out": graph(FLOW, lambda e: rounded(top.coefficients(e).select("v", "cc_out"), "cc_out")),
    "p3_cc": graph(FLOW, lambda e: rounded(top.coefficients(e).select("v", "cc"), "cc")),
    "p5_subsets": graph(FLOW, lambda e: top.high_clustering_subsets(e, 0.1)),
    "s17_numbered_subsets": graph(FLOW, lambda e: _listed(top.numbered(top.subset_members(top.high_clustering_subsets(e, 0.1))))),
    "p6_jaccard": graph(NATION, _similar),
    "p7_components": graph(PARTS, alg.components),
    "p8_groups": graph(NATION, lambda e: top.similarity_groups(_similar(e))),
    "p10_cover": graph(NATION, lambda e: top.group_cover(_similar(e))),
    "a7_mismatch": graph(CHAIN, _mismatch),
    "a13_rel_l2": graph(CHAIN, _rel_l2),
    "f5_mask": _masks,
    "f9_trial_draws": graph(CHAIN, lambda e: _records(e).select("trial", "iter", "vertex", "bit", "mask", F.col("kernel").alias("phase"))),
    "f13_trial_records": graph(CHAIN, _records),
    "f12_sssp_inject": graph(CHAIN, _inject),
    "f12_float_inject": graph(CHAIN, _float_inject),
    "f16_campaign": graph(CHAIN, _campaign),
    "f19_classify": graph(CHAIN, _classify),
    "f21_rank_metrics": graph(CHAIN, _rank_metrics),
    "r1_admission": log(lambda x: res.parsed_log(x)[0]),
    "r1_rejects": log(lambda x: res.parsed_log(x)[1]),
    "r2_flag": log(lambda x: res.flagged(res.parsed_log(x)[0]).select("trial", "outcome")),
    "r3_topk": log(lambda x: _counted(x).select("trial", "outcome")),
    **{f"r{4 + i}_{'_'.join(k)}": log(lambda x, k=k: res.rollup(_counted(x), k)) for i, k in enumerate(res.LEVELS)},
    "r11_ratios": log(lambda x: rounded(res.ratios(res.rollup(_counted(x), ("app",))), "masked_ratio", "sdc_ratio", "due_ratio")),
    "r12_all_levels": log(lambda x: res.all_rollups(_counted(x))),
    "r13_tsv": log(_through_tsv),
}


def _with(name: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}e AS MATERIALIZED ({SQL[name]}), vs AS MATERIALIZED (SELECT src AS v FROM e UNION SELECT dst FROM e){body}"


def _hit(i: int, changed: str, near: str = "src", far: str = "dst", a: str = "a") -> str:
    return f"SELECT e.{far} AS v FROM e JOIN {a}{i} x ON x.v = e.{near} WHERE x.{changed}"


def _sssp_steps(k: int, edges: str = "e", p: str = "") -> str:
    """CTEs {p}s0 to {p}s{k} of the frontier form."""
    out = f", {p}s0 AS MATERIALIZED (SELECT v, CASE WHEN v = (SELECT min(v) FROM vs) THEN 0 ELSE 2147483647 END AS d, true AS active FROM vs)"
    for i in range(1, k + 1):
        out += f""",
{p}g{i} AS (SELECT x.dst AS v, min(d) + 1 AS g FROM {edges} x JOIN {p}s{i - 1} s ON s.v = x.src WHERE d < 2147483647 GROUP BY x.dst),
{p}a{i} AS MATERIALIZED (SELECT s.v, CASE WHEN active AND s.v <> (SELECT min(v) FROM vs) THEN least(d, coalesce(g, 2147483647)) ELSE d END AS d,
  active AND s.v <> (SELECT min(v) FROM vs) AND coalesce(g, 2147483647) < d AS changed FROM {p}s{i - 1} s LEFT JOIN {p}g{i} g ON g.v = s.v),
{p}s{i} AS MATERIALIZED (SELECT v, d, v IN (SELECT x.dst FROM {edges} x JOIN {p}a{i} y ON y.v = x.src WHERE y.changed) AS active FROM {p}a{i})"""
    return out


def _pagerank_steps(k: int) -> str:
    out = ", od AS (SELECT src, count(*) AS n FROM e GROUP BY src), s0 AS MATERIALIZED (SELECT v, 0.15::DOUBLE AS rank, true AS active FROM vs)"
    for i in range(1, k + 1):
        out += f""",
g{i} AS (SELECT e.dst AS v, sum(rank / n) AS g FROM e JOIN od ON od.src = e.src JOIN s{i - 1} s ON s.v = e.src GROUP BY e.dst),
a{i} AS MATERIALIZED (SELECT s.v, rank AS old, CASE WHEN active THEN 0.15::DOUBLE + 0.85::DOUBLE * coalesce(g, 0) ELSE rank END AS rank FROM s{i - 1} s LEFT JOIN g{i} g ON g.v = s.v),
s{i} AS MATERIALIZED (SELECT v, rank, v IN (SELECT e.dst FROM e JOIN a{i} x ON x.v = e.src WHERE abs(x.rank - x.old) >= 0.01) AS active FROM a{i})"""
    return out


def _hits_steps(k: int, dense: bool, p: str = "") -> str:
    out = f", {p}s0 AS MATERIALIZED (SELECT v, 1::DOUBLE AS a, 1::DOUBLE AS h, 1::DOUBLE AS av, 1::DOUBLE AS hv, true AS active FROM vs)"
    for i in range(1, k + 1):
        over = "(SELECT max(abs(na - a) > 0.01 OR abs(nh - h) > 0.01) FROM {p}a{i})" if dense else ""
        go = over.format(i=i, p=p) if dense else (
            f"(v IN (SELECT e.src FROM e JOIN {p}a{i} x ON x.v = e.dst WHERE abs(x.na - x.a) >= 0.01) OR v IN (SELECT e.dst FROM e JOIN {p}a{i} x ON x.v = e.src WHERE abs(x.nh - x.h) >= 0.01))"
        )
        out += f""",
{p}ga{i} AS (SELECT e.dst AS v, sum(h) AS g FROM e JOIN {p}s{i - 1} s ON s.v = e.src GROUP BY e.dst),
{p}gh{i} AS (SELECT e.src AS v, sum(a) AS g FROM e JOIN {p}s{i - 1} s ON s.v = e.dst GROUP BY e.src),
{p}w{i} AS MATERIALIZED (SELECT s.v, a, h, active, CASE WHEN active THEN coalesce(x.g, 0) ELSE av END AS av, CASE WHEN active THEN coalesce(y.g, 0) ELSE hv END AS hv
  FROM {p}s{i - 1} s LEFT JOIN {p}ga{i} x ON x.v = s.v LEFT JOIN {p}gh{i} y ON y.v = s.v),
{p}n{i} AS (SELECT v, a, h, active, av / nullif((SELECT sqrt(sum(av * av)) FROM {p}w{i}), 0) AS av, hv / nullif((SELECT sqrt(sum(hv * hv)) FROM {p}w{i}), 0) AS hv FROM {p}w{i}),
{p}a{i} AS MATERIALIZED (SELECT *, CASE WHEN active THEN av ELSE a END AS na, CASE WHEN active THEN hv ELSE h END AS nh FROM {p}n{i}),
{p}s{i} AS MATERIALIZED (SELECT v, na AS a, nh AS h, av, hv, {go} AS active FROM {p}a{i})"""
    return out


_CC = """, f AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), d AS (SELECT v, count(*) FILTER (s) AS k_out, count(*) FILTER (NOT s) AS k_in
 FROM (SELECT src AS v, true AS s FROM f UNION ALL SELECT dst, false FROM f) GROUP BY v),
ti AS (SELECT a.dst AS v, count(*) AS n FROM f a JOIN f b ON a.dst = b.dst JOIN f c ON c.src = a.src AND c.dst = b.src GROUP BY a.dst),
tu AS (SELECT a.src AS v, count(*) AS n FROM f a JOIN f b ON a.src = b.src JOIN f c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
cc AS MATERIALIZED (SELECT d.v, CASE WHEN k_in >= 2 THEN coalesce(ti.n, 0) / (k_in * (k_in - 1)) ELSE 0.0 END AS cc_in,
 CASE WHEN k_out >= 2 THEN coalesce(tu.n, 0) / (k_out * (k_out - 1)) ELSE 0.0 END AS cc_out FROM d LEFT JOIN ti ON ti.v = d.v LEFT JOIN tu ON tu.v = d.v)"""
_TRACE = "tr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS iter, v AS vertex FROM s{i - 1} WHERE active" for i in range(1, UNROLL + 1)) + ")"
_HITS_TRACE = " UNION ALL ".join(f"SELECT {i} AS iter, v AS vertex FROM s{i - 1} WHERE active" for i in range(1, HITS_STEPS + 1))
_SUBSETS = """, hi AS (SELECT v FROM cc WHERE (cc_in + cc_out) / 2 >= 0.1),
 ie AS (SELECT src, dst FROM f WHERE src IN (FROM hi) AND dst IN (FROM hi)), be AS (SELECT src, dst FROM ie UNION SELECT dst, src FROM ie),
 rr AS (SELECT DISTINCT src AS a, src AS b FROM be UNION SELECT a, dst FROM rr JOIN be ON be.src = rr.b)"""


def _draw(salt: int, n: str) -> str:
    return f"(('0x' || substr(md5(trial::VARCHAR || ':{salt}'), 1, 12))::BIGINT % ({n}))"


_MASK = "(CASE WHEN bit = 31 THEN (-2147483648)::INT ELSE (1::BIGINT << bit)::INT END)"
_FLIP = {"f32": f"xor({{x}}::FLOAT::BIT, {_MASK}::BIT)::FLOAT::DOUBLE", "s32": f"xor(({{x}})::INT, {_MASK})::BIGINT"}
#: For each program: start of the columns; sender's value, aggregate, column, near and far end and flag of each way; new values;
#: flags; when a vertex is active; result.
_GRAVITY = {
    "SSSP": ({"d": "CASE WHEN v = (SELECT min(v) FROM vs) THEN 0 ELSE 2147483647 END::BIGINT"}, [("CASE WHEN d < 2147483647 THEN d + 1 END", "min", "g", "src", "dst", "changed")],
        {"d": "CASE WHEN v = (SELECT min(v) FROM vs) THEN d ELSE least(d, coalesce(g, 2147483647)) END"}, {"changed": "new_d <> d"}, "hit", "d"),
    "PageRank": ({"rank": "0.15::DOUBLE"}, [("rank / fan", "sum", "phi", "src", "dst", "changed")], {"rank": "0.15::DOUBLE + 0.85::DOUBLE * coalesce(phi, 0)"},
        {"changed": "abs(new_rank - rank) >= 0.01 AND NOT isnan(new_rank - rank)"}, "hit", "rank"),
    "HITS": (dict.fromkeys(("a", "h", "av", "hv"), "1::DOUBLE"), [("h", "sum", "ga", "src", "dst", "ch"), ("a", "sum", "gh", "dst", "src", "ca")], {"av": "coalesce(ga, 0)", "hv": "coalesce(gh, 0)"},
        {c: f"abs(new_{c[1]} - {c[1]}) >= 0.01 AND NOT isnan(new_{c[1]} - {c[1]})" for c in ("ca", "ch")}, "hit", "0.7::DOUBLE * a + 0.3::DOUBLE * h"),
    "SCC": ({"label": "v"}, [("label", "min", "g", "src", "dst", "changed")], {"label": "least(label, coalesce(g, label))"}, {"changed": "new_label < label"}, "hit AND low < label", "label"),
}


def _run(n: str, name: str, edges: str, runs: str, plan: str, limit: str) -> str:
    """CTE `n`: k, trial, v, columns, flags, active, fired after each superstep of the trials in `runs`, `limit` at most; plan
    has trial, iter, vertex, bit, kernel, register."""
    start, ways, apply, flags, active, _ = _GRAVITY[name]
    sites = camp.app(name, 0).sites
    first = ", ".join([*(f"{x} AS {c}" for c, x in start.items()), *(f"true AS {f}" for f in flags)])
    parts = " UNION ALL ".join(
        f"SELECT trial, e.{far} AS v, {flag} AS hit, {x} AS low, " + ", ".join(f"{x if c == into else 'NULL'} AS {c}" for _, _, c, *_ in ways) + f" FROM {n} s JOIN {edges} e ON s.v = e.{near}"
        for x, _, into, near, far, flag in ways
    )
    gathered = ", ".join(f"{how}({c}) AS {c}" for _, how, c, *_ in ways)
    none = {"s32": "2147483647", "f32": "0::DOUBLE"}

    def flipped(kernel: str, name_of: str) -> str:
        own = [s for s in sites if s.kernel == kernel]
        return ", ".join(
            f"CASE WHEN live AND kernel = '{kernel}' AND register = '{s.register}' THEN {_FLIP[s.type].format(x=f'coalesce({name_of.format(s.register)}, {none[s.type]})')} ELSE {name_of.format(s.register)} END AS {name_of.format(s.register)}"
            for s in own
        )

    held = "v = (SELECT min(v) FROM vs)" if name == "SSSP" else "false"
    new = ", ".join(f"CASE WHEN act THEN {x} ELSE {c} END AS new_{c}" for c, x in apply.items())
    norm = ""
    applied = "nw"
    if name == "HITS":
        norm = """nn AS (SELECT trial, sqrt(sum(new_av * new_av)) AS na, sqrt(sum(new_hv * new_hv)) AS nh FROM nw GROUP BY trial),
  nv AS (SELECT nw.* REPLACE (new_av / nullif(na, 0) AS new_av, new_hv / nullif(nh, 0) AS new_hv) FROM nw JOIN nn USING (trial)),
  ns AS (SELECT *, CASE WHEN act THEN new_av ELSE a END AS new_a, CASE WHEN act THEN new_hv ELSE h END AS new_h FROM nv),"""
        applied = "ns"
    moves = ", ".join(f"coalesce({x}, false) AS new_{f}" for f, x in flags.items())
    cut = {f: f"(live AND kernel = 'scatter' AND register = '{f}' AND new_{f})" for f in flags}
    last = ", ".join([*(f"new_{c}" for c in start), *(f"new_{f} AND NOT {c}" for f, c in cut.items())])
    return f"""{n} AS (SELECT 0 AS k, trial, v, {first}, false AS active, false AS fired FROM {runs}, vs
 UNION ALL SELECT * FROM (
  WITH m AS (SELECT trial, v, {gathered}, max(hit) AS hit, min(CASE WHEN hit THEN low END) AS low FROM ({parts}) GROUP BY trial, v),
  ac AS (SELECT s.*, m.hit, m.low, {", ".join(f"m.{c}" for _, _, c, *_ in ways)} FROM {n} s LEFT JOIN m USING (trial, v)),
  ak AS (SELECT *, k = 0 OR coalesce({active}, false) AS act FROM ac),
  pl AS (SELECT ak.*, p.bit, p.kernel, p.register, p.bit IS NOT NULL AND act AND NOT ({held}) AS live FROM ak LEFT JOIN {plan} p ON p.trial = ak.trial AND p.iter = ak.k + 1 AND p.vertex = ak.v),
  ga AS (SELECT * REPLACE ({flipped('gather', '{}')}) FROM pl),
  nw AS (SELECT *, {new} FROM ga),
  {norm}
  ap AS (SELECT * REPLACE ({flipped('apply', 'new_{}')}) FROM {applied}),
  mv AS (SELECT *, {moves} FROM ap)
  SELECT k + 1, trial, v, {last}, act, fired OR (live AND kernel IN ('gather', 'apply')) OR {" OR ".join(cut.values())}
  FROM mv WHERE k < {limit} AND trial IN (SELECT trial FROM ak WHERE act)))"""


def _study(name: str, trials: int, p: str = "x") -> str:
    """CTEs {p}gold, {p}t (the records), {p}inj, {p}last and {p}out (the outcomes) of a program over e."""
    app = camp.app(name, 0)
    edges, result, flags = {"PageRank": "pe", "SCC": "ie"}.get(name, "e"), _GRAVITY[name][5], list(_GRAVITY[name][3])
    cut = name == "HITS"
    sites = ", ".join(f"({s.line}, '{s.kernel}', '{s.opcode}', {s.width}, '{s.type}', '{s.register}', {s.looped})" for s in app.sites)
    budget = str(HITS_STEPS) if cut else f"(SELECT 2 * max(k) FROM {p}gold)"
    score = f"CASE WHEN isnan({{x}}) THEN '-inf'::DOUBLE ELSE round({{x}}, 6) END".format(x=result)
    if app.ranking:
        metrics = f"""{p}rg AS (SELECT v, row_number() OVER (ORDER BY {score} DESC, v) AS pos FROM {p}clean),
{p}ri AS (SELECT trial, v, row_number() OVER (PARTITION BY trial ORDER BY {score} DESC, v) AS pos FROM {p}last),
{p}mt AS (SELECT i.trial, count(*) FILTER (i.v <> g.v) AS n, coalesce(min(pos) FILTER (i.v <> g.v), 0)::DOUBLE AS m FROM {p}ri i JOIN {p}rg g USING (pos) GROUP BY i.trial)"""
    else:
        metrics = f"""{p}mt AS (SELECT i.trial, count(*) FILTER (i.{result} <> c.{result}) AS n, sqrt(sum((c.{result}::DOUBLE - i.{result}) ** 2)) / sqrt(sum(c.{result}::DOUBLE ** 2)) AS m
 FROM {p}last i JOIN {p}clean c USING (v) GROUP BY i.trial)"""
    due = "0" if app.ranking else "2147483647"
    return f""", {_run(f"{p}gold", name, edges, "(SELECT 0::BIGINT AS trial)", _NO_PLAN, str(HITS_STEPS) if cut else "9999")},
{p}clean AS MATERIALIZED (SELECT * FROM {p}gold WHERE k = (SELECT max(k) FROM {p}gold)),
{p}tr AS MATERIALIZED (SELECT k AS iter, v AS vertex FROM {p}gold WHERE active),
{p}t1 AS (SELECT range AS trial FROM range(1, {trials + 1})),
{p}t2 AS (SELECT trial, (1 + {_draw(12345, f"SELECT max(iter) FROM {p}tr")})::INT AS iter, (1 + {_draw(99, str(len(app.sites)))})::INT AS line FROM {p}t1),
{p}t3 AS (SELECT t.*, s.* EXCLUDE (line), {_draw(777, "width")}::INT AS bit, CASE WHEN looped THEN 1 + {_draw(31, str(app.trips))} ELSE 0 END::INT AS loop,
 1 + {_draw(4242, f"SELECT count(*) FROM {p}tr x WHERE x.iter = t.iter")} AS pick FROM {p}t2 t JOIN (VALUES {sites}) s(line, kernel, opcode, width, type, register, looped) USING (line)),
{p}o AS (SELECT iter, vertex, row_number() OVER (PARTITION BY iter ORDER BY vertex) AS pick FROM {p}tr),
{p}t AS MATERIALIZED (SELECT trial, '{name}' AS app, kernel, iter, vertex - 1 AS thread, vertex, bit, printf('%x', 1::BIGINT << bit) AS mask, line, opcode, width, type, register, loop
 FROM {p}t3 JOIN {p}o USING (iter, pick)),
{_run(f"{p}inj", name, edges, f"(SELECT trial FROM {p}t)", f"{p}t", budget)},
{p}end AS (SELECT trial, max(k) AS supersteps FROM {p}inj GROUP BY trial),
{p}last AS MATERIALIZED (SELECT i.*, supersteps FROM {p}inj i JOIN {p}end d ON i.trial = d.trial AND i.k = d.supersteps),
{p}fl AS (SELECT trial, max(fired)::INT AS fi_flag, supersteps, {"false" if cut else f"supersteps = {budget} AND max({' OR '.join(flags)})"} AS late FROM {p}last GROUP BY trial, supersteps),
{metrics},
{p}out AS (SELECT trial, supersteps, fi_flag, CASE WHEN late THEN 'DUE' WHEN n = 0 THEN 'Masked' ELSE 'SDC' END AS outcome, CASE WHEN late THEN {due} ELSE n END::BIGINT AS metric1,
 CASE WHEN late THEN {due} WHEN n = 0 THEN 0 ELSE m END::DOUBLE AS metric2 FROM {p}fl JOIN {p}mt USING (trial))"""


_NO_PLAN = "(SELECT 0 AS trial, 0 AS iter, 0 AS vertex, 0 AS bit, '' AS kernel, '' AS register WHERE false)"
_SHARES = ", pe AS MATERIALIZED (SELECT e.*, fan FROM e JOIN (SELECT src, count(*) AS fan FROM e GROUP BY src) USING (src))"
_REACH = ", r AS (SELECT v AS a, v AS b FROM vs UNION SELECT a, dst FROM r JOIN e ON e.src = r.b)"
_INSIDE = _REACH + """, sc AS MATERIALIZED (SELECT x.a AS v, min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
id AS (SELECT src, dst FROM e JOIN sc a ON a.v = src JOIN sc b ON b.v = dst WHERE a.label = b.label AND src <> dst), ie AS MATERIALIZED (SELECT src, dst FROM id UNION SELECT dst, src FROM id)"""
_LISTED = "SELECT row_number() OVER (ORDER BY members) AS number, array_to_string(members, ',') AS members FROM"
_STEPS_OF = "SELECT '{0}' AS program, max(k)::INT AS supersteps FROM {1}"


_ADMIT = f""", f AS (SELECT value, string_split(value, ',') AS f, len(string_split(value, ',')) AS n FROM ({LOG})),
ok AS (SELECT *, ((n = 19) OR (n = 17 AND f[15] = 'DUE')) AND f[5]::INT = f[6]::INT - 1 AS ok FROM f),
adm AS (SELECT f[1]::INT AS trial, f[2] AS app, f[3] AS kernel, f[4]::INT AS iter, f[5]::INT AS thread, f[6]::INT AS vertex, f[7]::INT AS bit, f[8] AS mask,
 f[9]::INT AS line, f[10] AS opcode, f[11]::INT AS width, f[12] AS type, f[13] AS register, f[14]::INT AS loop, CASE WHEN n = 19 THEN f[15]::INT END AS supersteps,
 CASE WHEN n = 19 THEN f[16]::BIGINT ELSE 1 END AS fi_flag, f[n - 2] AS outcome, f[n - 1]::BIGINT AS metric1, f[n]::DOUBLE AS metric2 FROM ok WHERE ok),
fl AS (SELECT * REPLACE (CASE WHEN fi_flag = 2147483647 THEN 'DUE' ELSE outcome END AS outcome) FROM adm WHERE fi_flag IN (1, 2147483647)),
tk AS (SELECT * REPLACE (CASE WHEN app IN ('HITS', 'PageRank') AND outcome = 'SDC' AND metric2 > 60 THEN 'Masked' ELSE outcome END AS outcome) FROM fl)"""
_LOG = "WITH " + _ADMIT[2:]
_COUNTS = "count(*) FILTER (outcome = 'Masked') AS masked, count(*) FILTER (outcome = 'SDC') AS sdc, count(*) FILTER (outcome = 'DUE') AS due"


def _offsets(by: str) -> str:
    n = f"(SELECT v, count(e.{by}) AS n FROM vs LEFT JOIN e ON e.{by} = v GROUP BY v)"
    return f" SELECT v, coalesce((sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS first, n FROM {n}"


def _rollup(keys: tuple[str, ...]) -> str:
    extra = ", coalesce(sum(metric1) FILTER (outcome = 'SDC'), 0)::BIGINT AS sdc_metric1" if keys == ("vertex",) else ""
    return f"{_LOG} SELECT {', '.join(keys)}, {_COUNTS}{extra} FROM tk GROUP BY {', '.join(keys)}"


_SITES = rf"""WITH s AS (SELECT line, trim(regexp_replace(value, '[\t ]+', ' ', 'g')) AS text FROM ({LISTING})),
k AS (SELECT * FROM s WHERE text <> '' AND NOT regexp_matches(text, '^(//|[.{{}}()@]|ret\b|bra\b|st[.]|[$\w]+:)'))"""
_DECODE = r""", d AS (SELECT line, text, split_part(text, ' ', 1) AS opcode, string_split(split_part(text, ' ', 1), '.') AS p, regexp_extract(text, '%\w+') AS register FROM k),
t AS (SELECT *, CASE WHEN starts_with(opcode, 'cvt') THEN p[-2] ELSE p[-1] END AS type FROM d),
b AS (SELECT *, coalesce(try_cast(regexp_extract(type, '\d+$') AS INT), 32) AS bits FROM t)
SELECT line, text, opcode, type, CASE WHEN starts_with(opcode, 'setp') OR type = 'pred' THEN 1 WHEN regexp_matches(opcode, '^(mul|mad)[.]wide') THEN 2 * bits
 WHEN starts_with(register, '%rs') THEN 16 WHEN starts_with(register, '%rd') THEN 64 ELSE bits END::INT AS width, register FROM b"""
_LEVEL = " ".join(f"WHEN {sum(1 << (3 - i) for i, n in enumerate(('app', 'kernel', 'iter', 'vertex')) if n not in k)} THEN '{'_'.join(k)}'" for k in res.LEVELS)
_RANK = "row_number() OVER (ORDER BY round(rank, 6) DESC, v)"

ORACLES: dict[str, str] = {
    "a4_sssp": _with(CHAIN, _sssp_steps(UNROLL) + f" SELECT v, d AS dist FROM s{UNROLL}"),
    "s1_edges": SQL[CHAIN],
    "s1_read_mtx": f"SELECT src::INT AS src, dst::INT AS dst, 1 AS w FROM ({SQL[CHAIN]})",
    "s2_read_undirected": f"WITH e AS ({SQL[CHAIN]}) SELECT src::INT AS src, dst::INT AS dst, 1 AS w FROM e UNION ALL SELECT dst::INT, src::INT, 1 FROM e",
    "s9_header_vertices": _with(CHAIN, " SELECT range::INT AS v FROM range(1, (SELECT max(v) FROM vs) + 1)"),
    "s13_last_frontier": _with(CHAIN, f"{_sssp_steps(UNROLL)}, {_TRACE} SELECT iter, vertex FROM tr WHERE iter = (SELECT max(iter) FROM tr)"),
    "f1_instructions": f"{_SITES} SELECT line, text FROM k",
    "f3_decode": _SITES + _DECODE,
    "f11_kernel": f"{_SITES} SELECT line, kernel FROM k LEFT JOIN (VALUES {', '.join(map(str, KERNELS))}) r(lo, hi, kernel) ON line BETWEEN lo AND hi",
    "s1_nation_trade": SQL[NATION],
    "s1_purchase_flow": SQL[FLOW],
    "s2_symmetrise": SQL[PARTS],
    "s4_csr_offsets": _with(CHAIN, _offsets("src")),
    "s5_csc_offsets": _with(CHAIN, _offsets("dst")),
    "s7_adjacency": _with(NATION, " SELECT v, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbours FROM vs LEFT JOIN e ON src = v GROUP BY v"),
    "s8_simple_edges": _with(PARTS, " SELECT DISTINCT src, dst FROM e WHERE src <> dst"),
    "g7_degree": _with(FLOW, " SELECT v, (SELECT count(*) FROM e WHERE src = v) AS out_deg, (SELECT count(*) FROM e WHERE dst = v) AS in_deg FROM vs"),
    "s12_sssp_trace": _with(CHAIN, f"{_sssp_steps(UNROLL)}, {_TRACE} SELECT iter, vertex FROM tr"),
    "a11_pagerank": _with(CHAIN, _pagerank_steps(UNROLL) + f" SELECT v, round(rank, 6) AS rank FROM s{UNROLL}"),
    "s10_pagerank_order": _with(CHAIN, _pagerank_steps(UNROLL) + f" SELECT {_RANK} AS pos, v FROM s{UNROLL}"),
    "a20_hits_dense": _with(FLOW, _hits_steps(12, True) + " SELECT v, round(a, 6) AS authority, round(h, 6) AS hub FROM s12"),
    "a19_hits_frontier": _with(FLOW, _hits_steps(HITS_STEPS, False) + f" SELECT v, round(a, 6) AS authority, round(h, 6) AS hub FROM s{HITS_STEPS}"),
    "a21_hits_score": _with(FLOW, _hits_steps(HITS_STEPS, False) + f" SELECT v, round(0.7::DOUBLE * a + 0.3::DOUBLE * h, 6) AS score FROM s{HITS_STEPS}"),
    "a23_reach": _with(CUT, _REACH + " SELECT a, b FROM r", True),
    "a27_scc": _with(CUT, _REACH + " SELECT x.a AS v, min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a", True),
    "a30_scc_count": _with(CHAIN, _REACH + " SELECT count(DISTINCT label) AS components FROM (SELECT min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)", True),
    "p1_cc_in": _with(FLOW, _CC + " SELECT v, round(cc_in, 6) AS cc_in FROM cc"),
    "p2_cc_out": _with(FLOW, _CC + " SELECT v, round(cc_out, 6) AS cc_out FROM cc"),
    "p3_cc": _with(FLOW, _CC + " SELECT v, round((cc_in + cc_out) / 2, 6) AS cc FROM cc"),
    "p5_subsets": _with(FLOW, _CC + _SUBSETS + " SELECT a AS v, min(b) AS subset FROM rr GROUP BY a", True),
    "s17_numbered_subsets": _with(FLOW, _CC + _SUBSETS + f", sb AS (SELECT a AS v, min(b) AS subset FROM rr GROUP BY a) {_LISTED} (SELECT list_sort(list(v)) AS members FROM sb GROUP BY subset)", True),
    "s12_hits_trace": _with(FLOW, _hits_steps(HITS_STEPS, False) + " " + _HITS_TRACE),
    "s12_scc_trace": _with(CUT, _INSIDE + ", " + _run("x", "SCC", "ie", "(SELECT 0::BIGINT AS trial)", _NO_PLAN, "9999") + " SELECT k AS iter, v AS vertex FROM x WHERE active", True),
    "g6_supersteps": _with(CHAIN, _SHARES + "".join(f", {_run(x, n, e, '(SELECT 0::BIGINT AS trial)', _NO_PLAN, '9999')}" for x, n, e in (("xs", "SSSP", "e"), ("xp", "PageRank", "pe")))
        + " " + " UNION ALL ".join(_STEPS_OF.format(n, x) for n, x in (("SSSP", "xs"), ("PageRank", "xp"))), True),
    "s6_ordered_edges": f"WITH e AS ({SQL[CHAIN]}) SELECT row_number() OVER (ORDER BY src, dst) AS pos, src::INT AS src, dst::INT AS dst, 1 AS w FROM e",
    "s10_ranked_file": _with(CHAIN, _pagerank_steps(UNROLL) + f" SELECT {_RANK} AS line, v AS value FROM s{UNROLL}"),
    "s11_values_file": _with(CHAIN, _sssp_steps(UNROLL) + f" SELECT row_number() OVER (ORDER BY v) AS line, d::BIGINT AS value FROM s{UNROLL}"),
    "s16_coefficient_file": _with(FLOW, _CC + " SELECT v, round((cc_in + cc_out) / 2, 6) AS cc FROM cc"),
    "a21_hits_order": _with(FLOW, _hits_steps(HITS_STEPS, False) + f" SELECT row_number() OVER (ORDER BY round(0.7::DOUBLE * a + 0.3::DOUBLE * h, 6) DESC, v) AS pos, v FROM s{HITS_STEPS}"),
    "a22_hits_rel_l2": _with(FLOW, _hits_steps(12, True) + ", d AS MATERIALIZED (SELECT v, a, h FROM s12)" + _hits_steps(HITS_STEPS, False, "f") + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS score, round(sqrt(sum((d.{c} - s.{c}) ** 2)) / sqrt(sum(d.{c} ** 2)), 6) AS rel_l2 FROM d JOIN fs{HITS_STEPS} s USING (v)" for n, c in (("authority", "a"), ("hub", "h")))),
    "a24_scc_frontier": _with(CUT, _INSIDE + " SELECT v, label FROM sc", True),
    "a31_scc_mismatch": _with(CUT, _INSIDE + """, be AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT v AS a, v AS b FROM vs UNION SELECT a, dst FROM w JOIN be ON be.src = w.b),
 wk AS (SELECT a AS v, min(b) AS label FROM w GROUP BY a) SELECT v, sc.label AS expected, wk.label AS found FROM sc JOIN wk USING (v) WHERE sc.label <> wk.label""", True),
    "f2_sites": _SITES + f""", n AS (SELECT list(line ORDER BY line) AS l FROM k), t AS (SELECT range AS trial FROM range(1, {TRIALS + 1})),
d AS (SELECT trial, l[1 + {_draw(99, "len(l)")}] AS line FROM t, n)
SELECT trial, line, CASE WHEN EXISTS (SELECT 1 FROM (VALUES {', '.join(map(str, LOOPS))}) x(lo, hi, r) WHERE line BETWEEN lo AND hi) THEN 1 + {_draw(31, "10")} ELSE 0 END::INT AS loop FROM d""",
    "f10_loops": _SITES + f""" SELECT line, arg_min(r, hi - lo) AS loop_register, count(r) > 0 AS in_loop FROM k LEFT JOIN (VALUES {', '.join(map(str, LOOPS))}) x(lo, hi, r) ON line BETWEEN lo AND hi GROUP BY line""",
    "p6_jaccard": _with(NATION, """, o AS (SELECT src AS v, list_sort(list(dst)) AS l FROM e GROUP BY src), i AS (SELECT dst AS v, list_sort(list(src)) AS l FROM e GROUP BY dst),
 p AS (SELECT a.v AS v1, b.v AS v2, len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))) AS i_, len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) AS o_
 FROM o a JOIN o b ON a.v < b.v JOIN i x ON x.v = a.v JOIN i y ON y.v = b.v) SELECT v1, v2, round(i_, 2) AS sim_in, round(o_, 2) AS sim_out FROM p WHERE i_ >= 0.2 AND o_ >= 0.2"""),
    "p7_components": _with(PARTS, _REACH + " SELECT a AS v, min(b) AS label FROM r GROUP BY a", True),
    "a7_mismatch": _with(CHAIN, ", e2 AS MATERIALIZED (SELECT * FROM e WHERE (src + dst) % 3 <> 0)" + _sssp_steps(UNROLL) + _sssp_steps(UNROLL, "e2", "q")
        + f" SELECT a.v, a.d AS expected, b.d AS found FROM s{UNROLL} a JOIN qs{UNROLL} b USING (v) WHERE a.d <> b.d"),
    "a13_rel_l2": _with(CHAIN, _pagerank_steps(UNROLL) + f" SELECT round(sqrt(sum((a.rank - b.rank) ** 2)) / sqrt(sum(a.rank ** 2)), 6) AS rel_l2 FROM s{UNROLL} a JOIN s3 b USING (v)"),
    "f5_mask": """WITH o AS (SELECT o_orderkey, (o_orderkey % 32)::INT AS bit, o_orderkey % 100000 AS x FROM orders), p AS (SELECT *, xor(x, 1::BIGINT << bit) & 4294967295 AS y FROM o)
SELECT o_orderkey, bit, 1::BIGINT << bit AS mask, CASE WHEN y > 2147483647 THEN y - 4294967296 ELSE y END AS flipped FROM p""",
    "f9_trial_draws": _with(CHAIN, _study("SSSP", TRIALS) + " SELECT trial, iter, vertex, bit, mask, kernel AS phase FROM xt", True),
    "f13_trial_records": _with(CHAIN, _study("SSSP", TRIALS) + " SELECT * FROM xt", True),
    "f12_sssp_inject": _with(CHAIN, _study("SSSP", INJECTED) + " SELECT trial, fi_flag, xfl.supersteps, late, sum(d)::BIGINT AS sum_d FROM xfl JOIN xlast USING (trial) GROUP BY ALL", True),
    "f12_float_inject": _with(CHAIN, _SHARES + _study("PageRank", EACH) + " SELECT * FROM xout", True),
    "f16_campaign": _with(CHAIN, _SHARES + _INSIDE + "".join(_study(n, EACH, n[:2]) for n in _GRAVITY) + " " + " UNION ALL ".join(
        f"SELECT t.*, o.* EXCLUDE (trial) REPLACE (round(metric2, 6) AS metric2) FROM {n[:2]}t t JOIN {n[:2]}out o USING (trial)" for n in _GRAVITY), True),
    "f19_classify": _with(CHAIN, _study("SSSP", INJECTED) + " SELECT trial, fi_flag, outcome, metric1, round(metric2, 6) AS metric2 FROM xout", True),
    "f21_rank_metrics": _with(CHAIN, _pagerank_steps(UNROLL) + f", x AS (SELECT {_RANK} AS pos, v FROM s{UNROLL}), y AS (SELECT {_RANK} AS pos, v FROM s3)"
        " SELECT count(*) FILTER (x.v <> y.v) AS metric1, coalesce(min(pos) FILTER (x.v <> y.v), 0)::BIGINT AS metric2 FROM x JOIN y USING (pos)"),
    "r1_admission": f"{_LOG} SELECT * FROM adm",
    "r1_rejects": f"{_LOG} SELECT value FROM ok WHERE NOT ok",
    "r2_flag": f"{_LOG} SELECT trial, outcome FROM fl",
    "r3_topk": f"{_LOG} SELECT trial, outcome FROM tk",
    **{f"r{4 + i}_{'_'.join(k)}": _rollup(k) for i, k in enumerate(res.LEVELS)},
    "r11_ratios": f"{_LOG}, c AS (SELECT app, {_COUNTS} FROM tk GROUP BY app) SELECT *, masked + sdc + due AS total, "
    + ", ".join(f"round({o} / (masked + sdc + due), 6) AS {o}_ratio" for o in ("masked", "sdc", "due")) + " FROM c",
    "r13_tsv": f"{_LOG}, c AS (SELECT kernel, iter, {_COUNTS} FROM tk GROUP BY kernel, iter) SELECT *, masked + sdc + due AS total, "
    + ", ".join(f"round({o} / (masked + sdc + due), 6) AS {o}_ratio" for o in ("masked", "sdc", "due")) + " FROM c",
    "r12_all_levels": f"{_LOG} SELECT CASE grouping(app, kernel, iter, vertex) {_LEVEL} END AS level, app, kernel, iter, vertex, {_COUNTS} FROM tk GROUP BY GROUPING SETS ("
    + ", ".join(f"({', '.join(k)})" for k in res.LEVELS) + ")",
}
