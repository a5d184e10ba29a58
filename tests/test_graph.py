"""Hand-made graphs, logs and files."""

import math
import random

import pytest
from pyspark.sql import functions as F
from vertexflow.functions import compare
from vertexflow.operators import algorithms as alg
from vertexflow.operators import campaign as camp
from vertexflow.operators import resilience as res
from vertexflow.operators import topology as top
from vertexflow.sources import graphs

CYCLE = [(1, 2), (2, 3), (3, 1), (3, 4)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def table(df):
    return {r[0]: r[1] for r in df.collect()}


def test_cycle_with_tail(spark):
    e = edges(spark, CYCLE)
    dist, _ = alg.sssp(e)
    assert table(dist) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert table(alg.scc(e)) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert table(alg.components(e)) == {1: 1, 2: 1, 3: 1, 4: 1}
    assert alg.reach(e).count() == 13


def test_isolated_and_unreachable(spark):
    e, vs = edges(spark, [(1, 2)]), spark.createDataFrame([(1,), (2,), (3,)], "v long")
    assert table(alg.sssp(e, vs)[0]) == {1: 0, 2: 1, 3: compare.INF}
    assert table(alg.pagerank(e, vs)[0])[3] == pytest.approx(0.15)
    assert table(alg.scc(e, vs)) == {1: 1, 2: 2, 3: 3}


def test_distances_hold_along_edges(spark):
    pairs = [(i % 17 + 1, (i * 7) % 23 + 1) for i in range(60)]
    d = table(alg.sssp(edges(spark, pairs))[0])
    assert all(d[v] <= d[u] + 1 for u, v in pairs if d[u] < compare.INF)


def test_complete_and_star(spark):
    full = edges(spark, [(a, b) for a in range(1, 5) for b in range(1, 5) if a != b])
    assert {r["cc"] for r in top.coefficients(full).collect()} == {1.0}
    star = edges(spark, [(1, b) for b in range(2, 6)])
    assert {r["cc"] for r in top.coefficients(star).collect()} == {0.0}
    assert [r["members"] for r in top.group_cover(top.similar_pairs(full, 0.3)).collect()] == [[1, 2, 3, 4]]


def test_mtx(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("%%comment\n4 4 4\n1 2 \n1 2\n3 3 2.9\n2 1 5\n")
    e, vs = graphs.read_mtx(spark, str(path))
    assert sorted(map(tuple, e.collect())) == [(1, 2, 1), (1, 2, 1), (2, 1, 5), (3, 3, 2)]
    assert vs.count() == 4
    assert graphs.read_mtx(spark, str(path), undirected=True)[0].count() == 8
    assert graphs.simple(e).count() == 2
    graphs.write_mtx(e, 4, str(tmp_path / "folder"))
    again, vs = graphs.read_mtx(spark, str(tmp_path / "folder"))
    assert sorted(map(tuple, again.collect())) == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 3, 1)] and vs.count() == 4
    (tmp_path / "none.mtx").write_text("% nothing\n")
    with pytest.raises(ValueError):
        graphs.read_mtx(spark, str(tmp_path / "none.mtx"))


def test_mtx_in_blocks(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("% c\n900 900 900\n" + "".join(f"{i} {i % 900 + 1}\n" for i in range(1, 901)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 512)
    try:
        e, vs = graphs.read_mtx(spark, str(path))
        assert table(e.select("src", "dst")) == {i: i % 900 + 1 for i in range(1, 901)} and vs.count() == 900
    finally:
        spark.conf.set(key, before)


def test_sites(spark):
    lines = ["// x", "add.s32 %r1, %r2, %r3;", "setp.ge.s32 %p1, %r1, 2;", "mul.wide.s32 %rd4, %r1, 4;", "@%p1 bra L;", "L:", "st.u32 [%rd1], %r2;", "cvt.u16.u32 %rs2, %r1;", "ret;"]
    sites = res.decoded(res.instructions(spark.createDataFrame(list(enumerate(lines)), "line int, value string")))
    assert {r["line"]: (r["width"], r["register"]) for r in sites.collect()} == {1: (32, "%r1"), 2: (1, "%p1"), 3: (64, "%rd4"), 7: (16, "%rs2")}


def test_offsets(spark):
    rows = {r["v"]: (r["first"], r["n"], r["neighbours"]) for r in graphs.offsets(edges(spark, CYCLE)).collect()}
    assert rows == {1: (0, 1, [2]), 2: (1, 1, [3]), 3: (2, 2, [1, 4]), 4: (4, 0, [])}


def test_ranking_puts_nan_last(spark):
    s = spark.createDataFrame([(1, 0.5), (2, math.nan), (3, 0.9), (4, 0.5)], "v long, score double")
    assert table(compare.ranked(s, "score")) == {1: 3, 2: 1, 3: 4, 4: 2}


def test_flips_undo_themselves(spark):
    df = spark.createDataFrame([(5, 31), (2147483647, 0), (-3, 7)], "x int, bit int")
    once = compare.flip_int(F.col("x"), F.col("bit"))
    rows = df.select("x", once.alias("y"), compare.flip_int(once, F.col("bit")).alias("z")).collect()
    assert rows[0]["y"] == -2147483643 and all(r["x"] == r["z"] != r["y"] for r in rows)


def test_log(spark):
    head = "1,HITS,gather,2,4,5,3,8,10,add.s32,32,s32,r1,0"
    lines = [f"{head},9,1,SDC,4,60", f"{head},9,1,SDC,4,61", f"{head},9,0,SDC,4,1", f"{head},9,2147483647,Masked,0,0", f"{head},DUE,0,0", "1,2", head.replace(",5,3", ",9,3") + ",9,1,SDC,4,5"]
    good, bad = res.parsed_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert (good.count(), bad.count()) == (5, 2)
    counted = res.tolerant(res.flagged(good))
    assert sorted(r["outcome"] for r in counted.collect()) == ["DUE", "DUE", "Masked", "SDC"]
    row = res.ratios(res.rollup(counted, ("app",))).head()
    assert row["masked_ratio"] + row["sdc_ratio"] + row["due_ratio"] == pytest.approx(1)
    assert res.all_rollups(counted).count() == 7


def test_injection_with_no_bit_is_masked(spark):
    e = edges(spark, CYCLE)
    plan = spark.createDataFrame([(1, 2, 2, None, "apply", "d"), (2, 2, 3, 4, "apply", "d")], "trial long, iter int, vertex long, bit int, kernel string, register string")
    out = {r["trial"]: (r["outcome"], r["fi_flag"]) for r in camp.classified(camp.Injected(camp.Golden(camp.app("SSSP", 1), e), plan)).collect()}
    assert out[1] == ("Masked", 0) and out[2][0] in ("SDC", "Masked") and out[2][1] == 1


def brute_sssp(pairs, source, fault):
    """Distances and whether the fault (iter, vertex, bit, phase) was reached, superstep by superstep."""

    def flip(x, bit):
        y = (x ^ (1 << bit)) & 0xFFFFFFFF
        return y - (1 << 32) if y > compare.INF else y

    vs = {v for p in pairs for v in p}
    d, active, fired, k = {v: 0 if v == source else compare.INF for v in vs}, set(vs), 0, 0
    while active:
        k, old, changed = k + 1, dict(d), set()
        for v in active - {source}:
            at = fault[3] if fault[:2] == (k, v) else None
            g = min([old[a] + 1 for a, b in pairs if b == v and old[a] < compare.INF], default=compare.INF)
            new = min(old[v], flip(g, fault[2]) if at == "gather" else g)
            d[v] = flip(new, fault[2]) if at == "apply" else new
            if d[v] != old[v] and at != "scatter":
                changed.add(v)
            fired |= at in ("gather", "apply") or (at == "scatter" and d[v] != old[v])
        active = {b for a, b in pairs if a in changed}
    return d, int(fired)


def brute_pagerank(pairs, fault):
    import numpy as np

    def flip(x, bit):
        return float((np.array([x], np.float32).view(np.uint32) ^ np.uint32(1 << bit)).view(np.float32)[0])

    vs, out = {v for p in pairs for v in p}, {}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    rank, active, fired, k = dict.fromkeys(vs, 0.15), set(vs), 0, 0
    while active:
        k, old, changed = k + 1, dict(rank), set()
        for v in active:
            at = fault[3] if fault[:2] == (k, v) else None
            phi = sum(old[a] / out[a] for a, b in pairs if b == v)
            new = 0.15 + 0.85 * (flip(phi, fault[2]) if at == "gather" else phi)
            rank[v] = flip(new, fault[2]) if at == "apply" else new
            moved = abs(rank[v] - old[v]) >= 0.01
            if moved and at != "scatter":
                changed.add(v)
            fired |= at in ("gather", "apply") or (at == "scatter" and moved)
        active = {b for a, b in pairs if a in changed}
    return rank, int(fired)


FAULTY = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 2), (2, 6)]
#: iter, vertex, bit, phase; in the last but one scatter skips an unchanged vertex, in the last gather skips the source
FAULTS = [(2, 3, b, p) for p in camp.PHASES for b in (0, 30)] + [(1, 2, 31, "gather"), (3, 4, 2, "scatter"), (1, 4, 5, "scatter"), (1, 1, 3, "gather")]


def injected(spark, app, pairs, faults, registers, patience=20):
    rows = [(i, *f, registers[f[3]]) for i, f in faults.items()]
    plan = spark.createDataFrame(rows, "trial long, iter int, vertex long, bit int, kernel string, register string")
    return camp.Injected(camp.Golden(app, edges(spark, pairs)), plan, patience)


def test_injected_phases_of_distances(spark):
    runs = injected(spark, camp.app("SSSP", 1), FAULTY, dict(enumerate(FAULTS)), {"gather": "g", "apply": "d", "scatter": "changed"})
    got, flags = runs.whole(runs.runs.select("trial")).collect(), {r["trial"]: (r["fi_flag"], r["late"]) for r in runs.runs.collect()}
    for i, f in enumerate(FAULTS):
        d, fired = brute_sssp(FAULTY, 1, f)
        assert ({r["v"]: r["d"] for r in got if r["trial"] == i}, *flags[i]) == (d, fired, False), f


def test_injected_phases_of_ranks(spark):
    # a rank of 1e37 takes hundreds of supersteps to settle
    runs = injected(spark, camp.app("PageRank"), FAULTY, {i: f for i, f in enumerate(FAULTS) if f[2] != 30}, {"gather": "phi", "apply": "rank", "scatter": "changed"})
    got, flags = runs.whole(runs.runs.select("trial")).collect(), {r["trial"]: r["fi_flag"] for r in runs.runs.collect()}
    for i in flags:
        rank, fired = brute_pagerank(FAULTY, FAULTS[i])
        assert {r["v"]: r["rank"] for r in got if r["trial"] == i} == pytest.approx(rank, rel=1e-5), FAULTS[i]
        assert flags[i] == fired


def test_a_run_out_of_patience_is_due(spark):
    runs = injected(spark, camp.app("PageRank"), FAULTY, {1: (2, 3, 30, "apply"), 2: (2, 3, 0, "scatter")}, {"apply": "rank", "scatter": "changed"}, 2)
    out = {r["trial"]: (r["outcome"], r["metric1"], r["supersteps"]) for r in camp.classified(runs).collect()}
    assert out[1] == ("DUE", 0, runs.budget) and out[2][0] != "DUE"


def test_log_of_a_campaign(spark):
    """Golden run, draws, injection and comparison of two programs, through the log and its roll-ups."""
    e = edges(spark, FAULTY)
    records = camp.campaign(camp.app("SSSP", 1), e, 8).unionByName(camp.campaign(camp.app("SCC"), e, 8))
    lines = [r["value"] for r in camp.log_lines(records).collect()]
    good, bad = res.parsed_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert bad.count() == 0
    key = ["app", "trial", "kernel", "iter", "vertex", "bit", "mask", "line", "register", "loop", "outcome", "metric1"]
    assert sorted(map(tuple, good.select(key).collect())) == sorted(map(tuple, records.select(key).collect()))
    assert {r["kernel"] for r in records.collect()} == set(camp.PHASES)
    counted = res.ratios(res.rollup(res.tolerant(res.flagged(good)), ("app",))).collect()
    assert all(r["masked_ratio"] + r["sdc_ratio"] + r["due_ratio"] == pytest.approx(1) for r in counted)
    assert len(res.write_tsvs(res.tolerant(res.flagged(good)), compare.stored(records).inputFiles()[0].rsplit("/", 2)[0] + "/rollups")) == 7


def brute_groups(near):
    """Groups as sets grown by recursion, as the definition reads."""
    found = set()

    def grow(group, last):
        for w in near[last]:
            if w not in group and all(w in near[m] for m in group):
                group.append(w)
                grow(group, w)
        return group

    for v in near:
        for w in near[v]:
            found.add(tuple(sorted(grow([v, w], w))))
    return sorted(found)


def brute_cover(groups):
    left, out = [set(g) for g in groups], []
    for v in range(max((max(g) for g in groups), default=0) + 1):
        having = [g for g in left if v in g]
        if having:
            size = max(map(len, having))
            best = next(g for g in having if len(g) == size)
            out.append(sorted(best))
            left = [g - best for g in left if g is not best]
            left = [g for g in left if len(g) > 1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_cover(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(1, 15), 2))) for _ in range(28)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    near = {v: sorted(near[v]) for v in sorted(near)}
    frame = spark.createDataFrame(pairs, "v1 long, v2 long")
    want = brute_groups(near)
    assert sorted(tuple(r["members"]) for r in top.similarity_groups(frame).collect()) == want
    assert sorted(r["members"] for r in top.group_cover(frame).collect()) == sorted(brute_cover(want))
    assert [tuple(r["members"]) for r in top.numbered(top.similarity_groups(frame)).orderBy("number").collect()] == want


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    pairs = {(rng.randint(1, 25), rng.choice([1, 1, 1, *range(2, 12)])) for _ in range(150)}
    pairs |= {(rng.randint(1, 6), v) for v in range(1, 26) for _ in range(2)}
    out, into = {}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    for t in (0.2, 0.5, 0.6):
        want = set()
        for a in out:
            for b in out:
                if a < b and a in into and b in into:
                    i, o = (len(s[a] & s[b]) / len(s[a] | s[b]) for s in (into, out))
                    if i >= t and o >= t:
                        want.add((a, b))
        assert {(r["v1"], r["v2"]) for r in top.similar_pairs(edges(spark, sorted(pairs)), t).collect()} == want


def test_ranges_of_a_heavy_tail_are_even(spark):
    scores = spark.range(4000).select(F.col("id").alias("v"), F.pow(F.lit(0.5), F.col("id") % 40).alias("score"))
    got = compare.ranked(scores, "score").collect()
    want = sorted(((r["v"], r["score"]) for r in scores.collect()), key=lambda x: (-x[1], x[0]))
    assert [v for v, _ in want] == [r["v"] for r in sorted(got, key=lambda r: r["pos"])]


def test_hits_without_an_edge(spark):
    rows = alg.hits(edges(spark, [(1, 2)]).filter("src = 0"), spark.createDataFrame([(1,), (2,)], "v long"), most=3)[0].collect()
    assert [r["authority"] for r in rows] == [None, None]
    assert alg.sssp(edges(spark, [(1, 2)]).filter("src = 0"))[0].count() == 0


def test_nothing_is_left_behind(spark):
    before = spark.catalog.listTables()
    alg.pagerank(edges(spark, CYCLE))
    assert [t.name for t in spark.catalog.listTables()] == [t.name for t in before]


def brute_reach(pairs, starts):
    out = set()
    for a in starts:
        seen, ahead = {a}, [a]
        while ahead:
            v = ahead.pop()
            new = [y for x, y in pairs if x == v and y not in seen]
            seen.update(new)
            ahead += new
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("local", [1 << 20, 40, 1])
def test_reach_equals_brute_force(spark, monkeypatch, local):
    """In memory as a whole, small components in memory and the large one by turns, and all by turns."""
    monkeypatch.setattr(alg, "LOCAL", local)
    draw = random.Random(5)
    pairs = [(draw.randrange(30), draw.randrange(30)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(4)] + [(200, 201), (201, 200), (200, 201), (300, 300)]
    starts = {v for p in pairs for v in p}
    rows = [tuple(r) for r in alg.reach(edges(spark, pairs)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_reach(pairs, starts)
    some = [0, 3, 101, 201, 999]
    vs = spark.createDataFrame([(v,) for v in some], "v int")
    found = alg.reach(edges(spark, pairs), vs)
    assert found.dtypes == [("a", "int"), ("b", "int")]
    assert {tuple(r) for r in found.collect()} == brute_reach(pairs, some)


def test_reach_of_a_long_chain_takes_few_jobs(spark):
    n, context = 150, spark.sparkContext
    context.setJobGroup("chain", "reach")
    try:
        assert alg.reach(edges(spark, [(i, i + 1) for i in range(n)])).count() == (n + 1) * (n + 2) // 2
        assert len(context.statusTracker().getJobIdsForGroup("chain")) < n
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["PageRank", "HITS"])
def test_a_golden_superstep_reads_only_its_own_rows(spark, name):
    golden = camp.Golden(camp.app(name), edges(spark, FAULTY), 3)
    files = [set(golden.at(k).inputFiles()) for k in range(golden.steps + 1)]
    assert all(files) and len(set().union(*files)) == sum(map(len, files))
    assert {r["iter"] for r in golden.trace().collect()} == {1, 2, 3}
    golden.drop()


def test_flips_in_sql(spark):
    rows = spark.createDataFrame([(x, b) for x in (0.15, -2.5, 0.0, 3e30) for b in (0, 22, 23, 30, 31)], "x double, bit int").withColumn("i", F.expr("CAST(x * 10 % 1000 AS INT)"))
    for kind, c, flip in (("f32", "x", compare.flip_float), ("s32", "i", compare.flip_int)):
        assert rows.filter(~F.expr(camp.FLIP[kind](c)).eqNullSafe(flip(F.col(c), F.col("bit")))).count() == 0


@pytest.mark.parametrize("name, gathered, column", [("SSSP", "g", "d"), ("PageRank", "phi", "rank"), ("SCC", "g", "label")])
def test_trials_in_memory_are_those_of_spark(spark, name, gathered, column):
    """Golden run, outcomes and end states in a task's memory against the supersteps through Spark, for faults of each phase
    in several supersteps, one trial without a fault and one whose vertex does not exist."""
    e = edges(spark, [*FAULTY, (3, 4), (7, 8), (9, 7), (8, 9), (6, 6)])
    a, registers = camp.app(name, 1 if name == "SSSP" else None), {"gather": gathered, "apply": column, "scatter": "changed"}
    faults = [(k, v, b, p) for k in (1, 2) for v in (1, 3, 8) for b in (1, 22, 30, 31) for p in camp.PHASES] + [(1, 3, None, "apply"), (1, 77, 3, "apply")]
    rows = [(i, *f, registers[f[3]]) for i, f in enumerate(faults)]
    plan = spark.createDataFrame(rows, "trial long, iter int, vertex long, bit int, kernel string, register string")
    golden, own = camp.Golden(a, e), camp.LocalGolden(a, camp.local_rows(a, e), (name, column))
    assert own.steps == golden.steps and sorted(map(tuple, own.trace().collect())) == sorted(map(tuple, golden.trace().collect()))
    assert own.state.schema[column] == golden.state.schema[column]

    def ends(runs):
        outcomes = {r["trial"]: tuple(r) for r in camp.classified(runs).drop("metric2").collect()}
        return outcomes, {(r["trial"], r["v"]): r[column] for r in runs.whole(runs.runs.select("trial")).collect()}

    (want, state), (got, own_state) = ends(camp.Injected(golden, plan)), ends(camp.LocalInjected(own, plan))
    assert got == want and {x[3] for x in got.values()} >= {"Masked", "SDC"}
    assert own_state == pytest.approx(state, rel=1e-12, nan_ok=True)


def test_a_campaign_over_a_long_chain_takes_few_jobs(spark):
    n, context = 60, spark.sparkContext
    context.setJobGroup("campaign", "chain")
    try:
        records = camp.campaign(camp.app("SSSP", 0), edges(spark, [(i, i + 1) for i in range(n)]), 4)
        assert records.count() == 4 and records.agg(F.max("supersteps")).head()[0] >= n // 2
        assert len(context.statusTracker().getJobIdsForGroup("campaign")) < n
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_strong_components_in_memory_and_by_turns(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(75)] + [(4, 4), (5, 5)]
    e = edges(spark, pairs)
    clean = alg.stored(e.filter("src <> dst").distinct())
    labels = table(alg.scc(e))
    assert labels == table(alg.scc_by_turns(clean, alg.stored(graphs.vertices(clean)))) and len(set(labels.values())) < len(labels)
    few = spark.createDataFrame([(v,) for v in range(40)], "v long")
    inside = edges(spark, [p for p in pairs if max(p) < 40 and p[0] != p[1]]).distinct()
    assert table(alg.scc(e, few)) == table(alg.scc_by_turns(inside, few))
