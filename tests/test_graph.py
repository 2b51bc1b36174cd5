"""Hand-computed results on a graph of five nodes, and properties on random ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prowave.operators import graph, propagate, walks

RAW = [(0, 1), (0, 2), (1, 2), (1, 2), (2, 0), (3, 2), (3, 3)]


@pytest.fixture(scope="module")
def t1(spark):
    return spark.createDataFrame(RAW, "src long, dst long").cache(), spark.range(5).select("id")


def test_degrees_with_and_without_loops(t1):
    e, nodes = t1
    got = {r["id"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(e, nodes).collect()}
    assert [got[i][0] for i in range(5)] == [2, 2, 1, 2, 0]
    got = {r["id"]: (r["out_degree"], r["in_degree"]) for r in graph.degrees(graph.clean_edges(e, keep_loops=False), nodes).collect()}
    assert [got[i][0] for i in range(5)] == [2, 2, 1, 1, 0]
    assert [got[i][1] for i in range(5)] == [1, 1, 4, 0, 0]


def test_counts_offsets_and_rewiring(spark, t1):
    e, nodes = t1
    clean = graph.clean_edges(e, keep_loops=False)
    assert graph.node_count(e).first()["n"] == 4  # the header knows of node 4, the edges don't
    s = graph.graph_stats(clean, nodes).first()
    assert (s["n"], s["m"], s["dead_ends"], s["isolated"], s["max_out"]) == (5, 6, 1, 1, 2)
    assert [r["out_offset"] for r in graph.csr_offsets(clean, nodes).orderBy("id").collect()] == [0, 2, 4, 5, 6]
    assert {(r[0], r[1]) for r in graph.rewire_dead_ends(clean, nodes, 5).collect()} >= {(4, 0)}
    assert {(r[0], r[1]) for r in graph.with_sink(clean, nodes, 5).collect()} >= {(4, 5)}
    assert graph.clean_edges(e, dedup=True).count() == 6


def test_prefix_sum_over_many_blocks(spark):
    df = spark.range(1000).repartition(7).select("id")
    got = graph.prefix_sum(df, "id", F.col("id") % 5, "s", block=16).orderBy("id").collect()
    assert [r["s"] for r in got] == np.concatenate([[0], np.cumsum(np.arange(1000) % 5)[:-1]]).tolist()


def dense(n: int, edges: list[tuple[int, int]], x: np.ndarray, alpha: float, depth: int | None = None) -> np.ndarray:
    p = np.zeros((n, n))
    for s, d in edges:
        p[d, s] += 1
    p /= np.maximum(p.sum(0), 1)
    if depth is None:
        return alpha * np.linalg.solve(np.eye(n) - (1 - alpha) * p, x)
    out, now = np.zeros(n), x.astype(float)
    for k in range(depth + 1):
        out += alpha * (1 - alpha) ** k * now
        now = p @ now
    return out


@pytest.mark.parametrize(("seed", "want"), [((1, 0, 0, 0, 0), (0.3152, 0.1056, 0.1696, 0, 0)), ((0.5, -1, 0, 0.5, 0), (0.0936, -0.1728, -0.0208, 0.1, 0))])
def test_fixed_depth_by_hand(spark, t1, seed, want):
    e, nodes = t1
    w = graph.weighted(graph.rewire_dead_ends(graph.clean_edges(e, keep_loops=False), nodes, 5))
    seeds = spark.createDataFrame([(i, float(v)) for i, v in enumerate(seed)], "id long, x double")
    got = {r["id"]: r["x"] for r in propagate.fixed_depth(w, seeds, ["x"], 0.2, 3).collect()}
    assert [got.get(i, 0.0) for i in range(5)] == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (200, 2)) if a != b} | {(i, (i + 1) % 60) for i in range(60)}
    edges = sorted(pairs | {(b, a) for a, b in pairs})
    x = rng.standard_normal((60, 2)) / 60
    seeds = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    return edges, graph.weighted(spark.createDataFrame(edges, "src long, dst long")).cache(), seeds.cache(), x


def test_push_meets_its_bound_and_keeps_mass(random_graph):
    edges, w, seeds, x = random_graph
    budget = propagate.walk_budget(60, 0.5)
    e = propagate.two_ends(w)
    state = propagate.push(e, propagate.start_state(e, seeds, ["x", "y"], budget), ["x", "y"], 0.2)
    rows = {r["id"]: r for r in state.collect()}
    deg = np.bincount([s for s, _ in edges], minlength=60)
    assert all(abs(0.8 * rows[i]["r_x"]) < deg[i] for i in rows)
    assert sum(r["r_x"] + r["m_x"] for r in rows.values()) == pytest.approx(budget * x[:, 0].sum(), abs=1e-6)
    exact = dense(60, edges, x[:, 1], 0.2)
    got = {r["id"]: r["y"] for r in propagate.closure(state, ["x", "y"], 0.2, budget).collect()}
    assert all(abs(got.get(i, 0) - exact[i]) <= deg[i] / budget for i in range(60))


def test_fixed_depth_is_linear_and_converges(random_graph):
    edges, w, seeds, x = random_graph
    both = seeds.select("id", (2 * F.col("x") - F.col("y")).alias("z"), "x", "y")
    got = {r["id"]: r for r in propagate.fixed_depth(w, both, ["x", "y", "z"], 0.5, 20).collect()}
    exact = dense(60, edges, x[:, 0], 0.5)
    for i in range(60):
        assert got[i]["z"] == pytest.approx(2 * got[i]["x"] - got[i]["y"], abs=1e-12)
        assert got[i]["x"] == pytest.approx(exact[i], abs=1e-6)


def test_budget_and_ladder():
    assert propagate.walk_budget(1000, 0.5) > propagate.walk_budget(1000, 1.0) > propagate.walk_budget(1000, 4.0)
    assert propagate.walk_budget(1000, 0.5, 0.2) == pytest.approx(5 * propagate.walk_budget(1000, 0.5), rel=1e-4)
    assert propagate.walk_budget(1000, 0.5, -3.0) > 0
    assert propagate.stage_ladder(1000, 1e7) == [1447, 131, 11, 1]
    assert propagate.stage_ladder(1000, 10.0) == [1]


def test_walks_stay_on_edges_and_repeat(spark, random_graph):
    edges, _, _, _ = random_graph
    e = spark.createDataFrame(edges, "src long, dst long")
    cache = walks.walk_cache(e, 0.3)
    with pytest.raises(ValueError):
        walks.walk_cache(e, 0.0)
    one = sorted(map(tuple, cache.collect()))
    assert one == sorted(map(tuple, walks.walk_cache(e.repartition(7), 0.3).collect()))
    assert len(one) == len(edges)
    slots = walks.slots_with_degree(e)
    start = e.select(F.col("src").alias("walk"), F.col("src").alias("cur"), F.lit(False).alias("done")).distinct()
    moved = {r["walk"]: (r["cur"], r["done"]) for r in walks.walk_step(start, slots, 0, 0.3).collect()}
    assert all(done and cur == w or (w, cur) in set(edges) for w, (cur, done) in moved.items())


def test_alias_draws_follow_the_weights(spark):
    w = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1.0, -2.0, 5.0, 0.0, -0.5])], "id long, value double")
    got = walks.alias_pick(w, 850).collect()
    n = np.bincount([r["id"] for r in got], minlength=6)
    assert len(got) == 850 and np.abs(n - 100 * np.array([0, 1, 2, 5, 0, 0.5])).max() <= 1
    assert {r["id"]: r["sign"] for r in got}[2] == -1
    assert walks.alias_pick(w.filter("value = 0"), 10).count() == 0


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.node_table(e).count() == 0
    assert graph.symmetrize(e).count() == 0
    assert graph.degrees(e, spark.range(3).select("id")).agg(F.sum("out_degree")).first()[0] == 0


@pytest.mark.parametrize("scales", [[1], [16, 4, 1]])
def test_stages_meet_the_same_bound(random_graph, scales):
    edges, w, seeds, x = random_graph
    budget = propagate.walk_budget(60, 0.5)
    e = propagate.two_ends(w)
    state = propagate.push(e, propagate.start_state(e, seeds, ["x"], budget), ["x"], 0.2, scales)
    exact, deg = dense(60, edges, x[:, 0], 0.2), np.bincount([s for s, _ in edges], minlength=60)
    got = {r["id"]: r["x"] for r in propagate.closure(state, ["x"], 0.2, budget).collect()}
    assert all(abs(got.get(i, 0) - exact[i]) <= deg[i] / budget for i in range(60))


def test_a_push_reads_its_edges_once(spark, random_graph):
    """Later rounds scan what is kept."""
    edges, _, seeds, _ = random_graph
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    e = propagate.two_ends(graph.weighted(spark.createDataFrame(edges, "src long, dst long"))).coalesce(1)
    e = e.mapInArrow(count, e.schema)
    state = propagate.start_state(e, seeds, ["x"], propagate.walk_budget(60, 0.5))
    before = reads.value
    propagate.push(e, state, ["x"], 0.2)
    assert reads.value - before <= 2 * len(edges)  # for the start's degrees and for the rounds


@pytest.fixture
def small_slices(spark, monkeypatch):
    """Several packed rows a block, also of few edges."""
    monkeypatch.setattr(propagate, "SLICE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_push_writes_its_state_once_in_many_rounds(spark, random_graph, monkeypatch, small_slices):
    """Each write is a job of its own; plain edges count their degrees themselves."""
    edges, w, seeds, x = random_graph
    writes, cut = [], propagate.cut_lineage
    monkeypatch.setattr(propagate, "cut_lineage", lambda df: writes.append(1) or cut(df))
    want = {r["id"]: r["x"] for r in propagate.estimate(w, seeds, ["x"], 60, 0.2, 0.05).collect()}
    assert len(writes) <= 10
    plain = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["x"] for r in propagate.estimate(plain, seeds, ["x"], 60, 0.2, 0.05).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    exact, deg = dense(60, edges, x[:, 0], 0.2), np.bincount([s for s, _ in edges], minlength=60)
    assert all(abs(got.get(i, 0) - exact[i]) <= deg[i] / propagate.walk_budget(60, 0.05) for i in range(60))


@pytest.mark.parametrize("own_weights", [False, True])
def test_packed_rounds_are_the_single_ones(spark, random_graph, monkeypatch, small_slices, own_weights):
    """Also in many slices and blocks, with weights of each edge, ends without a way out, null ends, and seeds given twice or outside the graph."""
    edges, _, seeds, _ = random_graph
    if own_weights:
        monkeypatch.setattr(propagate, "BLOCK_EDGES", 25)
    more = [(3, 1 << 40), (4, -7), (5, None), (6, 1 << 40)]
    w = graph.weighted(spark.createDataFrame(edges + more, "src long, dst long"))
    if own_weights:
        w = w.withColumn("w", F.col("w") * (1 + F.col("dst") % 3 / 10))
    e = propagate.two_ends(w.filter("dst is not null") if own_weights else w)
    budget = propagate.walk_budget(60, 0.5)
    state = propagate.start_state(e, seeds.select("id", "x", "y").unionAll(spark.createDataFrame([(2, 0.5, 0.0), (999, 0.25, -1.0)], "id long, x double, y double")), ["x", "y"], budget)
    single = state.groupBy("id").agg(F.max("degree").alias("degree"), *[F.sum(c).alias(c) for c in ("r_x", "r_y", "m_x", "m_y")])
    for _ in range(3):
        single = propagate.push_round(e, single, ["x", "y"], 0.2, 20.0)
    flat = lambda df: {(r["id"], c): float(r[c]) for r in df.collect() for c in ("degree", "r_x", "r_y", "m_x", "m_y")}
    got, want = flat(propagate.push(e, state, ["x", "y"], 0.2, [20.0], rounds=3)), flat(single)
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("hub", [1 << 20, 3])
def test_places_of_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "BLOCK", 4)
    edges = [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40, 2)] + [(50, 51)]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    slots = {(r["src"], r["dst"]): r["slot"] for r in graph.adjacency_slots(e).collect()}
    assert slots == {(0, i): i - 1 for i in range(1, 40)} | {(i, 0): 0 for i in range(1, 40, 2)} | {(50, 51): 0}
    turns = {(r["src"], r["dst"]): r["turn"] for r in graph.reverse_index(e).collect()}
    assert turns == {(0, i): 0 for i in range(1, 40)} | {(i, 0): (i - 1) // 2 for i in range(1, 40, 2)} | {(50, 51): 0}


def test_cached_walks_give_what_the_state_holds(spark, random_graph):
    """Shares sum to the rest whatever walks there are; many walks come near the exact values."""
    edges, w, seeds, x = random_graph
    e = propagate.two_ends(w)
    budget = 20 * propagate.walk_budget(60, 0.5)
    state = propagate.start_state(e, seeds, ["x"], budget)
    for _ in range(2):
        state = propagate.push_round(e, state, ["x"], 0.3)
    held = state.select("id", F.col("r_x").alias("r"), F.col("m_x").alias("m")).cache()
    cache = walks.walk_cache(spark.createDataFrame(edges, "src long, dst long"), 0.3)
    got = {r["id"]: r["value"] for r in walks.cached_walk_estimate(held, cache, 0.3, budget).collect()}
    assert sum(got.values()) == pytest.approx(x[:, 0].sum(), abs=1e-9)
    exact = dense(60, edges, x[:, 0], 0.3)
    assert np.abs([got.get(i, 0) - exact[i] for i in range(60)]).max() <= 0.25 * np.abs(exact).max()
    none = walks.cached_walk_estimate(held, cache.limit(0), 0.3, budget).agg(F.sum("value")).first()[0]
    assert none == pytest.approx(x[:, 0].sum(), abs=1e-9)
