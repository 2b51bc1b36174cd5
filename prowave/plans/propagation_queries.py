"""Queries of the propagation operators. Values are given as shares of the budget, rounded to nine digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.operators import graph, propagate, walks

from . import fixtures as fx
from .graph_queries import CACHE_SQL
from .registry import query

ALPHA, EPSILON = 0.2, 0.5
BUDGET_SQL = "ceil((2 + 2.0::DOUBLE / 3 * {eps}) * ln(n) * n / ({eps}::DOUBLE * {eps}) / greatest({gamma}, 0.001))"


def round9(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[(F.round(c, 9) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


@query("SELECT n, eps, gamma, " + BUDGET_SQL.format(eps="eps", gamma="gamma") + " AS budget FROM (SELECT count(*) AS n FROM part), (SELECT unnest([0.5, 2.0, 16.0])::DOUBLE AS eps), (SELECT unnest([0.2, 1.0])::DOUBLE AS gamma)")
def walk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.count_of(spark, sf_dir, "part")
    return spark.createDataFrame([(n, e, g, propagate.walk_budget(n, e, g)) for e in (0.5, 2.0, 16.0) for g in (0.2, 1.0)], "n long, eps double, gamma double, budget double")


@query(
    "WITH RECURSIVE p AS (SELECT n, " + BUDGET_SQL.format(eps="0.5", gamma="1.0") + " AS w FROM (SELECT count(*) AS n FROM part)), "
    "f AS (SELECT greatest(w / (1000 * ln(n)), 1)::DOUBLE AS first FROM p), s AS (SELECT floor(first)::BIGINT AS scale, floor(greatest(pow(floor(first), 1.0::DOUBLE / 3), 2))::BIGINT AS step FROM f), "
    "l AS (SELECT 0 AS stage, scale, step FROM s UNION ALL SELECT stage + 1, scale // step, step FROM l WHERE scale // step >= 1) SELECT stage::INTEGER AS stage, scale FROM l"
)
def stage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.count_of(spark, sf_dir, "part")
    return spark.createDataFrame(list(enumerate(propagate.stage_ladder(n, propagate.walk_budget(n, EPSILON)))), "stage int, scale long")


def _fixed_sql(columns: list[str], depth: int) -> str:
    w = ", ".join(f"{ALPHA} * {c} AS {c}" for c in columns)
    out = f"WITH {fx.SQL_PS}, {fx.SQL_SEED}, y0 AS (SELECT id, {w} FROM seed)"
    for k in range(depth):
        moved = ", ".join(f"{1 - ALPHA} * {c} / degree AS {c}" for c in columns)
        sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
        out += f", y{k + 1} AS (SELECT id, {sums} FROM (SELECT * FROM y0 UNION ALL SELECT e.dst AS id, {moved} FROM e JOIN y{k} y ON e.src = y.id JOIN d ON d.id = e.src) GROUP BY id)"
    return out + f" SELECT id, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in columns)} FROM y{depth}"


@query(_fixed_sql(["x"], 3))
def ppr_fixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = graph.weighted(fx.part_supplier(spark, sf_dir)[0])
    return round9(propagate.fixed_depth(weights, fx.supplier_seed(spark, sf_dir), ["x"], ALPHA, 3), "x")


@query(_fixed_sql(["x", "y", "z"], 3))
def ppr_multi_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = graph.weighted(fx.part_supplier(spark, sf_dir)[0])
    return round9(propagate.fixed_depth(weights, fx.supplier_seed(spark, sf_dir), ["x", "y", "z"], ALPHA, 3), "x", "y", "z")


def push_sql(graph_sql: str, start: str, rounds: int, scale: float = 1.0, scales: tuple[float, ...] = ()) -> str:
    """CTEs s0 … of (id, r, m) from a start relation: ``rounds`` at ``scale``, or at each of ``scales``; a round without an active node changes nothing."""
    out = f"WITH {graph_sql}, {start}"
    for k, at in enumerate(s for s in scales or (scale,) for _ in range(rounds)):
        out += f""", a{k} AS MATERIALIZED (SELECT s.*, coalesce(degree, 0) AS degree, abs({1 - ALPHA} * r) >= coalesce(degree, 0) * {at} AND coalesce(degree, 0) > 0 AS hot FROM s{k} s LEFT JOIN d ON s.id = d.id),
s{k + 1} AS MATERIALIZED (SELECT id, sum(r) AS r, sum(m) AS m FROM (
  SELECT id, CASE WHEN hot THEN 0 ELSE r END AS r, m + CASE WHEN hot THEN {ALPHA} * r ELSE 0 END AS m FROM a{k}
  UNION ALL SELECT e.dst, {1 - ALPHA} * r / degree, 0 FROM a{k} JOIN e ON e.src = a{k}.id WHERE hot) GROUP BY id)"""
    return out


START_SQL = f"w AS (SELECT {BUDGET_SQL.format(eps=EPSILON, gamma=1.0)} AS w FROM (SELECT count(*) AS n FROM nodes)), {fx.SQL_SEED}, s0 AS (SELECT id, x * (SELECT w FROM w) AS r, 0.0::DOUBLE AS m FROM seed WHERE x <> 0)"


def _state(spark: SparkSession, sf_dir: str, rounds: int, scale: float = 1.0):
    e, n = fx.part_supplier(spark, sf_dir)
    edges, budget = propagate.two_ends(graph.weighted(e)), propagate.walk_budget(n, EPSILON)
    state = propagate.start_state(edges, fx.supplier_seed(spark, sf_dir), ["x"], budget)
    for _ in range(rounds):
        state = propagate.push_round(edges, state, ["x"], ALPHA, scale)
    return state, budget, edges, n


def _shares(state: DataFrame, budget: float) -> DataFrame:
    return round9(state.select("id", (F.col("r_x") / budget).alias("r"), (F.col("m_x") / budget).alias("m")), "r", "m")


@query(f"WITH {fx.SQL_PS}, {START_SQL} SELECT id, round(r / (SELECT w FROM w), 9) + 0.0 AS r, m FROM s0")
def seed_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, budget, _, _ = _state(spark, sf_dir, 0)
    return _shares(state, budget)


_FIRST_SQL = "floor(greatest(w.w / (1000 * ln(c.n)), 1))"


@query(f"""WITH {fx.SQL_PS}, {START_SQL}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM e) AS m),
t AS (SELECT m / n::DOUBLE * {_FIRST_SQL} / floor(greatest(pow({_FIRST_SQL}, 1.0::DOUBLE / 3), 2)) / 0.8::DOUBLE / 4 AS t FROM w, c)
SELECT id, y * 1000 > (SELECT t FROM t) AS active FROM seed WHERE y <> 0""")
def first_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.part_supplier(spark, sf_dir)
    least = propagate.first_threshold(e.count(), n, propagate.walk_budget(n, EPSILON), ALPHA)
    return fx.supplier_seed(spark, sf_dir).filter("y <> 0").select("id", (F.col("y") * 1000 > least).alias("active"))


@query(push_sql(fx.SQL_PS, START_SQL.replace("WHERE x <> 0", "WHERE x <> 0 AND id % 3 = 0"), 2) + " SELECT id, round(r / (SELECT w FROM w), 9) + 0.0 AS r, round(m / (SELECT w FROM w), 9) + 0.0 AS m FROM s2")
def push_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a subset of nodes only."""
    e, n = fx.part_supplier(spark, sf_dir)
    edges, budget = propagate.two_ends(graph.weighted(e)), propagate.walk_budget(n, EPSILON)
    state = propagate.start_state(edges, fx.supplier_seed(spark, sf_dir), ["x"], budget, spark.range(0, n + 2, 3))
    for _ in range(2):
        state = propagate.push_round(edges, state, ["x"], ALPHA)
    return _shares(state, budget)


@query(push_sql(fx.SQL_PS, START_SQL, 2) + " SELECT id, round(r / (SELECT w FROM w), 9) + 0.0 AS r, round(m / (SELECT w FROM w), 9) + 0.0 AS m FROM s2")
def push_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, budget, _, _ = _state(spark, sf_dir, 2)
    return _shares(state, budget)


STAGES = (16, 4, 1)


@query(push_sql(fx.SQL_PS, START_SQL, 30, scales=STAGES) + f" SELECT id, round(r / (SELECT w FROM w), 9) + 0.0 AS r, round(m / (SELECT w FROM w), 9) + 0.0 AS m FROM s{30 * len(STAGES)}")
def push_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down a ladder of thresholds, each until no node is active."""
    state, budget, edges, _ = _state(spark, sf_dir, 0)
    return _shares(propagate.push(edges, state, ["x"], ALPHA, list(STAGES)), budget)


@query(push_sql(fx.SQL_PS, START_SQL, 2) + f" SELECT id, round((m + {ALPHA} * r) / (SELECT w FROM w), 9) + 0.0 AS x FROM s2")
def push_final_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, budget, _, _ = _state(spark, sf_dir, 2)
    return round9(propagate.closure(state, ["x"], ALPHA, budget), "x")


@query(push_sql(fx.SQL_PS, START_SQL, 3, 0.0) + " SELECT id, round(r / (SELECT w FROM w), 9) + 0.0 AS r, round(m / (SELECT w FROM w), 9) + 0.0 AS m FROM s3")
def power_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, budget, _, _ = _state(spark, sf_dir, 3, 0.0)
    return _shares(state, budget)


def _converged_sql() -> str:
    """The three seed columns pushed as one table of (column, id) nodes."""
    start = START_SQL.replace("s0 AS (SELECT id, x * (SELECT w FROM w) AS r, 0.0::DOUBLE AS m FROM seed WHERE x <> 0)", "")
    each = " UNION ALL ".join(f"SELECT id * 3 + {i} AS id, {c} * (SELECT w FROM w) AS r, 0.0::DOUBLE AS m FROM seed WHERE {c} <> 0" for i, c in enumerate("xyz"))
    copies = fx.SQL_PS.replace("e AS (SELECT p AS src, s AS dst FROM g UNION ALL SELECT s, p FROM g)", "e AS (SELECT src * 3 + c AS src, dst * 3 + c AS dst FROM (SELECT p AS src, s AS dst FROM g UNION ALL SELECT s, p FROM g), (SELECT unnest(range(3)) AS c))")
    one = lambda i, c: f"coalesce(max(round((m + {ALPHA} * r) / (SELECT w FROM w), 9)) FILTER (WHERE id % 3 = {i}), 0) + 0.0 AS {c}"
    return push_sql(copies, f"{start} s0 AS ({each})", 60) + f" SELECT id // 3 AS id, {', '.join(one(i, c) for i, c in enumerate('xyz'))} FROM s60 GROUP BY id // 3"


@query(_converged_sql())
def push_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until no residual reaches its node's degree; the SQL unrolls more rounds than are needed, tests hold it against the bound."""
    e, n = fx.part_supplier(spark, sf_dir)
    return round9(propagate.estimate(e, fx.supplier_seed(spark, sf_dir), ["x", "y", "z"], n, ALPHA, EPSILON), "x", "y", "z")


_SINK_START = f"w AS (SELECT {BUDGET_SQL.format(eps=EPSILON, gamma=1.0)} AS w FROM (SELECT count(*) AS n FROM nodes)), d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), s0 AS (SELECT c_custkey AS id, (c_acctbal / 10000 / (SELECT count(*) FROM customer)) * (SELECT w FROM w) AS r, 0.0::DOUBLE AS m FROM customer WHERE c_acctbal <> 0)"
_SINK_GRAPH = fx.SQL_CS.replace("e AS (", "e0 AS (", 1) + ", e AS (SELECT src, dst FROM e0 UNION ALL SELECT id, (SELECT count(*) FROM nodes) FROM nodes WHERE id NOT IN (SELECT src FROM e0))"


@query(push_sql(_SINK_GRAPH, _SINK_START, 3, 0.0) + f""", z AS (SELECT coalesce(sum(abs(r) + abs(m + {ALPHA} * r)), 0) / (SELECT w FROM w) AS lost FROM s3 WHERE id = (SELECT count(*) FROM nodes))
SELECT id, round(CASE WHEN id = (SELECT count(*) FROM nodes) THEN 0 ELSE (m + {ALPHA} * r) / (SELECT w FROM w) / (1 - (SELECT lost FROM z)) END, 9) + 0.0 AS x FROM s3""")
def sink_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    e = graph.with_sink(e, graph.node_table(e, n), n)
    c = fx.table(spark, sf_dir, "customer")
    budget = propagate.walk_budget(n, EPSILON)
    edges = propagate.two_ends(graph.weighted(e))
    state = propagate.start_state(edges, c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000 / c.count()).alias("x")), ["x"], budget)
    for _ in range(3):
        state = propagate.push_round(edges, state, ["x"], ALPHA, 0.0)
    return round9(propagate.closure(state, ["x"], ALPHA, budget, sink=n), "x")


_VEC_START = f"d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), w AS (SELECT {BUDGET_SQL.format(eps=16.0, gamma=1.0)} AS w FROM (SELECT count(*) AS n FROM nodes)), s0 AS (SELECT vec_id AS id, embedding[1]::DOUBLE * (SELECT w FROM w) AS r, 0.0::DOUBLE AS m FROM embeddings WHERE embedding[1] <> 0)"


@query(push_sql(CACHE_SQL, _VEC_START, 2).replace("WITH ", "WITH RECURSIVE ", 1) + f""", have AS (SELECT id, count(*) AS have FROM cache GROUP BY id),
v AS (SELECT s2.id, m, r, {1 - ALPHA} * r AS rest, least(ceil(abs({1 - ALPHA} * r)), coalesce(have, 0)) AS walks FROM s2 LEFT JOIN have ON s2.id = have.id),
t AS (SELECT id, m + {ALPHA} * r + CASE WHEN walks = 0 THEN rest ELSE 0 END AS value FROM v UNION ALL SELECT end_id, rest / walks FROM v JOIN cache USING (id) WHERE k < walks)
SELECT id, round(sum(value) / (SELECT w FROM w), 9) + 0.0 AS value FROM t GROUP BY id""")
def cached_walk_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds, then cached walks that go on until the coin stops them; tests hold it against the exact values."""
    e = fx.similar_vectors(spark, sf_dir)
    vec = fx.table(spark, sf_dir, "embeddings")
    budget = propagate.walk_budget(vec.count(), 16.0)
    edges = propagate.two_ends(graph.weighted(e))
    state = propagate.start_state(edges, vec.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x")), ["x"], budget)
    for _ in range(2):
        state = propagate.push_round(edges, state, ["x"], ALPHA)
    state = state.select("id", F.col("r_x").alias("r"), F.col("m_x").alias("m"))
    return round9(walks.cached_walk_estimate(state, walks.walk_cache(e, ALPHA), ALPHA, budget), "value")


@query()
def alias_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 draws by weight; tests hold each id's count against its share."""
    s = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return walks.alias_pick(s, 500)
