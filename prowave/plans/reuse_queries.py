"""Queries of the feature-reuse operators, over all features of the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.operators import features, graph, reuse

from . import fixtures as fx
from .feature_queries import PAIRS_SQL
from .registry import query

X = f"WITH {fx.SQL_VEC}"
COUNT = 64
BASES_SQL = f"""{PAIRS_SQL}, near AS (SELECT i, arg_min(j, (dist, j)) AS j, min(dist) AS dist FROM pairs GROUP BY i),
bases AS (SELECT j AS feat, round(sum(abs(1 - dist)), 6) AS score FROM near GROUP BY j ORDER BY score DESC, feat LIMIT 3)"""


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = features.gram(fx.table(spark, sf_dir, "embeddings"), COUNT)
    return reuse.base_features(reuse.cosine_pairs(products), reuse.base_count(COUNT, 0.04))


@query(f"{X}, {BASES_SQL} SELECT feat, score FROM bases")
def base_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir)


_MEET = "m AS (SELECT a.feat, b.feat AS base, a.id, a.value AS v, b.value AS b FROM x a JOIN x b ON a.id = b.id AND a.feat > 0 AND b.feat = 0)"
_ACCEPT = "SELECT feat, base, round(CASE WHEN {test} THEN theta ELSE 0 END, 6) + 0.0 AS theta FROM (SELECT m.feat, m.base, theta, sum(abs(v)) AS before, sum(abs(v - theta * b)) AS after FROM m JOIN t ON m.feat = t.feat AND m.base = t.base GROUP BY ALL)"


def _on_first(spark: SparkSession) -> DataFrame:
    return spark.range(1, COUNT).select(F.col("id").cast("int").alias("feat"), F.lit(0).alias("base"))


def _round6(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 6) + 0.0)


@query(f"{X}, {_MEET}, t AS (SELECT feat, base, sum(v * b) / sum(b * b) AS theta FROM m GROUP BY feat, base) " + _ACCEPT.format(test="abs(theta) >= 0.0001 AND after <= before"))
def l2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(reuse.l2_residue(fx.vectors(spark, sf_dir), _on_first(spark)), "theta")


@query(f"""{X}, {_MEET}, q AS (SELECT *, v / b AS ratio FROM m WHERE b <> 0),
r AS (SELECT *, round(sum(abs(b)) OVER (PARTITION BY feat, base ORDER BY abs(ratio), id ROWS UNBOUNDED PRECEDING), 9) AS run FROM q),
t AS (SELECT feat, base, coalesce(arg_min(ratio, (run, ratio)) FILTER (WHERE run > 0.5), arg_max(ratio, (run, ratio))) AS theta FROM r GROUP BY feat, base) """ + _ACCEPT.format(test="after <= before"))
def l1_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(reuse.l1_residue(fx.vectors(spark, sf_dir), _on_first(spark)), "theta")


def _greedy_sql(passes: int) -> str:
    out = f"""{X}, {BASES_SQL}, base AS (SELECT feat AS base, id, value AS b FROM x WHERE feat IN (SELECT feat FROM bases)),
size AS (SELECT base, sum(b * b) AS bb FROM base GROUP BY base), r0 AS (SELECT feat, id, value FROM x WHERE feat NOT IN (SELECT feat FROM bases))"""
    for k in range(passes):
        out += f""", o{k} AS MATERIALIZED (SELECT feat, sum(value * value) AS vv, sum(abs(value)) AS before FROM r{k} GROUP BY feat),
p{k} AS MATERIALIZED (SELECT feat, arg_min(base, (dist, base)) AS base, arg_min(p / bb, (dist, base)) AS theta FROM (
  SELECT feat, base, p, bb, round(1 - abs(p / (sqrt(vv) * sqrt(bb))), 9) AS dist FROM (SELECT feat, base, sum(value * b) AS p FROM r{k} JOIN base USING (id) GROUP BY feat, base) JOIN size USING (base) JOIN o{k} USING (feat)) GROUP BY feat),
t{k} AS MATERIALIZED (SELECT feat, base, CASE WHEN abs(theta) >= 0.0001 AND after <= before THEN theta ELSE 0 END AS theta FROM (
  SELECT r.feat, p.base, p.theta, o.before, sum(abs(r.value - p.theta * b.b)) AS after FROM r{k} r JOIN p{k} p ON r.feat = p.feat JOIN base b ON b.base = p.base AND b.id = r.id JOIN o{k} o ON o.feat = r.feat GROUP BY ALL)),
r{k + 1} AS MATERIALIZED (SELECT r.feat, r.id, r.value - t.theta * b.b AS value FROM r{k} r JOIN t{k} t ON r.feat = t.feat JOIN base b ON b.base = t.base AND b.id = r.id)"""
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(passes))
    return out + f", theta AS (SELECT feat, base, sum(theta) AS theta FROM ({every}) GROUP BY feat, base)"


@query(_greedy_sql(5) + " SELECT feat, base, round(theta, 6) + 0.0 AS theta FROM theta")
def reuse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(reuse.greedy_weights(fx.vectors(spark, sf_dir), _bases(spark, sf_dir))[0], "theta")


@query(_greedy_sql(2) + """, f AS (SELECT feat, sum(abs(theta)) AS t FROM theta GROUP BY feat), l AS (SELECT feat, sum(abs(value)) AS l1 FROM r2 GROUP BY feat)
SELECT count(t)::BIGINT AS reused, round(avg(t), 6) + 0.0 AS mean_theta, round(avg(l1), 6) + 0.0 AS mean_residue FROM l LEFT JOIN f USING (feat)""")
def reuse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round6(_round6(reuse.reuse_stats(*reuse.greedy_weights(fx.vectors(spark, sf_dir), _bases(spark, sf_dir), 2)), "mean_theta"), "mean_residue")


THETA_SQL = "theta AS (SELECT f::INTEGER AS feat, b::INTEGER AS base, ((f * 7 + b * 3) % 11 - 5) / 50.0::DOUBLE AS theta FROM range(3, 64) t(f), range(0, 3) u(b))"


def _theta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, b, ((f * 7 + b * 3) % 11 - 5) / 50.0) for f in range(3, COUNT) for b in range(3)], "feat int, base int, theta double")


@query(f"{X}, {THETA_SQL}, s AS (SELECT t.feat, b.id, sum(theta * b.value) AS v FROM theta t JOIN x b ON b.feat = t.base WHERE theta <> 0 GROUP BY t.feat, b.id) SELECT x.feat, x.id, round(x.value + coalesce(s.v, 0), 6) + 0.0 AS value FROM x LEFT JOIN s ON x.feat = s.feat AND x.id = s.id")
def reuse_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.vectors(spark, sf_dir)
    return _round6(reuse.combine(x, _theta(spark), x), "value")


@query(f"""{X}, {THETA_SQL}, k AS (SELECT * FROM theta WHERE abs(theta) >= 0.05), n AS (SELECT count(*) AS n FROM embeddings),
s AS (SELECT k.feat, b.id, sum(theta * b.value) AS v FROM k JOIN x b ON b.feat = k.base GROUP BY k.feat, b.id),
l AS (SELECT x.feat, x.id, x.value - coalesce(s.v, 0) AS left_over FROM x LEFT JOIN s ON x.feat = s.feat AND x.id = s.id)
SELECT feat, id, round(CASE WHEN feat IN (SELECT feat FROM k) AND abs(left_over) < 3 / (n * sqrt(n)) THEN 0 ELSE left_over END, 6) + 0.0 AS value FROM l, n""")
def pca_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.count_of(spark, sf_dir, "embeddings")
    return _round6(reuse.reduce_by(_theta(spark), fx.vectors(spark, sf_dir), 3, n, 0.05), "value")


ALPHA, EPSILON, GAMMA, ROUNDS = 0.5, 16.0, 0.2, 40


def _long_push(name: str, seeds: str, gamma: str) -> str:
    """CTEs that push the (feat, id, value) rows of ``seeds`` with the budget of (feat, gamma) rows until nothing is active; ``name`` has (feat, id, value)."""
    budget = f"ceil((2 + 2.0::DOUBLE / 3 * {EPSILON}) * ln(n) * n / ({EPSILON}::DOUBLE * {EPSILON}) / greatest(gamma, 0.001))"
    out = f"""{name}_w AS MATERIALIZED (SELECT feat, {budget} AS w FROM ({gamma}), (SELECT count(*) AS n FROM nodes)),
{name}_s0 AS MATERIALIZED (SELECT feat, id, value * w AS r, 0.0::DOUBLE AS m FROM ({seeds}) JOIN {name}_w USING (feat))"""
    for k in range(ROUNDS):
        out += f""", {name}_a{k} AS MATERIALIZED (SELECT s.*, coalesce(degree, 0) AS degree, abs({1 - ALPHA} * r) >= coalesce(degree, 0) AND coalesce(degree, 0) > 0 AS hot FROM {name}_s{k} s LEFT JOIN d USING (id)),
{name}_s{k + 1} AS MATERIALIZED (SELECT feat, id, sum(r) AS r, sum(m) AS m FROM (
  SELECT feat, id, CASE WHEN hot THEN 0 ELSE r END AS r, m + CASE WHEN hot THEN {ALPHA} * r ELSE 0 END AS m FROM {name}_a{k}
  UNION ALL SELECT feat, e.dst, {1 - ALPHA} * r / degree, 0 FROM {name}_a{k} a JOIN e ON e.src = a.id WHERE hot) GROUP BY feat, id)"""
    return out + f", {name} AS (SELECT feat, id, (m + {ALPHA} * r) / w AS value FROM {name}_s{ROUNDS} JOIN {name}_w USING (feat))"


@query(
    _greedy_sql(5).replace(X, f"{X}, {fx.SQL_SV}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src)", 1)
    + ", "
    + _long_push("pb", "SELECT * FROM x WHERE feat IN (SELECT feat FROM bases)", f"SELECT feat, {GAMMA}::DOUBLE AS gamma FROM bases")
    + ", "
    + _long_push("po", "SELECT * FROM r5", f"SELECT feat, greatest(2 - {GAMMA}::DOUBLE * sum(abs(theta)), 0.001) AS gamma FROM theta GROUP BY feat")
    + """, every AS (SELECT * FROM po UNION ALL SELECT t.feat, b.id, theta * b.value FROM theta t JOIN pb b ON b.feat = t.base WHERE theta <> 0)
SELECT feat, id, round(sum(value), 6) + 0.0 AS value FROM every GROUP BY feat, id UNION ALL SELECT feat, id, round(value, 6) + 0.0 FROM pb"""
)
def reuse_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features by bases and residuals; the SQL unrolls more rounds than are needed, tests hold it against plain pushing."""
    e = fx.similar_vectors(spark, sf_dir)
    n = fx.count_of(spark, sf_dir, "embeddings")
    return _round6(reuse.push_with_reuse(graph.weighted(e), fx.vectors(spark, sf_dir), n, ALPHA, EPSILON, GAMMA), "value")
