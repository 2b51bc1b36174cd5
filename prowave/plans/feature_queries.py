"""Queries of the feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.functions.scalar import soft_shrink
from prowave.operators import features, reuse

from . import fixtures as fx
from .registry import query

X = f"WITH {fx.SQL_VEC}"
R = lambda c="value": F.round(c, 6).alias(c)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[R(c) if c in names else F.col(c) for c in df.columns])


@query(f"{X} SELECT feat, id, round(value, 6) AS value FROM x")
def feat_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fx.vectors(spark, sf_dir), "value")


@query(f"{X} SELECT id, len(list(value)) AS width, round(sum(value), 6) AS total FROM x GROUP BY id")
def feat_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.to_wide(fx.vectors(spark, sf_dir))
    return w.select("id", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query(f"{X}, s AS (SELECT feat, stddev_pop(value) AS std FROM x GROUP BY feat) SELECT feat, id, round(value / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS value FROM x JOIN s USING (feat)")
def feat_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.standardize(fx.vectors(spark, sf_dir)), "value")


@query(f"{X}, s AS (SELECT feat, stddev_pop(value) AS std FROM x WHERE id < (SELECT count(*) FROM embeddings) // 2 GROUP BY feat) SELECT feat, id, round(value / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS value FROM x JOIN s USING (feat)")
def half_row_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.standardize_first_half(fx.vectors(spark, sf_dir), fx.count_of(spark, sf_dir, "embeddings")), "value")


@query(f"{X}, s AS (SELECT feat, sum(greatest(value, 0)) AS up, -sum(least(value, 0)) AS down FROM x GROUP BY feat) SELECT feat, id, round(CASE WHEN value > 0 THEN value / up WHEN value < 0 THEN value / down ELSE 0 END, 6) AS value FROM x JOIN s USING (feat)")
def feat_sign_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.sign_normalise(fx.vectors(spark, sf_dir)), "value")


@query(f"""{X}, s AS (SELECT feat, avg(value) AS mean, stddev_pop(value) AS sd FROM x WHERE id % 4 <> 0 GROUP BY feat),
t AS (SELECT feat, mean, CASE WHEN sd = 0 THEN 1 ELSE sd END AS std FROM s)
SELECT feat, id, round(least(greatest(value, mean - 3 * std), mean + 3 * std) / std, 6) AS value FROM x JOIN t USING (feat)""")
def feat_clip_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.clip_standardize(fx.vectors(spark, sf_dir), F.col("id") % 4 != 0), "value")


@query(f"""WITH {fx.SQL_SV}, {fx.SQL_VEC}, d AS (SELECT n.id, count(e.src) AS degree FROM nodes n LEFT JOIN e ON n.id = e.src GROUP BY n.id)
SELECT feat, id, round(value * CASE WHEN degree = 0 THEN 0 ELSE pow(greatest(degree::DOUBLE, 1e-12), -0.5) END, 6) AS value FROM x JOIN d USING (id)""")
def degree_pow_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.similar_vectors(spark, sf_dir)
    nodes = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    d = nodes.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return _rounded(features.degree_scale(fx.vectors(spark, sf_dir), d, -0.5, isolated_to_zero=True), "value")


@query(f"{X} SELECT feat, round(sum(abs(value)), 6) AS l1, round(sqrt(sum(value * value)), 6) AS l2 FROM x GROUP BY feat")
def l1_l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.norms(fx.vectors(spark, sf_dir)), "l1", "l2")


@query(f"{X}, f AS (SELECT feat, sum(abs(value)) AS l1, sum(value * value) AS sq, max(abs(value)) AS top FROM x GROUP BY feat) SELECT round(sqrt(sum(sq)), 6) AS fro, round(sum(l1), 6) AS abs_sum, round(max(l1), 6) AS max_col, round(max(top), 6) AS inf FROM f")
def matrix_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.matrix_norms(fx.vectors(spark, sf_dir)), "fro", "abs_sum", "max_col", "inf")


@query(f"{X} SELECT round(sum(abs(a.value - b.value)), 6) AS l1_distance FROM x a JOIN x b USING (id) WHERE a.feat = 0 AND b.feat = 1")
def l1_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.l1_distances(fx.vectors(spark, sf_dir), 0, 1), "l1_distance")


@query(f"{X} SELECT a.feat AS i, b.feat AS j, round(sum(a.value * b.value), 6) AS p FROM x a JOIN x b ON a.id = b.id AND a.feat <= b.feat GROUP BY 1, 2")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.gram(fx.table(spark, sf_dir, "embeddings"), 64), "p")


PAIRS_SQL = """sq AS (SELECT feat, sum(value * value) AS s FROM x GROUP BY feat HAVING sum(value * value) > 0),
pairs AS (SELECT i, j, round(1 - abs(p / (sqrt(a.s) * sqrt(b.s))), 9) AS dist FROM (
  SELECT a.feat AS i, b.feat AS j, sum(a.value * b.value) AS p FROM x a JOIN x b ON a.id = b.id AND a.feat <> b.feat GROUP BY 1, 2)
  JOIN sq a ON a.feat = i JOIN sq b ON b.feat = j)"""


@query(f"{X}, {PAIRS_SQL} SELECT i, j, round(dist, 6) AS dist FROM pairs")
def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reuse.cosine_pairs(features.gram(fx.table(spark, sf_dir, "embeddings"), 64)), "dist")


@query(f"WITH {fx.SQL_PS} SELECT n.id, coalesce(s_acctbal, 0.0) AS value FROM nodes n LEFT JOIN supplier ON n.id = (SELECT count(*) FROM part) + s_suppkey")
def query_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.count_of(spark, sf_dir, "part")
    s = fx.table(spark, sf_dir, "supplier")
    n = parts + s.count()
    return features.scatter(spark.range(n), s.select((F.col("s_suppkey") + parts).alias("id"), F.col("s_acctbal").alias("value")))


@query(f"{X} SELECT feat, id, round(least(value + 0.1, 0) + greatest(value - 0.1, 0), 6) AS value FROM x")
def soft_shrink_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.vectors(spark, sf_dir).select("feat", "id", F.round(soft_shrink(F.col("value"), 0.1), 6).alias("value"))


@query("SELECT vec_id AS id, least(vec_id // greatest(1, (SELECT count(*) FROM embeddings) // 10), 9)::INTEGER AS block FROM embeddings")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return features.row_blocks(e, fx.count_of(spark, sf_dir, "embeddings"))


@query(f"{X}, f AS (SELECT feat, round(sum(abs(value)), 6) AS l1 FROM x GROUP BY feat), k AS (SELECT * FROM f ORDER BY l1, feat LIMIT 5) SELECT feat, l1, row_number() OVER (ORDER BY l1 DESC, feat DESC)::INTEGER AS turn FROM k")
def arg_kmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _rounded(features.norms(fx.vectors(spark, sf_dir)).select("feat", "l1"), "l1")
    return reuse.arg_kmin(n, "feat", "l1", 5)


@query(f"{X} SELECT feat, id, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feat)::INTEGER AS turn FROM x")
def abs_decsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.by_abs_desc(fx.vectors(spark, sf_dir), "feat", "value", ["id"]).select("feat", "id", "turn")
