"""Graphs, features and seeds made from the driver's tables, in DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from prowave.functions.scalar import lcg
from prowave.operators import features, graph
from prowave.session import table


def count_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def part_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Undirected part-supplier edges, and the number of nodes; a supplier's id follows the parts'."""
    parts = count_of(spark, sf_dir, "part")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst")).distinct()
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))  # one pass over the pairs, where a union takes two
    return pairs.select(both.alias("e")).select("e.*"), parts + count_of(spark, sf_dir, "supplier")


SQL_PS = """g AS (SELECT DISTINCT l_partkey AS p, (SELECT count(*) FROM part) + l_suppkey AS s FROM lineitem),
e AS (SELECT p AS src, s AS dst FROM g UNION ALL SELECT s, p FROM g),
nodes AS (SELECT unnest(range((SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)))::BIGINT AS id),
d AS (SELECT src AS id, count(*)::BIGINT AS degree FROM e GROUP BY src)"""


def customer_supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Directed edges from customers to suppliers, all of which are dead ends."""
    customers = count_of(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + customers).alias("dst")).distinct()
    return pairs, customers + count_of(spark, sf_dir, "supplier")


SQL_CS = """e AS (SELECT DISTINCT o_custkey AS src, (SELECT count(*) FROM customer) + l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT unnest(range((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)))::BIGINT AS id)"""


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who follows whom within an hour's events: a multigraph with self-loops."""
    e = table(spark, sf_dir, "events")
    following = F.lead("user_id").over(W.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("src"), following.alias("dst")).filter("dst is not null")


SQL_SU = """e AS (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
nodes AS (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e)))::BIGINT AS id)"""


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways from each vector to the next of its label and to one picked by its id."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    following = e.select(F.col("vec_id").alias("src"), F.lead("vec_id").over(W.partitionBy("label").orderBy("vec_id")).alias("dst")).filter("dst is not null")
    other = e.select(F.col("vec_id").alias("src"), (lcg(F.col("vec_id")) % n).alias("dst"))
    return graph.clean_edges(graph.symmetrize(following.unionAll(other)), keep_loops=False)


SQL_SV = """one AS (
  SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings
  UNION ALL SELECT vec_id, ((vec_id * 1103515245 + 12345) % 2147483648) // 128 % (SELECT count(*) FROM embeddings) FROM embeddings),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one) WHERE src <> dst AND src IS NOT NULL AND dst IS NOT NULL),
nodes AS (SELECT vec_id AS id FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.to_long(table(spark, sf_dir, "embeddings"))


SQL_VEC = """x AS (SELECT (generate_subscripts(embedding, 1) - 1)::INTEGER AS feat, vec_id AS id, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def supplier_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): signed seeds on suppliers and parts, scaled to be small."""
    parts = count_of(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + parts).alias("id"), (F.col("s_acctbal") / 10000).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"), F.when(F.col("p_size") > 25, -0.5).otherwise(0.25).alias("z"))
    return s.unionAll(p)


SQL_SEED = """seed AS (
  SELECT (SELECT count(*) FROM part) + s_suppkey AS id, s_acctbal / 10000 AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS z FROM supplier
  UNION ALL SELECT p_partkey, 0.0::DOUBLE, p_retailprice / 1000, CASE WHEN p_size > 25 THEN -0.5 ELSE 0.25 END::DOUBLE FROM part)"""
