"""Queries of splits, scores, decomposition, the classifier and file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.operators import decomp, features, graph, model, propagate, reuse, splits
from prowave.session import checkpoint_dir
from prowave.sources import files

from . import fixtures as fx
from .graph_queries import LCG_SQL
from .registry import query

NODES = "n AS (SELECT vec_id AS id, label, {0} AS h0, {1} AS h1 FROM embeddings)".format(LCG_SQL.format("vec_id"), LCG_SQL.format("vec_id + 1"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


RANDOM_SQL = f"{NODES}, s AS (SELECT id, label, CASE WHEN turn <= 100 THEN 'train' WHEN turn <= 150 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY h0, id) AS turn FROM n))"


@query(f"WITH {RANDOM_SQL} SELECT id, split FROM s")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_random(_nodes(spark, sf_dir), 100, 50)


@query(f"""WITH {NODES}, t AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY h0, id) AS turn FROM n WHERE label IS NOT NULL) WHERE turn <= 20),
r AS (SELECT id, row_number() OVER (ORDER BY h1, id) AS turn FROM n WHERE id NOT IN (SELECT id FROM t))
SELECT id, 'train' AS split FROM t UNION ALL SELECT id, CASE WHEN turn <= 50 THEN 'val' ELSE 'test' END FROM r""")
def split_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_label(_nodes(spark, sf_dir), 20, 50)


@query(f"""WITH {NODES}, c AS (SELECT label, count(*) AS size, sum(count(*)) OVER (ORDER BY label) AS upto, sum(count(*)) OVER () AS total FROM n GROUP BY label),
k AS (SELECT label, floor(upto * 100.0::DOUBLE / total + 0.5) - floor((upto - size) * 100.0::DOUBLE / total + 0.5) AS a, floor(upto * 150.0::DOUBLE / total + 0.5) - floor((upto - size) * 150.0::DOUBLE / total + 0.5) AS b FROM c)
SELECT id, CASE WHEN turn <= a THEN 'train' WHEN turn <= b THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h0, id) AS turn FROM n) JOIN k USING (label)""")
def split_stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_stratified(_nodes(spark, sf_dir), 100, 50)


@query(f"WITH {RANDOM_SQL} SELECT id, split, (row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, id) - 1)::BIGINT AS row FROM s")
def split_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.reindex(splits.split_random(_nodes(spark, sf_dir), 100, 50))


@query(f"WITH {RANDOM_SQL} SELECT id FROM s WHERE split = 'test' OR label = 3")
def index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return splits.union(splits.split_random(nodes, 100, 50).filter("split = 'test'"), nodes.filter("label = 3"))


@query(f"WITH {RANDOM_SQL} SELECT id FROM s WHERE split <> 'train'")
def index_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return splits.difference(nodes, splits.split_random(nodes, 100, 50).filter("split = 'train'"))


@query("SELECT label, size, (SELECT max(label) + 1 FROM embeddings) AS classes FROM (SELECT label, count(*)::BIGINT AS size FROM embeddings GROUP BY label)")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    classes = nodes.agg(F.max("label") + 1).first()[0]
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("classes", F.lit(classes))


@query(f"WITH {RANDOM_SQL} SELECT split, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM s GROUP BY split")
def role_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.role_lists(splits.split_random(_nodes(spark, sf_dir), 100, 50)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT vec_id AS id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS hot FROM embeddings")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.one_hot(_nodes(spark, sf_dir), 10).withColumn("hot", F.array_join(F.col("hot").cast("array<string>"), ""))


@query("SELECT vec_id AS id, label, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INTEGER AS guess FROM embeddings")
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.slice("embedding", 1, 10)
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.array_position(top, F.array_max(top)) - 1).cast("int").alias("guess"))


GUESS_SQL = "p AS (SELECT vec_id AS id, unnest(range(10)) AS c, (unnest(range(10)) = label)::INTEGER AS hot, (unnest(embedding[1:10]) > 0.1)::INTEGER AS guess FROM embeddings)"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = splits.one_hot(_nodes(spark, sf_dir), 10)
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 10), lambda v: (v > F.lit(0.1)).cast("int")).alias("guess"))
    return hot.join(e, "id")


@query(f"WITH {GUESS_SQL}, s AS (SELECT sum(hot * guess)::BIGINT AS tp, sum((1 - hot) * guess)::BIGINT AS fp, sum(hot * (1 - guess))::BIGINT AS fn FROM p) SELECT *, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS micro_f1 FROM s")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.micro_f1(_guesses(spark, sf_dir)).withColumn("micro_f1", F.round("micro_f1", 9))


@query(f"WITH {GUESS_SQL}, s AS (SELECT id // 64 AS batch, count(DISTINCT id) AS size, sum(hot * guess) AS tp, sum((1 - hot) * guess) AS fp, sum(hot * (1 - guess)) AS fn FROM p GROUP BY 1) SELECT round(sum(size * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) / sum(size), 9) AS batch_f1 FROM s")
def batch_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.batch_f1(_guesses(spark, sf_dir), 64).withColumn("batch_f1", F.round("batch_f1", 9))


@query(f"""WITH {RANDOM_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS t FROM s)
SELECT 'n=' || n || ', m=' || (SELECT count(*) FROM lineitem) || ', F=64, C=' || (SELECT max(label) + 1 FROM embeddings) || ' | ' || printf('%d/%d/%d (%.2f%%/%.2f%%/%.2f%%)', a, b, t, a * 100.0::DOUBLE / n, b * 100.0::DOUBLE / n, t * 100.0::DOUBLE / n) AS summary FROM c""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    classes = nodes.agg(F.max("label") + 1).first()[0]
    return files.summary(nodes.count(), fx.count_of(spark, sf_dir, "lineitem"), 64, classes, splits.split_random(nodes, 100, 50))


@query()
def rsvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest singular values of all vectors; tests hold them against an exact decomposition."""
    s = decomp.singular_values(features.to_wide(fx.vectors(spark, sf_dir)), 8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "turn int, value double")


@query()
def rpca_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases by robust PCA and the others' weights on them."""
    return decomp.principal_bases(features.to_wide(fx.vectors(spark, sf_dir)), 3)[1]


@query()
def pca_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features by principal bases; tests hold it against plain pushing."""
    e, x = fx.similar_vectors(spark, sf_dir), fx.vectors(spark, sf_dir)
    n = fx.count_of(spark, sf_dir, "embeddings")
    bases, theta = decomp.principal_bases(features.to_wide(x), 3)
    kept = theta.filter(F.abs("theta") >= 1e-2)

    def reducer(long: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        return kept, reuse.reduce_by(theta, long.filter(~F.col("feat").isin(bases)).unionAll(long.filter(F.col("feat").isin(bases))), len(bases), n).filter(~F.col("feat").isin(bases))

    chosen = spark.createDataFrame([(b,) for b in bases], "feat int")
    return reuse.push_with_reuse(graph.weighted(e), x, n, 0.5, 16.0, reducer=reducer, bases=chosen).withColumn("value", F.round("value", 6))


@query()
def train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propagated vectors, rescaled by degree and standardised on training rows, classified by the skip MLP."""
    nodes, x = _nodes(spark, sf_dir), fx.vectors(spark, sf_dir)
    weights = graph.weighted(fx.similar_vectors(spark, sf_dir))
    columns = [f"x{i}" for i in range(64)]
    seeds = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    moved = propagate.fixed_depth(weights, seeds, columns, 0.5, 3)
    n = nodes.count()
    split = splits.split_stratified(nodes, int(n * 0.6), int(n * 0.2))
    long = moved.select("id", F.posexplode(F.array(*columns)).alias("feat", "value")).select("feat", "id", "value").join(split, "id")
    scaled = features.to_wide(features.clip_standardize(long, F.col("split") == "train"))
    rows = scaled.join(splits.one_hot(nodes, 10), "id").join(split, "id")
    a, b = (model.rows_of(rows.filter(F.col("split") == s)) for s in ("train", "val"))
    best, _ = model.train_mlp(*a, *b, model.SkipMLP(64, 64, 10, 2), epochs=20, patience=5, lr=0.005)
    return model.predict(rows.filter("split = 'test'"), best)


@query(f"WITH {fx.SQL_VEC} SELECT feat, id, round(value, 6) AS value FROM x")
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as npy row files and back; ids follow from each file's first id."""
    wide = features.to_wide(fx.vectors(spark, sf_dir)).repartitionByRange(4, "id")
    rows = files.npy_rows(wide)

    def back(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for first, data in zip(pdf["first_id"], pdf["data"], strict=True):
                a = files.parse_npy(bytes(data))
                at = np.arange(a.size)
                yield pd.DataFrame({"feat": (at % a.shape[1]).astype(np.int32), "id": first + at // a.shape[1], "value": a.reshape(-1).astype(np.float64)})

    return rows.mapInPandas(back, "feat int, id long, value double").withColumn("value", F.round("value", 6))


@query("SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem")
def edge_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as pairs of 64-bit numbers, and back."""
    import numpy as np

    data = files.edge_bytes(fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))

    def back(batches):
        import pandas as pd

        for pdf in batches:
            for d in pdf["data"]:
                pairs = np.frombuffer(bytes(d), "<u8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return data.mapInPandas(back, "src long, dst long")


@query(f"WITH {RANDOM_SQL} SELECT id, split FROM s")
def split_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split written as a partitioned table and read again."""
    path = f"{checkpoint_dir(spark)}/split-{uuid.uuid4().hex}"
    splits.split_random(_nodes(spark, sf_dir), 100, 50).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("id", "split")
