"""From edges, features and labels to embeddings and a trained classifier.

    python -m prowave.run precompute --config c.json --edges E --features X --out O [--splits S] [--queries Q]
    python -m prowave.run train --config c.json --features X --labels L --edges E --out O [--splits S] [--dev]

Tables are Parquet: edges (src, dst) or a text edge list; features (id,
embedding); labels (id, label), where a label is a number or, for ``multil``, an
array with a 1 for each label; splits (id, split). Embeddings go to
``O/<algo>_<seed>/score_<alpha>_<epsilon>``, the model beside them. Without
stored splits the rule of the configuration makes them, and ``O/splits_<seed>``
keeps them.

With ``inductive`` the training nodes have embeddings of their own, made on the
graph among them alone: these train, those of the whole graph are for the rest.
"""

from __future__ import annotations

import argparse
import json
import resource
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .operators import decomp, features, graph, model, propagate, reuse, splits
from .session import cut_lineage
from .sources import files


class Phases(dict):
    """Seconds by phase."""

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self[name] = round(self.get(name, 0.0) + time.perf_counter() - began, 3)


def prepare(long: DataFrame, degrees: DataFrame, rrz: float) -> DataFrame:
    """Features times degree^(1 - rrz), then signed sums of 1 a feature."""
    return features.sign_normalise(features.degree_scale(long, degrees, 1 - rrz))


def restore(long: DataFrame, degrees: DataFrame, rrz: float) -> DataFrame:
    """Embeddings times degree^(rrz - 1); isolated nodes get 0."""
    return features.degree_scale(long, degrees, rrz - 1, isolated_to_zero=True)


def embeddings(edges: DataFrame, nodes: DataFrame, long: DataFrame, c: Config, block: int = 64, queries: DataFrame | None = None) -> DataFrame:
    """(feat, id, value) by the algorithm of ``c``. Plain pushing takes ``block`` features a job, so a state row stays small."""
    n = nodes.count()
    weights = graph.weighted(graph.rewire_dead_ends(graph.clean_edges(edges, keep_loops=False), nodes, n, c.seed))
    if queries is not None:
        long = long.join(queries.select("id"), "id", "left_semi")
    feats = [r["feat"] for r in long.select("feat").distinct().orderBy("feat").collect()]
    if c.algo == "featreuse":
        return reuse.push_with_reuse(weights, long, n, c.alpha, c.epsilon, c.gamma, c.base_ratio)
    if c.algo == "featpca":
        bases, theta = decomp.principal_bases(features.to_wide(long), reuse.base_count(len(feats), c.base_ratio), seed=c.seed)

        def reducer(values: DataFrame, _: DataFrame) -> tuple[DataFrame, DataFrame]:
            rest = reuse.reduce_by(theta, values, len(bases), n).filter(~F.col("feat").isin(bases))
            return theta.filter(F.abs("theta") >= 1e-2), rest

        chosen = long.sparkSession.createDataFrame([(b,) for b in bases], "feat int")
        return reuse.push_with_reuse(weights, long, n, c.alpha, c.epsilon, c.gamma, c.base_ratio, reducer, chosen)
    out: DataFrame | None = None
    for at in range(0, len(feats), block):
        part = feats[at : at + block]
        wide = features.dense_wide(long.filter(F.col("feat").isin(part)), part)
        wide = wide.select("id", *[F.get("embedding", F.lit(i)).alias(f"x{f}") for i, f in enumerate(part)])
        columns = [f"x{f}" for f in part]
        got = propagate.estimate(weights, wide, columns, n, c.alpha, c.epsilon, staged=c.staged)
        got = got.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("feat"), F.col(f"x{f}").alias("value")) for f in part])).alias("x")).select("x.feat", "id", "x.value")
        out = got if out is None else out.unionAll(got)
    return out if out is not None else long


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in ``nodes``."""
    ids = nodes.select(F.col("id").alias("of"))
    return edges.join(ids, F.col("src") == F.col("of"), "left_semi").join(ids, F.col("dst") == F.col("of"), "left_semi")


def out_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.degrees(graph.clean_edges(edges, keep_loops=False), nodes).select("id", F.col("out_degree").alias("degree"))


def precompute(edges: DataFrame, wide: DataFrame, c: Config, queries: DataFrame | None = None, split: DataFrame | None = None) -> dict[str, DataFrame]:
    """Embeddings (feat, id, value) by part: "" for the whole graph and, if inductive, "_train" for the training nodes' own."""

    def of(e: DataFrame, rows: DataFrame, asked: DataFrame | None) -> DataFrame:
        return embeddings(e, rows.select("id"), prepare(features.to_long(rows, "id"), out_degrees(e, rows.select("id")), c.rrz), c, queries=asked)

    out = {"": of(edges, wide, queries)}
    if c.inductive:
        if split is None:
            raise ValueError("inductive embeddings need a split")
        ids = split.filter("split = 'train'").select("id")
        # Propagation counts on ids from 0 to n - 1, so the training nodes are numbered anew for it.
        row = cut_lineage(graph.prefix_sum(ids, "id", F.lit(1), "row"))
        end = lambda c: row.select(F.col("id").alias(f"{c}_id"), F.col("row").alias(f"{c}_row"))
        inner = edges.join(end("src"), F.col("src") == F.col("src_id")).join(end("dst"), F.col("dst") == F.col("dst_id")).select(F.col("src_row").alias("src"), F.col("dst_row").alias("dst"))
        own = of(inner, wide.join(row, "id").drop("id").withColumnRenamed("row", "id"), None)
        out["_train"] = own.withColumnRenamed("id", "at").join(row, F.col("at") == F.col("row")).select("feat", "id", "value")
    return out


def train(
    long: DataFrame, degrees: DataFrame, labels: DataFrame, c: Config, split: DataFrame, own: tuple[DataFrame, DataFrame] | None = None, keep: Callable | None = None,
) -> tuple[model.SkipMLP, dict]:
    """(classifier, figures): embeddings restored, clipped and standardised on training rows; F1 on the three sets.

    ``own`` has the embeddings and degrees of the training nodes' own graph, if they train.
    """
    known = labels.filter("label is not null")
    classes = splits.classes_of(known)
    hot = splits.one_hot(known, classes)

    def rows(values: DataFrame, deg: DataFrame) -> DataFrame:
        held = restore(values, deg, c.rrz).join(split, "id")
        return features.to_wide(features.clip_standardize(held, F.col("split") == "train", centre=True)).join(hot, "id").join(split, "id")

    whole = rows(long, degrees)
    fitted = rows(*own) if own else whole
    sets = {"train": model.rows_of(fitted.filter("split = 'train'")), "val": model.rows_of(whole.filter("split = 'val'"))}
    net = model.SkipMLP(sets["train"][0].shape[1], c.hidden, classes, c.layer, c.dropout, c.bias, seed=c.seed)
    best, history = model.train_mlp(*sets["train"], *sets["val"], net, c.epochs, c.patience, c.batch, c.lr, c.weight_decay, c.multil, keep)
    figures = {s: model.f1(best.forward(x)[0], y, c.multil) for s, (x, y) in sets.items()}
    figures["test"] = splits.micro_f1(model.predict(whole.filter("split = 'test'"), best, c.multil)).first()["micro_f1"]
    return best, figures | {"epochs": len(history)}


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="prowave.run")
    p.add_argument("what", choices=("precompute", "train"))
    p.add_argument("--config")
    p.add_argument("--set", nargs="*", default=[], metavar="name=value", help="parameters over the file's")
    p.add_argument("--seed", type=int, help="over the file's")
    p.add_argument("--dev", action="store_true", help="keep the last and the best model of a run, and go on from the last")
    for name in ("edges", "features", "labels", "queries", "splits", "out"):
        p.add_argument(f"--{name}")
    a = p.parse_args(argv)
    over = {k: json.loads(v) if v[:1] in "0123456789-.tf" and not v.startswith("feat") else v for k, v in (x.split("=", 1) for x in a.set)} | ({} if a.seed is None else {"seed": a.seed})
    c = Config.load(a.config, **over) if a.config else Config().having(over)
    spark = SparkSession.builder.getOrCreate()
    took = Phases()
    with took.phase("read"):
        edges = files.read_edge_text(spark, a.edges) if a.edges.endswith(".txt") else spark.read.parquet(a.edges)
        wide = spark.read.parquet(a.features)
    path = f"{a.out}/{c.score_name()}"
    split = None
    if a.splits or a.labels:
        with took.phase("split"):
            stored = spark.read.parquet(a.splits) if a.splits else None
            known = spark.read.parquet(a.labels).filter("label is not null") if a.labels else None
            if stored is not None and c.split != "restratify":
                split = stored.select("id", "split")
            elif known is not None:
                n = known.count()
                split = files.save_if_missing(splits.split_by_rule(known, c.split, c.train or int(n * 0.6), c.val or int(n * 0.2), c.seed, stored), f"{a.out}/splits_{c.seed}")
    if a.what == "precompute":
        queries = files.read_queries(spark, a.queries, 0) if a.queries else None
        with took.phase("push"):
            found = precompute(edges, wide, c, queries, split)
        with took.phase("write"):
            for part, rows in found.items():
                rows.withColumn("value", F.col("value").cast("float")).write.mode("overwrite").parquet(f"{a.out}/{c.score_name(part)}")
        figures: dict = {"path": path}
    else:
        own = None
        if c.inductive:
            ids = split.filter("split = 'train'").select("id")
            own = _read(spark, f"{a.out}/{c.score_name('_train')}"), out_degrees(among(edges, ids), ids)
        kept = files.Models(spark, f"{path}.models") if a.dev else None
        with took.phase("train"):
            best, figures = train(_read(spark, path), out_degrees(edges, wide.select("id")), spark.read.parquet(a.labels), c, split, own, kept.save if kept else None)
        spark.createDataFrame([(best.dumps(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}.model")
    figures |= {"seconds": took, "peak_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)}
    files.append_log(spark, f"{a.out}/log", json.dumps({"what": a.what, "score": c.score_name()} | figures))
    print(json.dumps(figures))
    return figures


if __name__ == "__main__":
    main()
