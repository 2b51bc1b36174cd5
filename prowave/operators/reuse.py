"""Feature reuse: push a few base features well, and the others as combinations of them plus a residual."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prowave.session import cut_lineage

from . import propagate
from .decomp import summed
from .features import dense_wide, gram, to_wide

PASSES = 5
LEAST_WEIGHT = 1e-4


def cosine_pairs(products: DataFrame, digits: int = 9) -> DataFrame:
    """(i, j, dist) of all i != j from products of pairs i <= j: 1 - |cos|; features without values have no distance."""
    own = products.filter("i = j").select(F.col("i").alias("f"), F.col("p").alias("sq")).filter("sq > 0")
    both = products.filter("i < j").select("i", "j", "p")
    both = both.unionAll(both.select(F.col("j"), F.col("i"), "p"))
    a, b = own.select(F.col("f").alias("i"), F.col("sq").alias("si")), own.select(F.col("f").alias("j"), F.col("sq").alias("sj"))
    return both.join(a, "i").join(b, "j").select("i", "j", F.round(1 - F.abs(F.col("p") / (F.sqrt("si") * F.sqrt("sj"))), digits).alias("dist"))


def base_features(pairs: DataFrame, count: int) -> DataFrame:
    """(feat, score): the features that are nearest to most others, by the closeness they are nearest with; ties to the smaller id.

    Fewer come back if fewer are anyone's nearest.
    """
    near = pairs.groupBy("i").agg(F.min(F.struct("dist", "j")).alias("near"))
    votes = near.groupBy(F.col("near.j").alias("feat")).agg(F.round(F.sum(F.abs(1 - F.col("near.dist"))), 6).alias("score"))
    return votes.orderBy(F.desc("score"), "feat").limit(count)


def base_count(features: int, ratio: float) -> int:
    return max(3, int(features * ratio))


def arg_kmin(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, value, turn) of the k smallest values, the largest of them first; ties to the smaller key."""
    least = df.orderBy(value, key).limit(k)
    return least.select(key, value, F.row_number().over(W.orderBy(F.desc(value), F.desc(key))).alias("turn"))


def by_abs_desc(df: DataFrame, key: str, value: str, within: list[str]) -> DataFrame:
    """(…, turn) in order of falling absolute value among the rows of equal ``within``."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(*within).orderBy(F.desc(F.abs(value)), key)))


def accepts(theta: Column, before: Column, after: Column) -> Column:
    """Whether a projection is taken: a weight that counts, and no growth of the residual's L1 norm."""
    return (F.abs(theta) >= LEAST_WEIGHT) & (after <= before)


def l2_residue(long: DataFrame, bases: DataFrame) -> DataFrame:
    """(feat, base, theta) of the L2 projection of each feature on one base; 0 where it isn't taken.

    ``long`` has (feat, id, value), ``bases`` (feat, base): which base each feature meets.
    """
    met = long.join(bases, "feat").join(long.select(F.col("feat").alias("base"), "id", F.col("value").alias("b")), ["base", "id"])
    theta = met.groupBy("feat", "base").agg((F.sum(F.col("value") * F.col("b")) / F.sum(F.col("b") * F.col("b"))).alias("theta"))
    sums = met.join(theta, ["feat", "base"]).groupBy("feat", "base", "theta").agg(F.sum(F.abs("value")).alias("before"), F.sum(F.abs(F.col("value") - F.col("theta") * F.col("b"))).alias("after"))
    return sums.select("feat", "base", F.when(accepts(F.col("theta"), F.col("before"), F.col("after")), F.col("theta")).otherwise(F.lit(0.0)).alias("theta"))


def l1_residue(long: DataFrame, bases: DataFrame) -> DataFrame:
    """(feat, base, theta): the ratio at which the base's absolute values, in order of |ratio|, pass a half in sum; 0 if the residual would grow."""
    met = long.join(bases, "feat").join(long.select(F.col("feat").alias("base"), "id", F.col("value").alias("b")), ["base", "id"])
    ratio = met.filter("b != 0").withColumn("ratio", F.col("value") / F.col("b"))
    run = ratio.withColumn("run", F.round(F.sum(F.abs("b")).over(W.partitionBy("feat", "base").orderBy(F.abs("ratio"), "id")), 9))
    theta = run.groupBy("feat", "base").agg(F.min(F.when(F.col("run") > 0.5, F.struct("run", "ratio"))).alias("hit"), F.max(F.struct("run", "ratio")).alias("end")).select("feat", "base", F.coalesce("hit", "end")["ratio"].alias("theta"))
    sums = met.join(theta, ["feat", "base"]).groupBy("feat", "base", "theta").agg(F.sum(F.abs("value")).alias("before"), F.sum(F.abs(F.col("value") - F.col("theta") * F.col("b"))).alias("after"))
    return sums.select("feat", "base", F.when(F.col("after") > F.col("before"), F.lit(0.0)).otherwise(F.col("theta")).alias("theta"))


def greedy_weights(long: DataFrame, bases: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(feat, base, theta) and the residual features (feat, id, value): in each pass every feature gives its projection on the nearest base away.

    Rows are written once in wide form. A pass is two scans of them: all products
    of features and bases, then the residuals' norms; features x bases numbers
    come to the driver, and the residual is always the input less bases x weights.
    """
    spark = long.sparkSession
    chosen = sorted(r["feat"] for r in bases.select("feat").distinct().collect())
    others = sorted(r["feat"] for r in long.select("feat").distinct().collect() if r["feat"] not in set(chosen))
    schema = "feat int, base int, theta double"
    if not others or not chosen:
        return spark.createDataFrame([], schema), long.filter(~F.col("feat").isin(chosen))
    k = len(chosen)
    wide = cut_lineage(dense_wide(long, [*chosen, *others]))
    total = np.zeros((k, len(others)))
    met: dict[tuple[int, int], float] = {}

    def rest(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return x[:, k:] - x[:, :k] @ theta

    for _ in range(passes):
        got = summed(wide, ["embedding"], lambda x, t=total: np.concatenate([x[:, :k].T @ (r := rest(x, t)), (r**2).sum(0)[None], np.abs(r).sum(0)[None], np.broadcast_to((x[:, :k] ** 2).sum(0)[:, None], (k, r.shape[1]))]))
        if not len(got):
            break
        got = got.reshape(2 * k + 2, -1)
        dots, vv, before, bb = got[:k], got[k], got[k + 1], got[k + 2 :, 0]
        good = (bb[:, None] > 0) & (vv > 0)
        dist = np.where(good, np.round(1 - np.abs(dots / np.sqrt(np.where(good, vv * bb[:, None], 1))), 9), np.inf)
        near = dist.argmin(0)
        at = np.flatnonzero(good.any(0))
        move = np.zeros_like(total)
        move[near[at], at] = dots[near[at], at] / bb[near[at]]
        after = summed(wide, ["embedding"], lambda x, t=total + move: np.abs(rest(x, t)).sum(0))
        took = (np.abs(move).sum(0) >= LEAST_WEIGHT) & (after <= before)
        move *= took
        total = total + move
        for f in at.tolist():
            key = (others[f], chosen[near[f]])
            met[key] = met.get(key, 0.0) + float(move[near[f], f])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = rest(np.stack(b.column("embedding").to_numpy(zero_copy_only=False)), total)
                ids = b.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.array(others, np.int32), len(ids))), pa.array(np.repeat(ids, len(others))), pa.array(r.reshape(-1))], names=["feat", "id", "value"])

    weights = spark.createDataFrame([(f, b, t) for (f, b), t in sorted(met.items())], schema)
    return weights, wide.mapInArrow(left, "feat int, id long, value double")


def reduce_by(theta: DataFrame, long: DataFrame, base_size: int, n: int, least: float = 1e-2) -> DataFrame:
    """Residual features for given weights (feat, base, theta): small weights go; where any is left, small residuals become 0."""
    kept = theta.filter(F.abs("theta") >= least)
    base = long.select(F.col("feat").alias("base"), "id", F.col("value").alias("b"))
    taken = kept.join(base, "base").groupBy("feat", "id").agg(F.sum(F.col("theta") * F.col("b")).alias("t"))
    left = F.col("value") - F.coalesce("t", F.lit(0.0))
    floor = base_size / (n * n**0.5)
    any_left = kept.select("feat", F.lit(True).alias("some")).distinct()
    out = long.join(taken, ["feat", "id"], "left").join(any_left, "feat", "left")
    return out.select("feat", "id", F.when(F.coalesce("some", F.lit(False)) & (F.abs(left) < floor), F.lit(0.0)).otherwise(left).alias("value"))


def combine(estimates: DataFrame, weights: DataFrame, base_results: DataFrame) -> DataFrame:
    """(feat, id, value): each feature's own estimate and its share of the bases' results."""
    shares = weights.filter("theta != 0").join(base_results.select(F.col("feat").alias("base"), "id", F.col("value").alias("b")), "base").select("feat", "id", (F.col("theta") * F.col("b")).alias("value"))
    return estimates.select("feat", "id", "value").unionAll(shares).groupBy("feat", "id").agg(F.sum("value").alias("value"))


def reuse_stats(weights: DataFrame, rest: DataFrame) -> DataFrame:
    """One row: how many features were reduced, their mean sum of absolute weights, and their residuals' mean L1 norm."""
    by = weights.groupBy(F.col("feat").alias("of")).agg(F.sum(F.abs("theta")).alias("t"))
    left = rest.groupBy("feat").agg(F.sum(F.abs("value")).alias("l1"))
    return left.join(by, F.col("feat") == F.col("of"), "left").agg(F.count("t").alias("reused"), F.avg("t").alias("mean_theta"), F.avg("l1").alias("mean_residue"))


Reducer = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def push_with_reuse(weights: DataFrame, long: DataFrame, n: int, alpha: float, epsilon: float, gamma: float = 0.2, ratio: float = 0.04, reducer: Reducer = greedy_weights, bases: DataFrame | None = None) -> DataFrame:
    """(feat, id, value) for all features: bases with a budget of 1 / gamma, the rest reduced by ``reducer`` and pushed cheaply.

    A reduced feature's budget is that of its own sum of weights; all columns
    move in one job, and the divisor stays positive whatever the weights.
    """
    feats = [r["feat"] for r in long.select("feat").distinct().orderBy("feat").collect()]
    if bases is None:
        bases = base_features(cosine_pairs(gram(to_wide(long), len(feats))), base_count(len(feats), ratio))
    bases = cut_lineage(bases.select("feat"))
    chosen = {r["feat"] for r in bases.collect()}

    def pushed(values: DataFrame, names: list[int], gammas: dict[int, float]) -> DataFrame:
        wide = dense_wide(values.filter(F.col("feat").isin(names)), names)
        wide = wide.select("id", *[F.get("embedding", F.lit(i)).alias(f"x{f}") for i, f in enumerate(names)])
        out = propagate.estimate(weights, wide, [f"x{f}" for f in names], n, alpha, epsilon, {f"x{f}": g for f, g in gammas.items()})
        return out.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("feat"), F.col(f"x{f}").alias("value")) for f in names])).alias("x")).select("x.feat", "id", "x.value")

    base_results = cut_lineage(pushed(long, sorted(chosen), {f: gamma for f in chosen}))
    others = [f for f in feats if f not in chosen]
    if not others:
        return base_results
    theta, rest = reducer(long, bases)
    sums = {r["feat"]: r["t"] for r in theta.groupBy("feat").agg(F.sum(F.abs("theta")).alias("t")).collect()}
    estimates = pushed(rest, others, {f: max(2 - gamma * sums.get(f, 0.0), 1e-3) for f in others})
    return combine(estimates, theta, base_results).unionAll(base_results)
