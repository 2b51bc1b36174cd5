"""Feature matrices: long ``(feat, id, value)`` or wide ``(id, embedding)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prowave.functions.scalar import clip, degree_power


def to_long(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("feat", "value")).select("feat", "id", "value")


def to_wide(long: DataFrame) -> DataFrame:
    """(id, embedding): a row's values in the order of their features."""
    return long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feat", "value"))).alias("x")).select("id", F.col("x.value").alias("embedding"))


def on_features(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Values beside their feature's statistics: one small row a feature, joined (and sent out, if its measured size allows)."""
    return long.join(stats, "feat")


def safe_std(std: Column) -> Column:
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def standardize(long: DataFrame, centre: bool = False) -> DataFrame:
    """Divided by the population deviation of the feature; a deviation of 0 counts as 1."""
    stats = long.groupBy("feat").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    value = (F.col("value") - F.col("mean") if centre else F.col("value")) / safe_std(F.col("std"))
    return on_features(long, stats).select("feat", "id", value.alias("value"))


def standardize_first_half(long: DataFrame, n: int) -> DataFrame:
    """Divided by the deviation of the first half of the rows; features constant there are left."""
    stats = long.filter(F.col("id") < n // 2).groupBy("feat").agg(F.stddev_pop("value").alias("std"))
    return on_features(long, stats).select("feat", "id", (F.col("value") / safe_std(F.col("std"))).alias("value"))


def sign_normalise(long: DataFrame) -> DataFrame:
    """Positive values of a feature sum to 1, negative ones to -1; sums of 0 count as 1."""
    stats = long.groupBy("feat").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("up"), F.sum(-F.least("value", F.lit(0.0))).alias("down"))
    value = F.when(F.col("value") > 0, F.col("value") / F.col("up")).when(F.col("value") < 0, F.col("value") / F.col("down")).otherwise(F.lit(0.0))
    return on_features(long, stats).select("feat", "id", value.alias("value"))


def clip_standardize(long: DataFrame, train: Column, k: float = 3.0, centre: bool = False) -> DataFrame:
    """Clipped to mean +- k deviations of the (unclipped) training rows, then divided by that deviation."""
    stats = long.filter(train).groupBy("feat").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    mean, std = F.col("mean"), safe_std(F.col("std"))
    held = clip(F.col("value"), mean - k * std, mean + k * std)
    return on_features(long, stats).select("feat", "id", ((held - mean if centre else held) / std).alias("value"))


def degree_scale(long: DataFrame, degrees: DataFrame, power: float, isolated_to_zero: bool = False) -> DataFrame:
    """Rows times a power of their node's degree."""
    d = degrees.select("id", degree_power(F.col("degree"), power, isolated_to_zero).alias("s"))
    return long.join(d, "id").select("feat", "id", (F.col("value") * F.col("s")).alias("value"))


def norms(long: DataFrame) -> DataFrame:
    """(feat, l1, l2)."""
    return long.groupBy("feat").agg(F.sum(F.abs("value")).alias("l1"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def matrix_norms(long: DataFrame) -> DataFrame:
    """One row: Frobenius, entrywise L1, largest column L1, largest entry."""
    by = long.groupBy("feat").agg(F.sum(F.abs("value")).alias("l1"), F.sum(F.col("value") * F.col("value")).alias("sq"), F.max(F.abs("value")).alias("top"))
    return by.agg(F.sqrt(F.sum("sq")).alias("fro"), F.sum("l1").alias("abs_sum"), F.max("l1").alias("max_col"), F.max("top").alias("inf"))


def gram(wide: DataFrame, width: int) -> DataFrame:
    """(i, j, p): products of all pairs i <= j of ``width`` features: one matrix product a batch, one row a pair and task."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        seen = False
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("x").to_numpy(zero_copy_only=False))[:, :width]
                total += x.T @ x
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    return wide.select(F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("p"))


def dense_wide(long: DataFrame, feats: list[int]) -> DataFrame:
    """(id, embedding): the values of ``feats`` in that order, 0 where there is none."""
    by = long.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feat", "value"))).alias("x"))
    return by.select("id", F.transform(F.array(*[F.lit(f) for f in feats]), lambda f: F.coalesce(F.try_element_at("x", f), F.lit(0.0))).alias("embedding"))


def l1_distances(long: DataFrame, a: int, b: int) -> DataFrame:
    """One row: the sum of absolute differences of two features."""
    two = long.filter(F.col("feat").isin(a, b)).groupBy("id").agg(F.sum(F.when(F.col("feat") == a, F.col("value")).otherwise(-F.col("value"))).alias("d"))
    return two.agg(F.sum(F.abs("d")).alias("l1_distance"))


def scatter(nodes: DataFrame, part: DataFrame) -> DataFrame:
    """Values known for some nodes as a value for every node; 0 for the others."""
    return nodes.join(part, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def row_blocks(wide: DataFrame, n: int, blocks: int = 10) -> DataFrame:
    """(id, block): equal runs of rows, the last takes the rest; for writing by partition."""
    return wide.withColumn("block", F.least(F.floor(F.col("id") / max(1, n // blocks)), F.lit(blocks - 1)).cast("int"))
