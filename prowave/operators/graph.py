"""Edges and nodes as DataFrames: ``edges(src, dst)``, ``nodes(id)``, ids from 0 to n - 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prowave.functions.scalar import lcg

BLOCK = 1 << 16
#: Nodes with more edges than this are ranked in parts.
HUB = 1 << 20


def clean_edges(edges: DataFrame, keep_loops: bool = True, dedup: bool = False) -> DataFrame:
    """Self-loops stay unless told otherwise, and so do parallel edges, which weigh a walk."""
    out = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    out = out if keep_loops else out.filter("src != dst")
    return out.distinct() if dedup else out


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src"))).distinct()


def node_table(edges: DataFrame, n: int | None = None) -> DataFrame:
    """All ids from 0 to n - 1; n is one more than the largest id unless given (trailing isolated nodes)."""
    if n is None:
        n = node_count(edges).first()["n"] or 0
    return edges.sparkSession.range(n).select(F.col("id"))


def node_count(edges: DataFrame) -> DataFrame:
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("n"), F.min(F.least("src", "dst")).alias("min_id"), F.count(F.lit(1)).alias("m"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node. One pass: both ends of an edge are counted by one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    every = ends.unionAll(nodes.select("id", F.lit(0), F.lit(0)))
    return every.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, dead ends (no way out), isolated nodes, largest out-degree."""
    d = degrees(edges, nodes)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("out_degree"), F.lit(0)).cast("long").alias("m"), count(F.col("out_degree") == 0).alias("dead_ends"), count((F.col("out_degree") == 0) & (F.col("in_degree") == 0)).alias("isolated"), F.max("out_degree").alias("max_out"))


def prefix_sum(df: DataFrame, key: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over smaller keys. Two levels, so no task has more than a block of keys or the block totals."""
    df = df.withColumns({"_v": value, "_b": F.floor(F.col(key) / block)})
    totals = df.groupBy("_b").agg(F.sum("_v").alias("_t"))
    base = totals.select(F.col("_b").alias("_of"), F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_v").over(W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_in", inside).join(base, F.col("_b") == F.col("_of")).withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_v", "_b", "_of", "_in", "_base")


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, out_offset, in_offset): where a node's neighbours begin; a node without any still takes one place on the way out."""
    d = degrees(edges, nodes)
    d = prefix_sum(d, "id", F.greatest("out_degree", F.lit(1)), "out_offset")
    return prefix_sum(d, "id", F.col("in_degree"), "in_offset").select("id", "out_offset", "in_offset")


def ranked(df: DataFrame, keys: list[str], part: Column, order: list, name: str) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its keys by (part, order). No task has more than one part of a key, or one key's parts."""
    df = df.withColumn("_p", part)
    totals = df.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), before.alias("_base"))
    inside = df.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)) - 1)
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return inside.join(base, same).withColumn(name, (F.col("_base") + F.col("_in")).cast("int")).drop("_p", "_q", "_in", "_base", *[f"_{i}" for i in range(len(keys))])


def _places(edges: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """Each edge's place among those of its ``key`` in the order of ``by``; hubs are ranked in parts of BLOCK ids of the other end."""
    hubs = edges.groupBy(F.col(key).alias("hub")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select("hub")
    few = edges.join(hubs, F.col(key) == F.col("hub"), "left_anti").withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(by)) - 1)
    many = edges.join(hubs, F.col(key) == F.col("hub"), "left_semi")
    return few.unionByName(ranked(many, [key], F.floor(F.col(by) / BLOCK), [by], name))


def adjacency_slots(edges: DataFrame) -> DataFrame:
    """(src, dst, slot): the place of each neighbour in its node's sorted list, from 0."""
    return _places(edges.select("src", "dst"), "src", "dst", "slot")


def reverse_index(edges: DataFrame) -> DataFrame:
    """(dst, src, turn): the appearances of each node as a neighbour, in order of where they come from."""
    return _places(edges.select("dst", "src"), "dst", "src", "turn")


def retarget(edges: DataFrame, old: int, new: int) -> DataFrame:
    """Every edge to ``old`` goes to ``new`` instead."""
    return edges.select("src", F.when(F.col("dst") == old, F.lit(new)).otherwise(F.col("dst")).alias("dst"))


def dead_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def rewire_dead_ends(edges: DataFrame, nodes: DataFrame, n: Column | int, seed: int = 0) -> DataFrame:
    """One edge from each dead end to a node picked by its id and the seed, whatever the partitioning."""
    n = F.lit(n) if isinstance(n, int) else n
    return edges.select("src", "dst").unionAll(dead_ends(edges, nodes).select(F.col("id").alias("src"), (lcg(F.col("id"), seed) % n).alias("dst")))


def with_sink(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Dead ends point to node ``n``, a sink of its own."""
    return edges.select("src", "dst").unionAll(dead_ends(edges, nodes).select(F.col("id").alias("src"), F.lit(n).cast("long").alias("dst")))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, degree, w) with w = 1 / out-degree, for propagation; the degree comes by a join, so a hub can be split."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return edges.join(degree, "src").select("src", "dst", "degree", (1 / F.col("degree")).alias("w"))
