"""Random walks with a portable generator: the same walks on any partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prowave.functions.scalar import LCG_M, lcg
from prowave.session import cut_lineage

from .graph import adjacency_slots

#: lcg() gives 24 bits.
_RANGE = float(LCG_M // 128)


def _draw(walk: Column, step: int, salt: int) -> Column:
    return lcg(walk * 31 + F.lit(step * 1009 + salt))


def walk_step(walks: DataFrame, slots: DataFrame, step: int, alpha: float | None = None) -> DataFrame:
    """(walk, cur, done) after one step: with chance ``alpha`` a walk stops (null: never), else it goes to a random neighbour.

    ``walks`` has (walk, cur, done), ``slots`` has (src, dst, slot, degree). A
    walk at a dead end stops there.
    """
    stop = F.lit(False) if alpha is None else _draw(F.col("walk"), step, 0) % int(_RANGE) < alpha * _RANGE
    w = walks.withColumn("done", F.col("done") | stop).withColumn("pick", _draw(F.col("walk"), step, 500))
    degree = slots.filter("slot = 0").select(F.col("src").alias("at"), "degree")
    w = w.join(degree, F.col("cur") == F.col("at"), "left").withColumn("done", F.col("done") | F.col("degree").isNull())
    w = w.withColumn("want", F.when(~F.col("done"), F.col("pick") % F.col("degree")))
    return w.join(slots.select("src", "dst", "slot"), (F.col("cur") == F.col("src")) & (F.col("want") == F.col("slot")), "left").select("walk", F.coalesce("dst", "cur").alias("cur"), "done")


def slots_with_degree(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy(F.col("src").alias("of")).agg(F.count(F.lit(1)).alias("degree"))
    s = adjacency_slots(edges)
    return s.join(degree, s["src"] == degree["of"]).select("src", "dst", "slot", "degree")


def coin(step: Column | int, salt: str) -> Column:
    """A number from 0 to 2^32 - 1 for a step of the walk (id, k), independent of all others: lcg() draws of successive steps aren't."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", "id", "k", F.lit(step).cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")


def walk_cache(edges: DataFrame, alpha: float) -> DataFrame:
    """(id, k, end_id): as many walks from each node as it has neighbours. Each makes a hop, and further ones until the coin stops it or it is at a dead end.

    A round moves the walks that are still open, and writes them; the others
    have ended. Walks are known by their node and number, whatever the degree.
    """
    if not 0 < alpha <= 1:
        raise ValueError("walks need a chance to stop")
    slots = cut_lineage(slots_with_degree(edges))
    degree = slots.filter("slot = 0").select(F.col("src").alias("at"), "degree")
    hop = slots.select("src", F.col("slot").cast("long").alias("place"), "dst")
    open_, ended, step = slots.select(F.col("src").alias("id"), F.col("slot").alias("k"), F.col("src").alias("cur"), "degree"), None, 0
    while True:
        moved = open_.withColumn("want", coin(step, "hop") % F.col("degree")).join(hop, (F.col("cur") == F.col("src")) & (F.col("want") == F.col("place"))).select("id", "k", F.col("dst").alias("cur"))
        stops = coin(step, "stop") < int(alpha * (1 << 32))
        after = cut_lineage(moved.join(degree, F.col("cur") == F.col("at"), "left").select("id", "k", "cur", "degree", (stops | F.col("degree").isNull()).alias("done")))
        some = after.filter("done").select("id", "k", F.col("cur").alias("end_id"))
        ended = some if ended is None else ended.unionAll(some)
        open_, step = after.filter("not done").drop("done"), step + 1
        if open_.isEmpty():
            return ended


def cached_walk_estimate(state: DataFrame, cache: DataFrame, alpha: float, budget: float) -> DataFrame:
    """(id, value) from (id, r, m): a step's closure, then ceil(|rest|) cached walks of each node, each with its signed share of the rest.

    Where fewer walks are cached they share it; a node without any keeps it. So
    values sum to what the state holds.
    """
    rest = (1 - alpha) * F.col("r")
    have = cache.groupBy(F.col("id").alias("of")).agg(F.count(F.lit(1)).alias("have"))
    s = state.join(have, F.col("id") == F.col("of"), "left").drop("of").withColumns({"rest": rest, "walks": F.least(F.ceil(F.abs(rest)), F.coalesce("have", F.lit(0)))})
    taken = s.filter("walks > 0").join(cache.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).filter(F.col("k") < F.col("walks"))
    shares = taken.select(F.col("end_id").alias("id"), (F.col("rest") / F.col("walks")).alias("value"))
    own = s.select("id", (F.col("m") + alpha * F.col("r") + F.when(F.col("walks") == 0, F.col("rest")).otherwise(F.lit(0.0))).alias("value"))
    return own.unionAll(shares).groupBy("id").agg((F.sum("value") / budget).alias("value"))


def alias_pick(weights: DataFrame, count: int) -> DataFrame:
    """(pick, id, sign): ``count`` draws with chances by |weight|, by the inverse of the running sum in fixed buckets.

    Draw i lies at (i + u) / count of the whole, so each id's share is met within
    one draw. Ids are found by the draw's range, without a table of aliases.
    """
    from .graph import prefix_sum

    scale = 1 << 20
    w = weights.filter("value != 0").withColumn("size", F.ceil(F.abs("value") * scale).cast("long"))
    w = prefix_sum(w, "id", F.col("size"), "before")
    total = w.agg(F.sum("size").alias("t")).first()["t"] or 0
    if not total:
        return w.select(F.lit(0).cast("long").alias("pick"), "id", F.signum("value").alias("sign")).limit(0)
    step = total / count
    first, last = F.ceil((F.col("before") / step) - F.lit(0.5)), F.ceil(((F.col("before") + F.col("size")) / step) - F.lit(0.5)) - 1
    return w.filter(last >= first).select(F.explode(F.sequence(first, last)).alias("pick"), "id", F.signum("value").alias("sign"))
