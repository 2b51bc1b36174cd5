"""Deterministic splits: who is in which set depends on ids and the seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from prowave.functions.scalar import lcg

from .graph import prefix_sum, ranked


def _key(seed: int) -> Column:
    return lcg(F.col("id"), seed)


def _turn(df: DataFrame, by: list[str], seed: int, name: str) -> DataFrame:
    """``df`` with each row's place, from 1, in pseudo-random order among those of equal ``by``, in 4,096 parts of a label."""
    return ranked(df, by, F.shiftright(_key(seed), 12), [_key(seed), "id"], name).withColumn(name, F.col(name) + 1)


def _cutoff(df: DataFrame, k: int, seed: int) -> Column:
    """Whether a row is among the first k in pseudo-random order: a histogram of 65,536 parts, then an order inside the part where the k-th is."""
    if k <= 0:
        return F.lit(False)
    part = F.shiftright(_key(seed), 8)
    upto = 0
    for r in sorted(df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if upto + r["n"] >= k:
            own = F.struct(_key(seed).alias("key"), F.col("id").alias("id"))
            last = df.filter(part == r["part"]).select(own.alias("x")).orderBy("x").limit(k - upto).agg(F.max("x").alias("x")).first()["x"]
            return own <= F.struct(F.lit(last["key"]).alias("key"), F.lit(last["id"]).alias("id"))
        upto += r["n"]
    return F.lit(True)


def split_random(nodes: DataFrame, train: int, val: int, seed: int = 0) -> DataFrame:
    """(id, split): exactly ``train`` and ``val`` rows (or all there are), the rest for test."""
    return nodes.select("id", F.when(_cutoff(nodes, train, seed), "train").when(_cutoff(nodes, train + val, seed), "val").otherwise("test").alias("split"))


def split_by_label(nodes: DataFrame, per_class: int, val: int, seed: int = 0) -> DataFrame:
    """(id, split): up to ``per_class`` rows of each label for training, ``val`` of the rest; rows without a label can't train.

    ``label`` is a number, or an array that has a positive number at each label
    of a row; then a row may be drawn for several labels and trains once.
    """
    if isinstance(nodes.schema["label"].dataType, T.ArrayType):
        each = nodes.select("id", F.posexplode("label").alias("label", "on")).filter("on > 0").drop("on")
    else:
        each = nodes.filter(F.col("label").isNotNull() & ~F.isnan(F.col("label").cast("double")))
    train = _turn(each, ["label"], seed, "turn").filter(F.col("turn") <= per_class).select("id").distinct()
    rest = nodes.select("id").join(train, "id", "left_anti")
    return train.withColumn("split", F.lit("train")).unionAll(rest.select("id", F.when(_cutoff(rest, val, seed + 1), "val").otherwise("test").alias("split")))


def split_stratified(nodes: DataFrame, train: int, val: int, seed: int = 0) -> DataFrame:
    """(id, split): each label gives its share of ``train`` and ``val``, by largest remainders so that the sums are met."""
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    every = W.partitionBy(F.lit(0))
    s = sizes.withColumn("n", F.sum("size").over(every))
    cuts = s.select("label", _share(F.col("size"), F.col("n"), train, "size").alias("to_train"), _share(F.col("size"), F.col("n"), train + val, "size").alias("to_val"))
    t = _turn(nodes, ["label"], seed, "turn").join(cuts.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return t.select("id", F.when(F.col("turn") <= F.col("to_train"), "train").when(F.col("turn") <= F.col("to_val"), "val").otherwise("test").alias("split"))


def _share(size: Column, n: Column, wanted: int, tie: str) -> Column:
    """A label's whole rows of ``wanted``: the difference of rounded running sums, which end at ``wanted``."""
    upto = F.sum(size).over(W.partitionBy(F.lit(0)).orderBy("label").rowsBetween(W.unboundedPreceding, 0))
    passed = lambda x: F.floor(x * F.lit(float(wanted)) / n + F.lit(0.5))
    return (passed(upto) - passed(upto - size)).cast("long")


def split_by_rule(nodes: DataFrame, rule: str, train: int, val: int, seed: int = 0, stored: DataFrame | None = None) -> DataFrame:
    """(id, split) by the named rule. ``restratify`` deals the stored split's nodes anew, with its sizes, by label; ``by_label`` takes ``train`` rows a label."""
    if rule == "restratify":
        if stored is None:
            raise ValueError("restratify needs a stored split")
        sizes = {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()}
        return split_stratified(nodes.join(stored.select("id"), "id", "left_semi"), sizes.get("train", 0), sizes.get("val", 0), seed)
    if stored is not None:
        return stored.select("id", "split")
    return {"stratified": split_stratified, "random": split_random, "by_label": split_by_label}[rule](nodes, train, val, seed)


def sample_nodes(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k ids (or all) in pseudo-random order; the same ones on any partitioning."""
    return nodes.select("id").filter(_cutoff(nodes, k, seed))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of ``a`` that aren't in ``b``, each once."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def union(*sets: DataFrame) -> DataFrame:
    """Ids of all sets, each once."""
    out = sets[0].select("id")
    for s in sets[1:]:
        out = out.unionAll(s.select("id"))
    return out.distinct()


def reindex(split: DataFrame) -> DataFrame:
    """(id, split, row): rows in the order train, val, test and by id, numbered from 0 by two-level sums."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    keyed = split.select("id", "split", (order * (1 << 48) + F.col("id")).alias("key"))
    return prefix_sum(keyed, "key", F.lit(1), "row").select("id", "split", "row")


def role_lists(split: DataFrame) -> DataFrame:
    """(split, ids): the sorted ids of each set. For export of small graphs: a set is one row."""
    return split.groupBy("split").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def classes_of(nodes: DataFrame) -> int:
    """How many labels there are: the length of the arrays, or one more than the largest number."""
    many = isinstance(nodes.schema["label"].dataType, T.ArrayType)
    return int(nodes.agg(F.max(F.size("label") if many else F.col("label") + 1)).first()[0] or 0)


def one_hot(nodes: DataFrame, classes: int) -> DataFrame:
    """(id, hot): 1 at the label's place, or wherever an array of labels is positive; a row without a label is all 0."""
    if isinstance(nodes.schema["label"].dataType, T.ArrayType):
        return nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce((F.get("label", i) > 0).cast("int"), F.lit(0))).alias("hot"))
    return nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce((i == F.col("label")).cast("int"), F.lit(0))).alias("hot"))


def micro_f1(predicted: DataFrame) -> DataFrame:
    """One row from (hot, guess) arrays: global micro-F1 over all labels."""
    pairs = predicted.select(F.explode(F.arrays_zip("hot", "guess")).alias("x")).select("x.hot", "x.guess")
    count = lambda a, b: F.sum(((F.col("hot") == a) & (F.col("guess") == b)).cast("long"))
    s = pairs.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    return s.select("tp", "fp", "fn", (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("micro_f1"))


def batch_f1(predicted: DataFrame, batch: int) -> DataFrame:
    """One row from (id, hot, guess): micro-F1 of runs of ``batch`` rows, averaged by their sizes."""
    x = predicted.withColumn("batch", F.floor(F.col("id") / batch)).select("id", "batch", F.explode(F.arrays_zip("hot", "guess")).alias("x"))
    count = lambda a, b: F.sum(((F.col("x.hot") == a) & (F.col("x.guess") == b)).cast("long"))
    by = x.groupBy("batch").agg(F.countDistinct("id").alias("size"), count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return by.agg((F.sum(f1 * F.col("size")) / F.sum("size")).alias("batch_f1"))
