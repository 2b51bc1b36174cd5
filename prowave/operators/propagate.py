"""Personalised PageRank of signed seeds over an edge table.

``state`` has a node's residuals and reserves, one column pair a feature, so an
edge row moves all features of a block at once and sums stay in generated code.
Rounds are synchronous: every active node is pushed at once. That order isn't
the one of a queue, but the end is held to the same condition: no residual
reaches its node's degree. For a single round, edge rows know the degrees of
both ends, so it needs no other table. A push to the bound reads and deals the
edges once and keeps them packed in blocks of nodes: a row holds the arrays of
a slice of edges, a block's state is one row too, and NumPy adds up what a block
sends to each other before it is exchanged. Several rounds make one job, which
counts what is still active and writes the state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from prowave.session import cut_lineage, forget_shuffles

#: Edges of a packed row, edges of a block, and nodes of a block times columns, all at most.
SLICE, BLOCK_EDGES, BLOCK_VALUES = 1 << 23, 3 << 21, 1 << 21
#: Rounds that make one job of a push to the bound, and edges times rounds of one, both at most.
JOB_ROUNDS, JOB_EDGES = 8, 1 << 28
#: Stands for a null id in packed rows.
NO_ID = -(1 << 63)


def walk_budget(n: int, epsilon: float, gamma: float = 1.0, least: float = 1e-3) -> float:
    """The number W that seeds are scaled by: ceil((2 + 2 eps / 3) ln n / (eps^2 / n) / gamma); gamma at least ``least``."""
    return float(math.ceil((2 + 2 / 3 * epsilon) * math.log(n) * n / epsilon**2 / max(gamma, least)))


def stage_ladder(n: int, budget: float) -> list[int]:
    """Thresholds of the stages: the first by the budget, each next one divided by its cube root (2 at least), down to 1."""
    first = int(max(budget / (1000 * math.log(n)), 1.0))
    step = int(max(first ** (1 / 3), 2.0))
    out = []
    while first >= 1:
        out.append(first)
        first //= step
    return out


def fixed_depth(weights: DataFrame, seeds: DataFrame, columns: list[str], alpha: float, depth: int, cut_every: int = 8) -> DataFrame:
    """sum over k <= depth of alpha (1 - alpha)^k (P^T)^k x, for each seed column; ids without mass don't appear.

    Horner's scheme: y <- alpha x + (1 - alpha) P^T y names y once a round, so
    the plan grows in a line; it is cut every ``cut_every`` rounds. Edges are
    exchanged by source once and reused.
    """
    first = seeds.select("id", *[(alpha * F.col(c)).alias(c) for c in columns])
    y = first
    for k in range(depth):
        moved = weights.join(y, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), *[((1 - alpha) * F.col("w") * F.col(c)).alias(c) for c in columns])
        y = first.unionAll(moved).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
        if (k + 1) % cut_every == 0 and k + 1 < depth:
            y = cut_lineage(y)
    return y


def first_threshold(edges: int, n: int, budget: float, alpha: float) -> float:
    """The seed size from which a node is worth pushing at first: mean degree times the ladder's first step, over 4 (1 - alpha)."""
    first = int(max(budget / (1000 * math.log(n)), 1.0))
    step = int(max(first ** (1 / 3), 2.0))
    return edges / n * first / step / (1 - alpha) / 4


def two_ends(weights: DataFrame) -> DataFrame:
    """(src, dst, w, degree, dst_degree): the edges of ``graph.weighted`` with the out-degree of the other end, 0 at dead ends."""
    degree = weights.groupBy(F.col("src").alias("of")).agg(F.first("degree").alias("dst_degree"))
    return weights.join(degree, F.col("dst") == F.col("of"), "left").select("src", "dst", "w", "degree", F.coalesce("dst_degree", F.lit(0)).alias("dst_degree"))


def _scaled(seeds: DataFrame, columns: list[str], budget: float | dict[str, float], degree: Column) -> DataFrame:
    of = budget if isinstance(budget, dict) else dict.fromkeys(columns, budget)
    return seeds.select("id", degree.alias("degree"), *[(F.col(c) * of[c]).alias(f"r_{c}") for c in columns], *[F.lit(0.0).alias(f"m_{c}") for c in columns])


def _seeded(columns: list[str]) -> Column:
    return F.exists(F.array(*columns), lambda v: v != 0)


def start_state(edges: DataFrame, seeds: DataFrame, columns: list[str], budget: float | dict[str, float], queries: DataFrame | None = None) -> DataFrame:
    """(id, degree, r_*, m_*): seeds times their column's budget as residuals; nodes whose seeds are all 0, or that aren't among the queries, are left out."""
    seeds = seeds if queries is None else seeds.join(queries.select("id"), "id", "left_semi")
    degree = edges.groupBy(F.col("src").alias("of")).agg(F.first("degree").alias("degree"))
    seeds = seeds.filter(_seeded(columns)).join(degree, F.col("id") == F.col("of"), "left")
    return _scaled(seeds, columns, budget, F.coalesce("degree", F.lit(0)))


def _active(c: str, alpha: float, scale: Column | float) -> Column:
    return (F.abs((1 - alpha) * F.col(f"r_{c}")) >= F.col("degree") * scale) & (F.col("degree") > 0)


def any_active(columns: list[str], alpha: float, scale: Column | float) -> Column:
    """Whether the largest residual is active: one comparison, whatever the number of columns."""
    each = [F.abs((1 - alpha) * F.col(f"r_{c}")) for c in columns]
    return ((F.greatest(*each) if len(each) > 1 else each[0]) >= F.col("degree") * scale) & (F.col("degree") > 0)


def push_round(edges: DataFrame, state: DataFrame, columns: list[str], alpha: float, scale: float = 1.0) -> DataFrame:
    """One synchronous round. Nodes below ``degree * scale`` keep their residuals; only active ones meet the edges."""
    zero = F.lit(0.0)
    hot = {c: _active(c, alpha, scale) for c in columns}
    front = state.filter(any_active(columns, alpha, scale)).select("id", *[F.when(hot[c], F.col(f"r_{c}")).otherwise(zero).alias(f"r_{c}") for c in columns])
    moved = edges.join(front, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.col("dst_degree").alias("degree"), *[((1 - alpha) * F.col("w") * F.col(f"r_{c}")).alias(f"r_{c}") for c in columns], *[zero.alias(f"m_{c}") for c in columns])
    stay = state.select("id", "degree", *[F.when(hot[c], zero).otherwise(F.col(f"r_{c}")).alias(f"r_{c}") for c in columns], *[(F.col(f"m_{c}") + F.when(hot[c], alpha * F.col(f"r_{c}")).otherwise(zero)).alias(f"m_{c}") for c in columns])
    return stay.unionAll(moved).groupBy("id").agg(F.max("degree").alias("degree"), *[F.sum(f"{x}_{c}").alias(f"{x}_{c}") for x in "rm" for c in columns])


_EDGES = "key long, n long, n_nodes long, nodes binary, degree binary, w binary, at binary, dst binary, starts binary, cut binary"
_STATE = "key long, ids binary, degree binary, r binary, m binary, active long"


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (ids ^ (ids >> 11)) % blocks


def _key(c: str, keys: list[int]) -> Column:
    """The key of the id's block, as ``_block`` has it."""
    return F.get(F.lit(keys), F.pmod(F.col(c).bitwiseXOR(F.shiftright(c, 11)), F.lit(len(keys))).cast("int"))


def _keys(spark: SparkSession, blocks: int) -> list[int]:
    """A key for each block, such that each goes to a partition of its own when keys are dealt to as many partitions."""
    placed = dict(spark.range(32 * blocks).select(F.pmod(F.hash("id"), F.lit(blocks)).alias("p"), "id").groupBy("p").agg(F.min("id")).collect())
    return [placed.get(p, -1 - p) for p in range(blocks)]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kind = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([r[i] for r in rows], kind[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _arrays(table: pa.Table, name: str, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) for v in table.column(name)]


def _pack_edges(keys: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices of edges of a key, in order of the other end's block and id.

    ``nodes`` are the sources, ``at`` each edge's place among them, ``dst`` the
    other ends, each once, ``starts`` the first edge of each, ``cut`` where the
    other ends of each block begin; ``w`` is by source where that says it all.
    Without weights, ``w`` is empty and ``degree`` counts the slice's edges.
    """
    place = np.array(keys)

    def packed(key: int, src: np.ndarray, dst: np.ndarray, degree: np.ndarray | None = None, w: np.ndarray | None = None) -> tuple:
        to = _block(dst, len(place))
        order = np.lexsort((dst, to))
        src, dst, to = src[order], dst[order], to[order]
        nodes, first, at, n = np.unique(src, return_index=True, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        if w is None:
            degree, w = n, np.empty(0)
        else:
            degree, w = degree[order][first], w[order]
            w = w[first] if (w[first][at] == w).all() else w
        cut = np.searchsorted(to[starts], np.arange(len(place) + 1))
        return (key, len(src), len(nodes), *(x.tobytes() for x in (nodes, degree, w, at.astype(np.int32), dst[starts], starts.astype(np.int32), cut.astype(np.int32))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def slices() -> Iterator[pa.RecordBatch]:
            key, *rest = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in held[0].schema.names)
            for k in np.unique(key).tolist():
                yield from _table([packed(k, *(x[key == k] for x in rest))], _EDGES).to_batches()

        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= SLICE:
                yield from slices()
                held.clear()
        if held:
            yield from slices()

    return run


def _pack_state(columns: list[str], keys: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = np.array(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy()
                r, m = (np.stack([b.column(f"{x}_{c}").to_numpy() for c in columns]) for x in "rm")
                to = _block(ids, len(place))
                rows = [(int(place[j]), ids[on].tobytes(), b"", r[:, on].tobytes(), m[:, on].tobytes(), 0) for j in np.unique(to) for on in [to == j]]
                yield from _table(rows, _STATE).to_batches()

    return run


def _merged(now: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, residuals and reserves: what it held and what it was sent, added up by id."""
    parts = list(zip(_arrays(now, "ids", np.int64), _arrays(now, "r", np.float64), _arrays(now, "m", np.float64), strict=True))
    parts.sort(key=lambda x: -len(x[2]))  # what it held comes first
    held, sent = parts[0], parts[1:]
    every = np.concatenate([x[0] for x in sent]) if sent else held[0][:0]
    ids = held[0]
    if (ids[1:] > ids[:-1]).all() and len(ids):
        at = np.searchsorted(ids, every)
        known = bool((ids[np.minimum(at, len(ids) - 1)] == every).all())
    else:
        known = False
    if not known:
        ids = np.unique(np.concatenate([ids, every]))
        at = np.searchsorted(ids, every)
    own = slice(None) if known else np.searchsorted(ids, held[0])
    out = []
    for i in (1, 2):
        total = np.zeros((k, len(ids)))
        if len(held[i]):
            np.add.at(total, (slice(None), own), held[i].reshape(k, -1)) if not known else np.copyto(total, held[i].reshape(k, -1))
        if i == 1 or any(len(x[i]) for x in sent):
            values = np.concatenate([x[i].reshape(k, -1) if len(x[i]) else np.zeros((k, len(x[0]))) for x in sent], axis=1) if sent else np.zeros((k, 0))
            for c in range(k):
                total[c] += np.bincount(at, values[c], len(ids))
        out.append(total)
    return ids, *out


def _step(k: int, alpha: float, scale: float | None, keys: list[int]) -> Callable:
    """A round of one block: adds up its state, pushes what is active at ``scale`` (None: nothing), and sends each block its sums."""
    place = np.array(keys)

    def run(mine: pa.Table, now: pa.Table) -> pa.Table:
        if not now.num_rows:
            return _table([], _STATE)
        key = now.column("key")[0].as_py()
        ids, r, m = _merged(now, k)
        degree = np.zeros(len(ids), np.int64)
        found = []
        for nodes, d, w in zip(_arrays(mine, "nodes", np.int64), _arrays(mine, "degree", np.int64), _arrays(mine, "w", np.float64), strict=True):
            at = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
            here = ids[at] == nodes
            degree[at[here]] = d[here] if len(w) else degree[at[here]] + d[here]
            found.append((at, here))
        if scale is None:
            return _table([(key, ids.tobytes(), degree.tobytes(), r.tobytes(), m.tobytes(), 0)], _STATE)
        hot = (np.abs((1 - alpha) * r) >= degree * scale) & (degree > 0)
        some = hot.any(0)
        moved = np.where(hot, r, 0.0)
        rows = [(key, ids.tobytes(), degree.tobytes(), (r - moved).tobytes(), (m + alpha * moved).tobytes(), int(some.sum()))]
        moved *= 1 - alpha
        parts = (_arrays(mine, n, t) for n, t in (("w", np.float64), ("at", np.int32), ("dst", np.int64), ("starts", np.int32), ("cut", np.int32)))
        for (node, here), w, at, dst, starts, cut in zip(found, *parts, strict=True):
            live = some[node] & here
            if not live.any():
                continue
            on = slice(None)
            if not live.all():  # only the edges of active nodes, and the other ends that they reach
                on = np.flatnonzero(live[at])
                owner = np.repeat(np.arange(len(dst), dtype=np.int32), np.diff(starts, append=len(at)))[on]
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                dst, cut = dst[owner[starts]], np.searchsorted(owner[starts], cut)
            w = w if len(w) else 1 / np.maximum(degree[node], 1)
            from_, by_node = at[on], len(w) == len(node)
            sums = np.empty((k, len(dst)))
            for c in range(k):
                value = np.where(here, moved[c][node], 0.0)
                sums[c] = np.add.reduceat((value * w)[from_] if by_node else value[from_] * w[on], starts)
            rows += [(int(place[j]), dst[a:b].tobytes(), b"", sums[:, a:b].tobytes(), b"", 0) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return _table(rows, _STATE)

    return run


def _gather(k: int) -> Callable:
    """A block's state as one row, for writing; ``active`` is what the last round found."""

    def run(now: pa.Table) -> pa.Table:
        ids, r, m = _merged(now, k)
        return _table([(now.column("key")[0].as_py(), ids.tobytes(), b"", r.tobytes(), m.tobytes(), sum(now.column("active").to_pylist()))], _STATE)

    return run


def _unpack(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, degree, r, m in zip(*(_arrays(b, n, t) for n, t in (("ids", np.int64), ("degree", np.int64), ("r", np.float64), ("m", np.float64))), strict=True):
                r, m = r.reshape(len(columns), -1), m.reshape(len(columns), -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, degree, *r, *m)], names=["id", "degree", *[f"{x}_{c}" for x in "rm" for c in columns]])

    return run


def _kept(edges: DataFrame, columns: int) -> tuple[DataFrame, list[int], int]:
    """The edges packed by block and persisted, the blocks' keys, and the number of edges.

    What blocks send each other grows with their number, so it is an eighth of
    the session's partitions, as packed edges are small; at least one for each
    core, and more where blocks would be too large.
    """
    spark = edges.sparkSession
    blocks = max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    of = [F.col("degree").cast("long").alias("degree"), F.col("w").cast("double").alias("w")] if "w" in edges.columns else []
    edges = edges.filter("src is not null").select(F.col("src").cast("long").alias("src"), F.coalesce(F.col("dst").cast("long"), F.lit(NO_ID)).alias("dst"), *of)
    while True:
        keys = _keys(spark, blocks)
        dealt = edges.select(_key("src", keys).alias("key"), "*").repartition(blocks, "key")
        kept = dealt.mapInArrow(_pack_edges(keys), _EDGES).repartition(blocks, "key").persist(StorageLevel.MEMORY_AND_DISK)
        n, nodes = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_nodes"), F.lit(0))).first()
        need = max(-(-n // BLOCK_EDGES), -(-nodes * columns // BLOCK_VALUES))
        if need <= blocks:
            return kept, keys, n
        kept.unpersist()
        blocks = need


def push(edges: DataFrame, state: DataFrame, columns: list[str], alpha: float, scales: list[float] = [1], rounds: int = 10_000) -> DataFrame:  # noqa: B006
    """Rounds at each scale until no node is active: (id, degree, r_*, m_*), written; a round that finds no active node changes nothing.

    Edges without ``w`` weigh 1 / out-degree, counted as they are packed.
    """
    k, kind = len(columns), state.schema["id"].dataType
    kept, keys, m = _kept(edges, k)
    a_job = max(1, min(JOB_ROUNDS, JOB_EDGES // max(m, 1)))
    values = [F.coalesce(F.col(f"{x}_{c}").cast("double"), F.lit(0.0)).alias(f"{x}_{c}") for x in "rm" for c in columns]

    def stepped(now: DataFrame, scale: float | None) -> DataFrame:
        return kept.groupBy("key").cogroup(now.groupBy("key")).applyInArrow(_step(k, alpha, scale, keys), _STATE)

    try:
        now = state.select(F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), *values).mapInArrow(_pack_state(columns, keys), _STATE)
        for scale in scales:
            left = rounds
            while left > 0:
                seen, n = Observation(), min(left, a_job)
                for _ in range(n):
                    now = stepped(now, scale)
                now = now.repartition(len(keys), "key").groupBy("key").applyInArrow(_gather(k), _STATE)
                now, left = cut_lineage(now.observe(seen, F.sum("active").alias("n"))), left - n
                forget_shuffles(edges.sparkSession)
                if not seen.get["n"]:
                    break
        names = ", ".join(f"{x}_{c} double" for x in "rm" for c in columns)
        out = stepped(now, None).mapInArrow(_unpack(columns), f"id long, degree long, {names}")
        return cut_lineage(out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")).cast(kind)))
    finally:
        kept.unpersist()


def closure(state: DataFrame, columns: list[str], alpha: float, budget: float | dict[str, float], sink: int | None = None) -> DataFrame:
    """Estimates: each node takes alpha of what residual it has left, and all is divided by the budget.

    With a ``sink``, what ended there is spread in proportion: values are divided
    by the share that didn't, and the sink itself gets 0.
    """
    of = budget if isinstance(budget, dict) else dict.fromkeys(columns, budget)
    out = state.select("id", *[((F.col(f"m_{c}") + alpha * F.col(f"r_{c}")) / of[c]).alias(c) for c in columns])
    if sink is None:
        return out
    lost = state.filter(F.col("id") == sink).agg(*[F.coalesce(F.sum(F.abs(F.col(f"r_{c}")) + F.abs(F.col(f"m_{c}") + alpha * F.col(f"r_{c}"))), F.lit(0.0)).alias(f"l_{c}") for c in columns])
    row = lost.first()
    return out.select("id", *[F.when(F.col("id") == sink, F.lit(0.0)).otherwise(F.col(c) / (1 - row[f"l_{c}"] / of[c])).alias(c) for c in columns])


def estimate(weights: DataFrame, seeds: DataFrame, columns: list[str], n: int, alpha: float, epsilon: float, gamma: float | dict[str, float] = 1.0, staged: bool = False) -> DataFrame:
    """Error-bounded estimates of all seed columns: |error| of a node is at most its degree / W on undirected graphs.

    ``weights`` may be plain edges, which saves the join that ``graph.weighted`` needs.
    ``gamma`` may differ by column. ``staged`` goes down the ladder of the largest budget.
    """
    gammas = gamma if isinstance(gamma, dict) else dict.fromkeys(columns, gamma)
    budget = {c: walk_budget(n, epsilon, gammas[c]) for c in columns}
    seeds = cut_lineage(seeds.select("id", *columns))  # else a filter on many columns made from one array is copied for each of them, over and over
    scales = [*stage_ladder(n, max(budget.values())), 1] if staged else [1]
    state = _scaled(seeds.filter(_seeded(columns)), columns, budget, F.lit(0))
    return closure(push(weights, state, columns, alpha, scales), columns, alpha, budget)
