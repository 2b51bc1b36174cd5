"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.functions.scalar import lcg
from prowave.operators import graph, splits, walks

from . import fixtures as fx
from .registry import query

WITH_SU, WITH_CS, WITH_PS, WITH_SV = (f"WITH {s}" for s in (fx.SQL_SU, fx.SQL_CS, fx.SQL_PS, fx.SQL_SV))
LCG_SQL = "((({0}) % 2147483648 * 1103515245 + 12345) % 2147483648) // 128"


@query(f"{WITH_SU} SELECT src, dst, count(*)::BIGINT AS copies FROM e GROUP BY src, dst")
def edge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clean_edges(fx.succession(spark, sf_dir)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))


@query(f"{WITH_SU} SELECT src, dst FROM e WHERE src <> dst")
def self_loop_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clean_edges(fx.succession(spark, sf_dir), keep_loops=False)


@query(f"{WITH_SU} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetrize(fx.succession(spark, sf_dir))


@query(f"{WITH_SU} SELECT max(greatest(src, dst)) + 1 AS n, min(least(src, dst)) AS min_id, count(*)::BIGINT AS m FROM e")
def node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_count(fx.succession(spark, sf_dir))


_DEGREES = "deg AS (SELECT n.id, coalesce(o.c, 0)::BIGINT AS out_degree, coalesce(i.c, 0)::BIGINT AS in_degree FROM nodes n LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) o ON n.id = o.src LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) i ON n.id = i.dst)"


@query(f"{WITH_CS}, {_DEGREES} SELECT id, out_degree, in_degree FROM deg")
def out_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    return graph.degrees(e, graph.node_table(e, n))


@query(f"{WITH_CS}, {_DEGREES} SELECT count(*)::BIGINT AS n, sum(out_degree)::BIGINT AS m, count(*) FILTER (WHERE out_degree = 0)::BIGINT AS dead_ends, count(*) FILTER (WHERE out_degree = 0 AND in_degree = 0)::BIGINT AS isolated, max(out_degree) AS max_out FROM deg")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    return graph.graph_stats(e, graph.node_table(e, n))


@query(f"""{WITH_CS}, {_DEGREES}
SELECT id, coalesce(sum(greatest(out_degree, 1)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_offset,
       coalesce(sum(in_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_offset FROM deg""")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    return graph.csr_offsets(e, graph.node_table(e, n))


@query(f"{WITH_PS} SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INTEGER AS slot FROM e")
def adj_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency_slots(fx.part_supplier(spark, sf_dir)[0])


@query(f"{WITH_CS} SELECT dst, src, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1)::INTEGER AS turn FROM e")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_index(fx.customer_supplier(spark, sf_dir)[0])


@query(f"{WITH_SU} SELECT src, CASE WHEN dst = 3 THEN 7 ELSE dst END AS dst FROM e")
def retarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.retarget(fx.succession(spark, sf_dir), 3, 7)


@query(f"{WITH_CS} SELECT src, dst FROM e UNION ALL SELECT id, {LCG_SQL.format('id + 3')} % (SELECT count(*) FROM nodes) FROM nodes WHERE id NOT IN (SELECT src FROM e)")
def dead_end_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    return graph.rewire_dead_ends(e, graph.node_table(e, n), n, seed=3)


@query(f"{WITH_CS} SELECT src, dst FROM e UNION ALL SELECT id, (SELECT count(*) FROM nodes) FROM nodes WHERE id NOT IN (SELECT src FROM e)")
def dead_end_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.customer_supplier(spark, sf_dir)
    return graph.with_sink(e, graph.node_table(e, n), n)


@query(f"{WITH_SV} SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.weighted(fx.similar_vectors(spark, sf_dir))


@query(f"{WITH_SU}, lines AS (SELECT '# ' || (SELECT count(*) FROM nodes) AS v UNION ALL SELECT src || ' ' || dst FROM e) SELECT split_part(v, ' ', 1)::BIGINT AS src, split_part(v, ' ', 2)::BIGINT AS dst FROM lines WHERE NOT starts_with(v, '#')")
def edge_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from prowave.session import checkpoint_dir
    from prowave.sources import files

    path = f"{checkpoint_dir(spark)}/edges-{uuid.uuid4().hex}"
    files.write_edge_text(fx.succession(spark, sf_dir), path)
    return files.read_edge_text(spark, path)


_SLOTS = "slots AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) AS slot, count(*) OVER (PARTITION BY src) AS degree FROM e)"


def _draw(walk: str, step: int, salt: int) -> str:
    return LCG_SQL.format(f"{walk} * 31 + {step * 1009 + salt}")


def _walk_sql(before: str, after: str, step: int, alpha: float) -> str:
    stop = f"(w.done OR {_draw('w.walk', step, 0)} < {alpha * 16777216})"
    return f"""{after} AS (SELECT w.walk, coalesce(s.dst, w.cur) AS cur, ({stop} OR g.degree IS NULL) AS done FROM {before} w
  LEFT JOIN (SELECT src, degree FROM slots WHERE slot = 0) g ON w.cur = g.src
  LEFT JOIN slots s ON w.cur = s.src AND NOT {stop} AND s.slot = {_draw('w.walk', step, 500)} % g.degree)"""


@query(f"{WITH_SV}, {_SLOTS}, w0 AS (SELECT id AS walk, id AS cur, false AS done FROM nodes), {_walk_sql('w0', 'w1', 0, 0.2)}, {_walk_sql('w1', 'w2', 1, 0.2)} SELECT walk, cur, done FROM w2")
def walk_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.similar_vectors(spark, sf_dir)
    slots = walks.slots_with_degree(e)
    start = e.select(F.col("src").alias("walk"), F.col("src").alias("cur"), F.lit(False).alias("done")).distinct()
    return walks.walk_step(walks.walk_step(start, slots, 0, 0.2), slots, 1, 0.2)


def _coin(step: str, salt: str) -> str:
    return f"('0x' || substr(md5(id || '|' || k || '|' || ({step}) || '|{salt}'), 1, 8))::BIGINT"


_HOP = "SELECT w.id, w.k, {0} AS step, s.dst AS cur, {1} < {2} AS done FROM {3} w JOIN slots s ON s.src = w.cur AND s.slot = {4} % s.degree"
_STOP = int(0.2 * (1 << 32))

#: Needs WITH RECURSIVE; every node of this graph has a neighbour.
CACHE_SQL = f"""{fx.SQL_SV}, {_SLOTS}, start AS (SELECT src AS id, slot AS k, src AS cur FROM slots),
hops AS ({_HOP.format("0", _coin("0", "stop"), _STOP, "start", _coin("0", "hop"))}
  UNION ALL {_HOP.format("step + 1", _coin("step + 1", "stop"), _STOP, "hops", _coin("step + 1", "hop"))} WHERE NOT done),
cache AS (SELECT id, k, cur AS end_id FROM hops WHERE done)"""


@query(f"WITH RECURSIVE {CACHE_SQL} SELECT id, k::INTEGER AS k, end_id FROM cache")
def walk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until the coin stops each walk; tests hold the lengths against their distribution."""
    return walks.walk_cache(fx.similar_vectors(spark, sf_dir), 0.2)


@query(f"SELECT custkey AS id FROM (SELECT c_custkey AS custkey, {LCG_SQL.format('c_custkey + 5')} AS h FROM customer ORDER BY h, c_custkey LIMIT 20)")
def node_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_nodes(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 20, seed=5)


@query(f"SELECT c_custkey AS id, {LCG_SQL.format('c_custkey + 9')} AS pick FROM customer")
def portable_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lcg(F.col("c_custkey"), 9).alias("pick"))
