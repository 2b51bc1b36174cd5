"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are cut into subspaces of ``SUB`` dimensions with 16 centroids each, so a
code has four bits a subspace. Codebooks and codes minimise a loss that weighs
the residual's part parallel to the vector more than the rest, since that part
moves the large inner products. Queries scan the codes with tables of partial
products (two codes a byte), and the best ``DEPTH`` of the whole table by codes
are ranked again by the vectors.

Codebooks are fitted on a bounded sample; every row is indexed and scanned.
Queries go to where the rows lie, ``PASS`` at a time: the codes are written once
and scanned in place, so a pass moves ``DEPTH`` numbers a query and task and
vectors never move. What a pass sends out is bounded by ``PASS`` vectors and
``PASS * DEPTH`` candidates (4096 and 2.1 million of 12 bytes).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from prowave.session import checkpoint_dir, written

SUB = 2
CODES = 16
SAMPLE_ROWS = 8192
THRESHOLD = 0.2
ROUNDS = 6
BLOCK_ROWS = 8192
PASS = 4096
DEPTH = 512
CHUNK = 128
K = 20


def anisotropy(dims: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel error against the rest for unit vectors and inner products from ``threshold`` on."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    def __init__(self, books: np.ndarray, eta: float, dims: int):
        self.books, self.eta, self.dims = books, eta, dims  # books: subspace, code, SUB

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        extra = -x.shape[1] % (2 * SUB)
        return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, SUB)

    def encode(self, x: np.ndarray, passes: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """(n, subspaces) codes; each is chosen again given the others, since they share the parallel residual."""
        p = self.parts(x)
        unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        if codes is None:
            codes = np.stack([((p[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(p.shape[1])], 1)
        along = np.stack([(unit[:, m] * (p[:, m] - self.books[m][codes[:, m]])).sum(1) for m in range(p.shape[1])], 1)
        total = along.sum(1)
        for _ in range(passes):
            for m in range(p.shape[1]):
                rest = total - along[:, m]
                off = p[:, m, None] - self.books[m]
                a = (unit[:, m, None] * off).sum(2)
                loss = (off**2).sum(2) + (self.eta - 1) * (rest[:, None] + a) ** 2
                codes[:, m] = loss.argmin(1)
                along[:, m] = np.take_along_axis(a, codes[:, m, None], 1)[:, 0]
                total = rest + along[:, m]
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        p = cls.parts(x)
        start = rng.choice(len(x), CODES, replace=len(x) < CODES)
        books = np.stack([p[start, m] + 1e-6 * rng.standard_normal((CODES, SUB)) for m in range(p.shape[1])])
        q = cls(books, anisotropy(x.shape[1], threshold), x.shape[1])
        unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = None
        for _ in range(rounds):
            codes = q.encode(x, 1, codes)
            along = np.stack([(unit[:, m] * (p[:, m] - q.books[m][codes[:, m]])).sum(1) for m in range(p.shape[1])], 1)
            for m in range(p.shape[1]):
                u, rest = unit[:, m], along.sum(1) - along[:, m]
                lhs = np.eye(SUB) + (q.eta - 1) * u[:, :, None] * u[:, None, :]
                rhs = p[:, m] + (q.eta - 1) * u * (rest + (u * p[:, m]).sum(1))[:, None]
                for c in range(CODES):
                    own = codes[:, m] == c
                    if own.any():
                        q.books[m, c] = np.linalg.solve(lhs[own].sum(0) + 1e-9 * np.eye(SUB), rhs[own].sum(0))
                along[:, m] = (u * (p[:, m] - q.books[m][codes[:, m]])).sum(1)
        return q

    def pack(self, x: np.ndarray) -> np.ndarray:
        codes = self.encode(x).astype(np.uint8)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products by table look-ups, one for each byte of two codes."""
        p = self.parts(queries).astype(np.float32)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            low, high = (sum(p[:, m, d, None] * self.books[m, :, d].astype(np.float32) for d in range(SUB)) for m in (2 * j, 2 * j + 1))
            table = (high[:, :, None] + low[:, None, :]).reshape(len(queries), 256)
            out += table.take(packed[:, j], axis=1)
        return out


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite vector that isn't zero, in doubles."""
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    good = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("vec", lambda v: v != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & good)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _index(q: Quantiser):
    """Blocks of up to BLOCK_ROWS rows: their ids and codes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([one(part.column("id").to_numpy()), one(q.pack(_matrix(part.column("vec"), q.dims)))], names=["ids", "codes"])

    return run


class Best:
    """The ``depth`` best (by code, then id) of each query of a chunk among all blocks seen."""

    def __init__(self, q: Quantiser, queries: np.ndarray, depth: int):
        self.q, self.queries, self.depth = q, queries, depth
        self.least = np.full(len(queries), -np.inf, np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        near = self.q.scan(self.queries, codes)
        least = self.least
        if len(ids) > self.depth and np.isneginf(least).any():
            least = np.maximum(least, np.partition(near, len(ids) - self.depth, axis=1)[:, len(ids) - self.depth])
        row, col = np.nonzero(near >= least[:, None])
        self.held.append((row.astype(np.int32), ids[col], near[row, col]))
        self.size += len(row)
        if self.size > 4 * self.depth * len(self.queries):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids, near = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -near, row))
        row, ids, near = row[order], ids[order], near[order]
        count = np.bincount(row, minlength=len(self.queries))
        first = np.cumsum(count) - count
        keep = np.arange(len(row)) - first[row] < self.depth
        full = np.flatnonzero(count >= self.depth)
        self.least[full] = near[first[full] + self.depth - 1]
        self.held, self.size = [(row[keep], ids[keep], near[keep])], int(keep.sum())
        return self.held[0]


def _scan(q: Quantiser, queries: np.ndarray, depth: int):
    """(query, id, near): the partition's best rows by codes for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [Best(q, queries[at : at + CHUNK], depth) for at in range(0, len(queries), CHUNK)]
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
                codes = np.frombuffer(b.column("codes")[i].as_buffer(), np.uint8).reshape(len(ids), -1)
                for c in chunks:
                    c.add(ids, codes)
        for n, c in enumerate(chunks):
            if c.held:
                row, ids, near = c.cut()
                yield pa.RecordBatch.from_arrays([pa.array(row + np.int32(n * CHUNK)), pa.array(ids), pa.array(near)], names=["query", "id", "near"])

    return run


def _exact(wanted: np.ndarray, queries: np.ndarray, query: np.ndarray, ids: np.ndarray):
    """(query, vec_id, score) of the candidate pairs (query, ids), whose ids ascend, for the rows of a batch."""
    known, first = np.unique(ids, return_index=True)
    first = np.append(first, len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("id").to_numpy()
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            rows = np.flatnonzero(known[at] == own) if len(known) else np.zeros(0, int)
            for part in np.array_split(rows, -(-len(rows) // 1024) or 1):
                x = _matrix(b.column("vec").take(pa.array(part)), queries.shape[1])
                count = first[at[part] + 1] - first[at[part]]
                row = np.repeat(np.arange(len(part)), count)
                pair = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at[part]], count)
                keep = wanted[query[pair]] != own[part][row]
                row, who = row[keep], query[pair[keep]]
                score = np.zeros(len(row))
                for d in range(queries.shape[1]):  # one fixed order of sums, so equal vectors have equal scores
                    score += queries[who, d] * x[row, d]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(own[part][row]), pa.array(score)], names=["query", "vec_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", depth: int = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product, its own id left out.

    Rows and queries that are null, zero, not finite, without an id, or of
    another length than most take no part. Equal queries count once; queries
    of one id with other vectors are ranked apart; repeated rows repeat. Empty
    tables give no rows. With more than ``PASS`` queries the passes' results lie
    in the shared folder.
    """
    spark = rows.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    base, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    sizes = base.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dims = sizes["dims"]
    base, asked = base.filter(F.size("vec") == dims), asked.filter(F.size("vec") == dims).withColumn("of", F.xxhash64("id", "vec")).dropDuplicates(["id", "of"])
    sample = base.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE_ROWS).select("vec").toArrow()
    q = Quantiser.fit(_matrix(sample.column("vec").combine_chunks(), dims))
    passes = max(1, -(-asked.count() // PASS))
    index, forget = written(base.mapInArrow(_index(q), "ids binary, codes binary"), "ann-codes")
    path = f"{checkpoint_dir(spark)}/ann-{uuid.uuid4().hex}"
    for n in range(passes):
        block = asked.filter(F.pmod("of", F.lit(passes)) == n).orderBy("id", "of").select("id", "vec").toArrow()
        if not block.num_rows:
            continue
        wanted, vecs = block.column("id").to_numpy(), np.ascontiguousarray(_matrix(block.column("vec").combine_chunks(), dims))
        best = W.partitionBy("query").orderBy(F.desc("near"), "id")
        near = index.mapInArrow(_scan(q, vecs, depth), "query int, id long, near float").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= depth)
        found = near.select("query", "id").toArrow()
        query, ids = found.column("query").to_numpy(), found.column("id").to_numpy()
        order = np.lexsort((query, ids))
        query, ids = query[order], ids[order]
        new = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
        exact = base.mapInArrow(_exact(wanted, vecs, query[new], ids[new]), "query int, vec_id long, score double")
        ranked = exact.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(wanted)], "of int, query_id long")
        ranked = ranked.join(F.broadcast(names), F.col("query") == F.col("of")).select("query_id", "rank", "vec_id", "score")
        if passes == 1:
            forget()
            return ranked
        ranked.write.mode("append").parquet(path)
    forget()
    return spark.read.schema(out_schema).parquet(path) if passes > 1 else spark.createDataFrame([], out_schema)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}
"""


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of the true ``k`` nearest that ``found`` has; for small tables (all rows come to the driver)."""
    take = lambda t: (lambda r: (r.column("id").to_numpy(), _matrix(r.column("vec").combine_chunks(), len(r.column("vec")[0]))))(usable(t, id_col, vec_col).orderBy("id").toArrow())
    (ids, x), (asked, y) = take(rows), take(queries)
    scores = y @ x.T
    scores[asked[:, None] == ids] = -np.inf
    got: dict[int, set[int]] = {}
    for r in found.select("query_id", "vec_id").collect():
        got.setdefault(r[0], set()).add(r[1])
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
    return sum(len(got.get(int(a), set()) & set(ids[b].tolist())) for a, b in zip(asked, best, strict=True)) / max(1, best.size)
