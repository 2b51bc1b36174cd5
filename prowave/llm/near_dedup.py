"""Near-duplicate classes by Order MinHash and banded alignment.

A document's k-mers are its runs of ``WORDS`` words, labelled with their
occurrence number. A band takes the ``ORDER`` labelled k-mers that are smallest
under the band's hash and keeps them *in text order*, so it agrees for texts
that are alike in edits, not only in vocabulary. Documents that agree in a band
are candidates; a candidate pair is linked if the banded alignment of its k-mer
sequences, matched / (n1 + n2 - matched), reaches ``SIMILARITY``. Classes are the
connected components of the links.

Texts of equal words are one node from the start. A bucket's smallest node is
its head. First every node is compared with the ``FIRST`` heads that agree with it
most, which joins a group of copies at a pair or two a node. Nodes that then share *two* bands (0.8 similar texts
share 10 of 20 on average, under two with a chance of about 1e-5) with one of
another class make *families*; a family's nodes are dealt to blocks, and all
pairs of two classes are compared, block against block, with each text sent once
to a pair of blocks: k-mers in common bound the alignment from above, and only
pairs that may reach ``SIMILARITY`` are aligned. So none is dropped, and no pair is
a row of its own.
Before texts are fetched, a pair's minima are compared, inside the join: of the
60 of both, at least ``AGREE`` must match by rank in their low four bits (0.8
similar texts match 40 on average, with a deviation of 5.3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from prowave.session import cut_lineage, written

from . import textkernel as tk

WORDS = 5
SIMILARITY = 0.8
ORDER = 3
BANDS = 20
AGREE = 16
FIRST = 2
BLOCK = 256
BLOCK_WORDS = 1 << 17
VOCABULARY = 1 << 13
ROWS_PER_TASK = 100_000
#: Up to so many links (32 bytes each) are joined by one task; beyond, by rounds of joins, with the same result.
LINKS_PER_TASK = 1 << 20

#: ORDER * BANDS minima, four bits each, fifteen a number.
MINIMA = tuple(f"m{i}" for i in range(ORDER * BANDS // 15))

_TURN = [pow(0x9E3779B97F4A7C15, b + 1, 1 << 64) | 1 for b in range(BANDS)]


def kmers(words: tk.Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of each row's k-mers in text order; a row of fewer words has one k-mer, of all its words."""
    h, counts = words.hashes(), np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = words.first[row] + np.arange(offsets[-1]) - offsets[row]
    out = np.zeros(len(at), np.uint64)
    full = counts[row] >= size
    out[full] = tk.window_hashes(h, size)[at[full]]
    for i in np.flatnonzero(~full):
        out[i] = tk.window_hashes(h[words.first[row[i]] : words.first[row[i] + 1]], int(counts[row[i]]))[0] ^ np.uint64(counts[row[i]])
    return out, offsets


def labelled(k: np.ndarray, row: np.ndarray) -> np.ndarray:
    """k-mers mixed with the number of their occurrence in the row."""
    order = np.lexsort((k, row))
    new = np.ones(len(k), bool)
    new[1:] = (k[order[1:]] != k[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    place = np.arange(len(k))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    out = np.empty(len(k), np.uint64)
    out[order] = tk.mix(k[order] + tk.mix(nth.astype(np.uint64) + np.uint64(1)))
    return out


def bands(k: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with k-mers, BANDS) keys, equal ones for the same ordered minimum k-mers; (rows, len(MINIMA)) the low four bits of the minima by rank."""
    n = np.diff(offsets)
    starts = offsets[:-1][n > 0]
    sizes = n[n > 0]
    row = np.repeat(np.arange(len(sizes)), sizes)
    label = labelled(k, row)
    out, minima = np.zeros((len(sizes), BANDS), np.uint64), np.zeros((len(sizes), BANDS, ORDER), np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(BANDS):
        h = label * np.uint64(_TURN[b])
        at = np.zeros((ORDER, len(sizes)), np.int64)
        for j in range(ORDER):
            least = np.minimum.reduceat(h, starts)
            found = np.flatnonzero(h == least[row])
            at[j] = found[np.searchsorted(found, starts)]
            h[at[j]] = top  # a row with fewer k-mers repeats its first place
            minima[:, b, j] = label[at[j]].astype(np.int64) & 15
        at.sort(axis=0)
        key = np.full(len(sizes), b + 1, np.uint64)
        for j in range(ORDER):
            key = tk.mix(key * np.uint64(31) + label[at[j]])
        out[:, b] = key
    return out, (minima.reshape(len(sizes), -1, 15) << (4 * np.arange(15))).sum(2)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
            k, offsets = kmers(words)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            h = words.hashes()
            first = words.first[:-1][some]
            place = (np.arange(len(h)) - words.first[words.doc] + 1).astype(np.uint64)
            s1 = np.add.reduceat(tk.mix(h ^ tk.mix(place)), first)
            s2 = np.add.reduceat(tk.mix(h + place * np.uint64(tk.WINDOW_BASE)), first)
            keys, minima = bands(k, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("_id").take(pa.array(lo + some)), b.column("_of").take(pa.array(lo + some)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.diff(offsets)[some]),
                    lists, *(pa.array(np.ascontiguousarray(m)) for m in minima.T),
                ],
                names=["_id", "_of", "s1", "s2", "n", "bands", *MINIMA],
            )


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matched / (len(a) + len(b) - matched) of the best order-keeping alignment; 0.0 as soon as it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))  # matches wanted
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - (short - head) :][::-1] != b[m - (short - head) :][::-1]) if short > head else ()
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : n - tail], b[head : m - tail]
    matched = head + tail
    if len(x) and len(y):
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        if matched + int(np.minimum(cx[ix], cy[iy]).sum()) < need:
            return 0.0
        matched += _banded(x, y, max(n, m) - need)
    return matched / (n + m - matched) if matched >= need else 0.0


def _banded(x: np.ndarray, y: np.ndarray, width: int) -> int:
    """Longest common subsequence by bit rows, with matches at most ``width`` off the diagonal."""
    where: dict[int, int] = {}
    for i, v in enumerate(x.tolist()):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    band = (1 << (2 * width + 1)) - 1
    v = full
    for j, w in enumerate(y.tolist()):
        m = where.get(w)
        if m:
            m &= band << (j - width) if j >= width else band >> (width - j)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                sides = []
                for name in ("text_u", "text_v"):
                    rows: list[np.ndarray] = []
                    for _, _, words in tk.each_slice(b.column(name), tk.SPACE_WORDS):
                        k, off = kmers(words)
                        rows += [k[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    sides.append(rows)
                good = [i for i, (x, y) in enumerate(zip(*sides, strict=True)) if aligned(x, y, least) >= least]
                yield b.select(["u", "v"]).take(pa.array(good, pa.int64()))

    return run


def _fits(a: Column, b: Column) -> Column:
    """Whether the lengths allow a link."""
    return F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b)


def _agree(a: str, b: str) -> Column:
    """How many minima of the two sides match: a four-bit group of the XOR that isn't 0 is a mismatch."""
    same = F.lit(15 * len(MINIMA))
    for m in MINIMA:
        x = F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        same = same - F.bit_count(x.bitwiseAND(F.lit(0x111111111111111)))
    return same


def _counted(df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
    """``df``, written, and how many of its rows meet ``of`` (all without it), counted in the same job."""
    seen = Observation()
    df = cut_lineage(df.observe(seen, F.count(F.lit(1) if of is None else F.when(of, 1)).alias("n")))
    return df, seen.get["n"]


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, written, in as many parts as its rows call for, not as the texts do, and that number of parts; 0 for an empty table."""
    df, n = _counted(df)
    return df.coalesce(max(4, -(-n // ROWS_PER_TASK))), n and max(4, -(-n // ROWS_PER_TASK))


def _side(df: DataFrame, of: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{of}{c}") for c in ("node", "n", *MINIMA, *more)])


def _candidate() -> Column:
    return _fits(F.col("a_n"), F.col("b_n")) & (_agree("a_", "b_") >= AGREE)


def _with_heads(nodes: DataFrame) -> DataFrame:
    """(u, v) to compare: each node with the heads that agree with it most."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n", *MINIMA)
    heads = rows.groupBy("key").agg(F.min(F.struct("node", "n", *MINIMA)).alias("head")).select("key", "head.*")
    # The turned key makes Spark exchange both sides of the join, so that it can split a large bucket.
    heads = _side(heads, "b_", "key").withColumn("b_key", F.bitwise_not("b_key"))
    met = _side(rows, "a_", "key").join(heads, (F.bitwise_not("a_key") == F.col("b_key")) & (F.col("a_node") != F.col("b_node")) & _candidate())
    best = met.groupBy("a_node").agg(F.collect_set(F.struct((-_agree("a_", "b_")).alias("off"), F.col("b_node").alias("head"))).alias("heads"))
    pairs = best.select("a_node", F.explode(F.slice(F.array_sort("heads"), 1, FIRST)["head"]).alias("head"))
    return pairs.select(F.least("a_node", "head").alias("u"), F.greatest("a_node", "head").alias("v")).distinct()


def _twice(nodes: DataFrame) -> DataFrame:
    """(key, node, n, minima, label): a row for each two bands of a node whose buckets both hold two labels."""
    own = ["node", "n", "label", *MINIMA]
    rows = nodes.select(F.explode("keys").alias("key"), *own)
    mixed = rows.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first != last").select(F.bitwise_not("key").alias("turned"))
    some = rows.join(mixed, F.bitwise_not("key") == F.col("turned"), "left_semi").groupBy(*own).agg(F.array_sort(F.collect_list("key")).alias("keys")).filter(F.size("keys") > 1)
    both = F.flatten(F.transform("keys", lambda a, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda b: F.xxhash64(a, b))))
    return some.select(F.explode(both).alias("key"), *own)


def _other(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Rows of ``a`` that meet one of ``b`` of another label in a bucket."""
    b = _side(b, "b_", "label", "key").withColumn("b_key", F.bitwise_not("b_key"))
    return _side(a, "a_", "label", "key").join(b, (F.bitwise_not("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & _candidate(), how)


def _open(rows: DataFrame) -> DataFrame:
    """The rows that meet a candidate of another label in a bucket."""
    b = _side(rows, "b_", "label", "key").withColumn("b_key", F.bitwise_not("b_key"))
    found = _side(rows, "a_", "label", "key").join(b, (F.bitwise_not("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & _candidate(), "left_semi")
    return found.select(*[F.col(c).alias(c[2:]) for c in found.columns])


def _dealt(rest: DataFrame) -> DataFrame:
    """(node, label, side, tile): each open node in all tiles of its family that its block is in.

    A family's largest class is dealt to blocks of its own, the others to
    blocks that are numbered first; a tile is two blocks, or one, but not two of
    the largest class.
    """
    heads = rest.groupBy("key").agg(F.min("node").alias("u")).select(F.bitwise_not("key").alias("turned"), "u")
    ties = rest.join(heads, F.bitwise_not("key") == F.col("turned")).filter(F.col("u") != F.col("node")).select("u", F.col("node").alias("v"))
    family = components(ties).select(F.col("node").alias("of"), F.col("label").alias("family"))
    rows, _ = _sized(rest.select("node", "n", "label").distinct().join(family, F.col("node") == F.col("of")).drop("of"))
    by = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    by = by.groupBy("family").agg(F.max(F.struct("c", "label", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    parts = lambda c, w: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(w / BLOCK_WORDS))
    by = by.select(F.col("family").alias("own"), F.col("most.label").alias("most"), parts(F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w")).alias("others"), parts(F.col("most.c"), F.col("most.w")).alias("mosts"))
    rows = rows.join(by, F.col("family") == F.col("own")).withColumn("large", F.col("label") == F.col("most"))
    spot = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(F.col("large"), F.col("others") + F.pmod(spot, F.col("mosts"))).otherwise(F.pmod(spot, F.col("others"))))
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(F.col("large"), F.lit(0)).otherwise(F.col("mosts")) - 1)))
    tile = F.xxhash64("family", F.least("block", "with"), F.greatest("block", "with"))
    return met.select("node", "label", F.when(F.col("block") <= F.col("with"), 0).otherwise(1).alias("side"), tile.alias("tile"))


def compare(side: np.ndarray, label: np.ndarray, seq: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of indices whose alignment reaches ``least``, enough of them to join the labels that any such pair joins.

    Rows of side 0 meet those of side 1, or each other if there is no side 1.
    """
    sizes = np.array([len(x) for x in seq])
    row = np.repeat(np.arange(len(seq)), sizes)
    gram = labelled(np.concatenate(seq), row)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    known, code = np.unique(gram, return_inverse=True)
    on = [np.bincount(code[side[row] == s], minlength=len(known)) for s in (0, 1)]
    shared = on[0] > 1 if alone else (on[0] > 0) & (on[1] > 0)
    place = np.cumsum(shared) - 1
    keep = shared[code]
    row, at = row[keep], place[code[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    back = np.zeros(len(seq), np.int64)
    back[left] = np.arange(len(left))
    back[right] = np.arange(len(right))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(shared.sum()), VOCABULARY):
        some = slice(*np.searchsorted(at, [lo, lo + VOCABULARY]))
        r, c = row[some], at[some] - lo
        grid = [np.zeros((len(x), VOCABULARY), np.float32) for x in ((left,) if alone else (left, right))]
        for s, g in enumerate(grid):
            own = side[r] == s
            g[back[r[own]], c[own]] = 1
        common += grid[0] @ grid[-1].T
    need = np.ceil(least * (sizes[left][:, None] + sizes[right]) / (1 + least) - 1e-9)
    good = (common >= need) & (label[left][:, None] != label[right])
    if alone:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    top = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for k in np.argsort(-(common[i, j] / (sizes[left[i]] + sizes[right[j]])), kind="stable"):
        u, v = int(left[i[k]]), int(right[j[k]])
        x, y = find(int(label[u])), find(int(label[v]))
        if x != y and aligned(seq[u], seq[v], least) >= least:
            top[x] = y
            out.append((u, v))
    return out


def _compare(least: float):
    """Links (u, v) between labels, from rows sorted by tile."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        seq: list[np.ndarray] = []
        for _, _, words in tk.each_slice(t.column("text").combine_chunks(), tk.SPACE_WORDS):
            k, off = kmers(words)
            seq += [k[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        label = t.column("label").combine_chunks()
        _, code = np.unique(np.stack([label.field(i).to_numpy() for i in (0, 1)]), axis=1, return_inverse=True)
        pairs = np.array(compare(t.column("side").to_numpy(), code.reshape(-1), seq, least), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([label.take(pa.array(pairs[:, i])) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            tile = b.column("tile").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]]) if len(tile) else np.zeros(1, int)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and tile[lo] != last:
                    yield of(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = tile[lo]
        if held:
            yield of(held)

    return run


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose alignment reaches ``least``."""
    side = lambda of: texts.select(F.col("node").alias(of), F.col("text").alias(f"text_{of}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(_verify(least), pairs.select("u", "v").schema)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all nodes of the links (u, v) of one task."""
    ends = [np.stack([b.column(c).field(i).to_numpy() for i in (0, 1)], 1) for c in ("u", "v") for b in batches] if (batches := list(batches)) else []
    if not ends or not sum(map(len, ends)):
        return
    every = np.concatenate(ends)
    nodes, at = np.unique(every, axis=0, return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(now, x, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    of = lambda a: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in (0, 1)], names=["_id", "_of"])
    yield pa.RecordBatch.from_arrays([of(nodes), of(nodes[label])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each linked node; the label is the component's smallest node.

    Up to LINKS_PER_TASK links are joined by one task. Beyond, a round points each node at the smallest one next door and follows the
    pointers to their ends, doubling the step, so a chain takes as many steps as
    its length has binary digits. Links then join ends, and those inside one go,
    until none is left. At least half of the nodes go each round, and a star's in
    one. The tables are in as many parts as their rows call for.
    """
    edges, n = _counted(links.select("u", "v").filter("u != v"))
    if n <= LINKS_PER_TASK:
        kind = links.schema["u"].dataType.simpleString()
        return cut_lineage(edges.coalesce(1).mapInArrow(joined, f"node {kind}, label {kind}"))
    edges, parts = _sized(edges.distinct())
    levels = []
    while parts:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        level = cut_lineage(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")).coalesce(parts))
        moving = 1
        while moving:
            jump = level.select(F.col("node").alias("at"), F.col("label").alias("further"))
            moved, moving = _counted(level.join(jump, F.col("label") == F.col("at")).select("node", "label", "further").coalesce(parts), F.col("label") != F.col("further"))
            level = moved.select("node", F.col("further").alias("label"))
        levels.append(level)
        end = lambda c, level=level: level.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        further = edges.join(end("u"), "u").join(end("v"), "v").filter("u_label != v_label")
        edges, parts = _sized(further.select(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v")).distinct().coalesce(parts))
    out = levels[-1]
    for level in levels[-2::-1]:
        out = level.join(out.select(F.col("node").alias("of"), F.col("label").alias("top")), F.col("label") == F.col("of"), "left").select("node", F.coalesce("top", "label").alias("label"))
    return cut_lineage(out) if len(levels) > 1 else out


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, _id, _of, keep) of each document; ``class_id`` is the smallest doc_id of its class.

    Texts without words (null, empty, blank) are in no one's class but their
    own. Rows with the same id and other texts are documents of their own, equal
    rows are alike; null ids come first and give a null class_id. ``keep`` is true for the
    class's first document. Columns other than doc_id and text aren't read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"), F.xxhash64(text).alias("_of"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    minima = ", ".join(f"{m} long" for m in MINIMA)
    sketches = cut_lineage(rows.select("_id", "_of", "text").mapInArrow(_sketch, f"_id long, _of long, s1 long, s2 long, n long, bands array<long>, {minima}"))
    least_one = F.min(F.struct("_id", "_of")).alias("node")
    nodes, _ = _sized(sketches.groupBy("s1", "s2").agg(least_one, F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first(m).alias(m) for m in MINIMA]))
    # Only buckets of two or more nodes matter from here on, and only the texts of nodes in one.
    spread = nodes.select("node", "n", *MINIMA, F.explode("bands").alias("key"))
    several = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.bitwise_not("key").alias("turned"))
    shared, _ = _sized(spread.join(several, F.bitwise_not("key") == F.col("turned"), "left_semi").groupBy("node", "n", *MINIMA).agg(F.collect_list("key").alias("keys")))
    wanted = shared.select("node._id", "node._of")
    texts, forget = written(rows.select("_id", "_of", "text").join(wanted, ["_id", "_of"], "left_semi").dropDuplicates(["_id", "_of"]).select(F.struct("_id", "_of").alias("node"), "text"), "near-texts")
    links, _ = _sized(_links(_with_heads(shared), texts, least))
    labels = components(links)
    known = shared.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "n", "keys", *MINIMA, F.coalesce("label", "node").alias("label"))
    rest, some = _sized(_open(_twice(known)))
    if some:
        tiles = _dealt(rest).join(texts.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("tile", "side", "label", "text")
        more = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare(least), links.schema)
        tops = components(more).select(F.col("node").alias("of"), F.col("label").alias("top"))
        labels = known.join(tops, F.col("label") == F.col("of"), "left").select("node", F.coalesce("top", "label").alias("label"))
    forget()
    named = nodes.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.bitwise_not("s1").alias("t1"), F.bitwise_not("s2").alias("t2"), F.coalesce("label", "node").alias("class"))
    member = sketches.join(named, (F.bitwise_not("s1") == F.col("t1")) & (F.bitwise_not("s2") == F.col("t2"))).select("_id", "_of", "class").distinct()
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"), F.xxhash64(text).alias("_of"), F.col("doc_id").cast("long").alias("doc_id"))
    own = F.struct("_id", "_of")
    joined = ids.join(member, ["_id", "_of"], "left").withColumn("class", F.coalesce("class", own))
    return joined.select("doc_id", F.when(F.col("class._id") > -(1 << 63), F.col("class._id")).alias("class_id"), "_id", "_of", (F.col("class") == own).alias("keep"))


def keep_one(docs: DataFrame, columns: tuple[str, ...], least: float = SIMILARITY) -> DataFrame:
    """The named columns of the first document of each class; of rows with its id and text, those of the smallest row."""
    kept = classes(docs, least).filter("keep").select("_id", "_of").distinct()
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_of")]
    found = docs.select(*key, F.struct(*columns).alias("row")).join(kept, ["_id", "_of"], "left_semi")
    return found.groupBy("_id", "_of").agg(F.min("row").alias("row")).select("row.*")
