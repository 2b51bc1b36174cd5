"""Benchmark passages in training texts, by an FM-index per shard.

A shard is a slice of an Arrow batch. Its words become numbers of the
benchmark's vocabulary; runs of such words that are too short for any window
are left out (they can't hold one), the rest is indexed. All benchmark windows
are then searched backwards at once, located, and merged to spans.

The benchmark is the query set: it is read in blocks of a bounded number of
windows, and each block is sent to the executors and searched in all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .fm_index import FMIndex

WINDOW = 10
BLOCK_WINDOWS = 200_000


@dataclass
class Block:
    """Distinct windows as vocabulary numbers (from 1; padded with 0) and the items of each."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[str]
    item_offsets: np.ndarray
    item_of: np.ndarray


def make_block(items: list[tuple[str, str]], window: int = WINDOW) -> Block:
    rows: dict[bytes, tuple[np.ndarray, dict[int, None]]] = {}
    names: dict[str, int] = {}
    hashes = []
    for name, text in items:
        for _, _, words in tk.each_slice(pa.array([text], pa.string()), tk.ALNUM_WORDS, lower=True):
            hashes.append((names.setdefault(name, len(names)), words.hashes()))
    vocabulary = np.unique(np.concatenate([h for _, h in hashes] or [np.zeros(0, np.uint64)]))
    for item, h in hashes:
        ids = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
        for i in range(max(1, len(ids) - window + 1)) if len(ids) else ():
            part = ids[i : i + window]
            rows.setdefault(part.tobytes(), (part, {}))[1][item] = None
    patterns = np.zeros((len(rows), window), np.int32)
    for i, (part, _) in enumerate(rows.values()):
        patterns[i, : len(part)] = part
    each = [list(found) for _, found in rows.values()]
    return Block(
        vocabulary, patterns, np.array([len(p) for p, _ in rows.values()], np.int64), list(names),
        np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), np.array([i for x in each for i in x], np.int64),
    )


def blocks_of(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """Blocks of up to ``most`` windows by an upper bound, half the characters (one longer item makes a block of its own); nulls have no words, a null id is named ''."""
    held: list[tuple[str, str]] = []
    windows = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, text in rows.toLocalIterator():
        n = len(text) // 2 + 1
        if held and windows + n > most:
            yield make_block(held, window)
            held, windows = [], 0
        held.append((name, text))
        windows += n
    if held:
        yield make_block(held, window)


def search_shard(words: tk.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, window) of each occurrence of the block's windows in a shard."""
    none = np.zeros(0, np.int64)
    if not len(block.patterns) or not len(words.start):
        return none, none, none
    h = words.hashes()
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == h
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (words.doc[1:] != words.doc[:-1])
    cut = np.flatnonzero(edge)
    begin, size = cut[:-1], np.diff(cut)
    runs = known[begin] & (size >= block.lengths.min())
    begin, size = begin[runs], size[runs]
    if not len(begin):
        return none, none, none
    room = size + 1  # a separator after each run
    place = np.repeat(np.cumsum(room) - room, size) + _within(size)
    source = np.repeat(begin, size) + _within(size)
    text = np.zeros(int(room.sum()), np.int64)
    text[place] = at[source] + 1
    back = np.zeros(len(text) + 1, np.int64)
    back[place] = source
    index = FMIndex(text, len(block.vocabulary) + 1)
    low, high = index.search(block.patterns, block.lengths)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    first = back[index.locate(np.repeat(low, count) + _within(count))]
    return first, block.lengths[window], window


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spans(covered: np.ndarray, words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of covered words of one row."""
    inside = np.zeros(len(covered) + 2, np.int8)
    inside[1:-1] = covered
    new = np.ones(len(covered) + 1, bool)
    new[1:-1] = words.doc[1:] != words.doc[:-1]
    first = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | new[:-1]))
    last = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | new[1:]))
    return first, last


def _stage(block: Block, last: bool, cut: bool):
    """One block searched in all texts; the last stage merges spans and gives the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old_spans, old_items = b.column("spans"), b.column("items")
            for lo, hi, words in tk.each_slice(b.column("text"), tk.ALNUM_WORDS, lower=True, limit=1 << 22):
                n = hi - lo
                first, size, window = search_shard(words, block)
                cover = np.zeros(len(words.start) + 1, np.int32)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + size, -1)
                for i, spans in enumerate(old_spans.slice(lo, n).to_pylist()):
                    for s in spans or ():
                        cover[words.first[i] + (s >> 32)] += 1
                        cover[words.first[i] + (s & 0xFFFFFFFF) + 1] -= 1
                covered = np.cumsum(cover)[:-1] > 0
                begin, end = _spans(covered, words)
                many = np.diff(block.item_offsets)[window]
                item = block.item_of[np.repeat(block.item_offsets[window], many) + _within(many)] if len(window) else np.zeros(0, np.int64)
                pair = np.unique(np.repeat(words.doc[first], many) * max(1, len(block.items)) + item)
                items: list[set[str]] = [set(x or ()) for x in old_items.slice(lo, n).to_pylist()]
                for p in pair.tolist():
                    items[p // len(block.items)].add(block.items[p % len(block.items)])
                keep = [b.column(c).slice(lo, n) for c in ("doc_id", "row")]
                if not last:
                    doc = words.doc[begin]
                    packed = ((begin - words.first[doc]) << 32) | (end - words.first[doc])
                    off = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*keep, b.column("text").slice(lo, n), pa.ListArray.from_arrays(pa.array(off), pa.array(packed)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "row", "text", "spans", "items"])
                    continue
                hit = np.bincount(words.doc[covered], minlength=n)
                out = [*keep, pa.array(np.diff(words.first)), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array(hit > 0)]
                if cut:
                    out.append(_without(b.column("text").slice(lo, n), words, begin, end))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text"][: len(out)])

    return run


def _without(texts: pa.Array, words: tk.Words, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts without the bytes from each span's first word to its last."""
    out = texts.to_pylist()
    raw: dict[int, list[tuple[int, int]]] = {}
    for f, e in zip(begin.tolist(), end.tolist(), strict=True):
        raw.setdefault(int(words.doc[f]), []).append((int(words.start[f]), int(words.end[e])))
    for i, spans in raw.items():
        base, data = int(words.offsets[i]), out[i].encode()
        parts, at = [], 0
        for s, e in spans:
            parts.append(data[at : s - base])
            at = e - base
        out[i] = b"".join([*parts, data[at:]]).decode()
    return pa.array(out, pa.string())


def search(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), cut: bool = False, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated[, text]) of each document; ``row`` holds the columns named by ``keep``.

    Null and empty texts have no words and no hits; an item without words is in
    no document; items of one id count once; repeated documents repeat. With
    ``cut``, ``text`` comes back without its hit spans. Without any benchmark
    item nothing is hit. No shuffle: documents pass once per block of items.
    """
    now = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col("text").cast("string").alias("text"),
        F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    row = now.schema["row"].dataType.simpleString()
    between = f"doc_id long, row {row}, text string, spans array<long>, items array<string>"
    held: Block | None = None
    for block in blocks_of(benchmark, window, block_windows):
        if held is not None:
            now = now.mapInArrow(_stage(held, False, False), between)
        held = block
    held = held or make_block([], window)
    return now.mapInArrow(_stage(held, True, cut), f"doc_id long, row {row}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", text string" * cut)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
cuts AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS run FROM cuts),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM docs),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT t.doc_id, t.p, s.size, array_to_string(d.w[t.p : t.p + s.size - 1], ' ') AS run FROM words t JOIN docs d ON t.doc_id = d.doc_id, sizes s WHERE t.p + s.size - 1 <= t.n),
hits AS (SELECT r.doc_id, r.p, r.size, x.item FROM runs r JOIN windows x ON r.size = x.size AND r.run = x.run),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
