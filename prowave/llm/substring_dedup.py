"""Repeated passages by seed and extend.

A *window* is ``length`` consecutive words of one document; each word of a
window that also starts earlier is removed (earlier: smaller doc_id, or same
document and earlier start). Windows are judged on the input.

1. *Seeds.* Winnowing picks an anchor for each window: the smallest hashed run
   of ``SEED`` words in it, leftmost of equals. It depends on the window's words
   alone, so equal windows have equal anchors at equal places. Anchors are
   counted (with partial sums), and documents learn by a join which of their
   anchors repeat. Anchors that don't can't be in a repeated window.
2. *Extension.* The windows around a repeated anchor are its extensions to both
   sides. Occurrences meet by anchor, and each window's hash is compared within
   that group; a group has fewer than ``HOT`` rows. Anchors that occur more often
   meet by whole window instead: equal windows of a slice are combined, then those
   of ``SALTS`` parts of the documents, then the parts' first ones, so a passage of
   half the corpus is no task of its own.
3. Neighbouring removed windows merge to maximal repeats, and texts are cut.

A document is known by a 64-bit hash of its id and whole text. Equality of
windows is that of 64-bit hashes within one anchor (also 64 bits); texts move
twice by document, by the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk

LENGTH = 20
SEED = 8
HOT = 1000
SALTS = 64


def _anchors_of(words: tk.Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts of windows in one row, their anchors' places, seed hashes)."""
    h = words.hashes()
    if len(h) < length:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = tk.window_hashes(h, SEED)
    n, width = len(h) - length + 1, length - SEED + 1
    best, at = seeds[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, width):
        now = seeds[j : j + n]
        less = now < best
        np.copyto(best, now, where=less)
        at[less] = j
    starts = np.flatnonzero(tk.inside_one_row(words, length))
    return h, starts, starts + at[starts], seeds


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows keyed by id and text: rows of one id with other texts are versions of it in the order of their hashes; equal rows are alike. Null ids come first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    return docs.select(own.alias("_id"), F.xxhash64(own, text).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _seeds(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("_row").to_numpy()
            for lo, _, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
                _, _, anchor, seeds = _anchors_of(words, length)
                at = anchor[np.flatnonzero(np.diff(anchor, prepend=-1))]
                row = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(seeds[at].view(np.int64)), pa.array(of[lo + row]), pa.array((at - words.first[row]).astype(np.int32))], names=["a", "_row", "at"])

    return run


def _flat(col: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, flat values' index range) of a list column's rows lo..hi; null lists are empty."""
    off = col.offsets.to_numpy()[lo : hi + 1].astype(np.int64)
    return np.repeat(np.arange(hi - lo), np.diff(off)), np.arange(off[0], off[-1])


def _windows(length: int):
    """Rows (key, _id, _row, at, hashes, mask, hot): the windows from word ``at`` on around a repeated anchor; ``mask`` marks those known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, of, seen = b.column("_id").to_numpy(), b.column("_row").to_numpy(), b.column("seen")
            values = seen.values.to_numpy()
            for lo, hi, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
                h, starts, anchor, seeds = _anchors_of(words, length)
                row, flat = _flat(seen, lo, hi)
                if not len(starts) or not len(flat):
                    continue
                level = np.zeros(len(h) + 1, np.int8)
                level[words.first[row] + (values[flat] >> 1)] = 1 + (values[flat] & 1)
                some = level[anchor] > 0
                starts, anchor = starts[some], anchor[some]
                if not len(starts):
                    continue
                whole = tk.window_hashes(h, length)[starts]
                doc = words.doc[starts]
                yield from _grouped(ids[lo + doc], of[lo + doc], (starts - words.first[doc]).astype(np.int32), whole, seeds[anchor], anchor, level[anchor] == 2)

    return run


def _rows(key, ids, of, place, hashes: np.ndarray, sizes: np.ndarray, mask: int, hot: bool) -> pa.RecordBatch:
    off = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)
    col = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(hashes))])
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(of), pa.array(place), col, pa.array(np.full(n, mask, np.int32)), pa.array(np.full(n, hot))], names=["key", "_id", "_row", "at", "hashes", "mask", "hot"])


def _grouped(ids, of, place, whole, seed, anchor, hot) -> Iterator[pa.RecordBatch]:
    cool = np.flatnonzero(~hot)
    if len(cool):
        cut = np.flatnonzero(np.diff(anchor[cool], prepend=-1))
        at = cool[cut]
        yield _rows(seed[at], ids[at], of[at], place[at], whole[cool], np.diff(np.append(cut, len(cool))), 0, False)
    warm = np.flatnonzero(hot)
    if len(warm):
        order = warm[np.lexsort((place[warm], of[warm], ids[warm], whole[warm]))]
        new = np.flatnonzero(np.diff(whole[order], prepend=whole[order[0]] + np.uint64(1)))
        lead = order[np.repeat(new, np.diff(np.append(new, len(order))))]
        first = (ids[order] == ids[lead]) & (of[order] == of[lead]) & (place[order] == place[lead])  # equal rows are alike
        own = lambda part: tk.mix(of[part].view(np.uint64))
        part = np.sort(order[first])
        yield _rows(tk.mix(whole[part] + own(part) % np.uint64(SALTS)), ids[part], of[part], place[part], whole[part], np.ones(len(part), int), 0, True)
        part = np.sort(order[~first])
        if len(part):
            yield _rows(tk.mix(own(part) * np.uint64(3) + place[part].astype(np.uint64)), ids[part], of[part], place[part], np.zeros(0, np.uint64), np.zeros(len(part), int), 1, False)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, _id, _row, at): (_id, _row, at, mask, whole) with a bit for each window that an earlier row of its key has.

    Of hot windows the first one of a key comes too, with its hash as ``whole`` and no bit.
    """
    last, known, before = None, np.zeros(0, np.uint64), None
    for b in batches:
        if not b.num_rows:
            continue
        # Rows of equal documents stand next to each other and count once.
        own = [b.column(c).to_numpy() for c in ("key", "_id", "_row", "at")]
        fresh = np.ones(b.num_rows, bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in own], axis=0)
        fresh[0] = before != tuple(c[0] for c in own)
        before = tuple(c[-1] for c in own)
        if not fresh.all():
            b = b.filter(pa.array(fresh))
            if not b.num_rows:
                continue
        key, mask = b.column("key").to_numpy(), b.column("mask").to_numpy().astype(np.int64)
        col = b.column("hashes")
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = col.buffers()[2]
        flat = np.frombuffer(data, np.uint64, (off[-1] - off[0]) // 8, off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(key)), np.diff(off) // 8)
        bit = np.arange(len(flat)) - (off[row] - off[0]) // 8
        k = key[row]
        order = np.lexsort((row, flat, k))
        same = np.zeros(len(flat), bool)
        if len(flat):
            same[order[1:]] = (flat[order[1:]] == flat[order[:-1]]) & (k[order[1:]] == k[order[:-1]])
            if last is not None and len(known):
                head = k == last
                same[head] |= np.isin(flat[head], known)
            tail = np.unique(flat[k == k[-1]])
            known = np.union1d(known, tail) if last == k[-1] else tail
            last = k[-1]
        mask = mask + np.bincount(row[same], (1 << bit[same]).astype(float), minlength=len(key)).astype(np.int64)
        lead = np.asarray(b.column("hot").to_numpy(zero_copy_only=False), bool) & (mask == 0)
        out = np.flatnonzero((mask > 0) | lead)
        whole = np.zeros(len(key), np.uint64)
        whole[row] = flat  # a hot row has one window
        take = [b.column(c).take(pa.array(out)) for c in ("_id", "_row", "at")]
        yield pa.RecordBatch.from_arrays([*take, pa.array(mask[out].astype(np.int32)), pa.array(whole[out].view(np.int64), mask=~lead[out])], names=["_id", "_row", "at", "mask", "whole"])


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_row, gone) of each document with repeated windows: ``gone`` lists (place << 16 | mask), a bit for each window from that word on."""
    seeds = _keyed(docs).select("_row", "text").mapInArrow(_seeds(length), "a long, _row long, at int")
    # The bits of the second key are turned so that both sides are exchanged for the join, which lets Spark split a frequent anchor.
    often = seeds.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.bitwise_not("a").alias("turned"), (F.col("n") >= HOT).alias("hot"))
    hits = seeds.join(often, F.bitwise_not("a") == F.col("turned"))
    place = F.col("at").cast("long")
    marks = hits.groupBy("_row").agg(F.collect_list(place * 2 + F.col("hot").cast("long")).alias("seen"))
    found = _placed(docs).join(marks, "_row").select("_id", "_row", "doc_id", "text", "seen").mapInArrow(_windows(length), "key long, _id long, _row long, at int, hashes binary, mask int, hot boolean")
    # Both uses of what is later read one exchange of the windows.
    later = found.repartition("key").sortWithinPartitions("key", "_id", "_row", "at").mapInArrow(_later, "_id long, _row long, at int, mask int, whole long")
    # At most SALTS first ones of each hot window are left: all but the first of them are repeats too.
    heads = later.filter("whole is not null").groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("_id", "_row", "at"))).alias("own"))
    again = heads.select(F.explode(F.slice("own", 2, SALTS)).alias("own")).select("own._row", "own.at", F.lit(1).alias("mask"))
    every = later.filter("mask > 0").select("_row", "at", "mask").unionByName(again)
    return every.groupBy("_row").agg(F.collect_list(place * 65536 + F.col("mask")).alias("gone"))


def _placed(docs: DataFrame) -> DataFrame:
    """Texts dealt out by row key: the same exchange in both joins, so Spark makes it once, if both read the same columns."""
    return _keyed(docs).repartition("_row")


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column("gone")
            values = gone.values.to_numpy(zero_copy_only=False)
            for lo, hi, words in tk.each_slice(b.column("text"), tk.SPACE_WORDS):
                removed = removed_words(words, *_flat(gone, lo, hi), values, length)
                count = lambda of: np.bincount(of, minlength=hi - lo)
                kept = kept_texts(words, ~removed)
                out = [b.column("doc_id").slice(lo, hi - lo), pa.array(count(words.doc)), pa.array(count(words.doc[removed])), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                if with_text:
                    out.append(pa.array([t.decode() for t in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(out)])

    return run


def removed_words(words: tk.Words, row: np.ndarray, flat: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    cover = np.zeros(len(words.start) + length + 17, np.int32)
    base, mask = words.first[row] + (values[flat] >> 16), values[flat] & 65535
    for bit in range(16):
        at = base[(mask >> bit) & 1 == 1] + bit
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
    return np.cumsum(cover)[: len(words.start)] > 0


def kept_texts(words: tk.Words, kept: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by one space."""
    n = len(words.data)
    start, end, doc = words.start[kept], words.end[kept], words.doc[kept]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    take = np.cumsum(edge)[:n] > 0
    data = words.data.copy()
    inner = start[1:][doc[1:] == doc[:-1]] - 1
    take[inner] = True
    data[inner] = 0x20
    ends = np.concatenate([[0], np.cumsum(take)])[words.offsets]
    out = data[take].tobytes()
    return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of each document.

    Null and blank texts have no words. Of repeated passages the first stays.
    Equal rows (same id and text) are alike and count as one document; only
    doc_id and text of ``docs`` are read. An empty table gives no rows.
    """
    if length - SEED + 1 > 16 or length < SEED:
        raise ValueError("length must be from SEED to SEED + 15")
    joined = _placed(docs).join(repeats(docs, length), "_row", "left").select("_id", "doc_id", "text", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    return joined.mapInArrow(_cut(length, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


#: doc_id is unique in the driver's tables.
ORACLE_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM split),
runs AS (SELECT doc_id, p, word, CASE WHEN p + {LENGTH - 1} <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) END AS run FROM words),
firsts AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS later FROM runs),
marked AS (SELECT doc_id, p, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM firsts),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS left_over FROM marked GROUP BY doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
