"""URL filter: explicit rules first, then a ratio of character language models.

Two smoothed variable-order Markov models over bytes are counted from every URL
that a rule decides: one for accepted, one for rejected URLs. A context of k
bytes backs off to k - 1 by Dirichlet smoothing. A URL without a rule is judged
by the length-normalised difference of its log-likelihoods against a threshold
calibrated on a fifth of the decided URLs, which isn't counted.

Counts are exact and grow with the URLs: an n-gram is a number of nine bits a
symbol, counted in a DataFrame. A byte and the ``ORDERS`` - 1 before it settle
what the byte adds to a score, so each slice of URLs asks for the weights of its
distinct n-grams and gets them by joins. Only counts of up to two symbols (66,049
at most) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prowave.session import cut_lineage, written

from . import textkernel as tk

ORDERS = 5
SYMBOL_BITS = 9
SLICE_BYTES = 1 << 19
SMOOTHING = 4.0
BINS = 400
SPAN = 4.0

#: (rule, verdict): a host and the beginning of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both '' for null and where there is no ``://``."""
    tail = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDERS - 1 symbols before it, the byte lowest; what stands before a URL's start is symbol 0."""
    part = data.astype(np.int64) + 1
    place = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = part.copy()
    for k in range(1, ORDERS):
        before = np.zeros(len(part), np.int64)
        before[k:] = part[:-k]
        before[place < k] = 0
        out |= before << (SYMBOL_BITS * k)
    return out


def _mask(symbols: int) -> int:
    return (1 << SYMBOL_BITS * symbols) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, accepted, rejected) of the decided URLs, summed up by slice."""
    for b in batches:
        yes = np.asarray(b.column("accepted").to_numpy(zero_copy_only=False), bool)
        data, offsets = tk.string_bytes(b.column("url"))
        for lo, hi in tk.slices(offsets, SLICE_BYTES):
            lengths = np.diff(offsets[lo : hi + 1])
            gram, at = np.unique(_grams(data[offsets[lo] : offsets[hi]], lengths), return_inverse=True)
            of = np.repeat(yes[lo:hi], lengths)
            n = [np.bincount(at, of == c, minlength=len(gram)).astype(np.int64) for c in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, n)], names=["gram", "accepted", "rejected"])


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, rows, grams): runs of URLs, and their distinct n-grams; a slice is named by what it holds."""
    for b in batches:
        data, offsets = tk.string_bytes(b.column("url"))
        rows = pa.StructArray.from_arrays(b.columns, names=b.schema.names)
        for lo, hi in tk.slices(offsets, SLICE_BYTES):
            part = data[offsets[lo] : offsets[hi]]
            gram = np.unique(_grams(part, np.diff(offsets[lo : hi + 1])))
            name = hashlib.blake2b(part.tobytes() + np.diff(offsets[lo : hi + 1]).tobytes() + str(b.column("page_id").slice(lo, hi - lo).to_pylist()).encode(), digest_size=8).digest()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.slice(lo, hi - lo), pa.array(gram))]
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little", signed=True)]), *lists], names=["slice", "rows", "grams"])


#: The n-grams and contexts that are looked up by joins: (low symbols left out, symbols).
_LOOKED_UP = ((0, 3), (0, 4), (0, 5), (1, 3), (1, 4))


def _keys(gram: Column) -> Column:
    """The numbers by which a gram's parts are counted, one for each of _LOOKED_UP."""
    return F.array(*[F.shiftright(gram, SYMBOL_BITS * low).bitwiseAND(F.lit(_mask(n))) + F.lit(i << (SYMBOL_BITS * ORDERS)) for i, (low, n) in enumerate(_LOOKED_UP)])


def weights(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, w): log P(byte | accepted) - log P(byte | rejected) of each wanted gram, from (gram, accepted, rejected) with distinct grams."""
    sums = [F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")]
    size = 1 << 2 * SYMBOL_BITS
    small = np.zeros((2, 2, size))  # of two symbols as a gram and as a context, by class
    for low in (0, 1):
        got = counts.groupBy(F.shiftright("gram", SYMBOL_BITS * low).bitwiseAND(F.lit(_mask(2))).alias("gram")).agg(*sums).toArrow()
        for c, name in enumerate(("accepted", "rejected")):
            small[low, c, got.column("gram").to_numpy()] = got.column(name).to_numpy()
    table = counts.select(F.explode(_keys(F.col("gram"))).alias("key"), "accepted", "rejected").groupBy("key").agg(*sums)
    asked = wanted.select("gram", F.posexplode(_keys(F.col("gram"))).alias("kind", "asked"))
    found = asked.join(table, F.col("asked") == F.col("key"), "left")
    one = lambda i, c: F.coalesce(F.max(F.when(F.col("kind") == i, F.col(c))), F.lit(0)).alias(f"{c[0]}{i}")
    parts = found.groupBy("gram").agg(*[one(i, c) for i in range(len(_LOOKED_UP)) for c in ("accepted", "rejected")])
    one_symbol = small[0].reshape(2, 1 << SYMBOL_BITS, 1 << SYMBOL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram = b.column("gram").to_numpy()
            logs = []
            for c, name in enumerate("ar"):
                of = [b.column(f"{name}{i}").to_numpy() for i in range(len(_LOOKED_UP))]
                p = (one_symbol[c].sum(0)[gram & _mask(1)] + SMOOTHING / 256) / (one_symbol[c].sum() + SMOOTHING)
                p = (small[0, c][gram & _mask(2)] + SMOOTHING * p) / (one_symbol[c].sum(1)[gram >> SYMBOL_BITS & _mask(1)] + SMOOTHING)
                p = (of[0] + SMOOTHING * p) / (small[1, c][gram >> SYMBOL_BITS & _mask(2)] + SMOOTHING)
                p = (of[1] + SMOOTHING * p) / (of[3] + SMOOTHING)
                p = (of[2] + SMOOTHING * p) / (of[4] + SMOOTHING)
                logs.append(np.log(p))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(logs[0] - logs[1])], names=["gram", "w"])

    return parts.mapInArrow(run, "gram long, w double")


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices' rows with their scores: the mean weight of a URL's bytes, 0 without any."""
    for b in batches:
        for i in range(b.num_rows):
            rows, found = b.column("rows")[i].values, b.column("found")[i].values
            known, w = found.field("gram").to_numpy(), found.field("w").to_numpy()
            order = np.argsort(known)
            data, offsets = tk.string_bytes(rows.field("url"))
            lengths = np.diff(offsets)
            each = w[order][np.searchsorted(known[order], _grams(data, lengths))] if len(known) else np.zeros(0)
            score = np.bincount(np.repeat(np.arange(len(lengths)), lengths), each, minlength=len(lengths)) / np.maximum(lengths, 1)
            names = [f.name for f in rows.type if f.name != "url"]
            yield pa.RecordBatch.from_arrays([*(rows.field(n) for n in names), pa.array(score)], names=[*names, "score"])


def threshold(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy on (accepted, score), in BINS bins; 0 without both kinds."""
    at = F.least(F.greatest(F.floor((F.col("score") / SPAN + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    found = np.zeros((2, BINS))
    for r in scored.groupBy("accepted", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        found[int(r["accepted"]), r["bin"]] = r["n"]
    if not (found[0].sum() and found[1].sum()):
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(found, 1)], 1) / found.sum(1, keepdims=True)
    good = (below[0] + 1 - below[1]) / 2  # balanced accuracy of a cut before each bin
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((best[np.argsort(np.abs(best - best.mean()), kind="stable")[0]] / BINS - 0.5) * SPAN)


def scores(rows: DataFrame) -> DataFrame:
    """The rows of (page_id, url, verdict of a rule or null, fold, …) without their url, with a score: models are counted on the rows that rules decide, but for fold 0."""
    kept = [f for f in rows.columns if f != "url"]
    types = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in kept)
    decided = rows.filter(F.col("rule_verdict").isNotNull() & (F.col("fold") != 0)).select("url", (F.col("rule_verdict") == "allow").alias("accepted"))
    counts = decided.mapInArrow(_count, "gram long, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    counts = cut_lineage(counts)
    if not counts.agg((F.max("accepted") > 0) & (F.max("rejected") > 0)).first()[0]:
        return rows.select(*kept, F.lit(0.0).alias("score"))  # one kind of URL alone can't be told from the other
    slices, forget = written(rows.mapInArrow(_slice, f"slice long, rows array<struct<{', '.join(f'{f}: {rows.schema[f].dataType.simpleString()}' for f in rows.columns)}>>, grams array<long>"), "url-slices")
    asked = slices.select("slice", F.explode("grams").alias("gram")).distinct()
    w = weights(counts, asked.select("gram").distinct()).select(F.bitwise_not("gram").alias("turned"), "w")
    found = asked.join(w, F.bitwise_not("gram") == F.col("turned")).groupBy("slice").agg(F.collect_list(F.struct("gram", "w")).alias("found"))
    none = F.array().cast("array<struct<gram: bigint, w: double>>")
    both = slices.select("slice", "rows").join(found, "slice", "left").select("rows", F.coalesce("found", none).alias("found"))
    out = cut_lineage(both.mapInArrow(_score, f"{types}, score double"))
    forget()
    return out


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each URL.

    Null URLs and those without ``://`` have '' for host and path, no rule, and
    are blocked: there is no address to judge. Repeated rows give repeated
    results; a URL of any length is read whole, one too long for a slice is a
    slice of its own. Where rules decide URLs of one kind alone or none the
    score is 0 and the rest is allowed. Other columns are left out.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "rule_verdict": verdict, "fold": F.coalesce(F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)), F.lit(0)).cast("int")})
    scored = scores(base)
    held_out = scored.filter(F.col("rule_verdict").isNotNull() & (F.col("fold") == 0))
    cut = threshold(held_out.select((F.col("rule_verdict") == "allow").alias("accepted"), "score"))
    own = F.when((F.col("host") != "") & (F.col("score") >= cut), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
