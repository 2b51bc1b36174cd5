"""Mix sources to target weights by systematic sampling, with DataFrame operations alone.

A document's expected copies are its source's target divided by the source's
size. Documents of a source stand in a fixed order (by size first, so that long
and short ones share evenly), their expected copies are summed up along it, one
offset per source is added, and a copy is taken at each integer passed.

The running sum is made in two levels so that no source is one task: bucket
totals are summed along each source, and ranks are counted inside a bucket
(size class and hash of the id). The number of buckets grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 64
ROWS_PER_BUCKET = 1 << 24


def buckets_for(rows: int) -> int:
    n = BUCKETS
    while n * ROWS_PER_BUCKET < rows * BUCKETS:
        n *= 2
    return n


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh ``weights`` in turn. The level that
    fills ``share`` of all words is found on the sources sorted by cap over
    weight: the first one whose cap isn't under the level left by those before.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap") / F.col("w")
    up = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("ratio", ratio)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0))) / F.sum("w").over(down)
    s = s.withColumn("level", level).withColumn("at", F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), "level")))
    s = s.withColumn("fill", F.min("at").over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("fill") * F.col("w")).alias("target"))


def copies(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, *keep, size, source_size, target, copies, taken) of each document.

    Null texts and texts without words have size 0 and take 0 words; a null
    source is a source; rows that repeat each take their own copies; an empty
    table gives none. Only the named columns of ``docs`` are read.
    """
    n = buckets_for(docs.count())
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *([F.struct(*[c for c in keep]).alias("row"), F.xxhash64(text).alias("tie")] if keep else [F.lit(0).alias("row"), F.lit(0).alias("tie")]),
    ).withColumns({"class": F.floor(F.sqrt("size")), "bucket": F.pmod(_hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))})
    key = ["source", "class", "bucket"]
    totals = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    along = W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*key, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    goal = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = starts.join(goal, same(starts, goal, ["source"])).select(starts["source"].alias("of"), starts["class"].alias("of_class"), starts["bucket"].alias("of_bucket"), "before", "source_size", "target")
    ranked = base.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id", "tie")))
    joined = ranked.join(starts, ranked["source"].eqNullSafe(starts["of"]) & (ranked["class"] == starts["of_class"]) & (ranked["bucket"] == starts["of_bucket"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))) / F.lit(4294967296.0)
    passed = lambda i: F.floor(rate * i + offset)
    place = F.col("before") + F.col("rank")
    out = joined.withColumn("copies", F.least(passed(place) - passed(place - 1), F.lit(most)).cast("long"))
    return out.select("doc_id", *[F.col("row")[c].alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The mix itself: each document's ``columns`` as many times as it is taken, with size, source_size, target, taken and the copy's number."""
    rest = tuple(c for c in columns if c != "doc_id")
    got = copies(docs, keep=rest).filter("copies > 0")
    return got.select("doc_id", *rest, "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h, (SELECT count(*) FROM documents) AS rows_all
  FROM documents),
nb AS (SELECT *, {BUCKETS} * (2 ** greatest(0, ceil(log2(greatest(rows_all, 1) / {ROWS_PER_BUCKET}))))::BIGINT AS nb FROM base),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), h % nb, size, doc_id NULLS FIRST) AS place FROM nb),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w, source_size * {MOST} AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER () AS words FROM w),
l AS (SELECT *, ({SHARE}::DOUBLE * words::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
        row_number() OVER (ORDER BY ratio, source NULLS LAST) AS turn FROM r),
f AS (SELECT arg_min(level, turn) AS fill FROM l WHERE ratio >= level),
goal AS (SELECT source, source_size, least(cap::DOUBLE, fill * w) AS target,
        CASE WHEN source_size > 0 THEN least(cap::DOUBLE, fill * w) / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{SEED}|' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l, f)
SELECT doc_id, size, source_size, target,
       (size * least({MOST}, floor(rate * place + u) - floor(rate * (place - 1) + u)))::BIGINT AS taken
FROM ranked JOIN goal ON ranked.source IS NOT DISTINCT FROM goal.source
"""
