"""Cross-site boilerplate lines by distinct-site spread, with DataFrame operations alone.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites. A
HyperLogLog sketch of the sites of each line's hash is built where the lines are
read and merged by aggregation; only lines whose estimate lies near the
threshold are counted exactly. Boilerplate goes from every document but the
first that has it (smallest doc_id, then first line), so no content is lost
altogether. Only hashes meet in the shuffles by line; texts move once, by
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_SITES = 10
SKETCH_BITS = 11
NEAR = 0.25


def _keys(docs: DataFrame) -> list[Column]:
    """Which row: null ids as the smallest; rows of one id are told apart by their text's hash, equal rows are alike."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_of")]


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """(h, g, first) of each line on at least ``min_sites`` sites; ``first`` is its first occurrence. A null source is a site of its own."""
    lines = _lines(docs)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sites"), F.min(F.struct("_id", "_of", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    spread = spread.filter(F.col("n") >= min_sites).withColumn("about", F.hll_sketch_estimate("sites")).filter(F.col("about") >= min_sites * (1 - near)).select("h", "g", "first", "about")
    close = spread.filter(F.col("about") <= min_sites * (1 + near)).select("h", "g")
    exact = lines.join(*_by_line(lines, close), "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("about") > min_sites * (1 + near)).select("h", "g", "first")
    return sure.unionByName(spread.join(exact.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "first"))


def _by_line(lines: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """``found`` and how to join it with ``lines``. The turned hash makes Spark exchange both sides for the join, so that it can split a frequent line."""
    turned = found.select(F.bitwise_not("h").alias("_h"), F.col("g").alias("_g"), *[c for c in found.columns if c not in "hg"])
    return turned, (F.bitwise_not(lines["h"]) == turned["_h"]) & (lines["g"] == turned["_g"])


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _of, line, h, g, site) of each line that isn't blank."""
    each = docs.select(*_keys(docs), F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull()).alias("site"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line", "s"))
    return each.filter(F.trim("s") != "").select("_id", "_of", "line", F.xxhash64("s").alias("h"), F.hash("s").alias("g"), "site")


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text, *keep, n_lines, n_removed) of each document, ``text`` without the removed lines.

    ``n_lines`` counts all lines, blank ones too (null text: 0, and the text
    stays null). A document of boilerplate alone keeps an empty text. Columns of
    ``docs`` that aren't named don't matter, whatever they are called.
    """
    lines = _lines(docs)
    hits = lines.join(*_by_line(lines, boilerplate(docs, min_sites))).filter(F.struct("_id", "_of", "line") != F.col("first"))
    gone = hits.groupBy("_id", "_of").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(*_keys(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("row"))
    joined = rows.join(gone, ["_id", "_of"], "left")
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.transform(parts, lambda _, i: i), F.col("gone"))
    joined = joined.withColumn("parts", parts)
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("parts"), i)), "\n"))
    return joined.select(
        "doc_id", text.alias("text"), *[F.col("row")[c].alias(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document; a null text counts as ''."""
    return dedup(docs, min_sites=min_sites).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
bad AS (
  SELECT s, min((doc_id, line)) AS first FROM lines WHERE trim(s) <> '' GROUP BY s
  HAVING count(DISTINCT coalesce('s:' || source, 'null')) >= {MIN_SITES}),
marked AS (SELECT l.*, b.s IS NOT NULL AND (l.doc_id, l.line) <> b.first AS gone FROM lines l LEFT JOIN bad b ON l.s = b.s)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
