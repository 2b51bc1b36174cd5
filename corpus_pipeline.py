"""From raw documents to a training mix, in five stages of the ``llm`` operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; ``n_chars`` follows the text. Other columns
of the input are left out, whatever they are called.

For all stages: an empty table gives an empty one; null texts count as empty but
stay null where a stage only drops rows; null ids, languages and sources pass as
they are; texts are read whole, however long; what a stage does with repeated
rows and ties is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prowave.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from prowave.session import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The classifier, the alignment and the index are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows that repeat, and equal texts, get the same score, so all stay or all go;
    empty and null texts are scored as ''. Without labels of both kinds the score
    is that of the one label, or 0.5, for all. Of labels that contradict each
    other the most frequent counts, 1 on a tie.
    """
    scored = quality.score(docs, table(spark, sf_dir, "labels"), keep=("lang", "source", "n_chars"), with_text=True)
    return scored.filter("predicted = 1").select("doc_id", "text", "row.lang", "row.source", "row.n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines.

    No row goes: a text of boilerplate alone becomes '', a null one stays null.
    The first occurrence of a line stays (smallest doc_id, null ids first, then
    the text's hash and the line); equal rows are alike, so a first one stays in
    all of them. A null source is a site.
    """
    return _documents(line_dedup.dedup(docs, keep=("lang", "source")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class.

    First is the smallest doc_id (null ids first), then the text's hash. Of rows
    with that id and text one stays, the smallest by its columns. Texts without
    words are in no one's class, so each id keeps one.
    """
    return near_dedup.keep_one(docs, COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is nothing but such passages goes.

    Texts without words stay as they are; rows that repeat are cut alike.
    Without benchmark items nothing is cut.
    """
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), keep=("lang", "source"), cut=True)
    return _documents(found.filter("n_words = 0 or n_hit < n_words").select("doc_id", "text", "row.lang", "row.source"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with its copy's number and its source's figures.

    Documents of equal size stand in the order of bucket, doc_id and text hash;
    rows that repeat are taken one by one. A null source is a source; texts
    without words have size 0 and add nothing to it.
    """
    return mixing.emit(docs, COLUMNS)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; what lies between them is written to the shared checkpoint folder."""
    docs, forget = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if forget:
            forget()
        forget = after
    return STAGES[-1][1](spark, docs, sf_dir)
