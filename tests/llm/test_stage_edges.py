"""Each stage of the pipeline on nulls, empty and blank texts, repeated rows, an empty table and clashing extra columns."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id int, size string, label int, key string"
LONG = " ".join(f"word{i % 977}" for i in range(3000))
ROWS = [
    (1, "A line.\nAnother line of the text.", "en", "a"), (1, "A line.\nAnother line of the text.", "en", "a"), (1, "another text with this id", "en", "b"), (2, None, "en", "a"), (2, None, None, None),
    (None, "no id here at all", "en", "a"), (None, "no id here at all", "de", "a"), (None, None, None, None), (3, "", "en", "a"), (4, " \n\t ", None, "b"), (5, LONG, "en", "a"), (6, LONG + " end", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "r", 7, "s", 9, "k") for r in ROWS], SCHEMA).repartition(3)


def test_rows_of_each_stage(spark, data, odd):
    left = {name: [tuple(r[:4]) for r in f(spark, odd, data).collect()] for name, f in p.STAGES[:-1]}
    texts = Counter(ROWS)
    assert not Counter(left["quality"]) - texts
    assert Counter(left["line_dedup"]) == texts and Counter(left["decontamination"]) == texts
    # of equal rows, of the long texts and of an id's null texts one stays; ids and texts that differ stay
    assert sorted((r[0] or 0, len(r[1] or "")) for r in left["near_dedup"]) == sorted([(1, 33), (1, 25), (2, 0), (0, 17), (0, 0), (3, 0), (4, 4), (5, len(LONG))])


def test_mix_of_odd_rows(spark, data, odd):
    got = p.STAGES[-1][1](spark, odd, data).collect()
    assert all(r["copy"] <= 2 and r["size"] * 2 >= r["taken"] for r in got)


def test_empty_table(spark, data, odd):
    for _, f in p.STAGES:
        assert f(spark, odd.limit(0), data).count() == 0
