"""The stages in a row, each held against brute force on its own input."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as p
from prowave.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{data}/documents.parquet")
    for name, f in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, data).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_shape(stages):
    assert len(p.STAGES) == 5
    for name, (_, after) in stages.items():
        if name != "mixing":
            assert tuple(after.columns) == p.COLUMNS
            assert after.filter("n_chars <> length(text)").count() == 0


def test_classifier_keeps_clean_documents(spark, data, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good, bad = (labels.filter(f"quality = {q}").join(before, "doc_id", "left_semi").select("doc_id") for q in (1, 0))
    assert good.join(after, "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert bad.join(after, "doc_id", "left_semi").count() <= 0.2 * bad.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
    old = {r["doc_id"]: r["text"].split("\n") for r in before.collect()}
    for r in after.collect():
        left = iter(old[r["doc_id"]])
        assert r["text"] == "" or all(x in left for x in r["text"].split("\n"))


def test_one_of_each_class_stays(stages):
    from test_operators import jaccard_classes

    before, after = stages["near_dedup"]
    want = jaccard_classes([(r["doc_id"], r["text"], None) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == set(want.values())


def test_no_benchmark_window_is_left(spark, data, stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    before, after = stages["decontamination"]
    held = {r["doc_id"]: r["text"] for r in before.collect()}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    hit = {i for i, t in held.items() if any(tuple((w := words(t))[k : k + 10]) in windows for k in range(len(words(t)) - 9))}
    for i, t in got.items():
        w = words(t)
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        assert i in hit or t == held[i]
    assert set(held) - set(got) <= hit


def test_mix(stages):
    before, after = stages["mixing"]
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before.collect()}
    assert sum(r["size"] for r in after.collect()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.15)


def test_run_gives_the_last_stage(spark, data, stages):
    assert sorted(p.run(spark, data).select("doc_id", "copy").collect()) == sorted(stages["mixing"][1].select("doc_id", "copy").collect())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got, want = registry.queries()[name](spark, data).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(str, got[names].values.tolist())) == sorted(map(str, want[names].values.tolist()))
