"""Every graph query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from prowave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    key = lambda v: "" if v is None else f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, data, db, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_classifier_gives_one_guess_a_row(spark, data):
    rows = registry.QUERIES["train_predict"](spark, data).collect()
    assert rows and all(sum(r["guess"]) == 1 and r["guess"][r["label_guess"]] == 1 for r in rows)


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from prowave import session

    class Context:
        master, at = "spark://host:7077", None

        def getCheckpointDir(self):  # noqa: N802
            return self.at

        def setCheckpointDir(self, path):  # noqa: N802
            self.at = path

    sc = Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))
    assert session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={"spark.checkpoint.dir": "s3a://shared"})) == "s3a://shared"
