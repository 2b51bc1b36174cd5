from __future__ import annotations

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from prowave.config import Config
from prowave.operators import decomp, features, graph, model, propagate, reuse, splits
from prowave.sources import files


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    x[:, 3] = 2 * x[:, 0] + 0.01 * x[:, 1]
    x[:, 5] = 1.0
    long = spark.createDataFrame([(f, i, float(x[i, f])) for i in range(40) for f in range(6)], "feat int, id long, value double").cache()
    return x, long


def as_matrix(long, shape):
    out = np.zeros(shape)
    for r in long.collect():
        out[r["id"], r["feat"]] = r["value"]
    return out


def test_scaling(matrix):
    x, long = matrix
    std = np.where(x.std(0) == 0, 1, x.std(0))
    assert as_matrix(features.standardize(long), x.shape) == pytest.approx(x / std)
    up, down = np.maximum(x, 0).sum(0), np.maximum(-x, 0).sum(0)
    got = as_matrix(features.sign_normalise(long), x.shape)
    assert np.maximum(got, 0).sum(0) == pytest.approx((up > 0).astype(float))
    assert np.minimum(got, 0).sum(0) == pytest.approx(-(down > 0).astype(float))
    train = x[10:]
    mean, sd = train.mean(0), np.where(train.std(0) == 0, 1, train.std(0))
    assert as_matrix(features.clip_standardize(long, F.col("id") >= 10, k=1.0), x.shape) == pytest.approx(np.clip(x, mean - sd, mean + sd) / sd)


def test_degree_scale_zeroes_isolated(spark, matrix):
    x, long = matrix
    d = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, degree int")
    deg = np.arange(40) % 3
    want = x * np.where(deg == 0, 0, np.maximum(deg, 1e-12) ** -0.5)[:, None]
    assert as_matrix(features.degree_scale(long, d, -0.5, isolated_to_zero=True), x.shape) == pytest.approx(want)


def test_gram_and_bases(matrix):
    x, long = matrix
    products = features.gram(features.to_wide(long), 6)
    assert {(r["i"], r["j"]): r["p"] for r in products.collect()}[(0, 3)] == pytest.approx(float(x[:, 0] @ x[:, 3]))
    bases = [r["feat"] for r in reuse.base_features(reuse.cosine_pairs(products), 2).collect()]
    assert set(bases) & {0, 3}


def test_reuse_gives_what_pushing_gives(spark, matrix):
    x, long = matrix
    edges = sorted({(i, (i * 7 + 1) % 40) for i in range(40)} | {((i * 7 + 1) % 40, i) for i in range(40)} | {(i, (i + 1) % 40) for i in range(40)} | {((i + 1) % 40, i) for i in range(40)})
    edges = [e for e in edges if e[0] != e[1]]
    w = graph.weighted(spark.createDataFrame(edges, "src long, dst long")).cache()
    got = as_matrix(reuse.push_with_reuse(w, long.withColumn("value", F.col("value") / 40), 40, 0.5, 0.5), x.shape)
    p = np.zeros((40, 40))
    for s, d in edges:
        p[d, s] = 1
    deg = p.sum(0)
    exact = 0.5 * np.linalg.solve(np.eye(40) - 0.5 * p / deg, x / 40)
    loosest = propagate.walk_budget(40, 0.5, 2.0)
    assert np.abs(got - exact).max() <= 6 * deg.max() / loosest


def test_greedy_weights_leave_a_smaller_residual(spark, matrix):
    x, long = matrix
    weights, rest = reuse.greedy_weights(long, spark.createDataFrame([(0,), (5,)], "feat int"))
    theta = {(r["feat"], r["base"]): r["theta"] for r in weights.collect()}
    assert theta[(3, 0)] == pytest.approx(2, abs=0.05)
    left = as_matrix(rest, x.shape)
    for f in (1, 2, 3, 4):
        back = left[:, f] + sum(t * x[:, b] for (g, b), t in theta.items() if g == f)
        assert back == pytest.approx(x[:, f])
        assert np.abs(left[:, f]).sum() <= np.abs(x[:, f]).sum() + 1e-9


def test_decomposition():
    rng = np.random.default_rng(2)
    low = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 12))
    u, s, v = decomp.randomized_svd(low, 3)
    assert (u * s) @ v.T == pytest.approx(low, abs=1e-8)
    assert s == pytest.approx(np.linalg.svd(low)[1][:3])
    assert decomp.pseudo_inverse(low, 3) == pytest.approx(np.linalg.pinv(low, rcond=1e-6), abs=1e-8)
    a, b = decomp.robust_pca(low)
    assert np.linalg.norm(low - a - b) <= 1e-3 * np.linalg.norm(low)
    assert decomp.shrink(np.array([-2.0, 0.5, 3.0]), 1.0).tolist() == [-1.0, 0.0, 2.0]


def test_splits_are_exact_and_stable(spark):
    nodes = spark.createDataFrame([(i, i % 4 if i % 10 else None) for i in range(200)], "id long, label int")
    for f in (lambda n: splits.split_random(n, 50, 30), lambda n: splits.split_by_label(n, 10, 30), lambda n: splits.split_stratified(n, 50, 30)):
        one, two = f(nodes), f(nodes.repartition(9))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
        sizes = {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
        assert sum(sizes.values()) == 200 and sizes["val"] == 30
    assert splits.split_random(nodes, 0, 0).filter("split != 'test'").count() == 0
    assert splits.split_random(nodes, 500, 5).filter("split = 'train'").count() == 200


def test_f1(spark):
    df = spark.createDataFrame([(0, [1, 0], [1, 1]), (1, [0, 1], [0, 0])], "id long, hot array<int>, guess array<int>")
    assert splits.micro_f1(df).first()["micro_f1"] == pytest.approx(0.5)
    assert splits.batch_f1(df, 1).first()["batch_f1"] == pytest.approx((2 / 3 + 0) / 2)


@pytest.mark.parametrize(("layers", "skip"), [(2, True), (4, True), (4, False)])
@pytest.mark.parametrize("transform", ["none", "bias", "bn", "biasbn"])
@pytest.mark.parametrize("multilabel", [False, True])
def test_model_gradients(layers, skip, transform, multilabel):
    rng = np.random.default_rng(0)
    m = model.SkipMLP(5, 5, 3, layers, transform=transform, skip=skip)
    for params in (m.biases, m.scales, m.shifts):  # else units of dead rows sit on the kink
        for b in params:
            b += 0.3 * rng.standard_normal(b.shape)
    x, y = rng.standard_normal((7, 5)), np.eye(3)[rng.integers(0, 3, 7)]
    _, grads = m.gradients(x, y, multilabel, None)
    assert len(grads) == len(m.parameters())
    for params, g in zip(m.parameters(), grads, strict=True):
        at = (0,) * params.ndim
        params[at] += 1e-6
        up = m.gradients(x, y, multilabel, None)[0]
        params[at] -= 2e-6
        down = m.gradients(x, y, multilabel, None)[0]
        params[at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=2e-5)
    again = model.SkipMLP.loads(m.dumps())
    assert again.forward(x)[0] == pytest.approx(m.forward(x)[0])


def test_unknown_transform_is_an_error():
    with pytest.raises(ValueError):
        model.SkipMLP(2, 2, 2, transform="batch")
    with pytest.raises(ValueError):
        Config().having({"bias": "batch"})


def test_training_learns(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    x = np.eye(3)[y] + 0.3 * rng.standard_normal((300, 3))
    best, history = model.train_mlp(x[:200], np.eye(3)[y[:200]], x[200:], np.eye(3)[y[200:]], model.SkipMLP(3, 16, 3, 3, dropout=0.1, transform="biasbn"), epochs=30, lr=0.01)
    assert model.f1(best.forward(x[200:])[0], np.eye(3)[y[200:]]) > 0.9 and history
    df = spark.createDataFrame([(i, x[i].tolist(), np.eye(3, dtype=int)[y[i]].tolist()) for i in range(200, 300)], "id long, embedding array<double>, hot array<int>")
    assert splits.micro_f1(model.predict(df, best)).first()["micro_f1"] > 0.9


def test_text_edges(spark, tmp_path):
    (tmp_path / "adj.txt").write_text("# 5\n0 1\n1  2\n\n# more\n2 0\n")
    path = str(tmp_path / "adj.txt")
    assert sorted(map(tuple, files.read_edge_text(spark, path).collect())) == [(0, 1), (1, 2), (2, 0)]
    assert files.header_count(spark, path) == 5
    (tmp_path / "bad.txt").write_text("0 1\nx y\n")
    with pytest.raises(Exception, match="not an edge"):
        files.read_edge_text(spark, str(tmp_path / "bad.txt")).collect()


def test_binary_files(spark, tmp_path):
    (tmp_path / "graph.bin").write_bytes(b"".join(struct.pack("<QQ", a, b) for a, b in [(0, 1), (2, 3)]))
    assert sorted(map(tuple, files.read_edge_binary(spark, str(tmp_path / "graph.bin")).collect())) == [(0, 1), (2, 3)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    got = {(r["feat"], r["id"]): r["value"] for r in files.read_npy(spark, str(tmp_path / "m.npy")).collect()}
    assert got[(1, 2)] == 5.0 and len(got) == 6
    data = (tmp_path / "m.npy").read_bytes()
    with pytest.raises(ValueError):
        files.parse_npy(data[:-4])
    with pytest.raises(ValueError):
        files.parse_npy(b"\x93NUMPY\x03\x00" + data[8:])


def test_other_files(spark, tmp_path):
    files.write_attributes(spark, str(tmp_path / "a"), 5, 7)
    assert files.read_attributes(spark, str(tmp_path / "a")) == {"n": 5, "m": 7}
    files.write_queries(spark.range(3), str(tmp_path / "q"))
    assert files.read_queries(spark, str(tmp_path / "q"), 9).count() == 3 and files.read_queries(spark, None, 9).count() == 9
    wide = spark.createDataFrame([(i, [1.0 * i]) for i in range(23)], "id long, embedding array<double>")
    files.write_blocks(features.row_blocks(wide, 23, 5), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 23 and len([d for d in os.listdir(tmp_path / "w") if d.startswith("block=")]) == 5
    assert files.save_if_missing(wide, str(tmp_path / "w")).count() == 23


def test_config(tmp_path):
    c = Config().having({"alpha": 0.5, "epsilon": 16})
    c.dump(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c and Config.load(str(tmp_path / "c.json"), seed=3).seed == 3
    assert c.score_name() == "featpush_0/score_0.5_16"
    assert json.loads((tmp_path / "c.json").read_text())["algo"] == "featpush"
    for bad in ({"alfa": 1}, {"algo": "other"}):
        with pytest.raises(ValueError):
            Config().having(bad)


@pytest.fixture
def three_groups(spark, tmp_path):
    """Paths of edges, features and labels of 60 nodes of three kinds."""
    rng = np.random.default_rng(6)
    y = np.arange(60) % 3
    x = np.eye(3)[y] @ rng.standard_normal((3, 8)) + 0.2 * rng.standard_normal((60, 8))
    edges = [(i, j) for i in range(60) for j in range(60) if i != j and y[i] == y[j] and (i + j) % 4 == 0] + [(i, (i + 1) % 60) for i in range(59)]
    spark.createDataFrame(edges, "src long, dst long").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, embedding array<double>").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(i, int(y[i])) for i in range(60)], "id long, label int").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(i, [int(y[i] == k) for k in range(3)]) for i in range(60)], "id long, label array<int>").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([(i, "train" if i >= 24 else "val" if i < 12 else "test") for i in range(60)], "id long, split string").write.parquet(str(tmp_path / "s"))
    return tmp_path


@pytest.mark.parametrize("algo", ["featpush", "featreuse", "featpca"])
def test_command(three_groups, algo):
    from prowave import run

    d = three_groups
    args = ["--edges", str(d / "e"), "--features", str(d / "x"), "--labels", str(d / "l"), "--out", str(d / "o"), "--set", f"algo={algo}", "alpha=0.5", "epsilon=4", "hidden=16", "epochs=40", "rrz=0.5", "layer=2"]
    assert run.main(["precompute", *args])["path"].endswith(f"{algo}_0/score_0.5_4")
    assert run.main(["train", *args])["test"] > 0.6


def test_inductive_multilabel_with_stored_splits(spark, three_groups):
    """The training nodes' own embeddings are made without the others' edges; stored splits are used as they are."""
    from prowave import run

    d = three_groups
    args = ["--edges", str(d / "e"), "--features", str(d / "x"), "--labels", str(d / "m"), "--splits", str(d / "s"), "--out", str(d / "o"), "--seed", "3", "--dev"]
    args += ["--set", "alpha=0.5", "epsilon=4", "hidden=16", "epochs=15", "layer=3", "bias=biasbn", "multil=true", "inductive=true", "staged=true", "lr=0.02"]
    run.main(["precompute", *args])
    own = spark.read.parquet(str(d / "o" / "featpush_train_3" / "score_0.5_4"))
    assert own.agg(F.min("id"), F.max("id")).first()[:] == (24, 59) and spark.read.parquet(str(d / "o" / "featpush_3" / "score_0.5_4")).agg(F.max("id")).first()[0] == 59
    assert run.main(["train", *args])["test"] > 0.6
    epoch, text = files.Models(spark, str(d / "o" / "featpush_3" / "score_0.5_4.models")).load("last")
    assert epoch == 14 and model.SkipMLP.loads(text).transform == "biasbn"
    assert [json.loads(x)["what"] for x in files.read_log(spark, str(d / "o" / "log"))] == ["precompute", "train"]


def test_split_rules(spark):
    nodes = spark.createDataFrame([(i, [int(i % 3 == 0), int(i % 5 == 0)]) for i in range(100)], "id long, label array<int>")
    got = splits.split_by_label(nodes, 10, 20)
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes["val"] == 20 and 14 <= sizes["train"] <= 20 and sum(sizes.values()) == 100
    assert splits.classes_of(nodes) == 2 and splits.one_hot(nodes, 2).filter("id = 15").first()["hot"] == [1, 1]
    single = spark.createDataFrame([(i, i % 4) for i in range(100)], "id long, label int")
    stored = spark.createDataFrame([(i, "train" if i < 40 else "val" if i < 50 else "test") for i in range(80)], "id long, split string")
    again = splits.split_by_rule(single, "restratify", 0, 0, 1, stored)
    assert {r["split"]: r["count"] for r in again.groupBy("split").count().collect()} == {"train": 40, "val": 10, "test": 30}
    train = again.filter("split = 'train'").join(single, "id").groupBy("label").count().collect()
    assert all(r["count"] == 10 for r in train)
    assert sorted(map(tuple, splits.split_by_rule(single, "random", 5, 5, 0, stored).collect())) == sorted(map(tuple, stored.collect()))


def test_written_files_read_back(spark, tmp_path):
    pairs = [(i * 7 % 50, i) for i in range(100)]
    e = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    files.write_edge_binary(e, str(tmp_path / "b"))
    assert sorted(map(tuple, files.read_edge_binary(spark, str(tmp_path / "b")).collect())) == sorted(pairs)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("*.bin")))
    assert [tuple(x) for x in np.frombuffer(data, "<u8").reshape(-1, 2).tolist()] == sorted(pairs)
    files.write_adjacency_text(e, 120, str(tmp_path / "t"))
    assert files.header_count(spark, str(tmp_path / "t")) == 120
    assert sorted(map(tuple, files.read_edge_text(spark, str(tmp_path / "t")).collect())) == sorted(pairs)
    x = np.random.default_rng(0).standard_normal((40, 3)).astype(np.float32)
    wide = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    files.write_npy(wide, str(tmp_path / "n"))
    assert np.concatenate([np.load(p) for p in sorted((tmp_path / "n").glob("*.npy"))]) == pytest.approx(x)
