"""Readers, records, scoring and draws on small made-up inputs."""

from __future__ import annotations

import json
import logging
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkdifficulty import BinaryDataset, DifficultyPipeline
from sparkdifficulty.functions import scoring, stats
from sparkdifficulty.operators import measures as m
from sparkdifficulty.operators import neighbours
from sparkdifficulty.operators.neighbours import nearest, tagged
from sparkdifficulty.plans import subsampling as sub
from sparkdifficulty.result import ComplexityProfile, DifficultyScore, DimensionResult
from sparkdifficulty.sources import readers


def dataset(spark, x, y):
    return BinaryDataset.of(spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": list(np.asarray(x, float).tolist()), "y": list(y)})), "x", "y", 1, 0, "id")


def brute(x, k, ok):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return [[j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i and ok(i, j)][:k] for i in range(len(x))]


@pytest.mark.parametrize("bytes_", [1 << 20, 2000])
def test_neighbours_in_one_turn_or_many(spark, bytes_):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(150, 3)), 1), rng.integers(0, 2, 150)
    rows = tagged(dataset(spark, x, y).rows)
    for rule, ok in (("any", lambda i, j: True), ("same", lambda i, j: y[i] == y[j]), ("other", lambda i, j: y[i] != y[j])):
        got = {r["row_id"]: r["nbrs"] for r in nearest(rows, rows, 4, rule, bytes_).collect()}
        assert [got[i] for i in range(150)] == brute(x, 4, ok)


def short_list(x, y, ids, wants):
    got = {}
    for b in neighbours.found_in(neighbours.References(ids, x, y), ids, x, y, wants):
        got |= {(r["row_id"], r["want"]): r["nbrs"] for r in b.to_pylist()}
    return got


@pytest.mark.parametrize("kind", ["plain", "copies", "offset", "tiny", "wide"])
def test_short_lists_lose_nothing(kind, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(neighbours, "REF_ROWS", 50)
    monkeypatch.setattr(neighbours, "FIRST", 9)
    monkeypatch.setattr(neighbours, "PAIRS", 500)
    x, y = rng.normal(size=(200, 4)), rng.integers(0, 3, 200)
    x = {"plain": x, "copies": np.vstack([np.zeros((140, 4)), x[:60]]), "offset": np.round(x) * 1e-9 + 1e5, "tiny": x * 1e-30, "wide": x * np.exp(20 * rng.normal(size=(200, 1)))}[kind]
    for tags in (y, np.arange(200) % 90):
        got = short_list(x, tags, np.arange(200), [(5, "any"), (1, "same"), (2, "other")])
        for w, (k, ok) in enumerate(((5, lambda i, j: True), (1, lambda i, j, t=tags: t[i] == t[j]), (2, lambda i, j, t=tags: t[i] != t[j]))):
            assert [got[i, w] for i in range(200)] == brute(x, k, ok)


def test_tree_of_groups_far_apart(spark):
    x = np.round(np.vstack([np.random.default_rng(8).normal(c, 1, (60, 2)) for c in (0, 100, 250, 450)]), 1)  # more copies and rows than a list holds
    x[:30] = 0
    data = dataset(spark, x, [1] * 60 + [0] * 180)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    up, want = list(range(240)), set()
    for i, j in sorted(((i, j) for i in range(240) for j in range(i + 1, 240)), key=lambda e: (d[e], *e)):
        if up[i] != up[j]:
            up = [up[i] if z == up[j] else z for z in up]
            want.add((i, j))
    for most in (1 << 26, 2000):
        assert {(r["a"], r["b"]) for r in m.minimum_spanning_tree(data.rows, 64, most).collect()} == want
    ends = {e for a, b in want if (a < 60) != (b < 60) for e in (a, b)}
    assert m.n1(data) == len(ends) / 240 == m.n1(data, m.wanted(data).where("want = 0"))


def test_a_tree_of_many_rows_in_time(spark):
    rows = spark.range(16_000).select(F.col("id").alias("row_id"), F.array(*[F.randn(i) for i in range(48)]).alias("x")).persist()
    began = time.perf_counter()
    assert m.minimum_spanning_tree(rows).count() == 15_999
    assert time.perf_counter() - began < 30


def test_clusters_by_definition(spark):
    rng = np.random.default_rng(4)
    x = np.round(np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-3, 6, (30, 2))]), 1)
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "row_id long, x array<double>, tag long")
    eps, least = 0.5, 4
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in np.flatnonzero(near[j] & core) if k not in label]
    for i in np.flatnonzero(~core):
        at = [label[j] for j in np.flatnonzero(near[i] & core)]
        if at:
            label[i] = min(at)
    assert {r["row_id"]: r["cluster"] for r in m.clusters(points, eps, least).collect()} == {int(i): int(c) for i, c in label.items()}


def test_spectrum_with_more_columns_than_rows(spark):
    x = np.random.default_rng(5).normal(size=(30, 50))
    got = m.variance_ratios(dataset(spark, x, [1] * 10 + [0] * 20))
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1][:29]
    assert np.allclose(got, want / want.sum(), atol=1e-12)


def test_draws_keep_all_components(spark, caplog):
    x = np.random.default_rng(1).normal(size=(600, 3))
    data = dataset(spark, x, [1] * 4 + [0] * 596)
    with caplog.at_level(logging.WARNING):
        r = DifficultyPipeline(n_max=100, n_subsamples=2).score(data)
    assert "two are taken" in caplog.text
    d7 = r.score.dimensions[6]
    assert set(d7.metadata["components_per_subsample"]) == {"L1", "N2norm", "N2_raw", "converged", "n_iter"} and set(d7.metadata["component_seconds"]) == {"L1", "N2"}
    assert isinstance(d7.components["converged"], bool) and set(r.score.dimensions[1].metadata["component_seconds"]) == {"F3", "N1", "kDN"}


def test_a_loose_tolerance_ends_sooner(spark):
    x = np.random.default_rng(2).normal(size=(200, 4))
    data = dataset(spark, x, (x[:, 0] + 0.5 * x[:, 1] > 1).astype(int))
    assert m.l1(data, tol=1.0)[2] <= m.l1(data, tol=1e-4)[2] and m.l1(data, max_iter=1)[1:] == (False, 1)


def test_positions_of_skewed_ids(spark, monkeypatch):
    monkeypatch.setattr(sub, "RUN", 20)
    ids = [*range(100), 10**15]
    got = {r["row_id"]: r["pos"] for r in sub.numbered(spark.createDataFrame([(i, "x") for i in reversed(ids)], "row_id long, part string")).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_a_large_minority_is_kept_whole(spark, tmp_path):
    from sparkdifficulty.plans import catalogue

    pd.DataFrame({"o_orderkey": range(1, 9002), "o_orderstatus": ["P"] * 7000 + ["O"] * 2001, "o_totalprice": 1.0, "o_custkey": 1, "o_orderpriority": "1-URGENT"}).to_parquet(tmp_path / "orders.parquet")
    got = catalogue.keep_minority_draw(spark, str(tmp_path)).toPandas()
    assert sorted(got["row_id"]) == list(range(1, 7001)) and got["is_min"].all()  # as its SQL has it


def test_a_minority_draw_by_size(spark):
    rows = spark.range(-20, 80).select(F.col("id").alias("row_id"), (F.col("id") < 20).alias("is_min"))
    others = sorted(range(20, 80), key=lambda i: (i * 2654435761 % 2**32, i))
    for n_max, whole, few, want in ((50, False, 40, others[:10]), (50, True, 40, others[:10]), (40, True, 40, []), (30, True, 40, []), (30, False, 12, others[:18])):
        got = {r["row_id"] for r in sub.keep_minority(rows, n_max, whole=whole).collect()}
        assert len([i for i in got if i < 20]) == few and {i for i in got if i >= 20} == set(want)


def test_records_are_checked():
    dims = [DimensionResult(f"D{i}", 0.5) for i in range(1, 8)]
    DifficultyScore(0.5, "High", (1 / 7,) * 7, dims)
    for bad in ((1.5, "High", (1 / 7,) * 7, dims), (0.5, "Huge", (1 / 7,) * 7, dims), (0.5, "High", (1.0,), dims), (0.5, "High", (1 / 7,) * 7, dims[1:])):
        with pytest.raises(ValueError):
            DifficultyScore(*bad)
    rest = ("name", None, None, [], [], 0.5, 0.35)
    for vector, signature, qualifier in (((0.1,) * 6, "V", "low"), ((0.1,) * 7, "VI", None), ((0.1,) * 7, "V", None), ((0.1,) * 7, "I", "low"), ((0.1,) * 7, "V", "some")):
        with pytest.raises(ValueError):
            ComplexityProfile(vector, signature, rest[0], None, qualifier, [], [], 0.5, 0.35)


def test_score_profile_and_action(spark):
    dims = [DimensionResult(f"D{i}", v) for i, v in enumerate((0.1, 0.9, 0.2, 0.6, 0.1, 0.4, 0.2), 1)]
    score = scoring.difficulty_score(dims, scoring.WEIGHTS)
    assert score.value == pytest.approx(sum(w * d.value for w, d in zip(scoring.WEIGHTS, dims, strict=True)))
    profile = scoring.profile(score, scoring.TAU, scoring.TAU_PRIME)
    assert (profile.signature, profile.dominant_dimension, profile.qualifier) == ("II", "D2", None)
    assert profile.active_dimensions == ["D2", "D4"] and profile.elevated_dimensions == ["D2", "D4", "D6"]
    advice = scoring.action(profile, score, 1000, 9.0)
    assert advice.evaluation_metrics and advice.preprocessing_strategy and len(set(advice.preprocessing_strategy)) == len(advice.preprocessing_strategy)
    assert json.dumps(advice.as_dict())


def test_errors_of_prediction(spark):
    x, y = np.array([0.1, 0.9, 0.4, 0.6]), np.array([0.8, 0.1, 0.7, 0.5])
    got = {r["x"]: r for r in stats.prediction_errors(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "x", "y").collect()}
    line = np.polyfit(x, y, 1)
    for a, b in zip(x, y, strict=True):
        r = abs(b - np.polyval(line, a))
        assert got[a]["abs_ols"] == pytest.approx(r) and got[a]["sq_ols"] == pytest.approx(r * r) and got[a]["abs_direct"] == pytest.approx(abs(a - 1 + b)) and got[a]["rank_err"] == 0


def load(spark, name, folder):
    df, features, label, few, many = readers.LOADERS[name](spark, str(folder))
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in features]) if isinstance(features, list) else F.col(features), (F.col(label) == few).cast("int")).collect()
    return sorted((tuple(r[0]), r[1]) for r in rows)


def test_loaders(spark, tmp_path):
    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    put("PS_20174392719_1491204439457_log.csv", "step,type,amount,nameOrig,nameDest,isFraud,isFlaggedFraud", "1,PAY,5.0,a,b,0,0", "2,CASH,7.0,a,b,1,0")
    assert load(spark, "paysim", tmp_path) == [((1, 5, 1), 0), ((2, 7, 0), 1)]
    put("train_transaction.csv", "TransactionID,is_fraud,a,b,c", "1,0,1,x,", "2,1,,y,", "3,0,3,,4")
    assert load(spark, "ieee_cis", tmp_path) == [((1, 0), 0), ((2, 1), 1), ((3, 0.5), 0)]
    put("svmguide1.txt", "1 1:2 2:3", "1 1:4", "2 2:5")
    assert load(spark, "svmguide1", tmp_path) == [((0, 5), 1), ((2, 3), 0), ((4, 0), 0)]
    put("KDDTrain+.txt", ",".join(["0", "tcp", "http", "SF", *["1"] * 37, "normal", "20"]), ",".join(["0", "udp", "dns", "SF", *["1"] * 37, "neptune", "20"]))
    assert [(r[0][:4], len(r[0]), r[1]) for r in load(spark, "nsl_kdd", tmp_path)] == [((0, 0, 1, 0), 41, 0), ((0, 1, 0, 0), 41, 1)]
    shards = tmp_path / "shards"
    shards.mkdir()
    (shards / "a.csv").write_text(" F1, F2, Label\n1,Infinity,BENIGN\n3,4,Bot\n")
    (shards / "b.csv").write_text(" F1, F2, Label\nx,8,BENIGN\n")
    assert load(spark, "cic_ids", shards) == [((1, 6), 0), ((2, 8), 0), ((3, 4), 1)]
    put("feature_time_48k_2048_load_1.csv", "max,min,fault", "1,2,Ball_007_1", "3,4,Normal_1")
    assert load(spark, "cwru", tmp_path) == [((1, 2), 1), ((3, 4), 0)]
    put("Human__TCGA_BRCA__UNC__RNAseq__HiSeq_RNA__01_28_2016__BI__Gene__Firehose_RSEM_log2.cct", "attrib_name\tS1\tS2\tS3\tS4", "G1\t1.5\t2\t3\t9", "G2\t5\t5\t6\t9")
    put("Human__TCGA_BRCA__MS__Clinical__Clinical__01_28_2016__BI__Clinical__Firehose.tsi.txt", "attrib_name\tS1\tS2\tS3\tS9", "age\t1\t2\t3\t4", "PAM50\tLumA\tBasal\tNA\tHer2")
    assert load(spark, "tcga_brca", tmp_path) == [((1.5, 5), 0), ((2, 5), 1)]
    put("yeast.data", "A_B  0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8  ME3", "C  1 1 1 1 1 1 1 1 CYT")
    assert [r[1] for r in load(spark, "yeast_me3", tmp_path)] == [1, 0]
    put("ecoli.data", "A  1 2 3 4 5 6 7 imU", "B  1 2 3 4 5 6 8 cp")
    assert load(spark, "ecoli_imu", tmp_path) == [((1, 2, 3, 4, 5, 6, 7), 1), ((1, 2, 3, 4, 5, 6, 8), 0)]
    put("diabetes.csv", "a,b,Outcome", "1,2,1")
    put("creditcard.csv", "Time,V1,Amount,Class", "0,1.5,2,0")
    put("wdbc.data", ",".join(["9", "M", *map(str, range(30))]))
    assert load(spark, "pima_diabetes", tmp_path) == [((1, 2), 1)] and load(spark, "credit_card_fraud", tmp_path) == [((1.5, 2), 0)] and load(spark, "breast_cancer", tmp_path)[0][1] == 1
    with pytest.raises(Exception):
        readers.LOADERS["yeast_me3"](spark, str(tmp_path / "nowhere"))[0].count()


def test_json_sink(tmp_path):
    readers.write_json([DimensionResult("D1", 0.25, {"a": np.float64(1.0), "b": (1, 2)})], str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())[0]["components"] == {"a": 1.0, "b": [1, 2]}
