"""Queries and operators give all rows, not a first part."""

import numpy as np

from tidewire.operators import projection
from tidewire.plans.catalogue import QUERIES

FOLDER, MORE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_plane_holds_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    made = spark.createDataFrame([(f"k{i:02}", "a", i, x[i].tolist()) for i in range(60)], "term string, label string, n int, v array<double>")
    out = projection.whole_map(made, "term", "v", "label", "n", most=40, rounds=20).toPandas().sort_values("term")
    assert out["term"].tolist() == [f"k{i:02}" for i in range(60)] and np.isfinite(out[["x", "y"]]).all().all()
    assert np.allclose(out[["x", "y"]].to_numpy()[:40], projection.tsne(x[:40], rounds=20))


def test_projection_tsne_keeps_all_keys(spark):
    from tidewire.plans.learning import _modes, emb

    wanted = emb(spark, MORE).join(_modes(spark, MORE), "term").count()
    assert QUERIES["projection_tsne"](spark, MORE).count() == wanted > 300


def test_nets_and_bayes_are_trained_for_all_categories(spark, monkeypatch):
    from tidewire.operators import models, neural
    from tidewire.plans.statistics import CATEGORIES

    seen = []
    monkeypatch.setattr(neural, "fit_each", lambda rows, labels, categories, make, **s: seen.append((categories, getattr(make(), "layers", None), s.get("rounds"))) or {})
    monkeypatch.setattr(neural, "predict", lambda rows, nets: rows.selectExpr("id", "array('') pred"))
    monkeypatch.setattr(models, "each_category", lambda rows, labels, categories, fit, **s: seen.append((categories, None, None)) or {})
    monkeypatch.setattr(models, "predicted", lambda rows, fitted: rows.selectExpr("id", "array('') pred"))
    for name in ("feed_forward", "recurrent", "nb_ml", "feed_forward_ml"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [(CATEGORIES, (64, 700, 500, 2), None), (CATEGORIES, None, None), (CATEGORIES, None, None), (CATEGORIES, None, None)]
    assert {r["category"] for r in QUERIES["nb_priors"](spark, "/root/testdata/sf0.001").collect()} == set(CATEGORIES)


def test_sequences_hold_more_than_twenty(spark, monkeypatch):
    from tidewire.operators import neural

    seen = []
    monkeypatch.setattr(neural, "fit_each", lambda rows, *a, **s: seen.append(rows.selectExpr("size(features) n").distinct().collect()) or {})
    monkeypatch.setattr(neural, "predict", lambda rows, nets: rows.selectExpr("id", "array('') pred"))
    QUERIES["recurrent"](spark, "/root/testdata/sf0.001")
    assert [r["n"] for r in seen[0]] == [100]
    assert {r["length"] for r in QUERIES["sequence_cut"](spark, "/root/testdata/sf0.001").collect()} == {100}


def test_newest_and_sweeps_see_the_whole_table(spark):
    from pyspark.sql import functions as F

    from tidewire.plans.base import arts

    everything = arts(spark, FOLDER, "split_name").count()
    sizes = {r["prefix"]: r["n"] for r in QUERIES["prefix_sweep"](spark, FOLDER).groupBy("prefix").agg(F.count("*").alias("n")).collect()}
    assert sizes[100] == 100 and sizes[500_000] == everything > 400 and {5000, 195_000} <= set(sizes)
    assert {100, 500_000} <= {r["prefix"] for r in QUERIES["learning_curve"](spark, FOLDER).select("prefix").collect()}
    assert QUERIES["newest_articles"](spark, FOLDER).count() > 100
