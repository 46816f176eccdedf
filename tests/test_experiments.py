"""Each training job trains what it is named for and keeps it; each test job loads that."""

import pytest
from pyspark.sql import functions as F

from tidewire import experiments, jobs
from tidewire.config import Config
from tidewire.sources.catalogue import NAMES, Catalogue
from tidewire.storage import new_path

FOLDER = "/root/testdata/sf0.001"
SET = ["category=science", "threshold=0", "rounds=1", "buckets=3", "layers=8,4", "bow_layers=8", "rate=0.01"]


def run(spark, name, out, *more):
    c = Config.of([f"job={name}", f"data={FOLDER}", *SET, *more])
    c.out = out  # models go below it; the result isn't written
    return [r.asDict() for r in jobs.JOBS[name](spark, c).collect()], c


@pytest.fixture(scope="module")
def kept(spark):
    """All trainings that tests need, with their measures."""
    out = new_path(spark, "experiments")
    return out, {name: run(spark, name, out)[0] for name in ("trainBaseline", "trainTypes", "trainTime", "trainConfidence")}


def test_families_and_tags(kept):
    _, made = kept
    assert [(r["tag"], r["family"]) for r in made["trainBaseline"]] == [("baseline", f) for f in experiments.FAMILIES]
    assert [(r["tag"], r["family"]) for r in made["trainTypes"]] == [("types", "nb_w2v"), ("types", "nb_bow")]
    assert {r["tag"] for r in made["trainTime"]} == {"time"} and {r["tag"] for r in made["trainConfidence"]} == {"confidence-50"}
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 for name, rows in made.items() if name != "trainTime" for r in rows)  # the first bucket of time holds three articles


def test_kept_models_predict_the_same(spark, kept):
    out, made = kept
    c = Config.of([f"data={FOLDER}", f"out={out}", *SET])
    sets = experiments.catalogue(spark, c)
    validation = sets.by("validation_ordered")
    for row in made["trainBaseline"]:
        fitted = experiments.load(spark, row["family"], experiments.model_path(c, "baseline", row["family"]), "science")
        again = experiments.evaluate(fitted, validation, ["science"], sets.embeddings(), "baseline").first().asDict()
        assert {k: again[k] for k in ("tp", "fp", "fn", "tn", "family")} == {k: row[k] for k in ("tp", "fp", "fn", "tn", "family")}
    with pytest.raises(FileNotFoundError):
        experiments.load(spark, "nb_bow", experiments.model_path(c, "none", "nb_bow"))
    with pytest.raises(KeyError):
        experiments.load(spark, "ffn_w2v", experiments.model_path(c, "baseline", "ffn_w2v"), "none")


@pytest.mark.parametrize(("name", "families"), [("testModels", list(experiments.FAMILIES)), ("testNaive", ["nb_bow", "nb_w2v"] * 2), ("testW2VvsBoW", ["ffn_bow", "nb_bow", "ffn_w2v", "nb_w2v"]), ("testSub", ["nb_w2v", "nb_bow"]), ("testConfidence", ["ffn_w2v"])])
def test_tests_load_what_was_trained(spark, kept, name, families):
    rows, _ = run(spark, name, kept[0])
    assert [r["family"] for r in rows] == families
    tested = Catalogue(spark, FOLDER).by(experiments.TESTS[name][0] if name in experiments.TESTS else "mini_test").articles.count()
    assert all(0 < r["tp"] + r["fp"] + r["fn"] + r["tn"] <= tested for r in rows)


@pytest.mark.parametrize("name", ["testLengths", "testTimeDecay"])
def test_buckets_of_kept_nets(spark, kept, name):
    rows, c = run(spark, name, kept[0])
    assert [r["bucket"] for r in rows] == list(range(c.buckets))


def test_pretrained_must_be_there(spark, kept):
    with pytest.raises(FileNotFoundError):
        run(spark, "testPretrained", kept[0])
    run(spark, "trainRNNW2V", kept[0], "tag=pretrained")
    assert [r["tag"] for r in run(spark, "testPretrained", kept[0])[0]] == ["pretrained"]


@pytest.mark.parametrize(("name", "family"), [("trainFFNW2V", "ffn_w2v"), ("trainFFNBoW", "ffn_bow"), ("trainNaiveW2V", "nb_w2v"), ("trainNaiveBoW", "nb_bow"), ("trainNaiveTraditional", "nb_bow")])
def test_single_trainings(spark, name, family):
    rows, _ = run(spark, name, "")
    assert [r["family"] for r in rows] == [family] and rows[0]["tag"] == ("traditional" if "Traditional" in name else "baseline")


def test_super_sample_draws_the_category_again(spark):
    rows, _ = run(spark, "trainSuper", "")
    assert [(r["tag"], r["family"]) for r in rows] == [("superSample", f) for f in experiments.FAMILIES]


def test_sweeps_go_on_to_the_whole_set(spark):
    total = Catalogue(spark, FOLDER).by("train_ordered").articles.count()
    assert [r["size"] for r in run(spark, "trainNaiveBoWInc", "")[0]] == [100] and total < 100
    assert [r["size"] for r in run(spark, "trainFFNW2VInc", "")[0]] == [5000]
    assert experiments.SIZES[-1] == 195_000 and experiments.SIZES2[-1] == 500_000


def test_named_sets(spark):
    sets = Catalogue(spark, FOLDER)
    assert len(NAMES) == 32
    ids = lambda name: {r["id"] for r in sets.by(name).articles.select("id").collect()}
    whole, parts = ids("annotated"), [ids(f"{p}_ordered") for p in ("train", "validation", "test")]
    assert set.union(*parts) == whole and sum(map(len, parts)) == len(whole)
    assert abs(len(parts[0]) - 0.6 * len(whole)) <= 1
    assert ids("train_ordered_full") >= set() and len(ids("train_ordered_full")) == int(0.6 * len(ids("raw")))
    assert ids("annotated_minimal") <= whole and ids("mini") <= whole
    shuffled = [ids(f"{p}_shuffled") for p in ("train", "validation", "test")]
    assert set.union(*shuffled) == whole and sum(map(len, shuffled)) == len(whole) and shuffled[0] != parts[0]
    assert ids("sub_train_ordered") < parts[0]
    typed, plain = sets.by("train_ordered_types").annotations.count(), sets.by("train_ordered").annotations.count()
    assert typed > plain
    balanced = sets.balanced("science").articles
    assert balanced.where("array_contains(iptc, 'science')").count() * 2 == balanced.count() or balanced.count() < len(parts[0])
    train, validation = sets.ordered(time=3)
    assert not {r["id"] for r in train.articles.collect()} & {r["id"] for r in validation.articles.collect()}
    assert Catalogue(spark, FOLDER, count=10).by("train_ordered").articles.count() == 6
    assert sets.subsampled()[1].articles.count() and sets.shuffled()[0].articles.count() == len(shuffled[0])
    with pytest.raises(KeyError):
        sets.by("none")
    assert sets.table("annotations", 0.5).count() < sets.table("annotations").count()


def test_confidence_leaves_out_what_is_less_sure(spark):
    class Sure(Catalogue):
        def table(self, name, fraction=1.0):
            rows = super().table(name, fraction)
            return rows.withColumn("confidence", F.when(F.length("phrase") % 2 == 0, 0.3).otherwise(0.8)) if name == "annotations" else rows

    sets = Sure(spark, FOLDER)
    assert sets.annotations(confidence=0.25).count() > sets.annotations(confidence=0.75).count() > sets.annotations(confidence=1.0).count() == 0
    assert sets.by("mini_25").annotations.count() > sets.by("mini_75").annotations.count()
    assert sets.ordered(confidence=0.75)[0].annotations.count() <= sets.ordered()[0].annotations.count()
