"""Jobs, settings and the text service run on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidewire import experiments, jobs, storage
from tidewire.api import TextService, answer
from tidewire.config import Config
from tidewire.sources.catalogue import Catalogue
from tidewire.storage import new_path

FOLDER = "/root/testdata/sf0.001"
#: Rows of the jobs over the smallest tables, or the name of another job or dataset that has as many.
ARTICLES, ANNOTATIONS = 63, 521
COUNTS = {
    "testSpark": 1, "printArticles": 20, "printEntities": 40, "cacheMinimal": "annotated_minimal", "cacheMini": "labelled", "cacheAnnotated": "annotated", "computeDbAnnotationsConfidence": "annotated", "cacheAnnotatedWithTypes": "annotated_types",
    "splitAndCache": ARTICLES, "cache": ARTICLES, "cacheAndSplitAll": "annotated", "stats": 1, "iptcDistribution": None, "storedLengths": 3, "reportStored": 1, "cacheW2V": "fbw2vIds", "cacheWordVectors": "fbw2vIds",
    "combineIds": None, "computeDbAnnotations": None, "fbw2vIds": None, "cacheAndSplitLength": None, "cacheAndSplitTime": None, "cacheSuperBalanced": None, "cacheSuperSampled": None, "cacheSubSampled": None, "tnesDocumentVectors": None, "tnesWordVectors": None, "logResults": None,
}


def settings(name):
    return Config.of([f"job={name}", f"data={FOLDER}", "category=science", "threshold=0", "rounds=1", "buckets=3"])


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_job(spark, name):
    made = jobs.run(spark, settings(name))
    wanted = COUNTS[name]
    if wanted == "labelled":
        wanted = jobs.articles(spark, settings(name), "iptc").where("size(iptc) > 0 and id rlike '^[0-9]+$'").count()
    elif isinstance(wanted, str):
        wanted = jobs.run(spark, settings(wanted)).count() if wanted in jobs.JOBS else Catalogue(spark, FOLDER).by(wanted).articles.count()
    n = made.count()
    assert n == wanted if wanted is not None else n > 0


def test_every_job_is_run_by_some_test():
    files = {"cacheRaw", "cacheNYT", "wdToFbFromDump", "dbpediaToWdFromDump"}  # below
    trained = set(experiments.EXPERIMENTS) | set(experiments.TESTS) | {"trainFFNW2VInc", "trainFFNW2VInc2", "trainNaiveBoWInc", "testConfidence", "testLengths", "misc", "testTimeDecay", "test"}  # test_experiments
    assert set(jobs.JOBS) == set(COUNTS) | files | trained


def test_split_jobs(spark):
    by = {r["part"]: r["count"] for r in jobs.run(spark, settings("splitAndCache")).groupBy("part").count().collect()}
    assert by == {"train": 37, "test": 13, "validation": 13}
    rows = jobs.run(spark, settings("cacheAndSplitTime")).groupBy("bucket", "part").count().collect()
    assert {(r["bucket"], r["part"]) for r in rows} == {(-1, "train")} | {(b, p) for b in range(3) for p in ("test", "validation")}
    lengths = jobs.run(spark, settings("cacheAndSplitLength")).groupBy("bucket").agg(F.min("wc").alias("least"), F.max("wc").alias("most")).orderBy("bucket").collect()
    assert [r["bucket"] for r in lengths] == [0, 1, 2] and all(a["most"] <= b["least"] for a, b in zip(lengths, lengths[1:]))


def test_super_sampled_jobs(spark):
    rows = jobs.run(spark, settings("cacheSuperBalanced"))
    yes, no = rows.where("array_contains(iptc, 'science')").count(), rows.where("not coalesce(array_contains(iptc, 'science'), false)").count()
    held = jobs.articles(spark, settings("x"), "iptc").where("array_contains(iptc, 'science')").count()
    assert yes == held + no
    sizes = {r["count"] for r in jobs.run(spark, settings("cacheSuperSampled")).groupBy("label").count().collect()}
    assert len(sizes) == 1
    assert jobs.run(spark, settings("cacheSubSampled")).count() < ARTICLES


def test_report_of_stored_predictions(spark):
    line = jobs.run(spark, settings("reportStored")).first()
    assert line["label"] == "science"
    outcomes = jobs.run(spark, settings("logResults")).where("label = 'science'").groupBy("outcome").count().collect()
    assert {r["outcome"] for r in outcomes} <= {"tp", "fp"} and outcomes


def test_jobs_of_files(spark, tmp_path):
    (tmp_path / "dump.txt").write_text('<http://w/Q1> <http://w/P646c> "/m/x" .\n<http://w/Q2> <http://w/P1c> "/m/y" .\n<http://w/Q3> <http://w/same> <http://dbpedia.org/resource/Oslo> .\n')
    c = Config.of(["job=wdToFbFromDump", f"data={tmp_path}"])
    assert [tuple(r) for r in jobs.run(spark, c).collect()] == [("Q1", "x")]
    c = Config.of(["job=dbpediaToWdFromDump", f"data={tmp_path}"])
    assert [tuple(r) for r in jobs.run(spark, c).collect()] == [("Q3", "Oslo")]
    (tmp_path / "news").mkdir()
    (tmp_path / "news" / "1.xml").write_text('<nitf><head><docdata><doc-id id-string="7"/></docdata></head><body><body.head><hedline><hl1>Head</hl1></hedline></body.head><body.content><block class="full_text"><p>Text.</p></block></body.content></body></nitf>')
    for name in ("cacheRaw", "cacheNYT"):
        c = Config.of([f"job={name}", f"data={tmp_path / 'news'}"])
        lines = jobs.run(spark, c).collect()
        assert len(lines) == 1 and "Text." in lines[0][0]


def test_written_job(spark):
    """The result is kept, what was written on the way isn't."""
    c = Config.of(["job=splitAndCache", f"data={FOLDER}", f"out={new_path(spark, 'jobs')}"])
    before = set(storage._made)
    assert jobs.run(spark, c).count() == ARTICLES and set(storage._made) == before


def test_sweep_leaves_what_is_in_use(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    for name in ("tidewire-old", "tidewire-new", "other-old", f"tidewire-{spark.sparkContext.applicationId}"):
        (tmp_path / name / "x").mkdir(parents=True)
    for name in ("tidewire-old", "other-old", f"tidewire-{spark.sparkContext.applicationId}"):
        for part in (tmp_path / name / "x", tmp_path / name):
            os.utime(part, (1_000_000, 1_000_000))
    assert storage.sweep(spark, 24) == ["tidewire-old"]
    assert {p.name for p in tmp_path.iterdir()} == {"tidewire-new", "other-old", f"tidewire-{spark.sparkContext.applicationId}"}


def test_settings():
    c = Config.of(["job=x y,z", "count=5", "types=true"])
    assert c.limit == 5 and c.types and c.run_name == "x_y_z_count=5_types=True"
    for bad in ("nokey=1", "job"):
        with pytest.raises(SystemExit):
            Config.of([bad])
    with pytest.raises(SystemExit):
        jobs.run(None, Config.of(["job=none"]))


def test_text_service(spark):
    surfaces = spark.createDataFrame([("ann lee", "k1"), ("oslo", "k2")], "phrase string, term string")
    types = spark.createDataFrame([("k2", "Q515")], "term string, type string")
    held = spark.createDataFrame([("k1", [1.0, 2.0])], "term string, v array<float>")
    prior = spark.createDataFrame([("c", 1, -0.7), ("c", 0, -0.7)], "category string, is int, prior double")
    weights = spark.createDataFrame([("c", 1, "k1", -1.0), ("c", 0, "k1", -2.0)], "category string, is int, term string, weight double")
    service = TextService(spark, surfaces, types, held, prior, weights)
    text = "Dr. Ann Lee works in Oslo. Later Ann Lee left."
    assert {r["term"] for r in service.annotate("We met in Oslo.").collect()} == {"k2"}
    assert {r["term"] for r in service.annotate_with_types("We met in Oslo.").collect()} == {"k2", "Q515"}
    assert [r["line"] for r in service.predict("We met Ann Lee in Oslo.").collect()] == ["c: true"]
    assert [r["line"] for r in service.predict("Nothing here.").collect()] == ["c: false"]
    assert service.vector_of("none").first()["v"] is None
    assert "NO_MATCH" in {r["vector"] for r in service.text_vectors("We met in Oslo.").collect()}
    assert len(answer(service.details(text))) > 3
    assert service.extract("").count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
