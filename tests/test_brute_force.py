"""Operators that SQL can't express, against plain Python on small data."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.stemmer import stem
from tidewire.operators import language, models, projection, terms
from tidewire.sources import formats

TEXTS = ["The runner was running; runs hopefully, hopping", "Relational conditions, RELATIONAL data", "", None, "running running running", "a b c a"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def words(text):
    return ["".join(c for c in w if c in "abcdefghijklmnopqrstuvwxyz$¥€+") for w in (text or "").lower().split()]


def test_stem_frequencies(spark, texts):
    got = {(r["doc"], r["term"]): (r["mc"], r["offset"]) for r in terms.text_terms(texts, "id", "text", stem=True).collect()}
    wanted = {}
    for i, text in enumerate(TEXTS):
        stems = [stem(w) for w in words(text) if w]
        for s, n in Counter(stems).items():
            wanted[i, s] = (n, stems.index(s))
    assert got == wanted and got[0, "run"][0] == 2


def test_hashed_weights(spark, texts):
    """Without collisions the sum of a document's weights is that over its words."""
    rows = texts.where("text is not null").select("id", F.split(F.lower("text"), r"\s+").alias("words"))
    out = models.as_array(models.inverse_frequencies(models.hashing_tf(rows, "words")), "idf")
    got = {r["id"]: r["total"] for r in out.select("id", F.aggregate("idf", F.lit(0.0), lambda s, x: s + x).alias("total")).collect()}
    docs = {i: Counter(t.lower().split() or [""]) for i, t in enumerate(TEXTS) if t is not None}
    df = Counter(w for c in docs.values() for w in c)
    assert got == pytest.approx({i: sum(n * math.log((len(docs) + 1) / (df[w] + 1)) for w, n in c.items()) for i, c in docs.items()})


def test_word_vectors_find_words_of_like_company(spark):
    rows = spark.createDataFrame([(["red", "wine", "glass"] * 4,), (["white", "wine", "glass"] * 4,), (["goal", "match", "team"] * 4,)] * 40, "words array<string>")
    found = models.word_vectors(rows, "words", size=8, least=1, partitions=1).findSynonyms("red", 6).collect()
    assert [r["similarity"] for r in found] == sorted((r["similarity"] for r in found), reverse=True)
    assert {r["word"] for r in found[:3]} == {"wine", "glass", "white"}


def test_principal_plane(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1]
    out = projection.principal(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), "id", "v").orderBy("id").collect()
    got = np.array([r["point"] for r in out])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    wanted = x @ v[:2].T
    for k in (0, 1):
        sign = np.sign(got[:, k] @ wanted[:, k])
        assert got[:, k] - got[:, k].mean() == pytest.approx(sign * (wanted[:, k] - wanted[:, k].mean()), abs=1e-6)


def test_support_vectors_part_what_can_be_parted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    rows = spark.createDataFrame([(i, r.tolist(), float(r[0] + r[1] > 0)) for i, r in enumerate(x)], "id long, numbers array<double>, label double")
    rows = models.features(rows, "numbers")
    out = models.support_vectors(50)(rows).transform(rows).select("label", "prediction").collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.95


def test_names_and_nouns(spark):
    rows = spark.createDataFrame([(1, "Dr. Ann Lee works in Oslo. The Harbour Council asked for $5 on Monday."), (2, None), (3, "")], "id long, text string")
    found = language.word_rows(language.extracted(rows, "id", "text"), "id")
    names = {(r["kind"], r["name"]): r["n"] for r in language.name_counts(language.merged_names(found, "id")).collect()}
    assert names["LOCATION", "Oslo"] == 1 and names["ORGANIZATION", "Harbour Council"] == 1 and any(k == "PERSON" and "Ann Lee" in n for k, n in names)
    by = {r["kind"]: r["names"] for r in language.names_by_kind(language.merged_names(found, "id"), "id").collect()}
    assert by["LOCATION"] == ["Oslo"] and {r["id"] for r in found.select("id").distinct().collect()} == {1}
    assert {r["raw"] for r in language.nouns(found).collect()} == {"Dr", "Ann", "Lee", "Oslo", "Harbour", "Council", "Monday"}


@pytest.mark.parametrize(("text", "tags"), [("She quickly opened the old wooden door.", "PRP RB VBD DT NN NN NN ."), ("They have never visited Oslo.", "PRP VBP RB VBN NNP ."), ("We want to build houses in 1999.", "PRP VBP TO VB NNS IN CD ."), ("The meeting was cancelled by the famous minister.", "DT NN VBD VBN IN DT JJ NN ."), ("He works in a small town.", "PRP VBZ IN DT NN NN .")])
def test_tags(text, tags):
    """By rules: what no rule speaks for is a noun."""
    assert [w["tag"] for w in language.by_rules(text)] == tags.split()


def test_normal_numbers(spark):
    rows = formats.random_normals(spark, 20_000)
    got = rows.agg(F.avg("x"), F.stddev("x"), F.count("*"), F.count_distinct("id")).first()
    assert abs(got[0]) < 0.03 and abs(got[1] - 1) < 0.03 and got[2] == got[3] == 20_000
    assert rows.rdd.getNumPartitions() == 10 and rows.collect()[:5] == formats.random_normals(spark, 20_000).collect()[:5]
