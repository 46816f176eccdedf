"""Operators on small data with results worked out by hand, and cases that whole tables don't show."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.stemmer import stem
from tidewire.operators import enrich, language, metrics, models, neural, projection, splits, stats, taxonomy, terms, vectors
from tidewire.sources import codec, formats, nitf, sinks
from tidewire.storage import cut, new_path

GOLD = {"a1": "abc", "a2": "acd", "a3": "bcd", "a4": "abd", "a5": "ad", "a6": "ac", "a7": "d", "a8": "a"}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, list(g), ["a", "c", "d"]) for i, g in GOLD.items()], "id string, iptc array<string>, pred array<string>")


def one(df):
    return df.first().asDict()


def test_confusion_and_micro_average(spark, labelled):
    counts = metrics.confusion(labelled, "iptc", "pred", list("abcd"))
    by = {r["label"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in counts.collect()}
    assert by["a"] == (6, 2, 0, 0) and by["b"][0] == 0 and by["c"][1] == 4 and by["d"][:2] == (5, 3)
    m = one(metrics.micro_average(counts))
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (15, 9, 3, 5)
    assert [round(m[c], 3) for c in ("precision", "recall", "accuracy", "f_score")] == [0.625, 0.833, 0.625, 0.714]


def test_example_metrics(labelled):
    m = one(metrics.example_metrics(labelled, "iptc", "pred"))
    assert [m["subset_accuracy"], m["h_loss"], m["precision"], m["recall"], m["accuracy"]] == pytest.approx([0.125, 0.4375, 0.625, 0.875, 0.5625])


def test_example_metrics_of_empty_sets(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), ([], ["b"]), (None, None)], "iptc array<string>, pred array<string>")
    assert one(metrics.example_metrics(rows, "iptc", "pred"))["recall"] == pytest.approx(1 / 3)
    assert math.isnan(one(metrics.example_metrics(rows, "iptc", "pred", compat=True))["recall"])
    assert one(metrics.label_shape(rows, "iptc", "pred", compat=True))["diversity_gold"] == 1.0


def test_tfidf_fixture(spark):
    rows = spark.createDataFrame([("a1", "a", 1), ("a1", "b", 2), ("a1", "c", 3), ("a2", "b", 2), ("a2", "c", 1), ("a2", "d", 1), ("a3", "c", 3), ("a3", "d", 2)], "article_id string, term string, mc int")
    vocabulary, n = terms.fit_tfidf(rows, "article_id", "term")
    assert {r["term"]: r["df"] for r in vocabulary.collect()} == {"a": 1, "b": 2, "c": 3, "d": 2} and n.first()[0] == 3
    got = {r["term"]: r["tf_idf"] for r in terms.tfidf(rows, vocabulary, n, "article_id", "term").where("article_id = 'a1'").collect()}
    assert got["a"] == pytest.approx(math.log(3) / 6) and got["b"] == pytest.approx(2 / 6 * math.log(1.5)) and got["c"] == 0
    assert {r["article_id"]: (r["most"], r["total"]) for r in stats.mention_extremes(rows).collect()} == {"a1": (3, 6), "a2": (2, 4), "a3": (3, 5)}


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "d int, term string")
    assert [r["term"] for r in terms.document_frequency(rows, "d", "term", 1).collect()] == ["x"]


def test_taxonomy_levels(spark):
    topics = spark.createDataFrame([("1", "health"), ("2", "health treatment"), ("3", "medicine"), ("4", "arts")], "topic_id string, topic_label string")
    edges = spark.createDataFrame([("2", "1"), ("3", "2"), ("3", "3"), ("3", "2")], "child string, parent string")
    got = {(r["label"], r["level"]): r["broad"] for r in taxonomy.level_names(topics, edges).collect()}
    assert [got["medicine", k] for k in range(4)] == ["health", "health treatment", "medicine", "medicine"] and got["arts", 2] == "arts"
    articles = spark.createDataFrame([("a", ["Acupuncture", "Medicine", None, "none such"])], "id string, desc_terms array<string>")
    mapping = spark.createDataFrame([("acupuncture", "medtop/2"), ("medicine", "n/a")], "descriptor string, topic_id string")
    assert sorted(r["topic_id"] for r in taxonomy.descriptor_topics(articles, mapping, topics).collect()) == ["2", "3"]


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("vietnamization", "vietnam"), ("adjustment", "adjust"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas"), ("sky", "sky"), ("agreed", "agre"), ("sized", "size")])
def test_stem(word, expected):
    assert stem(word) == expected


def test_text_functions(spark):
    row = spark.createDataFrame([("Arts, culture + more", "x[1]~\n y", "<http://e/a/Q42>", 93784000)], "a string, b string, c string, ms long")
    got = row.select(T.trim_label(F.col("a")), T.safe_string(F.col("b")), T.resource_id(F.col("c")), T.pretty_time(F.col("ms")), T.pretty_time(F.lit(61000), True)).first()
    assert list(got) == ["Arts_culture_more", "x 1 y", "Q42", "1d 2h 3m 4s", "1m 1s"]


plain = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zl", "Zp"), blacklist_characters="[]~\t\n\r"), min_size=1, max_size=12).map(str.strip).filter(lambda s: s and s not in ("N", "NONE", "none") and "  " not in s and s.isascii())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(plain, plain, st.lists(plain, max_size=3), st.integers(0, 9)), min_size=1, max_size=6, unique_by=lambda r: r[0]))
def test_article_line_round_trip(spark, rows):
    made = [(i, h, None, n, None, sorted(set(t)), None, [], [], {h: (i, h, n, -1, "NONE", "NONE", "NONE", -1.0)}) for i, h, t, n in rows]
    df = spark.createDataFrame(made, codec.ARTICLE)
    again = codec.article_of(codec.article_line(df)).collect()
    assert sorted((r["id"], r["hl"], r["wc"], tuple(r["iptc"]), tuple(a["phrase"] for a in r["ann"].values())) for r in again) == sorted((r[0], r[1], r[3], tuple(r[5]), (r[1],)) for r in made)


def test_bad_article_line(spark):
    lines = spark.createDataFrame([("one\t two",)], "value string")
    assert codec.article_of(lines, strict=False).count() == 0
    with pytest.raises(Exception, match="9 fields"):
        codec.article_of(lines).collect()


def test_splits(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") < 30).alias("pos"))
    parts = {r["part"]: r["n"] for r in splits.ordered_split(rows, "id").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 60, "test": 20, "validation": 20}
    assert splits.balanced(rows, "id", F.col("pos")).count() == 60
    more = splits.supersampled(rows, "id", F.col("pos"))
    assert more.count() == 170 and more.where("pos").count() == 100 and more.select("id").distinct().count() == 170
    assert splits.supersampled(rows.where("not pos"), "id", F.col("pos")).count() == 70
    assert splits.static_buckets(rows, 3, "id", compat=True).count() == 33 * 3 + 2
    assert sorted(r["idx"] for r in splits.with_index(rows, "id").collect()) == list(range(100))
    assert splits.with_index(rows.where("false"), "id").count() == 0
    buckets = splits.relative_buckets(rows, 4, "id", "id").groupBy("part").agg(F.count("*").alias("n"))
    assert {r["part"]: r["n"] for r in buckets.collect()} == {"train": 27, "test": 36, "validation": 36}


def test_names_merge(spark):
    rows = spark.createDataFrame([(1, 0, "Ann", "P"), (1, 1, "Lee", "P"), (1, 2, "met", "O"), (1, 3, "Bob", "P"), (1, 4, "Oslo", "L"), (2, 0, "Eve", "P")], "id int, place int, raw string, ner string")
    got = sorted((r["id"], r["start"], r["name"], r["kind"]) for r in language.merged_names(rows, "id").collect())
    assert got == [(1, 0, "Ann Lee", "P"), (1, 3, "Bob", "P"), (1, 4, "Oslo", "L"), (2, 0, "Eve", "P")]
    words = language.by_rules("Dr. Ann Lee of the Holm Council paid $500 in Oslo on Monday.")
    assert {w["ner"] for w in words} >= {"PERSON", "ORGANIZATION", "MONEY", "LOCATION", "TIME"}
    assert language.by_rules(None) == []


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [2.0, 2.0])], "k string, v array<double>")
    assert {r["k"]: r["vector"] for r in vectors.summed(rows, "k", F.col("v"), mean=True).collect()} == {"a": [2.0, 4.0], "b": [2.0, 2.0]}
    assert rows.where("k = 'b'").select(vectors.minmax(F.col("v"))).first()[0] == [0.0, 0.0]
    assert spark.range(1).select(vectors.from_csv(F.lit("1, x,3"))).first()[0] == [1.0, None, 3.0]


def test_naive_bayes_agrees_with_spark(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import Vectors

    data = [("1", [1, 0, 3], 1), ("2", [0, 2, 1], 0), ("3", [2, 2, 0], 1), ("4", [0, 1, 4], 0), ("5", [1, 1, 1], 1)]
    weighted = spark.createDataFrame([(i, f"t{j}", float(w)) for i, v, _ in data for j, w in enumerate(v) if w], "id string, term string, w double")
    labels = spark.createDataFrame([(i, "x") for i, _, y in data if y], "id string, label string")
    prior, weights = models.nb_counts(weighted, labels, ["x"])
    model = NaiveBayes(smoothing=1.0).fit(spark.createDataFrame([(float(y), Vectors.dense(v)) for _, v, y in data], ["label", "features"]))
    own = {(r["is"], r["term"]): r["weight"] for r in weights.collect()}
    assert {r["is"]: r["prior"] for r in prior.collect()} == pytest.approx({0: model.pi[0], 1: model.pi[1]})
    for y in (0, 1):
        assert [own[y, f"t{j}"] for j in range(3)] == pytest.approx(model.theta.toArray()[y].tolist())


def test_nets_learn_and_gradients_hold(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(4, 3, 5)), np.array([0, 1, 1, 0])
    for net, data in ((neural.Recurrent(5, 4), x), (neural.FeedForward((5, 4, 2)), x[:, 0])):
        length = np.array([3, 1, 2, 3])
        loss = lambda: -np.log(np.where(y == 1, net.probability(data, length), 1 - net.probability(data, length))).mean()  # noqa: B023, E731
        for w, g in zip(net.weights, net.gradients(data, y, length), strict=True):
            at = tuple(rng.integers(0, s) for s in w.shape)
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    points = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(str(i), p.tolist(), ["c"] if p[0] > 0 else []) for i, p in enumerate(points)], "id string, features array<double>, iptc array<string>")
    nets = neural.fit_each(rows, "iptc", ["c"], lambda: neural.FeedForward((4, 8, 2)), rounds=4, workers=2, batch=10)
    said = {r["id"]: bool(r["pred"]) for r in neural.predict(rows, nets).collect()}
    assert np.mean([said[str(i)] == (p[0] > 0) for i, p in enumerate(points)]) > 0.9


def test_projection_refuses_too_many(spark, monkeypatch):
    monkeypatch.setattr(projection, "MOST", 2)
    rows = spark.createDataFrame([(str(i), "l", [float(i), 1.0]) for i in range(3)], "k string, l string, v array<double>")
    with pytest.raises(ValueError, match="at most"):
        projection.neighbour_map(rows, "k", "v", "l")


def test_nitf(spark):
    text = '<?xml version="1.0"?><!DOCTYPE nitf SYSTEM "http://x/nitf.dtd"><nitf><head><meta name="dsk" content="Sports"/><docdata><doc-id id-string="7"/><identified-content><classifier class="indexing_service" type="descriptor">Games</classifier><classifier class="online_producer" type="taxonomic_classifier">Top/News/Sports</classifier><person class="indexing_service">Lee, Ann</person></identified-content></docdata><pubdata date.publication="20070115T000000" ex-ref="http://u" item-length="3"/></head><body><body.head><hedline><hl1>Head &amp; line</hl1></hedline></body.head><body.content><block class="full_text"><p>One two.</p><p>Three.</p></block></body.content></body></nitf>'
    docs = nitf.parsed(spark.createDataFrame([(text,), ("<broken",), (None,), ("",)], "value string"))
    good = docs.where("error is null").first()
    assert (good["headline"], good["body"], good["news_desk"], good["people"]) == ("Head & line", "One two.\nThree.", "Sports", ["Lee, Ann"])
    article = nitf.to_articles(docs).collect()
    assert len(article) == 1 and article[0]["desc"] == ["games", "sports"] and article[0]["date"] == "1168819200000" and article[0]["wc"] == 3
    assert "Head & line" in nitf.pretty(docs.where("error is null")).first()["text"]


def test_linked_resources(spark):
    answer = '{"Resources":[{"@URI":"http://d/resource/Oslo","@support":"5","@types":"Wikidata:Q515,Schema:City","@surfaceForm":"Oslo","@offset":"3","@similarityScore":"0.9"},{"@URI":"http://d/x"}]}'
    rows = formats.linked_resources(spark.createDataFrame([("a", answer), ("b", None), ("c", "{}")], "id string, response string")).collect()
    assert [(r["id"], r["entity"]["id"], r["entity"]["types"]) for r in rows] == [("a", "Oslo", ["Q515"])]


def test_expansion_of_ids(spark):
    notes = spark.createDataFrame([("a", "k", 2, 5, "Q1"), ("a", "m", 1, 3, "NONE")], "article_id string, term string, mc int, ann_offset int, wd string")
    broader = spark.createDataFrame([("Q1", "B1"), ("Q1", "B2")], "wd string, b string")
    assert {r["term"]: r["mc"] for r in enrich.expanded(notes, broader).collect()} == {"k": 2, "m": 1, "B1": 2, "B2": 2}
    assert {r["term"]: r["mc"] for r in enrich.expanded(notes, broader, compat=True).collect()} == {"k": 6, "m": 1}


def test_models_and_vocabulary_are_kept(spark):
    path = new_path(spark, "model")
    vocabulary = spark.createDataFrame([("a", 2)], "term string, df long")
    sinks.save_vocabulary(vocabulary, spark.createDataFrame([(3,)], "documents long"), path)
    assert sinks.load_vocabulary(spark, path)[1].first()[0] == 3
    with pytest.raises(ValueError):
        sinks.save_vocabulary(vocabulary.where("false"), vocabulary, path)


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5


def test_binary_scores(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert metrics.auroc(rows, "score", "label").first()[0] == pytest.approx(0.875)
    assert metrics.auroc(rows.where("label = 1"), "score", "label").first()[0] is None
    assert metrics.binary_curve(rows, "score", "label").count() == 3


def test_scoring_stream(spark):
    from tidewire.streaming import scoring

    path = new_path(spark, "arriving")
    spark.createDataFrame([("a", "t", 2, "2020-01-01 10:00:00"), ("a", "u", 1, "2020-01-01 11:00:00")], "article_id string, term string, mc int, at string").withColumn("loaded_at", F.to_timestamp("at")).drop("at").write.parquet(path)
    weights = spark.createDataFrame([("c", "t", 0.5), ("c", "u", -0.25)], "category string, term string, gain double")
    stream = scoring.scored(scoring.arriving(spark, path, "article_id string, term string, mc int, loaded_at timestamp"), weights)
    out = scoring.run_to_end(stream, "scored_articles", new_path(spark, "state"), "complete").collect()
    assert [(r["article_id"], r["category"], r["margin"]) for r in out] == [("a", "c", 0.75)]


def test_terms_are_counted_in_the_row(spark):
    rows = spark.createDataFrame([(1, "b a  b"), (2, None), (3, ""), (4, "$ x x"), (5, "w " * 30_000)], "id long, text string")
    got = {(r["doc"], r["term"]): (r["mc"], r["offset"], r["total"]) for r in terms.text_terms(rows, "id", "text", totals=True).collect()}
    assert got == {(1, "a"): (1, 1, 3), (1, "b"): (2, 0, 3), (4, "$"): (1, 0, 3), (4, "x"): (2, 1, 3), (5, "w"): (30_000, 0, 30_000)}
    plan = terms.text_terms(rows, "id", "text")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1]


@pytest.mark.parametrize("name", ["relative_buckets", "subsample_labels"])
def test_no_window_over_a_hot_group(spark, name):
    """Train, or a label of most rows, is no task's alone."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.when(F.col("id") % 300 == 0, "rare").otherwise("hot")).alias("iptc"))
    out = splits.relative_buckets(rows, 3, "id", "id") if name == "relative_buckets" else splits.subsample_labels(rows)
    plan = out._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "hashpartitioning(bucket" not in plan and "row_number" not in plan
    if name == "relative_buckets":
        by = {(r["bucket"], r["part"]): r["count"] for r in out.groupBy("bucket", "part").count().collect()}
        assert by == {(-1, "train"): 1000} | {(b, p): 333 for b in range(3) for p in ("test", "validation")} and out.select("id").distinct().count() == 2998
    else:
        assert out.count() == 20


def test_places_in_the_whole_order(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 7)
    got = [(r["k"], r["id"], r["idx"]) for r in splits.with_index(rows, "k", "id").collect()]
    assert [i for _, _, i in sorted(got)] == list(range(5000))


def test_bayes_of_all_categories_in_one_pass_is_sparks_own(spark):
    rows = spark.createDataFrame([(i, ["x"] if i % 3 == 0 else ["y", "other"] if i % 3 == 1 else None, [9.0 * (i % 3 == 0), float(i % 5), 1.0]) for i in range(90)], "id int, iptc array<string>, numbers array<double>")
    rows = models.features(rows, "numbers")
    fit = models.naive_bayes()
    together = models.each_category(rows, "iptc", ["x", "y", "none"], fit)
    single = models.each_category(rows, "iptc", ["x", "y", "none"], lambda df: fit(df))
    for c in single:
        assert together[c].pi.toArray() == pytest.approx(single[c].pi.toArray()) and together[c].theta.toArray() == pytest.approx(single[c].theta.toArray())
    said = [{r["id"]: r["pred"] for r in models.predicted(rows, m).collect()} for m in (together, single)]
    assert said[0] == said[1] and any(said[0].values())
    path = new_path(spark, "bayes")
    sinks.save_models(together, path)
    assert sinks.load_model(models.NaiveBayesModel, path, "x").theta.toArray() == pytest.approx(together["x"].theta.toArray())


def test_margins_of_the_sparse_model_are_those_of_the_written_one(spark):
    rows = [(f"d{i}", f"t{(i * j) % 11}", float(1 + (i + j) % 3)) for i in range(40) for j in range(1, 5)]
    weighted = spark.createDataFrame(rows, "id string, term string, w double")
    labels = spark.createDataFrame([(f"d{i}", c) for i in range(40) for c in (["a"] if i % 3 else ["b", "c"])], "id string, label string")
    test = spark.createDataFrame([("n1", "t1", 2.0), ("n1", "t1", 1.0), ("n1", "unknown", 5.0), ("n2", "t3", 1.0), ("n3", "unknown", 1.0)], "id string, term string, w double")
    cats = ["a", "b", "never"]
    got = {(r["id"], r["category"]): r["margin"] for r in models.nb_margins(test, models.nb_fit(weighted, labels, cats)).collect()}
    wanted = {(r["id"], r["category"]): r["margin"] for r in models.nb_predict(test, *models.nb_counts(weighted, labels, cats)).collect()}
    assert got == pytest.approx(wanted) and set(got) == {(i, c) for i in ("n1", "n2") for c in cats}


def test_weights_are_averaged_by_a_tree(spark, monkeypatch):
    """However many sets of weights a node takes and however many nets are trained together, the mean is that of all parts by their rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(rng.normal(size=3).tolist(), [int(i % 2), int(i % 3 == 0)]) for i in range(240)], "features array<double>, labels array<int>")
    data, workers = neural.spread(rows, 6)
    assert workers == 6 and {r["part"]: r["count"] for r in data.groupBy("part").count().collect()} == dict.fromkeys(range(6), 40)
    make = lambda: [neural.FeedForward((3, 4, 2), seed) for seed in (1, 2)]
    flat = neural._fit(data, 6, make(), 2, 0.01, 10, 0.95)
    monkeypatch.setattr(neural, "WIDTH", 2)
    tree = neural._fit(data, 6, make(), 2, 0.01, 10, 0.95)
    alone = neural._fit(data.select("features", "part", F.slice("labels", 2, 1).alias("labels")), 6, make()[1:], 2, 0.01, 10, 0.95)
    for one, other in ((flat[0], tree[0]), (flat[1], tree[1]), (flat[1], alone[0])):
        for a, b in zip(one.weights, other.weights, strict=True):  # in single precision
            assert a == pytest.approx(b, rel=1e-3, abs=1e-5)
    assert neural.spread(rows)[1] == 1


def test_copies_of_labels_are_not_broadcast(spark):
    """The copies look as few as the labels until they are made; sent to all tasks through the driver they filled its memory."""
    made = spark.createDataFrame([(f"a{i:03}", ["common"] if i else ["rare"]) for i in range(300)], "id string, iptc array<string>")
    out = splits.supersample_labels(made)
    rows = out.collect()
    assert len(rows) == 2 * 299 and sorted(r["copy"] for r in rows if r["label"] == "rare") == list(range(299)) and {r["id"] for r in rows if r["label"] == "rare"} == {"a000"}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth, sent = [len(line) - len(line.lstrip(" +-:|")) for line in plan], []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            sent += plan[i:below]
    assert sent and any("Generate explode" in line for line in plan) and not any("Generate explode" in line for line in sent)


def test_perceptrons_of_all_categories_are_spark_s_own(spark):
    """The weights of Spark's trainer on the same rows in one partition, without a job for each gradient of each category."""
    import numpy as np

    from tidewire.operators import perceptron

    x = np.random.default_rng(5).normal(size=(300, 4))  # the last block has fewer rows than the others
    x[250:] = x[:50]  # rows of the same features, with the same labels or others
    held = [[c for c, ok in (("x", v[0] * v[1] > 0), ("y", v[2] + v[3] > 0.5 or i > 280)) if ok] for i, v in enumerate(x)]
    rows = models.features(spark.createDataFrame([(i, x[i].tolist(), held[i]) for i in range(300)], "id int, numbers array<double>, iptc array<string>").repartition(3), "numbers")
    fit, cats = models.feed_forward(4, (6, 5), rounds=20, kind=np.float64), ["x", "y", "none"]
    spark.sparkContext.setJobGroup("perceptrons", "")
    together = models.each_category(rows, "iptc", cats, fit)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("perceptrons"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(together) == cats and jobs < 20
    few = models.feed_forward(4, (6, 5), rounds=5)
    rough, single = models.each_category(rows, "iptc", cats, few), {}
    for c in cats:
        y = [int(c in h) for h in held]
        made = [(float(y[i]), x[i].tolist()) for i in perceptron.ordered(x, np.array(y))]
        marked = models.features(spark.createDataFrame(made, "label double, numbers array<double>").coalesce(1), "numbers")
        single[c] = fit(marked)
        assert together[c].layers == list(single[c].getLayers()) == list(together[c].spark(spark).getLayers())
        assert np.allclose(together[c].weights, single[c].weights.toArray(), rtol=1e-6, atol=1e-6)
        assert np.allclose(rough[c].weights, few(marked).weights.toArray(), rtol=1e-3, atol=1e-3)
    wanted = {i: [] for i in range(300)}
    for c in sorted(cats):
        said = [{r["id"] for r in m.transform(rows).where("prediction = 1").select("id").collect()} for m in (single[c], together[c].spark(spark))]
        assert said[0] == said[1]
        for i in said[0]:
            wanted[i].append(c)
    assert {r["id"]: r["pred"] for r in models.predicted(rows, together).collect()} == wanted and sum(map(len, wanted.values())) > 100


def test_perceptrons_of_more_rows_than_a_task_holds(spark, monkeypatch):
    import numpy as np

    from tidewire.operators import perceptron

    x = np.random.default_rng(6).normal(size=(40, 2))
    rows = models.features(spark.createDataFrame([(i, x[i].tolist(), ["x"] if x[i, 0] > 0 else None) for i in range(40)], "id int, numbers array<double>, iptc array<string>"), "numbers")
    said = []
    for most in (80, 79):  # Spark's own trainer takes what is too much
        monkeypatch.setattr(perceptron, "MOST", most)
        said.append({r["id"]: r["pred"] for r in models.predicted(rows, models.each_category(rows, "iptc", ["x"], models.feed_forward(2, (3,), rounds=20))).collect()})
    assert said[0] == said[1] == {i: ["x"] if x[i, 0] > 0 else [] for i in range(40)}
