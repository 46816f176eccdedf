"""Nulls, empty and very long texts, ties and repeated rows, empty tables and extra columns: each with the result that the docstrings state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.llm import cooccurrence, encoding, frequency, leakage, near_duplicates, neighbours, proportions, spans, split_overlap, subjects

ARTICLE = "id string, hl string, body string, iptc array<string>, pred array<string>, desc_terms array<string>, ann array<string>, split_name string, source string, loaded_at timestamp, n long, key string, rep string, label string, row int, subject string, a int, b int"
T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
EXTRA = (1, "x", "y", "z", 2, "s", 3, 4)
LONG = " ".join(f"word{i % 5000} reagent court" for i in range(60_000))
SAME = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"


def article(i, hl=None, body=None, iptc=None, split=None, at=T0, ann=None):
    return (i, hl, body, iptc, None, None, ann, split, None, at, *EXTRA)


@pytest.fixture(scope="module")
def messy(spark):
    rows = [article(None, "h", SAME), article("n"), article("e", "", "", [], "train"), article("b", " ", " \n\t", ["", None, " "], "test"), article("l", None, LONG, ["science"], "train"), article("l2", None, LONG, ["Science "], "test"), article("d1", "x", SAME, ["sport", "sport", None], "train", T0, ["k", "k", None, "", "m"]), article("d1", "x", SAME, ["science"], "validation", T1, ["k", "m"]), article("d2", "x " + SAME, None, None, "validation", None), article("d2", "x " + SAME, None, None, "validation", None), article("t", SAME, SAME, ["science"], None, T1)]
    return spark.createDataFrame(rows, ARTICLE)


@pytest.fixture(scope="module")
def taxonomy(spark):
    topics = spark.createDataFrame([("1", "science"), ("2", "sport"), ("3", "physics"), (None, None)], "topic_id string, topic_label string")
    edges = spark.createDataFrame([("3", "1"), ("3", "3"), ("3", "1"), ("9", "1"), (None, "1")], "child string, parent string")
    return topics, edges


def test_near_duplicates(messy):
    links, members = near_duplicates.near_duplicates(messy)
    assert {r["id"]: r["rep"] for r in members.collect()} == {"l": "l", "l2": "l", "d1": "d1", "d2": "d1", "t": "t"}
    assert sorted(tuple(r) for r in near_duplicates.pairs(links, members).collect()) == [("d1", "d2"), ("d1", "t"), ("d2", "t"), ("l", "l2")]
    links, members = near_duplicates.near_duplicates(messy.where("false"))
    assert links.count() == members.count() == near_duplicates.pairs(links, members).count() == 0
    assert near_duplicates.groups(messy.where("false")).count() == 0


def test_split_overlap(messy):
    got = {(r["eval_id"], r["train_id"]) for r in split_overlap.overlaps(messy).collect()}
    assert got == {("d1", "d1"), ("d2", "d1"), ("l2", "l")}
    assert split_overlap.overlaps(messy.where("false")).count() == 0


def test_subjects(spark, messy, taxonomy):
    labels = spark.createDataFrame([("l", "science"), ("none", "science"), (None, "sport"), ("d1", "unknown")], "id string, subject string")
    got = subjects.classify(messy, *taxonomy, labels, rounds=1)
    assert {r["id"] for r in got.collect()} <= {"l", "l2", "d1", "t"}
    assert subjects.classify(messy.where("false"), *taxonomy, labels).count() == 0
    assert subjects.classify(messy, taxonomy[0].where("false"), taxonomy[1], labels).count() == 0


def test_sample(spark, messy, taxonomy):
    mapping = proportions.subjects_of_labels(*taxonomy)
    assert mapping == {"physics": ["science"], "science": ["science"], "sport": ["sport"]}
    rows = proportions.subjects_by(messy.where("id is not null").dropDuplicates(["id"]), "id", "iptc", mapping)
    targets = spark.createDataFrame([("science", 700, 1), ("science", 700, 1), ("sport", 300, 1), ("absent", None, 3), (None, 1, 1)], "topic string, target_permille int, min_rows int")
    out, report = proportions.sample(rows, targets)
    assert out.count() == rows.count() // 2
    by = {r["topic"]: r for r in report.collect()}
    assert by["absent"]["shortage"] == by["absent"]["gap"] == 3 and set(by) == {"science", "sport", "absent"}
    out, report = proportions.sample(rows.where("false"), targets)
    assert out.count() == 0 and report.count() == 3
    out, report = proportions.sample(rows, targets.where("false"))
    assert out.count() == rows.count() // 2 and report.count() == 0


def test_sample_of_many_equal_rows(spark):
    """A category with a third of the rows, all alike, is drawn to its target."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(F.array(F.lit("cold"))).alias("subjects"))
    targets = spark.createDataFrame([("hot", 200, 5), ("cold", 800, 5)], "topic string, target_permille int, min_rows int")
    out, report = proportions.sample(rows, targets, 1000)
    by = {r["topic"]: r["sampled"] for r in report.collect()}
    assert out.count() == 1000 and abs(by["hot"] - 200) <= 8  # a unit for each task


def test_counts(spark, messy):
    notes = spark.createDataFrame([("d1", " A  b "), ("d1", "a b"), ("d2", "A B"), ("d3", "a b"), (None, "a b"), ("d4", None), ("d5", "  "), ("d6", LONG)], "article_id string, phrase string")
    terms = spark.createDataFrame([("m", "k", 3, 9), ("m", "k", 3, 9), ("m2", "k", 1, 5), ("m", None, 1, 9), ("m", " ", 1, 9)], "model_name string, term string, df int, document_count int")
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in frequency.term_counts(notes, messy, terms).collect()}
    assert got["phrase", "a b"] == (4, 3, "common") and got["tfidf", "k"] == (4, 4, "common") and len(got) == 3
    assert frequency.term_counts(notes.where("false"), messy.where("false"), terms.where("false")).count() == 0


def test_heavy_terms_are_counted_exactly(spark):
    """Rows with records that repeat, and rows that stand for several; whichever terms are heavy."""
    record = F.when(F.col("id") % 5 > 0, (F.col("id") % 900).cast("string"))
    rows = spark.range(30000).select(F.lit("f").alias("field_name"), record.alias("record"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 7000).cast("string"))).alias("term"), F.lit(2).alias("occurrences"), F.lit(1).alias("records"))
    alone = F.count_if(F.col("record").isNull())
    wanted = {r["term"]: (r["o"], r["n"]) for r in rows.groupBy("term").agg(F.sum("occurrences").alias("o"), (F.count_distinct("record") + alone).alias("n")).collect()}
    for heavy in (0, 1, 50):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.heavy_light(rows, heavy=heavy).collect()}
        assert got == wanted


def test_terms_of_arrays(spark):
    rows = spark.createDataFrame([(["b", "a", "b", None, " ", "b"],), ([],), (None,), (["x"],), (["a"] * 5,)], "terms array<string>")
    got = sorted((r["term"], r["occurrences"], r["records"]) for r in frequency.in_arrays(rows, "f", F.col("terms")).collect())
    assert got == [("a", 1, 1), ("a", 5, 1), ("b", 3, 1), ("x", 1, 1)]


def test_pairs(messy):
    state = cooccurrence.article_pairs(messy)
    got = {(r["field_name"], r["item_a"], r["item_b"]): r["k"] for r in state.scores().collect()}
    assert got == {("ann", "k", "m"): 1}
    assert cooccurrence.article_pairs(messy.where("false")).scores().count() == 0


def test_big_basket(spark):
    rows = spark.createDataFrame([("f", "b", None, [f"i{i:04}" for i in range(700)])], "field_name string, basket string, version timestamp, items array<string>")
    state = cooccurrence.PairTable(spark)
    state.update(rows)
    assert state.read("pairs").count() == 700 * 699 // 2


def test_encoding(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, LONG, "x"), (3, LONG, "x"), (4, "a" * 20000, "x"), (None, "hi", "x"), (5, " " * 3000 + "<|endoftext|>", "x")], "doc_id long, text string, ids string")
    got = encoding.encode_column(rows).collect()
    assert len(got) == 7 and all(r["ids"] == [] for r in got if r["doc_id"] in (1, 2))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for r in got:
        if r["doc_id"] in (3, 4, 5):
            text = {3: LONG, 4: "a" * 20000, 5: " " * 3000 + "<|endoftext|>"}[r["doc_id"]]
            assert r["ids"] == t.encode(text, add_special_tokens=False).ids
    assert encoding.encode_column(rows.where("false")).count() == 0


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "too short", 0), (None, item, 0), (5, item, 1), (6, "a " * 40, 0)], "item_id long, text string, score int")
    docs = spark.createDataFrame([(1, LONG + " " + item.upper() + " " + LONG, 0), (2, None, 0), (3, "", 0), (4, item[:-12], 0), (5, item.replace(" ", ", "), 0), (5, item, 0), (None, item, 0), (6, "x " * 100 + "a " * 12, 0), (7, "a " * 11, 0)], "doc_id long, text string, run_words int")
    got = {(r["doc_id"], r["item_id"]): r["run_words"] for r in leakage.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (1, 5), (5, 1), (5, 5), (6, 6)}  # 4 ends in the middle of the twelfth word
    assert got[1, 1] == 13
    assert leakage.leaks(docs, items.where("false")).count() == 0 and leakage.leaks(docs.where("false"), items).count() == 0


def test_spans(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "-" + text[:350], 0), (3, None, 0), (4, "", 0), (None, text, 0), (5, "b" * 4000, 0), (6, text, 0)], "doc_id long, text string, span_start int")
    got = sorted(tuple(r) for r in spans.shared_spans(docs).collect())
    assert got == [(1, 0, 500), (2, 1, 351), (6, 0, 500)]
    assert spans.shared_spans(docs.where("false")).count() == 0
    assert spans.shared_spans(docs.where("doc_id = 1")).count() == 0


def test_vectors(spark):
    v = [1.0] + [0.0] * 63
    w = [0.9, 0.3] + [0.1] * 62
    rows = [("f", f"k{i:02}", v, 0) for i in range(12)] + [("f", "k00", v, 0), ("f", "w", w, 0), ("f", "s", [2 * x for x in v], 0), ("g", "alone", v, 0), ("f", None, v, 0), ("f", "n", None, 0), ("f", "z", [0.0] * 64, 0), ("f", "h", v[:10], 0), ("f", "i", [float("inf")] + v[1:], 0), ("f", "q", [float("nan")] + v[1:], 0), ("f", "m", [None] + v[1:], 0)]
    made = spark.createDataFrame(rows, "field_name string, key string, v array<float>, rank int")
    got = {}
    for r in neighbours.neighbours(made).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["other"]))
    assert set(got) == {f"k{i:02}" for i in range(12)} | {"w", "s"}
    others = lambda key: [o for _, o in sorted(got[key])]
    assert others("k00") == ["k01", "k02", "k03", "k04", "k05"] and others("k07") == ["k00", "k01", "k02", "k03", "k04"] and others("s") == ["k00", "k01", "k02", "k03", "k04"]
    assert len(got["w"]) == 5
    assert neighbours.neighbours(made.where("false")).count() == 0


def test_leak_longer_than_a_passage(spark):
    """A run that crosses the grid of passages, or is longer than one, counts whole."""
    item = [f"w{i}" for i in range(80)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = {1: (30, item[:30]), 2: (5, item), 3: (40, item[20:75]), 4: (3, item[:20] + ["x"] + item[21:45])}
    made = spark.createDataFrame([(i, " ".join([f"o{k}" for k in range(n)] + w + ["end"])) for i, (n, w) in docs.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["run_words"] for r in leakage.leaks(made, items).collect()} == {1: 30, 2: 80, 3: 55, 4: 24}
