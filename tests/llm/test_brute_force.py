"""Operators against plain Python on whole tables: every row, no limits."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from tidewire.llm import cooccurrence, encoding, leakage, near_duplicates, neighbours, proportions, queries, shingles, spans, split_overlap, subjects
from tidewire.sources.tables import latest, table

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\W_]+")


def words(*texts):
    return [w for t in texts for w in WORD.findall((t or "").lower())]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    why, _ = compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert not why


@pytest.fixture(scope="module")
def articles(spark):
    return table(spark, MORE, "articles").cache()


@pytest.fixture(scope="module")
def similar(articles):
    """All pairs of articles with a similarity of 0.6 or more."""
    sets = {}
    for r in articles.select("id", "hl", "body").distinct().collect():
        w = words(r["hl"], r["body"])
        if len(w) >= 20:
            sets[r["id"]] = frozenset(zip(w, w[1:], w[2:], strict=False))
    return {(a, b): s for a, b in itertools.combinations(sorted(sets), 2) if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.6}


def test_near_duplicates(spark, similar):
    got = [tuple(r) for r in near_duplicates.p3_found(spark, MORE).collect()]
    assert len(got) == len(set(got)) and set(got) == set(similar)


def test_groups_are_components(spark, similar):
    group = {}
    for a, b in similar:
        group.setdefault(a, a), group.setdefault(b, b)
    for _ in range(20):
        for a, b in similar:
            group[a] = group[b] = min(group[a], group[b])
    rows = near_duplicates.p3_groups(spark, MORE).collect()
    assert {r["id"]: r["group_id"] for r in rows} == group
    best = defaultdict(float)
    for (a, b), s in similar.items():
        best[a], best[b] = max(best[a], s), max(best[b], s)
    assert {r["id"]: r["similarity"] for r in rows} == pytest.approx(best, abs=1e-6)


@pytest.mark.parametrize("sides", [False, True])
def test_hot_buckets_lose_nothing(spark, similar, monkeypatch, sides):
    whole = shingles.bucket_pairs
    for module in (near_duplicates, split_overlap):
        monkeypatch.setattr(module, "bucket_pairs", lambda *a, **k: whole(*a, hot=2, **k))
    if not sides:
        assert {tuple(r) for r in near_duplicates.p3_found(spark, MORE).collect()} == set(similar)
    else:
        assert {tuple(r) for r in split_overlap.p5_found(spark, MORE).collect()} == overlaps_of(spark, similar)


def overlaps_of(spark, similar):
    sides = defaultdict(set)
    for r in table(spark, MORE, "articles").select("id", "split_name").distinct().collect():
        sides[r["id"]].add("train" if r["split_name"] == "train" else "other")
    across = {(a, b) for a, b in similar if ("train" in sides[a] and "other" in sides[b]) or ("other" in sides[a] and "train" in sides[b])}
    return across | {(i, i) for i, s in sides.items() if len(s) == 2}


def test_split_overlap(spark, similar):
    got = [tuple(r) for r in split_overlap.p5_found(spark, MORE).collect()]
    assert len(got) == len(set(got)) and set(got) == overlaps_of(spark, similar)


def test_overlap_report_counts_what_is_listed(spark):
    articles = table(spark, MORE, "articles")
    listed = {r["eval_id"]: r["n"] for r in split_overlap.overlaps(articles).groupBy("eval_id").agg(F.count("*").alias("n")).collect()}
    got = [tuple(r) for r in split_overlap.overlap_counts(articles).collect()]
    assert len(got) == len(listed) and dict(got) == listed


def test_overlaps_of_many_copies_are_counted_without_listing(spark):
    """10,000 copies in train and as many in test, all the same text: a hundred million pairs."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("head").alias("hl"), F.lit(text).alias("body"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split_name"), F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("loaded_at"))
    got = split_overlap.overlap_counts(rows).agg(F.count("*"), F.min("pairs"), F.max("pairs"), F.sum("pairs")).first()
    assert tuple(got) == (10_000, 10_000, 10_000, 100_000_000)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, (50, shingles.HASHES)).astype(np.uint64)
    _, packed = near_duplicates.embed(hashes)
    low = hashes.astype(np.uint32)
    counts = np.concatenate([packed & 15, packed >> 4], 1).astype(int)
    for i, j in itertools.combinations(range(50), 2):
        assert np.abs(counts[i] - counts[j]).sum() <= np.bitwise_count(low[i] ^ low[j]).sum()


def test_nearest_vectors(spark):
    rows = neighbours.stored_vectors(table(spark, MORE, "neural_models"), table(spark, MORE, "annotations"))
    held = neighbours.valid(rows).toPandas()
    near = neighbours.p2_neighbours(spark, MORE).toPandas()
    found = {tuple(r) for r in neighbours.p2_found(spark, MORE).collect()}
    cases, hits, total = set(), 0, 0
    for field, group in held.groupby("field_name"):
        group = group.sort_values("key")
        keys, x = group["key"].tolist(), neighbours.unit(np.stack(group["v"].to_list()).astype(float))
        cosine = np.round(x @ x.T, 10)
        np.fill_diagonal(cosine, -9)
        own = near[near["field_name"] == field].groupby("key")["other"].apply(set).to_dict()
        for i, key in enumerate(keys):
            best = np.argsort(-cosine[i], kind="stable")[:5]
            total += len(best)
            hits += len(own[key] & {keys[j] for j in best})
            cases |= {(field, *sorted((key, keys[j]))) for j in best if cosine[i, j] >= 0.85}
    assert hits / total >= 0.9
    assert len(found & cases) >= 0.99 * len(cases) and len(found - cases) <= 0.01 * len(cases)


def test_subjects_of_documents_left_out(spark):
    """Labels of half of the labelled articles are kept back; those must come out right."""
    labels = table(spark, "/root/testdata/sf0.1", "subject_labels")
    kept = labels.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    found = subjects.classify(*(table(spark, "/root/testdata/sf0.1", n) for n in ("articles", "topics", "topic_edges")), kept)
    found = {tuple(r) for r in found.where("n_subject * 4 >= n_sentences").select("id", "subject").collect()}
    truth = {tuple(r) for r in labels.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).select("id", "subject").collect()}
    ids = {i for i, _ in truth}
    found = {x for x in found if x[0] in ids}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 0.03 * len(truth)


def test_posteriors_are_independent():
    """A sentence with words of two subjects is about both, one of faint words about none; the posterior of a subject doesn't depend on the others'."""
    model = np.zeros((4, 3), np.float32)
    model[0, 0] = model[1, 1] = 5
    model[2] = [0.1, 0.2, 0.3]
    counts = np.ones((100, 3))
    counts[0, 0] = 300
    counts[1] = [60, 40, 50]
    weights = subjects.weights(counts)
    assert weights[0, 0] > subjects.FAINT and not weights[1].any()
    curve = np.tile([1.0, -3.0], (3, 1))
    scores = np.array([model[0] + model[1], model[0], 3 * model[2], model[0] + model[1] + 4 * model[1]])
    p = subjects.calibrated(scores, curve)
    assert (p >= subjects.SURE).tolist() == [[True, True, False], [True, False, False], [False] * 3, [True, True, False]]
    assert p[0, 0] == p[1, 0] == p[3, 0]
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 5000)
    slope, offset = subjects.fit_curve(x, (rng.random(5000) < 1 / (1 + np.exp(-(0.8 * x - 4)))).astype(float), np.ones(5000))
    assert abs(slope - 0.8) < 0.1 and abs(offset + 4) < 0.5


def test_sample_keeps_targets_and_floors(spark):
    sample, report = proportions.article_sample(spark, MORE)
    rows = sample.collect()
    assert len({r["id"] for r in rows}) == len(rows) == latest_labelled(spark) // 2
    for r in report.collect():
        assert r["sampled"] == sum(r["topic"] in x["subjects"] for x in rows)
        assert r["gap"] == max(0, r["required"] - r["sampled"]) and r["shortage"] == max(0, r["required"] - r["held"])
        if r["shortage"]:
            assert r["sampled"] == r["held"]


def latest_labelled(spark):
    mapping = proportions.subjects_of_labels(table(spark, MORE, "topics"), table(spark, MORE, "topic_edges"))
    return proportions.subjects_by(latest(table(spark, MORE, "articles"), "iptc"), "id", "iptc", mapping).count()


def test_pivotal_keeps_chances():
    rng = np.random.default_rng(3)
    chance = rng.random(40)
    chance *= 20 / chance.sum()
    chance = np.minimum(chance, 1)
    hits, rounds = np.zeros(40), 4000
    for _ in range(rounds):
        taken, left, last = proportions.pivotal(chance, rng.random(40), None)
        assert abs(len(taken) + (last[1] if last else 0) - chance.sum()) < 1e-6 and len(set(taken) | set(left)) >= 39
        hits[taken] += 1
        if last:
            hits[last[0]] += last[1]
    assert np.abs(hits / rounds - chance).max() < 0.05


def test_encoding(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    docs = table(spark, MORE, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["ids"] for r in encoding.p8_ids(spark, MORE).collect()}
    wanted = {r["doc_id"]: x.ids for r, x in zip(docs, tokenizer.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False), strict=True)}
    assert got == wanted


def test_leaks(spark):
    items = {r["item_id"]: words(r["text"]) for r in table(spark, MORE, "eval_items").collect()}
    runs = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 11):
            runs[tuple(w[k : k + 12])].add(i)
    wanted = set()
    for r in table(spark, MORE, "documents").select("doc_id", "text").collect():
        w = words(r["text"])
        wanted |= {(r["doc_id"], i) for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    got = [tuple(r) for r in leakage.p9_found(spark, MORE).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    docs, listed = table(spark, MORE, "documents"), table(spark, MORE, "eval_items")
    parts = leakage.leaks(docs, listed, index_chars=20_000)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} == wanted


def shared_of(rows, least):
    """Maximal shared runs of (id, text) rows, by comparing all stretches."""
    holders = defaultdict(set)
    for i, t in rows:
        for k in range(len(t) - least + 1):
            holders[t[k : k + least]].add(i)
    out = set()
    for i, t in rows:
        on = np.zeros(len(t) + 1, int)
        for k in range(len(t) - least + 1):
            if len(holders[t[k : k + least]]) > 1:
                on[k : k + least] = 1
        edge = np.diff(np.concatenate([[0], on[:-1] if len(t) else on[:0], [0]]))
        out |= {(i, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)}
    return out


@pytest.mark.parametrize("hot", [spans.HOT, 1])
def test_shared_spans(spark, hot):
    docs = table(spark, MORE, "documents").where("text is not null")
    wanted = shared_of([tuple(r) for r in docs.select("doc_id", "text").collect()], 300)
    got = [tuple(r) for r in spans.shared_spans(docs, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_shared_spans_of_repeats_and_astral_signs(spark):
    rng = np.random.default_rng(5)
    base = "".join(chr(c) for c in rng.choice([97, 98, 233, 0x1F600], 400))
    rows = [(1, "x" * 50 + base[:120] + "y" * 60), (2, base[20:140] + "a" * 300), (3, "a" * 200), (4, base[60:100]), (5, "ab" * 90), (6, "zab" * 40 + "ab" * 60), (7, base[:120]), (8, base[:120])]
    got = {tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), least=60, gram=8).collect()}
    assert got == shared_of(rows, 60)


def test_pairs_follow_changes(spark):
    """Any order of batches, with reloads and rows that come late, gives the counts of the last baskets; scores that an update gives are those that changed."""
    rng = np.random.default_rng(2)
    state, last = cooccurrence.PairTable(spark, buckets=4), {}
    before = {}
    for step in range(3):
        rows = []
        for _ in range(25):
            basket, version = f"b{rng.integers(0, 20)}", int(rng.integers(0, 50))
            items = [None if x == 9 else f"i{x}" for x in rng.integers(0, 10, rng.integers(0, 6))]
            rows.append(("f", basket, version, items))
        made = spark.createDataFrame(rows, "field_name string, basket string, v int, items array<string>").withColumn("version", F.timestamp_seconds("v")).drop("v")
        for _, basket, version, items in rows:
            new = (version, tuple(sorted({i for i in items if i})))
            if basket not in last or new[0] > last[basket][0] or (new[0] == last[basket][0] and new >= last[basket]):
                last[basket] = new
        affected = {(r["item_a"], r["item_b"]): r["k"] for r in state.update(made).collect()}
        if step == 0:
            assert affected
        k, n = Counter(), Counter()
        for _, items in last.values():
            n.update(items)
            k.update(itertools.combinations(items, 2))
        got = {(r["item_a"], r["item_b"]): (r["k"], r["n_a"], r["n_b"], r["n_all"]) for r in state.scores().collect()}
        assert got == {p: (c, n[p[0]], n[p[1]], len(last)) for p, c in k.items()}
        assert {p for p in got if before.get(p, (0, 0, 0))[:3] != got[p][:3]} <= set(affected)
        before = got
        if step != 1:
            state.refresh()
        state = cooccurrence.PairTable(spark, state.path)


def test_small_batch_rewrites_its_buckets_only(spark):
    """A batch of one basket leaves the other buckets' versions; the state before the last is removed, the last one can still be read."""
    rows = [("f", f"b{i}", None, [f"i{i % 40}", f"i{i % 40 + 1}"]) for i in range(400)]
    kinds = "field_name string, basket string, version timestamp, items array<string>"
    state = cooccurrence.PairTable(spark, buckets=16)
    state.update(spark.createDataFrame(rows, kinds))
    state.refresh()
    before = {name: dict(of) for name, of in state.manifest.items()}
    reader = cooccurrence.PairTable(spark, state.path)
    affected = {(r["item_a"], r["item_b"]) for r in state.update(spark.createDataFrame([("f", "new", None, ["i1", "i2"])], kinds)).collect()}
    assert affected == {("i0", "i1"), ("i1", "i2"), ("i2", "i3")} and state.scores().where("item_a = 'i1' and item_b = 'i2'").first()["k"] == 11
    state.refresh()
    changed = {name: {b for b in of | before[name] if of.get(b) != before[name].get(b)} for name, of in state.manifest.items()}
    assert len(changed["baskets"]) == len(changed["pairs"]) == 1 and len(changed["items"]) <= 2 and len(changed["scores"]) <= 3 and len(before["baskets"]) == 16
    assert reader.scores().where("item_a = 'i1' and item_b = 'i2'").first()["k"] == 10 and reader.totals == {"f": 400}
    assert cooccurrence.PairTable(spark, state.path).scores().where("item_a = 'i1' and item_b = 'i2'").first()["k"] == 11
    state.update(spark.createDataFrame([("f", "new", None, [])], kinds))
    assert state._manifests() == [4, 5]
    again = cooccurrence.PairTable(spark, state.path)
    assert sum(r["k"] for r in again.scores().collect()) == 400 and again.totals == {"f": 401} == state.totals


def test_radius_passes_similar_pairs():
    assert 0 < near_duplicates.radius(0.9) < near_duplicates.radius(0.6) < shingles.HASHES * 4 * 1.571 and math.isfinite(near_duplicates.radius(1.0))
