"""Problem 4: the subjects that each document is about, and the make-up of the collection.

Complement naive Bayes over hashed words. The first counts come from documents: each word of a labelled document counts for its subjects,
in shares. Labels are the correct subjects of the few documents that have them, else those of ``iptc`` and, with less weight, ``pred``, which may be
missing or wrong. Expectation-maximization then goes on with sentences, as a sentence is about one subject: the E-step gives each
sentence a posterior over the subjects and none, with the document's labels as a weak prior and uniform where there are none; the M-step counts words by
posterior. All documents take part in each round, labelled or not.

All words of a sentence are summed, but words that speak for no subject by ``FAINT`` or more weigh nothing: so long sentences of words that mean little don't add up to much, and
those said in many documents don't draw themselves into one subject with each round.

Posteriors are calibrated for each subject on its own, whatever the others have: a logistic curve of the evidence for the subject, fitted on sentences with any of documents with correct subjects (and,
with less weight, with labels) by whether the subject is among them. A sentence is about each subject whose
calibrated posterior is at least ``SURE``, so it may be about two or none. A document has each subject that a quarter of its sentences with a subject are about.

Words are hashed into ``FEATURES`` slots, so the model that is broadcast and the counts that come back are bounded (12 subjects: 12 MB), whatever
the vocabulary. Each round is a pass over the documents with counts in local arrays, then a sum by slot.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.taxonomy import subjects_of_labels
from tidewire.llm.words import WordHasher, chunks, words
from tidewire.sources.tables import latest, table
from tidewire.storage import cut

#: Slots of hashed words; rounds of expectation-maximization; smoothing of counts.
FEATURES, ROUNDS, SMOOTHING = 1 << 17, 5, 2.0
#: Weight of a word for its best subject below which it weighs nothing; evidence beyond which a posterior rises no more.
FAINT, FULL = 0.5, 12.0
#: Weight of correct subjects, of iptc and of pred in the first counts; weight of no label in a sentence's prior.
GOLD, GIVEN, GUESSED, ANY = 8.0, 1.0, 0.7, 0.15
#: Calibrated posterior from which a sentence has a subject; documents have those of one in so many of such sentences.
SURE, PART = 0.5, 4
#: Calibration sentences that the driver takes at most (a bounded sample of labelled rows, by hash).
CALIBRATION = 50_000
CHUNK = 1_000_000

#: Short forms whose full stop ends no sentence.
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "No", "vs")
_OPEN = "".join(rf"(?<!\b{t}\.)" for t in _TITLES)
# the common signs are asked for first: most places fail there, before the short forms are tried
_END = re.compile(r"(?<=[.!?…])" + _OPEN + r"[\"'”’»)\]]*\s+|(?<=[a-z][.!?])" + _OPEN + r"[\"”]*(?=[A-Z“])|\s*[\r\n]+\s*|</?\w+[^<>]{0,40}>")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, its character entities replaced; markup and line ends separate them too."""
    return [s for s in _END.split(html.unescape(text or "")) if s.strip()]


def _split(rows: DataFrame, place: dict[str, int], mapping: dict[str, list[str]]) -> DataFrame:
    """(id, slots array<int>, sizes array<int>, prior array<float>, gold boolean): hashed words of all sentences, words of each, and the documents' labels in shares."""
    above = {label: [place[s] for s in subjects if s in place] for label, subjects in mapping.items()}
    space = re.compile(r"\s+")

    def shares(gold: list | None, iptc: list | None, pred: list | None) -> list[float]:
        weight = np.zeros(len(place))
        known = {place[s] for s in gold or () if s in place}
        if known:
            weight[list(known)] = GOLD
        else:
            for labels, w in ((iptc, GIVEN), (pred, GUESSED)):
                for s in {s for x in labels or () if x for s in above.get(space.sub(" ", x.strip().lower()), ())}:
                    weight[s] += w
        return weight.tolist()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            body = batch.column(1).to_pylist()
            for part in chunks(np.array([len(b or "") for b in body], np.int64), CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                split = [[w for s in sentences(b) if (w := words(s))] for b in body[part]]
                flat = [w for s in split for w in s]
                slots = (hasher(flat) % np.uint64(FEATURES)).astype(np.int32)
                size = np.fromiter(map(len, flat), np.int32, len(flat))
                count = np.fromiter(map(len, split), np.int64, len(split))
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
                gold, iptc, pred = (rows.column(i).to_pylist() for i in (2, 3, 4))
                prior = [shares(*x) for x in zip(gold, iptc, pred, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slots)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(size)),
                        pa.array(prior, pa.list_(pa.float32())),
                        pa.array([bool(g) for g in gold]),
                    ],
                    ["id", "slots", "sizes", "prior", "gold"],
                )

    return rows.select("id", "body", "gold", "iptc", "pred").mapInArrow(go, "id string, slots array<int>, sizes array<int>, prior array<float>, gold boolean")


class Batch:
    """The sentences of some documents: slots of all words, the sentence of each word, the document of each sentence."""

    def __init__(self, rows: pa.RecordBatch, n: int) -> None:
        slots, sizes = rows.column(1), rows.column(2)
        self.slots = slots.flatten().to_numpy().astype(np.int64)
        self.sizes = sizes.flatten().to_numpy().astype(np.int64)
        count = np.diff(sizes.offsets.to_numpy())
        self.doc = np.repeat(np.arange(rows.num_rows), count)
        self.word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.prior = rows.column(3).flatten().to_numpy().reshape(-1, n).astype(np.float64)
        self.gold = rows.column(4).to_numpy(zero_copy_only=False)

    def scores(self, model: np.ndarray) -> np.ndarray:
        """Sum of the weights of each sentence's words, by subject."""
        if not len(self.sizes):
            return np.zeros((0, model.shape[1]))
        return np.add.reduceat(model[self.slots], np.cumsum(self.sizes) - self.sizes, axis=0, dtype=np.float64)


def posterior(scores: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Over the subjects and, last, none. prior: the labels' weights of the sentence's document."""
    weight = prior + ANY
    weight = np.concatenate([weight / weight.sum(1, keepdims=True), np.full((len(scores), 1), 1.0)], axis=1)
    s = np.concatenate([scores, np.zeros((len(scores), 1))], axis=1)
    p = weight * np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def calibrated(scores: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Posterior of each subject for each sentence, on its own; 0 without evidence. curve: slope and offset by subject."""
    return np.where(scores > 0, 1 / (1 + np.exp(-(curve[:, 0] * np.minimum(scores, FULL) + curve[:, 1]))), 0.0)


def weights(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: how much less likely a word is in the other subjects than the subjects' mean says. counts: slots by subjects."""
    rest = counts.sum(1, keepdims=True) - counts
    seen = max(1, int((counts.sum(1) > 0).sum()))
    log = np.log(rest + SMOOTHING) - np.log(rest.sum(0, keepdims=True) + SMOOTHING * seen)
    out = (log.mean(1, keepdims=True) - log).astype(np.float32)
    out[out.max(1) < FAINT] = 0
    return out


def _count(docs: DataFrame, n: int, model: np.ndarray | None) -> np.ndarray:
    """Words by subject: of documents by their labels (no model), else of sentences by posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, np.zeros((FEATURES, n))
        for rows in batches:
            b = Batch(rows, n)
            if model is None:
                total = b.prior.sum(1, keepdims=True)
                strength = np.where(b.gold, GOLD, 1.0)[:, None]
                p = np.where(total > 0, b.prior / np.maximum(total, 1e-9) * strength, 0)[b.doc]
            else:
                p = posterior(b.scores(model), b.prior[b.doc])[:, :n]
            for c in range(n):
                counts[:, c] += np.bincount(b.slots, p[b.word, c], FEATURES)
        on = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *[pa.array(counts[on, c]) for c in range(n)]], ["slot", *[f"c{c}" for c in range(n)]])

    sums = docs.mapInArrow(go, "slot int, " + ", ".join(f"c{c} double" for c in range(n)))
    rows = sums.groupBy("slot").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(n)]).toPandas()  # at most FEATURES rows
    out = np.zeros((FEATURES, n))
    out[rows["slot"].to_numpy()] = rows.drop(columns="slot").to_numpy()
    return out


def fit_curve(x: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve of evidence x; towards (1, -3) where there is little to fit."""
    x, out, centre = np.stack([np.minimum(x, FULL), np.ones(len(x))], 1), np.array([1.0, -3.0]), np.array([1.0, -3.0])
    for _ in range(25):  # a Gaussian prior of deviation 0.5 and 1 around the usual curve
        p = 1 / (1 + np.exp(-x @ out))
        gradient = x.T @ (weight * (right - p)) - (out - centre) / [0.25, 1.0]
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([4.0, 1.0]), gradient)
        out += step / max(1.0, np.abs(step).max() / 0.5)
    return np.array([max(out[0], 0.05), out[1]])


def _calibrate(docs: DataFrame, n: int, model: np.ndarray) -> np.ndarray:
    """Slope and offset of each subject's logistic curve of its evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            b = Batch(rows, n)
            scores = b.scores(shared.value)
            at, subject = np.nonzero(scores > 0)
            right, weight = b.prior[b.doc[at], subject] > 0, np.where(b.gold[b.doc[at]], 1.0, 0.1)
            yield pa.RecordBatch.from_arrays([pa.array(subject.astype(np.int32)), pa.array(scores[at, subject]), pa.array(right), pa.array(weight)], ["subject", "evidence", "is_right", "weight"])

    some = docs.where("size(sizes) > 0 and exists(prior, x -> x > 0)").orderBy(F.desc("gold"), F.xxhash64("id"), "id").limit(CALIBRATION // 8)
    rows = some.mapInArrow(go, "subject int, evidence double, is_right boolean, weight double").toPandas()
    own = [rows[rows["subject"] == c] for c in range(n)]
    return np.stack([fit_curve(x["evidence"].to_numpy(float), x["is_right"].to_numpy(float), x["weight"].to_numpy(float)) for x in own])


def classify(documents: DataFrame, topics: DataFrame, edges: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, subject, n_sentences, n_subject, share, posterior), a row for each document and each subject that some sentence of it is about.

    documents: article rows with body, iptc and pred; an id's latest row counts. labels: (id, subject), correct and complete where present. share: of the
    sentences with a subject; posterior: the greatest calibrated posterior of a sentence. Documents with null or blank bodies, or without a sentence that has a
    subject, have no rows; so have rows with a null id. Labels that no topic bears count for nothing. Texts are read whole.
    """
    mapping = subjects_of_labels(topics, edges)
    names = sorted({s for v in mapping.values() for s in v})
    if not names:
        return documents.sparkSession.createDataFrame([], "id string, subject string, n_sentences long, n_subject long, share double, posterior double")
    place, n = {s: i for i, s in enumerate(names)}, len(names)
    gold = labels.where("id is not null").groupBy("id").agg(F.collect_set("subject").alias("gold"))
    rows = latest(documents, "body", "iptc", "pred").where("trim(body) <> ''").join(gold, "id", "left")
    docs = cut(_split(rows, place, mapping), "p4-sentences")
    model = weights(_count(docs, n, None))
    for _ in range(rounds):
        model = weights(_count(docs, n, model))
    shared = documents.sparkSession.sparkContext.broadcast((model, _calibrate(docs, n, model)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve = shared.value
        for rows in batches:
            b = Batch(rows, n)
            p = calibrated(b.scores(model), curve)
            sentence, subject = np.nonzero(p >= SURE)
            some = np.zeros(len(p), bool)
            some[sentence] = True
            key = b.doc[sentence] * n + subject
            cell, at = np.unique(key, return_inverse=True)
            count, most = np.bincount(at, minlength=len(cell)), np.zeros(len(cell))
            np.maximum.at(most, at, p[sentence, subject])
            total = np.bincount(b.doc[some], minlength=rows.num_rows)[cell // n]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(cell // n)), pa.array([names[i] for i in cell % n], pa.string()), pa.array(total.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(count / np.maximum(total, 1)), pa.array(most)],
                ["id", "subject", "n_sentences", "n_subject", "share", "posterior"],
            )

    return docs.mapInArrow(go, "id string, subject string, n_sentences long, n_subject long, share double, posterior double")


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    found = classify(*(table(spark, folder, name) for name in ("articles", "topics", "topic_edges", "subject_labels")))
    return found.where(F.col("n_subject") * PART >= F.col("n_sentences"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of each article."""
    return _classified(spark, folder).select("id", "subject")


def p4_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """The collection by subject: its articles, and its part of all sentences with a subject."""
    found = classify(*(table(spark, folder, name) for name in ("articles", "topics", "topic_edges", "subject_labels")))
    sums = found.groupBy("subject").agg(F.count_if(F.col("n_subject") * PART >= F.col("n_sentences")).alias("articles"), F.sum("n_subject").alias("sentences"))
    return sums.withColumn("share", F.col("sentences") / F.sum("sentences").over(Window.partitionBy()))
