"""One model per label: naive Bayes as plain counts, and the models of pyspark.ml."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, NaiveBayes, NaiveBayesModel
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import perceptron


class Bayes(NamedTuple):
    """Multinomial naive Bayes of all categories in sparse form: only terms that a category's documents hold have cells."""

    categories: DataFrame  # category, base: log prior of is less that of isn't, prior_yes, prior_no
    terms: DataFrame  # term, w_all: its sum over all documents
    cells: DataFrame  # category, term, w_yes: its sum over the category's documents
    sums: DataFrame  # category, log_yes, log_no: logarithms of the smoothed sums over all terms
    smoothing: float


def nb_fit(weighted: DataFrame, labels: DataFrame, categories: list[str], smoothing: float = 1.0) -> Bayes:
    """Multinomial naive Bayes for every category at once.

    weighted: (id, term, w), w not negative; labels: (id, label). A document without terms takes no part. One pass of sums for all categories: those of
    the documents with the category are counted, those without it are the difference to all documents.
    """
    spark = weighted.sparkSession
    cats = spark.createDataFrame([(c,) for c in categories], "category string")
    rows = weighted.groupBy("id", "term").agg(F.sum("w").alias("w"))
    docs = rows.select("id").distinct()
    held = labels.select("id", F.col("label").alias("category")).distinct().join(F.broadcast(cats), "category", "left_semi")
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    yes = held.join(docs, "id", "left_semi").groupBy("category").agg(F.count("*").alias("n_yes"))
    prior = cats.join(yes, "category", "left").join(F.broadcast(n_docs)).withColumn("n_yes", F.coalesce("n_yes", F.lit(0)))
    log = lambda n: F.log(n + smoothing) - F.log(F.col("n_docs") + 2 * smoothing)
    prior = prior.select("category", log(F.col("n_yes")).alias("prior_yes"), log(F.col("n_docs") - F.col("n_yes")).alias("prior_no"))
    terms = rows.groupBy("term").agg(F.sum("w").alias("w_all"))
    cells = rows.join(held, "id").groupBy("category", "term").agg(F.sum("w").alias("w_yes"))
    whole = terms.agg(F.coalesce(F.sum("w_all"), F.lit(0.0)).alias("whole"), F.count("*").alias("n_terms"))
    sums = cats.join(cells.groupBy("category").agg(F.sum("w_yes").alias("s")), "category", "left").join(F.broadcast(whole)).withColumn("s", F.coalesce("s", F.lit(0.0)))
    size = smoothing * F.col("n_terms")
    sums = sums.select("category", F.log(F.col("s") + size).alias("log_yes"), F.log(F.greatest(F.col("whole") - F.col("s"), F.lit(0.0)) + size).alias("log_no"))
    return Bayes(prior.withColumn("base", F.col("prior_yes") - F.col("prior_no")), terms, cells, sums, smoothing)


def nb_counts(weighted: DataFrame, labels: DataFrame, categories: list[str], smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The model of ``nb_fit`` written out: (category, is, prior) and (category, is, term, weight), a row for each category and term, seen together or not. To predict, use ``nb_margins``."""
    model = nb_fit(weighted, labels, categories, smoothing)
    both = lambda yes, no, name: F.explode(F.array(F.struct(F.lit(1).alias("is"), yes.alias(name)), F.struct(F.lit(0).alias("is"), no.alias(name)))).alias("x")
    prior = model.categories.select("category", both(F.col("prior_yes"), F.col("prior_no"), "prior")).select("category", "x.*")
    grid = model.terms.join(F.broadcast(model.sums)).join(model.cells, ["category", "term"], "left").withColumn("w_yes", F.coalesce("w_yes", F.lit(0.0)))
    yes = F.log(F.col("w_yes") + smoothing) - F.col("log_yes")
    no = F.log(F.greatest(F.col("w_all") - F.col("w_yes"), F.lit(0.0)) + smoothing) - F.col("log_no")
    weights = grid.select("category", "term", both(yes, no, "weight")).select("category", "x.is", "term", "x.weight")
    return prior, weights


def nb_margins(weighted: DataFrame, model: Bayes) -> DataFrame:
    """(id, category, margin) for each document with known terms: how much better is than isn't; the category is predicted if it is above 0. Terms unknown to the model don't count.

    What a term says of a category that it wasn't seen with is the same for all of those but for a constant, so tokens meet only the categories they were seen with.
    """
    s = F.lit(model.smoothing)
    known = weighted.groupBy("id", "term").agg(F.sum("w").alias("w")).join(model.terms, "term")
    unseen = F.log(s) - F.log(F.col("w_all") + s)
    common = known.groupBy("id").agg(F.sum(F.col("w") * unseen).alias("common"), F.sum("w").alias("total"))
    per = F.broadcast(model.categories.join(model.sums, "category").select("category", "base", (F.col("log_no") - F.col("log_yes")).alias("constant")))  # a row for each category
    every = common.join(per).select("id", "category", (F.col("common") + F.col("total") * F.col("constant") + F.col("base")).alias("margin"))
    rest = F.greatest(F.col("w_all") - F.col("w_yes"), F.lit(0.0))
    gain = F.log(F.col("w_yes") + s) - F.log(rest + s) - unseen
    seen = known.join(model.cells, "term").select("id", "category", (F.col("w") * gain).alias("margin"))
    return every.unionByName(seen).groupBy("id", "category").agg(F.sum("margin").alias("margin"))


def nb_predict(weighted: DataFrame, prior: DataFrame, weights: DataFrame) -> DataFrame:
    """The margins by a model that is written out, as ``nb_counts`` gives it and as it is stored."""
    gain = weights.groupBy("category", "term").agg(F.sum(F.when(F.col("is") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias("gain"))
    base = prior.groupBy("category").agg(F.sum(F.when(F.col("is") == 1, F.col("prior")).otherwise(-F.col("prior"))).alias("base"))
    rows = weighted.groupBy("id", "term").agg(F.sum("w").alias("w")).join(gain, "term")
    return rows.groupBy("id", "category").agg(F.sum(F.col("w") * F.col("gain")).alias("sum")).join(F.broadcast(base), "category").select("id", "category", (F.col("sum") + F.col("base")).alias("margin"))


def features(rows: DataFrame, column: str) -> DataFrame:
    """rows with a vector column ``features`` of an array of numbers."""
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


class Perceptron(NamedTuple):
    """A multilayer perceptron as ``feed_forward.all`` fits it; ``spark`` gives it as a model of Spark's own, which goes through it row by row."""

    layers: list[int]
    weights: np.ndarray  # of each layer in Spark's order

    def spark(self, session: SparkSession) -> MultilayerPerceptronClassificationModel:
        context = session.sparkContext
        made = context._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(f"mlpc-{uuid.uuid4().hex[:12]}", _py2java(context, Vectors.dense(self.weights)))
        model = MultilayerPerceptronClassificationModel(made)
        model._set(layers=self.layers)
        model._transfer_params_to_java()
        return model


def each_category(rows: DataFrame, labels: str, categories: list[str], fit, parallelism: int = 1) -> dict[str, Model | Perceptron]:
    """A model for each category, fitted on rows with label 1 if the category is among the labels. parallelism: models fitted at a time. A family that can fit all categories in one pass does, unless the rows are too many for it."""
    held = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    if hasattr(fit, "all") and (made := fit.all(rows.withColumn("_held", held), categories)) is not None:
        return made

    def one(category: str) -> Model:
        return fit(rows.withColumn("label", F.array_contains(held, category).cast("double")))

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return dict(zip(categories, pool.map(one, categories), strict=True))


def predicted(rows: DataFrame, models: dict[str, Model | Perceptron], key: str = "id") -> DataFrame:
    """(key, pred): the sorted categories whose model says yes."""
    if models and all(isinstance(m, Perceptron) for m in models.values()):
        return perceptron.predict(rows.select(key, vector_to_array("features").alias("numbers")), {c: (m.layers, m.weights) for c, m in models.items()}, key)
    out = rows
    for i, model in enumerate(models.values()):
        out = model.transform(out.drop("rawPrediction", "probability", "prediction")).withColumn(f"_p{i}", F.col("prediction"))
    said = F.array(*[F.when(F.col(f"_p{i}") >= 1.0, F.lit(c)) for i, c in enumerate(models)])
    return out.select(key, F.array_sort(F.array_compact(said)).alias("pred"))


class naive_bayes:  # noqa: N801 - a family, as the functions below
    """Fits a multinomial naive Bayes: of one label, or of all categories by one sum over the rows."""

    def __init__(self, smoothing: float = 1.0) -> None:
        self.smoothing = smoothing

    def __call__(self, rows: DataFrame) -> Model:
        return NaiveBayes(smoothing=self.smoothing, modelType="multinomial").fit(rows)

    def all(self, rows: DataFrame, categories: list[str]) -> dict[str, Model]:
        """Models of rows (features, _held) by category. Sums of features by category and over all rows, as many vectors as categories; Spark's own model class holds them."""
        marks = F.concat(F.array(F.lit(None).cast("string")), F.array_intersect("_held", F.array(*[F.lit(c) for c in categories])))
        each = rows.select("features", F.explode(marks).alias("_c")).groupBy("_c").agg(F.count("*").alias("n"), Summarizer.sum(F.col("features")).alias("sum"))
        got = {r["_c"]: (r["n"], r["sum"].toArray()) for r in each.collect()}
        if None not in got:
            raise ValueError("there are no rows to fit")
        (n, whole), s = got[None], self.smoothing
        jvm = rows.sparkSession._jvm
        models = {}
        for c in categories:
            n_yes, yes = got.get(c, (0, np.zeros(len(whole))))
            counts, sums = np.array([n - n_yes, n_yes], float), np.stack([whole - yes, yes])
            present = counts > 0  # Spark's model has only the labels that rows have, up to the greatest
            keep = 2 if present[1] else 1
            pi = np.log(counts[:keep] + s) - np.log(n + keep * s)
            theta = np.log(sums[:keep] + s) - np.log(sums[:keep].sum(1, keepdims=True) + s * len(whole))
            made = jvm.org.apache.spark.ml.classification.NaiveBayesModel(f"nb-{uuid.uuid4().hex[:12]}", _py2java(rows.sparkSession.sparkContext, Vectors.dense(pi)), _py2java(rows.sparkSession.sparkContext, Matrices.dense(*theta.shape, theta.flatten("F").tolist())), _py2java(rows.sparkSession.sparkContext, Matrices.dense(0, 0, [])))
            models[c] = NaiveBayesModel(made)
        return models


class feed_forward:  # noqa: N801
    """Fits a feed-forward net with sigmoid layers by L-BFGS: Spark's own of one label, or the same of all categories at a time; tidewire.operators.neural has tanh layers and RMSProp. kind: the precision of the latter's passes over the rows."""

    def __init__(self, size: int, hidden: tuple[int, ...] = (700, 500), seed: int = 123, rounds: int = 50, kind: type = np.float32) -> None:
        self.layers, self.seed, self.rounds, self.kind = [size, *hidden, 2], seed, rounds, kind

    def __call__(self, rows: DataFrame) -> Model:
        return MultilayerPerceptronClassifier(layers=self.layers, seed=self.seed, maxIter=self.rounds).fit(rows)

    def all(self, rows: DataFrame, categories: list[str]) -> dict[str, Perceptron] | None:
        """Nets of rows (features, _held) by category, each trained by a task with all rows; none if they are too many for that."""
        n, context = rows.count(), rows.sparkSession.sparkContext
        if not n:
            raise ValueError("there are no rows to fit")
        if n * self.layers[0] > perceptron.MOST or not categories:
            return None
        layers = context._gateway.new_array(context._jvm.int, len(self.layers))
        for i, k in enumerate(self.layers):
            layers[i] = k
        first = _java2py(context, context._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(layers, True).model(self.seed).weights())
        marks = F.array(*[F.array_contains("_held", c).cast("int") for c in categories])
        fitted = perceptron.fit(rows.select(vector_to_array("features").alias("numbers"), marks.alias("marks")), self.layers, first.toArray(), len(categories), self.rounds, self.kind)
        return {c: Perceptron(self.layers, weights) for c, weights in zip(categories, fitted, strict=True)}


def support_vectors(rounds: int = 100):
    """Fits a linear support vector machine; rawPrediction holds its scores."""
    return LinearSVC(maxIter=rounds).fit


def hashing_tf(rows: DataFrame, words: str, size: int = 1 << 20) -> DataFrame:
    """rows with hashed word counts in ``tf``."""
    return HashingTF(inputCol=words, outputCol="tf", numFeatures=size).transform(rows)


def inverse_frequencies(rows: DataFrame, column: str = "tf", least: int = 1) -> DataFrame:
    """rows with weights by inverse document frequency in ``idf``; Spark's smoothed form."""
    return IDF(inputCol=column, outputCol="idf", minDocFreq=least).fit(rows).transform(rows)


def word_vectors(rows: DataFrame, words: str, size: int = 50, seed: int = 123, least: int = 5, partitions: int = 1):
    """A Word2Vec model; ``findSynonyms(word, n)`` gives the nearest words by cosine."""
    return Word2Vec(inputCol=words, outputCol="w2v", vectorSize=size, seed=seed, minCount=least, numPartitions=partitions).fit(rows)


def standardised(rows: DataFrame, column: str = "features") -> DataFrame:
    """rows with components of mean 0 and deviation 1 in ``scaled``."""
    return StandardScaler(inputCol=column, outputCol="scaled", withMean=True, withStd=True).fit(rows).transform(rows)


def normalised_by_max(rows: DataFrame, column: str = "features") -> DataFrame:
    """rows with vectors divided by their greatest absolute component in ``scaled``."""
    return Normalizer(inputCol=column, outputCol="scaled", p=float("inf")).transform(rows)


def as_array(rows: DataFrame, column: str) -> DataFrame:
    """rows with a vector column as an array."""
    return rows.withColumn(column, vector_to_array(column))
