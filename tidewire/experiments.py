"""Training and testing of model families on named datasets: what is trained on what, with which settings, and where it is kept.

A family is a net (``ffn``, ``rnn``) or naive Bayes (``nb``) on document vectors (``w2v``) or on bags of annotations (``bow``), a model for each category. Models are kept by tag and family, and a test loads them;
bags keep their vocabulary, so that a test's articles are put into the places and weights of the training.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.operators import metrics, models, neural, splits, terms, vectors
from tidewire.sources import sinks
from tidewire.sources.catalogue import Catalogue, Dataset
from tidewire.sources.tables import normalised
from tidewire.storage import cut

FAMILIES = ("ffn_w2v", "ffn_bow", "nb_w2v", "nb_bow", "rnn_w2v")


@dataclass
class Fitted:
    """Models of a family, with what makes an article's features. models: nets or Spark's models by category, or a list of Bayes models."""

    family: str
    models: dict | list
    vocabulary: DataFrame | None = None
    documents: DataFrame | None = None


@dataclass(frozen=True)
class Experiment:
    """Families trained on a pair of datasets. pair: settings of ``Catalogue.ordered``, or names of datasets; threshold: articles that a term must be in more than; rate: the nets' step."""

    tag: str
    families: tuple[str, ...] = FAMILIES
    pair: dict | tuple[str, str] = field(default_factory=dict)
    rate: float = 0.05
    threshold: int = 100
    super_sample: bool = False
    traditional: bool = False


EXPERIMENTS = {
    "trainBaseline": Experiment("baseline"),
    "trainSuper": Experiment("superSample", super_sample=True),
    "trainTypes": Experiment("types", ("nb_w2v", "nb_bow"), {"types": True}),
    "trainTime": Experiment("time", pair={"time": 10}, rate=0.5, threshold=20),
    "trainConfidence": Experiment("confidence-50", pair=("mini_train", "mini_validation"), rate=0.5, threshold=10),
    "trainFFNW2V": Experiment("", ("ffn_w2v",)),
    "trainFFNBoW": Experiment("", ("ffn_bow",)),
    "trainRNNW2V": Experiment("", ("rnn_w2v",)),
    "trainNaiveW2V": Experiment("", ("nb_w2v",)),
    "trainNaiveBoW": Experiment("", ("nb_bow",)),
    "trainNaiveTraditional": Experiment("traditional", ("nb_bow",), ("train_ordered_full", "validation_ordered_full"), threshold=200, traditional=True),
}
#: Tests: dataset, and tags with their families.
TESTS = {
    "testModels": ("test_ordered", (("baseline", FAMILIES),)),
    "testNaive": ("test_ordered", (("baseline", ("nb_bow", "nb_w2v")), ("types", ("nb_bow", "nb_w2v")))),
    "testPretrained": ("validation_ordered", (("pretrained", ("rnn_w2v",)),)),
    "testW2VvsBoW": ("test_ordered", (("baseline", ("ffn_bow", "nb_bow", "ffn_w2v", "nb_w2v")),)),
    "testSub": ("sub_test_ordered", (("types", ("nb_w2v", "nb_bow")),)),
}
#: Sizes of training sets of the two sweeps.
SIZES = tuple(range(5000, 200_000, 5000))
SIZES2 = (100, 250, 500, 1000, 2000, 3000, 5000, 10_000, 20_000, 50_000, 100_000, 200_000, 500_000)


def catalogue(spark: SparkSession, c: Config) -> Catalogue:
    return Catalogue(spark, c.data, c.limit, c.size, c.seed)


def with_text_terms(dataset: Dataset) -> Dataset:
    """The dataset with the stemmed words of the bodies as its annotations."""
    words = terms.text_terms(dataset.articles, "id", "body", stem=True)
    return Dataset(dataset.articles, words.select(F.col("doc").alias("article_id"), "term", "mc", F.col("offset").alias("ann_offset"), F.col("term").alias("phrase"), F.lit(None).cast("string").alias("fb")))


def features(family: str, dataset: Dataset, vocabulary: DataFrame, documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, iptc, features), a row for each article with any: a document vector, one without negative values for naive Bayes, a sequence of vectors, or the bag's places and weights."""
    weighted = terms.tfidf(dataset.annotations, vocabulary.select("term", "df"), documents, "article_id", "term", all_terms=False)
    if family == "rnn_w2v":
        made = vectors.sequences(dataset.annotations, embeddings).select("article_id", F.col("steps").alias("features"))
    elif family.endswith("w2v"):
        made = vectors.document_vectors(weighted, embeddings, family == "nb_w2v").select("article_id", F.col("vector").alias("features"))
    else:
        made = vectors.bag_of_words(weighted, vocabulary.select("term", "idx")).select("article_id", F.struct("indices", "weights").alias("features"))
    labels = dataset.articles.select("id", F.transform("iptc", normalised).alias("iptc"))
    return made.withColumnRenamed("article_id", "id").join(labels, "id")


def vocabulary_of(dataset: Dataset, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(term, df, idx) and the number of documents; both written, as places must not change."""
    vocabulary, documents = terms.fit_tfidf(dataset.annotations, "article_id", "term", threshold)
    placed = vectors.vocabulary_index(vocabulary).join(vocabulary, "term")
    return cut(placed.select("term", "df", "idx"), "vocabulary"), cut(documents, "documents")


def _bags(rows: DataFrame) -> DataFrame:
    """(id, term, w) of bags."""
    pairs = rows.select("id", F.explode(F.arrays_zip("features.indices", "features.weights")).alias("x"))
    return pairs.select("id", F.col("x.indices").cast("string").alias("term"), F.col("x.weights").cast("double").alias("w"))


def fit(family: str, rows: DataFrame, names: list[str], c: Config, rate: float, size: int, super_sample: bool = False) -> dict | list:
    """Models of a family on rows (id, iptc, features). size: components of a vector, or places of a bag. super_sample: for each category its articles are drawn again up to the number of the others."""
    if super_sample:
        each = [fit(family, splits.supersampled(rows, "id", F.array_contains("iptc", name)), [name], c, rate, size) for name in names]
        return [m for own in each for m in own] if family == "nb_bow" else {k: v for own in each for k, v in own.items()}
    hidden = tuple(int(n) for n in (c.bow_layers if family == "ffn_bow" else c.layers).split(",") if n)
    if family.startswith("ffn"):
        return neural.fit_each(rows, "iptc", names, lambda: neural.FeedForward((size, *hidden, 2), c.seed), rounds=c.rounds, rate=rate, batch=c.batch)
    if family == "rnn_w2v":
        return neural.fit_each(rows, "iptc", names, lambda: neural.Recurrent(size, c.hidden, c.seed), rounds=c.rounds, rate=rate, batch=c.batch)
    if family == "nb_w2v":
        return models.each_category(models.features(rows.withColumnRenamed("features", "numbers"), "numbers"), "iptc", names, models.naive_bayes(), c.parallelism)
    labels = rows.select("id", F.explode("iptc").alias("label"))
    return [models.nb_fit(cut(_bags(rows), "bags"), labels, names)]


def said(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """(id, pred) of rows (id, features)."""
    if fitted.family == "nb_w2v":
        return models.predicted(models.features(rows.withColumnRenamed("features", "numbers"), "numbers"), fitted.models)
    if fitted.family != "nb_bow":
        return neural.predict(rows, fitted.models)
    bags, out = _bags(rows), None
    for model in fitted.models:
        margins = models.nb_margins(bags, model)
        out = margins if out is None else out.unionByName(margins)
    return out.groupBy("id").agg(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("margin") > 0, F.col("category"))))).alias("pred"))


def train(family: str, dataset: Dataset, names: list[str], c: Config, embeddings: DataFrame, rate: float, threshold: int, super_sample: bool = False) -> Fitted:
    """A family trained on a dataset."""
    vocabulary, documents = vocabulary_of(dataset, threshold)
    rows = cut(features(family, dataset, vocabulary, documents, embeddings), "features")
    size = vocabulary.count() if family == "ffn_bow" else c.size
    return Fitted(family, fit(family, rows, names, c, rate, size, super_sample), vocabulary, documents)


def evaluate(fitted: Fitted, dataset: Dataset, names: list[str], embeddings: DataFrame, tag: str) -> DataFrame:
    """Measures of each label, with the tag and family of the models."""
    rows = cut(features(fitted.family, dataset, fitted.vocabulary, fitted.documents, embeddings), "features")
    pred = said(fitted, rows.select("id", "features"))
    joined = rows.select("id", "iptc").join(pred, "id", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<string>")))
    return metrics.per_label(metrics.confusion(joined, "iptc", "pred", names)).withColumns({"tag": F.lit(tag), "family": F.lit(fitted.family)})


def save(fitted: Fitted, path: str) -> None:
    """Write the models of a family and their vocabulary."""
    spark = fitted.vocabulary.sparkSession
    sinks.save_table(fitted.vocabulary, f"{path}/vocabulary")
    sinks.save_table(fitted.documents, f"{path}/documents")
    if fitted.family == "nb_bow":
        for i, model in enumerate(fitted.models):
            for name in ("categories", "terms", "cells", "sums"):
                sinks.save_table(getattr(model, name).withColumn("smoothing", F.lit(model.smoothing)), f"{path}/bayes/{i}/{name}")
    elif fitted.family == "nb_w2v":
        sinks.save_models(fitted.models, f"{path}/models")
    else:
        sinks.save_nets(spark, fitted.models, f"{path}/nets")
    sinks.save_table(spark.createDataFrame([(label, i) for i, label in enumerate(fitted.models if isinstance(fitted.models, dict) else map(str, range(len(fitted.models))))], "label string, number int"), f"{path}/labels")


def load(spark: SparkSession, family: str, path: str, label: str | None = None) -> Fitted:
    """The models of a family as they were saved, or that of one label; none there is an error."""
    try:
        labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("number").collect()]
    except Exception as e:
        raise FileNotFoundError(f"no models of {family} in {path}; a training job with the same out keeps them there") from e
    if label is not None and family != "nb_bow":
        labels = [x for x in labels if x == label]
        if not labels:
            raise KeyError(f"no model of {label} in {path}")
    vocabulary, documents = (spark.read.parquet(f"{path}/{name}") for name in ("vocabulary", "documents"))
    if family == "nb_bow":
        made = []
        for i in labels:
            own = [spark.read.parquet(f"{path}/bayes/{i}/{name}") for name in ("categories", "terms", "cells", "sums")]
            smoothing = own[0].first()["smoothing"]
            own = [x.drop("smoothing") for x in own]
            if label is not None:
                own = [x.where(F.col("category") == label) if "category" in x.columns else x for x in own]
            made.append(models.Bayes(*own, smoothing))
    elif family == "nb_w2v":
        made = {x: sinks.load_model(models.NaiveBayesModel, f"{path}/models", x) for x in labels}
    else:
        made = sinks.load_nets(spark, f"{path}/nets", labels)
    return Fitted(family, made, vocabulary, documents)


def pair_of(spark: SparkSession, c: Config, experiment: Experiment) -> tuple[Dataset, Dataset]:
    """Train and validation of an experiment; one without a pair of its own takes types and confidence from the settings."""
    sets = catalogue(spark, c)
    if isinstance(experiment.pair, tuple):
        pair = tuple(sets.by(name) for name in experiment.pair)
    else:
        pair = sets.ordered(**(experiment.pair or {"types": c.types, "confidence": c.confidence}))
    return tuple(map(with_text_terms, pair)) if experiment.traditional else pair


def tag_of(c: Config, experiment: Experiment) -> str:
    return experiment.tag or c.tag or "baseline"


def model_path(c: Config, tag: str, family: str) -> str:
    return c.path("models", tag, family)


def run_experiment(spark: SparkSession, c: Config, experiment: Experiment, names: list[str]) -> DataFrame:
    """Measures of all families of an experiment; with ``out`` set their models are kept."""
    pair = pair_of(spark, c, experiment)
    # annotations are put together from several tables: once, not for each family
    train_set, validation = (Dataset(cut(s.articles, "articles"), cut(s.annotations, "annotations")) for s in pair)
    embeddings = cut(catalogue(spark, c).embeddings(), "embeddings")
    threshold = experiment.threshold if c.threshold < 0 else c.threshold
    out = None
    for family in experiment.families:
        fitted = train(family, train_set, names, c, embeddings, c.rate or experiment.rate, threshold, experiment.super_sample or c.super_sample)
        if c.out:
            save(fitted, model_path(c, tag_of(c, experiment), family))
        made = evaluate(fitted, validation, names, embeddings, tag_of(c, experiment))
        out = made if out is None else out.unionByName(made)
    return out


def run_test(spark: SparkSession, c: Config, dataset: str, tags: tuple, names: list[str]) -> DataFrame:
    """Measures of kept models on a dataset."""
    sets = catalogue(spark, c)
    made, embeddings, out = sets.by(dataset), cut(sets.embeddings(), "embeddings"), None
    typed = Dataset(made.articles, sets.annotations(types=True)).part(made.articles)
    for tag, families in tags:
        for family in families:
            own = evaluate(load(spark, family, model_path(c, tag, family)), typed if tag == "types" else made, names, embeddings, tag)
            out = own if out is None else out.unionByName(own)
    return out


def run_buckets(spark: SparkSession, c: Config, tag: str, rows: DataFrame, criterion) -> DataFrame:
    """Measures of the kept recurrent nets of a tag by bucket of rows (articles with bucket), with the bucket's borders by a criterion."""
    sets = catalogue(spark, c)
    notes = Dataset(rows, sets.annotations()).part(rows).annotations
    fitted = load(spark, "rnn_w2v", model_path(c, tag, "rnn_w2v"))
    made = features("rnn_w2v", Dataset(rows, notes), fitted.vocabulary, fitted.documents, sets.embeddings())
    pred = said(fitted, cut(made, "features").select("id", "features"))
    joined = rows.drop("pred").join(pred, "id").withColumn("iptc", F.transform("iptc", normalised))
    return metrics.by_bucket(joined, "bucket", "iptc", "pred", criterion)


def run_sizes(spark: SparkSession, c: Config, family: str, sizes: tuple[int, ...], names: list[str], rate: float = 0.05, threshold: int = 100) -> DataFrame:
    """Micro averages of a family trained on the first articles of the train set, for each size up to the first that holds all of them."""
    train_set, validation = catalogue(spark, c).ordered(c.types, c.confidence)
    train_set, validation = (Dataset(cut(s.articles, "articles"), cut(s.annotations, "annotations")) for s in (train_set, validation))
    embeddings, total, out = cut(catalogue(spark, c).embeddings(), "embeddings"), train_set.articles.count(), None
    placed = cut(splits.with_index(train_set.articles, "id"), "placed")
    for size in sizes:
        part = train_set.part(placed.where(F.col("idx") < size).drop("idx"))
        fitted = train(family, part, names, c, embeddings, c.rate or rate, threshold if c.threshold < 0 else c.threshold, c.super_sample)
        rows = cut(features(family, validation, fitted.vocabulary, fitted.documents, embeddings), "features")
        counts = metrics.confusion(rows.select("id", "iptc").join(said(fitted, rows.select("id", "features")), "id"), "iptc", "pred", names)
        own = cut(metrics.micro_average(counts).withColumn("size", F.lit(size)), "measures")
        out = own if out is None else out.unionByName(own)
        if size >= total:
            break
    return out
