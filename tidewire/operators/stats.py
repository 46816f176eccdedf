"""Descriptive statistics of articles, annotations and labels. All are aggregates with partial sums before the shuffle; joins are by article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.sources.tables import normalised


def labels_of(articles: DataFrame, labels: str = "iptc") -> DataFrame:
    """(id, label): each article's labels, normalised, each once; blank and null ones don't count."""
    rows = articles.select("id", F.explode(F.array_distinct(F.transform(labels, normalised))).alias("label"))
    return rows.where("label <> ''")


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n), null keys left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """max, min, mean, population deviation and variance, and count of a value; nulls don't count."""
    v = value.cast("double")
    return rows.groupBy(*by).agg(F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.var_pop(v).alias("variance"), F.count(v).alias("n"))


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    """(value, n) of each value that occurs."""
    return rows.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def annotation_sizes(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """articles with n_ann, the number of their annotations; articles without any have 0. annotations: one row for each article and term."""
    n = annotations.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n_ann"))
    return articles.join(n, "id", "left").withColumn("n_ann", F.coalesce("n_ann", F.lit(0)).cast("long"))


def annotations_per_label(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """(label, articles, annotations, per_article): sums over the articles that have the label."""
    rows = labels_of(articles).join(annotation_sizes(articles.select("id"), annotations), "id")
    return rows.groupBy("label").agg(F.count("*").alias("articles"), F.sum("n_ann").alias("annotations")).withColumn("per_article", F.col("annotations") / F.col("articles"))


def label_diversity(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """(label, distinct_terms, annotations, diversity): different terms over all annotations of the label's articles."""
    rows = labels_of(articles).join(annotations.select(F.col("article_id").alias("id"), "term"), "id")
    return rows.groupBy("label").agg(F.count_distinct("term").alias("distinct_terms"), F.count("*").alias("annotations")).withColumn("diversity", F.col("distinct_terms") / F.col("annotations"))


def general(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: articles, those without labels, those without annotations, annotations and different terms."""
    sized = annotation_sizes(articles, annotations)
    one = sized.agg(F.count("*").alias("articles"), F.count_if(F.size(F.coalesce("iptc", F.array().cast("array<string>"))) == 0).alias("without_labels"), F.count_if(F.col("n_ann") == 0).alias("without_annotations"))
    two = annotations.agg(F.count("*").alias("annotations"), F.count_distinct("term").alias("distinct_terms"))
    return one.join(F.broadcast(two))


def border_stats(rows: DataFrame, bucket: str, criterion: Column) -> DataFrame:
    """(bucket, n, least, most) of a criterion."""
    return rows.groupBy(bucket).agg(F.count("*").alias("n"), F.min(criterion).alias("least"), F.max(criterion).alias("most"))


def equal_annotation_sets(annotations: DataFrame, more_than_terms: int = 3, more_than_articles: int = 2) -> DataFrame:
    """(first_id, articles, terms) of groups of more than so many articles with the same set of more than so many terms.

    A set is 128 bits of hash, which sum up its terms in any order, and its size: no article's terms are collected, and a group of a third of all articles is a counter.
    """
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "term").cast("decimal(20,0)")).alias(f"h{seed}")
    sets = annotations.groupBy("article_id").agg(F.count("*").alias("terms"), h(1), h(2)).where(F.col("terms") > more_than_terms)
    groups = sets.groupBy("h1", "h2", "terms").agg(F.min("article_id").alias("first_id"), F.count("*").alias("articles"))
    return groups.where(F.col("articles") > more_than_articles).select("first_id", "articles", "terms")


def common_annotations(articles: DataFrame, weighted: DataFrame, more_than_words: int = 1000, more_than: int = 10) -> DataFrame:
    """(label, term, tf_idf, mentions): the greatest tf-idf of a term in a label's long articles, of terms with more than so many mentions. weighted: (article_id, term, mc, tf_idf)."""
    long_ones = articles.where(F.col("wc") > more_than_words)
    rows = labels_of(long_ones).join(weighted.select(F.col("article_id").alias("id"), "term", "mc", "tf_idf"), "id")
    return rows.groupBy("label", "term").agg(F.max("tf_idf").alias("tf_idf"), F.sum("mc").alias("mentions")).where(F.col("mentions") > more_than)


#: Thresholds of the term frequency sweep: units, tens, hundreds and thousands.
SWEEP = tuple(d * s for s in (1, 10, 100, 1000) for d in range(1 if s > 1 else 0, 10))


def frequency_sweep(annotations: DataFrame, thresholds: tuple[int, ...] = SWEEP) -> DataFrame:
    """(threshold, articles, terms, annotations): what is left when terms in no more than so many articles are taken out. thresholds ascend.

    As a step's terms are a part of the last one's, and a term's frequency doesn't change when others go, the thresholds are one pass: each annotation counts up to the
    greatest threshold its term passes, and sums run from the top.
    """
    df = annotations.groupBy("term").agg(F.count("*").alias("df"))
    last = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t < F.col("df")))
    steps = df.withColumn("last", last)
    terms = steps.groupBy("last").agg(F.count("*").alias("terms"), F.sum("df").alias("annotations"))
    articles = annotations.join(steps.select("term", "last"), "term").groupBy("article_id").agg(F.max("last").alias("last")).groupBy("last").agg(F.count("*").alias("articles"))
    spark = annotations.sparkSession
    named = spark.createDataFrame(list(enumerate(thresholds)), "at int, threshold int")
    counts = terms.join(articles, "last", "full_outer")  # a row for each threshold at most
    rows = named.join(F.broadcast(counts), F.col("last") > F.col("at"), "left")
    zero = F.lit(0).cast("long")
    return rows.groupBy("threshold").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("articles", "terms", "annotations")])


def length_correlation(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row (articles, correlation) of annotations against words, of articles with a known number of words."""
    sized = annotation_sizes(articles.where("wc >= 0"), annotations)
    return sized.agg(F.count("*").alias("articles"), F.corr(F.col("n_ann").cast("double"), F.col("wc").cast("double")).alias("correlation"))


def mention_extremes(annotations: DataFrame) -> DataFrame:
    """(article_id, most, total) of mc."""
    return annotations.groupBy("article_id").agg(F.max("mc").alias("most"), F.sum("mc").alias("total"))


def annotation_distribution(annotations: DataFrame) -> DataFrame:
    """(term, mentions, articles), fewest mentions first."""
    return annotations.groupBy("term").agg(F.sum("mc").alias("mentions"), F.count("*").alias("articles")).orderBy("mentions", "term")


def label_batch(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """Summaries of words and annotations for each label."""
    rows = labels_of(articles).join(annotation_sizes(articles.select("id", "wc"), annotations), "id").where("wc >= 0")
    words, notes = summary(rows, F.col("wc"), "label"), summary(rows, F.col("n_ann"), "label")
    return words.select("label", "n", F.col("mean").alias("mean_words"), F.col("stdev").alias("stdev_words")).join(notes.select("label", F.col("mean").alias("mean_annotations"), F.col("max").alias("max_annotations")), "label")


def column_stats(vectors: DataFrame, vector: str) -> DataFrame:
    """(place, mean, most, variance) of each component; the variance is the sample's. Null vectors don't count."""
    each = vectors.select(F.posexplode(vector).alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("place").agg(F.avg("x").alias("mean"), F.max("x").alias("most"), F.var_samp("x").alias("variance"))


def mode_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): the most frequent label of each key, of equal ones the least."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(most, [key, "n"]).groupBy(key, "n").agg(F.min(label).alias(label)).select(key, label, "n")
