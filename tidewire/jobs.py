"""Jobs by name: preparation, statistics, training and evaluation. ``python -m tidewire.jobs job=NAME data=FOLDER out=FOLDER key=value...``

A job gives a DataFrame; the command line writes it below ``out`` and prints its first rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import experiments
from tidewire.config import Config
from tidewire.operators import enrich, metrics, projection, splits, stats, taxonomy, terms, vectors
from tidewire.sources import codec, formats, nitf, sinks
from tidewire.sources.tables import latest, normalised, table
from tidewire.storage import cut, scope

JOBS: dict[str, Callable[[SparkSession, Config], DataFrame]] = {}


def job(*names: str):
    def add(run):
        for name in names:
            JOBS[name] = run
        return run

    return add


def articles(spark: SparkSession, c: Config, *columns: str) -> DataFrame:
    """The articles, each id once; the first ``count`` of them by id if one is given."""
    columns = columns or ("hl", "body", "wc", "pub_date", "iptc", "url", "desc_terms", "pred", "split_name")
    return formats.limited(latest(table(spark, c.data, "articles"), *columns), c.limit, c.fraction, "id")


def annotations(spark: SparkSession, c: Config) -> DataFrame:
    return terms.annotation_map(table(spark, c.data, "annotations"))


def embeddings(spark: SparkSession, c: Config) -> DataFrame:
    return vectors.embeddings_of(table(spark, c.data, "annotations"), c.size)


def categories(spark: SparkSession, c: Config) -> list[str]:
    """The one category asked for, else all top categories from ``start`` on."""
    if c.category:
        return [c.category]
    top = taxonomy.top_categories(table(spark, c.data, "topics"), table(spark, c.data, "topic_edges"), c.start or None)
    return [r["label"] for r in top.limit(1000).collect()]


# --- preparation -----------------------------------------------------------------------------------------------------------------------------------


@job("testSpark")
def test_spark(spark, c):
    return spark.range(10).agg(F.sum("id").alias("total"))


@job("printArticles")
def print_articles(spark, c):
    """The first articles with their number of annotations."""
    return stats.annotation_sizes(articles(spark, c), annotations(spark, c)).orderBy("id").limit(c.limit or 20)


@job("printEntities")
def print_entities(spark, c):
    """Ten annotations of each confidence, by article and term."""
    out = None
    for level in (0.25, 0.5, 0.75, 1.0):
        rows = experiments.catalogue(spark, c).annotations(confidence=level).orderBy("article_id", "term").limit(10).withColumn("confidence", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


@job("cacheRaw", "cacheNYT")
def cache_raw(spark, c):
    """News markup below the data folder as JSON lines."""
    return codec.to_json(nitf.to_articles(nitf.read(spark, c.data, count=c.limit)))


@job("cacheMinimal")
def cache_minimal(spark, c):
    """Labelled articles that keep an annotation with an id and a vector, without their texts."""
    kept = enrich.with_vector(articles(spark, c), annotations(spark, c), embeddings(spark, c))
    return kept.withColumns({"body": F.lit(""), "hl": F.lit("")})


@job("cacheMini")
def cache_mini(spark, c):
    return splits.newest(articles(spark, c), c.limit or 100_000)


@job("cacheAnnotated", "computeDbAnnotationsConfidence")
def cache_annotated(spark, c):
    """Articles with the map of their annotations."""
    return enrich.with_annotations(articles(spark, c), annotations(spark, c))


@job("cacheAnnotatedWithTypes")
def cache_typed(spark, c):
    """Articles with an annotation for each of their descriptors' topics too."""
    found = taxonomy.descriptor_topics(articles(spark, c, "desc_terms"), table(spark, c.data, "descriptor_map"), table(spark, c.data, "topics"))
    more = found.select(F.col("id").alias("article_id"), F.col("topic_id").alias("term"), F.lit(1).alias("mc"), F.lit(-1).alias("ann_offset"), F.concat(F.col("topic_id"), F.lit("->"), F.col("id")).alias("phrase"))
    own = annotations(spark, c).select("article_id", "term", "mc", "ann_offset", "phrase")
    return enrich.with_annotations(articles(spark, c), own.unionByName(more).dropDuplicates(["article_id", "term"]))


@job("computeDbAnnotations")
def collapse(spark, c):
    rows = table(spark, c.data, "annotations").withColumn("entity", enrich.present("db")).where("entity is not null")
    return enrich.entity_collapse(rows, "article_id", "entity", "ann_offset").orderBy("article_id", "offset")


@job("wdToFbFromDump")
def wd_to_fb(spark, c):
    return formats.statement_pairs(spark, c.data, "P646c")


@job("dbpediaToWdFromDump")
def db_to_wd(spark, c):
    return formats.same_as_pairs(spark, c.data)


@job("combineIds")
def combine_ids(spark, c):
    rows = table(spark, c.data, "annotations")
    db_wd, wd_fb = enrich.lookup_pairs(rows, "db", "wd"), enrich.lookup_pairs(rows, "wd", "fb")
    fb = db_wd.join(wd_fb, "wd").groupBy("db").agg(F.max("fb").alias("fb"))
    return enrich.id_report(rows.select(enrich.present("db").alias("db")), "db", db_wd, fb)


@job("fbw2vIds")
def vector_ids(spark, c):
    return embeddings(spark, c).select("term").orderBy("term")


@job("cacheW2V", "cacheWordVectors")
def cache_vectors(spark, c):
    """Vectors of the keys that the collection holds."""
    return embeddings(spark, c).join(annotations(spark, c).select("term").distinct(), "term", "left_semi")


@job("splitAndCache", "cache")
def split_ordered(spark, c):
    return splits.ordered_split(articles(spark, c), "id")


@job("cacheAndSplitLength")
def split_length(spark, c):
    return splits.static_buckets(articles(spark, c).where("wc >= 0"), c.buckets, "wc", "id")


@job("cacheAndSplitTime")
def split_time(spark, c):
    return splits.relative_buckets(articles(spark, c), c.buckets, "id", "id", seed=c.seed)


@job("cacheAndSplitAll")
def split_stored(spark, c):
    """The articles that have annotations, with their stored split."""
    return articles(spark, c).join(annotations(spark, c).select(F.col("article_id").alias("id")), "id", "left_semi")


@job("cacheSuperBalanced")
def super_balanced(spark, c):
    return splits.supersampled(articles(spark, c), "id", F.array_contains("iptc", c.category))


@job("cacheSuperSampled")
def super_sampled(spark, c):
    return splits.supersample_labels(articles(spark, c, "iptc"), c.limit, c.seed)


@job("cacheSubSampled")
def sub_sampled(spark, c):
    return articles(spark, c).join(splits.subsample_labels(articles(spark, c, "iptc"), c.seed), "id", "left_semi")


# --- statistics ------------------------------------------------------------------------------------------------------------------------------------


@job("iptcDistribution")
def label_distribution(spark, c):
    rows = articles(spark, c, "iptc", "desc_terms")
    if not c.broad_match:
        return stats.count_by(stats.labels_of(rows), "label").orderBy(F.desc("n"), "label")
    topics, edges = table(spark, c.data, "topics"), table(spark, c.data, "topic_edges")
    found = taxonomy.descriptor_topics(rows, table(spark, c.data, "descriptor_map"), topics)
    return stats.count_by(taxonomy.broad_topics(found, topics, edges, c.level), "label").orderBy(F.desc("n"), "label")


@job("stats")
def all_stats(spark, c):
    return stats.general(articles(spark, c, "iptc"), annotations(spark, c))


@job("storedLengths")
def lengths(spark, c):
    """Quality of the stored predictions by length: each bucket of articles ordered by their number of words."""
    return metrics.by_bucket(split_length(spark, c), "bucket", "iptc", "pred", F.col("wc")).orderBy("bucket")


@job("tnesDocumentVectors")
def document_plane(spark, c):
    held = document_features(spark, c, "ffn_w2v").withColumn("label", F.get("iptc", F.lit(0)))
    held = held.orderBy("id").limit(c.limit) if c.limit else held
    return projection.whole_map(held, "id", "features", "label", "id", rounds=200)


@job("tnesWordVectors")
def word_plane(spark, c):
    labels = stats.labels_of(articles(spark, c, "iptc"))
    modes = stats.mode_label(annotations(spark, c).select(F.col("article_id").alias("id"), "term").join(labels, "id"), "term", "label")
    rows = embeddings(spark, c).join(modes, "term")
    rows = rows.orderBy(F.desc("n"), "term").limit(c.limit) if c.limit else rows
    return projection.whole_map(rows, "term", "v", "label", F.desc("n"), rounds=200)


# --- training and evaluation -----------------------------------------------------------------------------------------------------------------------


def document_features(spark: SparkSession, c: Config, kind: str) -> DataFrame:
    """(id, iptc, features) of all articles, weights fitted on the train part."""
    sets = experiments.catalogue(spark, c)
    vocabulary, documents = experiments.vocabulary_of(sets.by("train_ordered"), max(c.threshold, 0))
    return cut(experiments.features(kind, sets.annotated(), vocabulary, documents, sets.embeddings()), "features")


def _experiment(name: str) -> None:
    def run_it(spark, c):
        return experiments.run_experiment(spark, c, experiments.EXPERIMENTS[name], categories(spark, c))

    JOBS[name] = run_it


def _test(name: str) -> None:
    def run_it(spark, c):
        return experiments.run_test(spark, c, *experiments.TESTS[name], categories(spark, c))

    JOBS[name] = run_it


for _name in experiments.EXPERIMENTS:
    _experiment(_name)
for _name in experiments.TESTS:
    _test(_name)


@job("trainFFNW2VInc")
def train_incremental(spark, c):
    """Feed-forward nets on train sets of 5,000 to 195,000 articles."""
    return experiments.run_sizes(spark, c, "ffn_w2v", experiments.SIZES, categories(spark, c))


@job("trainFFNW2VInc2")
def train_incremental_wide(spark, c):
    """The same for sizes from 100 to 500,000, wider and wider apart."""
    return experiments.run_sizes(spark, c, "ffn_w2v", experiments.SIZES2, categories(spark, c))


@job("trainNaiveBoWInc")
def train_naive_incremental(spark, c):
    """Naive Bayes on document vectors for sizes from 100 to 500,000."""
    return experiments.run_sizes(spark, c, "nb_w2v", experiments.SIZES2, categories(spark, c))


@job("testConfidence")
def test_confidence(spark, c):
    """Feed-forward nets of each confidence that has been trained, on the annotations of that confidence."""
    out = None
    for level in (25, 50, 75, 100):
        try:
            sets = experiments.catalogue(spark, c)
            fitted = experiments.load(spark, "ffn_w2v", experiments.model_path(c, f"confidence-{level}", "ffn_w2v"))
        except FileNotFoundError:
            continue
        test = sets.split(sets.mini(level / 100), "test")
        made = experiments.evaluate(fitted, test, categories(spark, c), sets.embeddings(), f"confidence-{level}")
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise FileNotFoundError("no models of any confidence; trainConfidence with the same out keeps them there")
    return out


@job("testLengths", "misc")
def test_lengths(spark, c):
    """Recurrent nets of the baseline by bucket of articles ordered by their number of words."""
    return experiments.run_buckets(spark, c, "baseline", split_length(spark, c), F.col("wc")).orderBy("bucket")


@job("testTimeDecay", "test")
def test_time_decay(spark, c):
    """Recurrent nets trained on the time before, by the buckets of time that follow."""
    rows = split_time(spark, c).where("part = 'test'").drop("part")
    return experiments.run_buckets(spark, c, "time", rows, F.try_to_number("id", F.lit("999999999999999999")).cast("long")).orderBy("bucket")


@job("reportStored")
def report_stored(spark, c):
    """Report lines of the predictions that the articles hold, by label."""
    rows = articles(spark, c, "iptc", "pred").withColumns({x: F.array_compact(F.transform(x, normalised)) for x in ("iptc", "pred")})
    return metrics.report_lines(metrics.per_label(metrics.confusion(rows, "iptc", "pred", categories(spark, c)))).orderBy("label")


@job("logResults")
def log_results(spark, c):
    """Predicted labels with whether they are right, in a folder for each outcome and label if ``out`` is set."""
    rows = articles(spark, c, "iptc", "pred").withColumns({x: F.array_compact(F.transform(x, normalised)) for x in ("iptc", "pred")})
    made = rows.select("id", "iptc", F.explode(F.array_distinct("pred")).alias("label"))
    made = made.select("id", "label", F.when(F.array_contains(F.coalesce("iptc", F.array().cast("array<string>")), F.col("label")), "tp").otherwise("fp").alias("outcome"))
    if c.out:
        sinks.save_outcomes(made, c.path("outcomes", c.run_name))
    return made


def run(spark: SparkSession, c: Config) -> DataFrame:
    """The result of a job, written below ``out`` if that is set."""
    if c.job not in JOBS:
        raise SystemExit(f"no job {c.job}; there are {', '.join(sorted(JOBS))}")
    if not c.out:
        return JOBS[c.job](spark, c)
    with scope():
        sinks.save_table(JOBS[c.job](spark, c), c.path(c.run_name))
    return spark.read.parquet(c.path(c.run_name))


def main(args: list[str]) -> int:
    from tidewire.session import get_session

    c = Config.of(args)
    spark = get_session(c.job, partitions=c.partitions)
    run(spark, c).show(50, truncate=120)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
