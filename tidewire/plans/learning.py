"""Models by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import models, neural, projection, splits, stats, terms, vectors
from tidewire.plans.base import ANN, ART, LAB, anns, arts, query, r6
from tidewire.plans.sets import SWEEP
from tidewire.plans.statistics import CATEGORIES
from tidewire.plans.vectors import _MM as MINMAX
from tidewire.plans.vectors import _NB as SCALED
from tidewire.plans.vectors import _W as WEIGHTS
from tidewire.plans.vectors import emb, weighted
from tidewire.sources.tables import table
from tidewire.storage import cut

_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)


def bags(spark, d):
    """Terms of the train articles, weighted by mentions."""
    train = arts(spark, d, "split_name").where("split_name = 'train'").select("id")
    return anns(spark, d).select(F.col("article_id").alias("id"), "term", F.col("mc").cast("double").alias("w")).join(train, "id", "left_semi")


def labels(spark, d):
    return stats.labels_of(arts(spark, d, "iptc"))


_NB = f"""{ART}, {ANN}, {LAB}, bag as (select article_id id, term, mc::double w from ann where article_id in (select id from art where split_name = 'train')),
cat as (select unnest([{_CATS}]) category), doc as (select distinct id from bag), held as (select id, label category from lab where label in ({_CATS}) and id in (select id from doc)),
flag as (select id, category, (id, category) in (select id, category from held) is_ from doc, cat),
prior as (select category, b.is_, ln(count(f.id) + 1) - ln((select count(*) from doc) + 2) prior from cat cross join (select unnest([true, false]) is_) b left join flag f using (category, is_) group by all),
cell as (select category, is_, term, sum(w) w from flag join bag using (id) group by all),
weight as (select category, is_, term, ln(coalesce(w, 0) + 1) - ln((select coalesce(sum(w), 0) from cell c where c.category = cat.category and c.is_ = b.is_) + (select count(distinct term) from bag)) weight from cat cross join (select unnest([true, false]) is_) b cross join (select distinct term from bag) left join cell using (category, is_, term))"""


@query(f"with {_NB} select category, is_::int as \"is\", round(prior, 6) prior from prior")
def nb_priors(spark, d):
    prior, _ = models.nb_counts(bags(spark, d), labels(spark, d), CATEGORIES)
    return prior.withColumn("prior", r6("prior"))


@query(f"with {_NB} select category, is_::int as \"is\", term, round(weight, 6) weight from weight")
def nb_params(spark, d):
    _, weights = models.nb_counts(bags(spark, d), labels(spark, d), CATEGORIES)
    return weights.withColumn("weight", r6("weight"))


@query(f"with {_NB}, gain as (select category, term, sum(case when is_ then weight else -weight end) g from weight group by all), base as (select category, sum(case when is_ then prior else -prior end) b from prior group by 1), test as (select article_id id, term, mc from ann where article_id in (select id from art where split_name = 'test')) select id, category, round(sum(mc * g) + any_value(b), 5) margin, sum(mc * g) + any_value(b) > 0 predicted from test join gain using (term) join base using (category) group by all")
def nb_predict(spark, d):
    model = models.nb_fit(cut(bags(spark, d), "bags"), labels(spark, d), CATEGORIES)
    test = arts(spark, d, "split_name").where("split_name = 'test'").select("id")
    rows = anns(spark, d).select(F.col("article_id").alias("id"), "term", F.col("mc").alias("w")).join(test, "id", "left_semi")
    out = models.nb_margins(rows, model)
    return out.select("id", "category", F.round("margin", 5).alias("margin"), (F.col("margin") > 0).alias("predicted"))


def _documents(spark, d, normalise=False):
    """Articles with a vector of features and their labels."""
    held = vectors.document_vectors(weighted(spark, d), emb(spark, d), normalise).withColumnRenamed("article_id", "id")
    rows = held.join(arts(spark, d, "iptc", "split_name"), "id").withColumnRenamed("vector", "numbers")
    return cut(rows, "documents")  # read once for each model and round


def _said(rows, pred):
    return pred.select("id", F.array_join("pred", ",").alias("pred"))


_VECTORS = f"""{ART}, {WEIGHTS}, {SCALED}, m as (select article_id, {MINMAX('e')} v from q), r as (select article_id, unnest(v) x, generate_subscripts(v, 1) i from m), vec as (select article_id id, i term, sum(x) w from r group by all),
bag as (select * from vec where id in (select id from art where split_name = 'train')), cat as (select unnest([{_CATS}]) category), doc as (select distinct id from bag),
held as (select distinct id, x category from (select id, unnest(iptc) x from art) where id in (select id from doc)), flag as (select id, category, (id, category) in (select id, category from held) is_ from doc, cat),
prior as (select category, is_, ln(count(*) + 1) - ln((select count(*) from doc) + 2) prior from flag group by all), cell as (select category, is_, term, sum(w) w from flag join bag using (id) group by all),
weight as (select category, is_, term, ln(w + 1) - ln(sum(w) over (partition by category, is_) + count(*) over (partition by category, is_)) weight from cell),
gain as (select category, term, sum(case when is_ then weight else -weight end) g from weight group by all having count(*) = 2), base as (select category, sum(case when is_ then prior else -prior end) b from prior group by 1 having count(*) = 2),
margin as (select id, category, sum(w * g) + any_value(b) m from vec join gain using (term) join base using (category) where id in (select id from art where split_name = 'test') group by all)"""


@query(f"with {_VECTORS} select id, coalesce(string_agg(category, ',' order by category) filter (where m > 0), '') pred from margin group by id")
def nb_ml(spark, d):
    """Spark's naive Bayes for each label, on normalised document vectors."""
    rows = models.features(_documents(spark, d, normalise=True), "numbers")
    fitted = models.each_category(rows.where("split_name = 'train'"), "iptc", CATEGORIES, models.naive_bayes(), parallelism=2)
    return _said(rows, models.predicted(rows.where("split_name = 'test'"), fitted))


@query()
def feed_forward(spark, d):
    """A feed-forward net with tanh layers for each label."""
    rows = _documents(spark, d).withColumnRenamed("numbers", "features")
    nets = neural.fit_each(rows.where("split_name = 'train'"), "iptc", CATEGORIES, lambda: neural.FeedForward((64, 700, 500, 2)))
    return _said(rows, neural.predict(rows.where("split_name = 'test'"), nets))


@query()
def feed_forward_ml(spark, d):
    """Spark's multilayer perceptron for each label."""
    rows = models.features(_documents(spark, d), "numbers")
    fitted = models.each_category(rows.where("split_name = 'train'"), "iptc", CATEGORIES, models.feed_forward(64), parallelism=4)
    return _said(rows, models.predicted(rows.where("split_name = 'test'"), fitted))


@query()
def recurrent(spark, d):
    """A recurrent net over the sequence of an article's annotation vectors for each label."""
    rows = vectors.sequences(anns(spark, d), emb(spark, d)).select(F.col("article_id").alias("id"), F.col("steps").alias("features")).join(arts(spark, d, "iptc", "split_name"), "id")
    nets = neural.fit_each(rows.where("split_name = 'train'"), "iptc", CATEGORIES, lambda: neural.Recurrent(64))
    return _said(rows, neural.predict(rows.where("split_name = 'test'"), nets))


@query()
def support_vectors(spark, d):
    """Scores of a linear support vector machine."""
    rows = models.features(table(spark, d, "embeddings").withColumn("label", (F.col("label") % 2).cast("double")), "embedding")
    out = models.support_vectors(20)(rows).transform(rows)
    return models.as_array(out, "rawPrediction").select("vec_id", F.get("rawPrediction", F.lit(1)).alias("score"))


@query()
def hashed_tf_idf(spark, d):
    """Hashed word counts weighted by inverse document frequency, as the sum of the weights of each document."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.split(F.lower("text"), r"\s+").alias("words"))
    out = models.as_array(models.inverse_frequencies(models.hashing_tf(rows, "words", 1 << 12)), "idf")
    return out.select("doc_id", F.aggregate("idf", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query()
def word_synonyms(spark, d):
    """The words nearest to one by Word2Vec."""
    rows = table(spark, d, "documents").where("lang = 'en' and text is not null").select(F.split(F.lower("text"), r"\s+").alias("words"))
    return models.word_vectors(rows, "words", size=16, partitions=4).findSynonyms("the", 20)


@query()
def projection_pca(spark, d):
    return projection.principal(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y"))


@query()
def projection_tsne(spark, d):
    """Key vectors in the plane by stochastic neighbour embedding, with their most frequent label; as many as the plane takes of those with the most mentions are embedded, the rest is placed by its nearest."""
    return projection.whole_map(emb(spark, d).join(_modes(spark, d), "term"), "term", "v", "label", F.desc("n"), rounds=100)


def _modes(spark, d):
    rows = anns(spark, d).select(F.col("article_id").alias("id"), "term").join(labels(spark, d), "id")
    return stats.mode_label(rows, "term", "label")


@query(f"with l as (select user_id run, row_number() over (partition by user_id order by event_id) iteration, value score from events), c as (select *, score - lag(score) over (partition by run order by iteration) ch from l) select run, iteration, round(avg(score) over (partition by run order by iteration rows between 99 preceding and current row), 9) mean_score, round(avg(ch) over (partition by run order by iteration rows between 7 preceding and current row), 9) mean_change from c")
def training_log(spark, d):
    """Running means over a log of scores; here the events of each user."""
    from pyspark.sql import Window

    rows = table(spark, d, "events").withColumn("iteration", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    out = neural.log_means(rows.select(F.col("user_id").alias("run"), "iteration", F.col("value").alias("score")))
    return out.select("run", "iteration", F.round("mean_score", 9).alias("mean_score"), F.round("mean_change", 9).alias("mean_change"))


@query(f"with {ART}, {ANN}, k as (select term, count(*) df from ann where article_id in (select id from art where split_name = 'train') group by 1 having count(*) > 2) select t.prefix, count(*) n, count(distinct ann.term) terms from (select id, row_number() over (order by id) - 1 r from art where split_name = 'train') a join (select unnest({SWEEP}) prefix) t on r < t.prefix join ann on article_id = id join k using (term) group by 1")
def learning_curve(spark, d):
    """Training sets of growing size, and the vocabulary that each sees."""
    train = arts(spark, d, "split_name").where("split_name = 'train'").select("id")
    rows = anns(spark, d).withColumnRenamed("article_id", "id").join(train, "id", "left_semi").select("id", "term")
    kept = terms.vocabulary_filter(rows, terms.document_frequency(rows, "id", "term", 2))
    return splits.prefixes(train, SWEEP, "id").join(kept, "id").groupBy("prefix").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))
