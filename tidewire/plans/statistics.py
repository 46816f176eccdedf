"""Descriptive statistics of the collection, and quality of its predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import metrics, splits, stats, taxonomy, terms
from tidewire.plans.base import ANN, ART, LAB, SIZED, anns, arts, norm, query, r6
from tidewire.sources.tables import normalised, table


def _round(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@query(f"with {ART}, {LAB} select label, count(*) n from lab group by 1")
def label_distribution(spark, d):
    return stats.count_by(stats.labels_of(arts(spark, d, "iptc")), "label")


@query(f"with {ART}, {ANN}, {LAB}, {SIZED} select label, count(*) articles, sum(n_ann)::bigint annotations, round(sum(n_ann) / count(*), 6) per_article from lab join sized using (id) group by 1")
def ann_per_label(spark, d):
    return _round(stats.annotations_per_label(arts(spark, d, "iptc"), anns(spark, d)), "per_article")


@query(f"with {ART}, {ANN}, {LAB} select label, count(distinct term) distinct_terms, count(*) annotations, round(count(distinct term) / count(*), 6) diversity from lab join ann on article_id = id group by 1")
def label_diversity(spark, d):
    return _round(stats.label_diversity(arts(spark, d, "iptc"), anns(spark, d)), "diversity")


@query(f"with {ART}, {ANN}, {SIZED} select count(*) articles, count(*) filter (where coalesce(len(iptc), 0) = 0) without_labels, count(*) filter (where n_ann = 0) without_annotations, (select count(*) from ann) annotations, (select count(distinct term) from ann) distinct_terms from sized")
def general_stats(spark, d):
    return stats.general(arts(spark, d, "iptc"), anns(spark, d))


@query(f"with {ART} select max(wc)::double max, min(wc)::double min, round(avg(wc), 6) mean, round(stddev_pop(wc), 6) stdev, round(var_pop(wc), 6) variance, count(wc) n from art where wc >= 0")
def length_stats(spark, d):
    return _round(stats.summary(arts(spark, d, "wc").where("wc >= 0"), F.col("wc")), "mean", "stdev", "variance")


@query(f"with {ART} select wc as value, count(*) n from art group by 1")
def length_histogram(spark, d):
    return stats.histogram(arts(spark, d, "wc"), F.col("wc"))


@query(f"with {ANN} select mc as value, count(*) n from ann group by 1")
def mention_histogram(spark, d):
    return stats.histogram(anns(spark, d), F.col("mc"))


@query(f"with {ART} select split_name bucket, count(*) n, min(wc) least, max(wc) most from art group by 1")
def border_stats(spark, d):
    return stats.border_stats(arts(spark, d, "split_name", "wc").withColumnRenamed("split_name", "bucket"), "bucket", F.col("wc"))


@query("with s as (select user_id, list_sort(list(distinct event_type)) t from events group by 1 having count(distinct event_type) > 3) select min(user_id) first_id, count(*) articles, len(t)::bigint terms from s group by t having count(*) > 2")
def equal_annotation_sets(spark, d):
    """Users with the same set of more than three kinds of events."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("article_id"), F.col("event_type").alias("term")).distinct()
    return stats.equal_annotation_sets(rows)


@query(f"with {ART}, {ANN}, {LAB} select label, term, round(max(tf_idf), 6) tf_idf, sum(mc)::bigint mentions from lab join ann on article_id = id join art using (id) where wc > 100 group by all having sum(mc) > 10")
def common_annotations(spark, d):
    return _round(stats.common_annotations(arts(spark, d, "iptc", "wc"), anns(spark, d), 100, 10), "tf_idf")


@query(f"with {ANN}, f as (select *, count(*) over (partition by term) df from ann), t as (select unnest([{', '.join(map(str, stats.SWEEP))}]) threshold) select threshold, count(distinct article_id) articles, count(distinct term) terms, count(article_id) annotations from t left join f on df > threshold group by 1")
def freq_sweep(spark, d):
    return stats.frequency_sweep(anns(spark, d))


@query(f"with {ART}, {ANN}, {SIZED} select count(*) articles, round(corr(n_ann, wc), 6) correlation from sized where wc >= 0")
def length_correlation(spark, d):
    return _round(stats.length_correlation(arts(spark, d, "wc"), anns(spark, d)), "correlation")


@query(f"with {ANN} select article_id, max(mc) most, sum(mc)::bigint total from ann group by 1")
def mention_extremes(spark, d):
    return stats.mention_extremes(anns(spark, d))


@query(f"with {ANN} select term, sum(mc)::bigint mentions, count(*) articles from ann group by 1")
def annotation_distribution(spark, d):
    return stats.annotation_distribution(anns(spark, d))


@query(f"with {ART}, {ANN}, {LAB}, {SIZED} select label, count(*) n, round(avg(wc), 6) mean_words, round(stddev_pop(wc), 6) stdev_words, round(avg(n_ann), 6) mean_annotations, max(n_ann)::double max_annotations from lab join sized using (id) where wc >= 0 group by 1")
def label_batch_stats(spark, d):
    return _round(stats.label_batch(arts(spark, d, "iptc", "wc"), anns(spark, d)), "mean_words", "stdev_words", "mean_annotations")


@query(f"with {ANN} select min(mc) least, max(mc) most, sum(mc)::bigint total, count(*) n, count(distinct fb) different from ann")
def global_reduce(spark, d):
    return anns(spark, d).agg(F.min("mc").alias("least"), F.max("mc").alias("most"), F.sum("mc").alias("total"), F.count("*").alias("n"), F.count_distinct("fb").alias("different"))


@query("select distinct fb from annotations where lower(trim(fb)) not in ('none', '')")
def distinct_ids(spark, d):
    return table(spark, d, "annotations").where("lower(trim(fb)) not in ('none', '')").select("fb").distinct()


@query("select i - 1 place, round(avg(x), 6) mean, round(max(x), 6) most, round(var_samp(x), 6) variance from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by 1")
def column_stats(spark, d):
    return _round(stats.column_stats(table(spark, d, "embeddings"), "embedding"), "mean", "most", "variance")


@query(f"with {ART}, k as (select unnest(ann) term, label from art join (select distinct id, {norm('x')} as label from (select id, unnest(iptc) x from art)) using (id)), c as (select term, label, count(*) n from k where term is not null and label <> '' group by all) select term, label, n from (select *, row_number() over (partition by term order by n desc, label) r from c) where r = 1")
def mode_label(spark, d):
    """The most frequent label of the articles that hold a key."""
    rows = arts(spark, d, "ann", "iptc")
    keys = rows.select("id", F.explode("ann").alias("term"))
    return stats.mode_label(keys.join(stats.labels_of(rows), "id"), "term", "label")


# --- quality of predictions ------------------------------------------------------------------------------------------------------------------------

CATEGORIES = ["courts and law", "farming and food", "local government", "medicine", "money and markets", "schools", "science", "software", "sport", "stage and screen", "transport", "weather and environment"]
_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)
_NORM = lambda c: f"coalesce(list_distinct(list_filter(list_transform({c}, lambda x: {norm('x')}), lambda x: x is not null)), [])"
_PAIR = f"{ART}, pair as (select id, wc, split_name, {_NORM('iptc')} g, {_NORM('pred')} p from art)"
_CONF = f"{_PAIR}, cat as (select unnest([{_CATS}]) as label), conf as (select label, count(*) filter (where list_contains(g, label) and list_contains(p, label)) tp, count(*) filter (where not list_contains(g, label) and list_contains(p, label)) fp, count(*) filter (where list_contains(g, label) and not list_contains(p, label)) fn, count(*) filter (where not list_contains(g, label) and not list_contains(p, label)) tn from pair, cat group by 1)"
_MEASURE = "case when fn = 0 then 1.0 else tp / (tp + fn) end recall, case when fp = 0 then 1.0 else tp / (tp + fp) end as precision, (tp + tn) / (tp + fp + fn + tn) accuracy"
_FULL = f"select *, 2 * recall * precision / (recall + precision + 0.0001) f_score from (select *, {_MEASURE} from X)"
_NAMES = ("recall", "precision", "accuracy", "f_score")
_R = ", ".join(f"round({c}, 6) as {c}" for c in _NAMES)


def predictions(spark, d):
    """Correct and predicted labels of the articles, normalised."""
    clean = lambda c: F.array_compact(F.transform(c, normalised))
    return arts(spark, d, "iptc", "pred", "wc", "split_name").select("id", "wc", "split_name", clean("iptc").alias("iptc"), clean("pred").alias("pred"))


@query(f"with {_CONF} select label, tp, fp, fn, tn, {_R} from ({_FULL.replace('X', 'conf')})")
def confusion_per_label(spark, d):
    return _round(metrics.per_label(metrics.confusion(predictions(spark, d), "iptc", "pred", CATEGORIES)), *_NAMES)


@query(f"with {_CONF}, s as (select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, sum(tn)::bigint tn from conf) select tp, fp, fn, tn, {_R} from ({_FULL.replace('X', 's')})")
def micro_avg(spark, d):
    return _round(metrics.micro_average(metrics.confusion(predictions(spark, d), "iptc", "pred", CATEGORIES)), *_NAMES)


@query(f"with {_CONF} select {', '.join(f'round(avg({c}), 6) as {c}' for c in _NAMES)} from ({_FULL.replace('X', 'conf')})")
def macro_avg(spark, d):
    return _round(metrics.macro_average(metrics.confusion(predictions(spark, d), "iptc", "pred", CATEGORIES)), *_NAMES)


_EX = f"{_PAIR}, e as (select *, len(list_intersect(g, p)) c, len(list_distinct(list_concat(g, p))) u from pair), m as (select avg((list_sort(g) = list_sort(p))::int) subset_accuracy, avg((c > 0)::int) subset_one, avg(case when u = 0 then 0 else (u - c) / u end) h_loss, avg(case when len(p) = 0 then 0 else c / len(p) end) as precision, avg(case when len(g) = 0 then 0 else c / len(g) end) recall, avg(case when u = 0 then 0 else c / u end) accuracy from e)"


@query(f"with {_EX} select round(subset_accuracy, 6) subset_accuracy, round(subset_one, 6) subset_one, round(h_loss, 6) h_loss, round(precision, 6) as precision, round(recall, 6) recall, round(accuracy, 6) accuracy, round(2 * precision * recall / (precision + recall), 6) f_score from m")
def example_metrics(spark, d):
    return _round(metrics.example_metrics(predictions(spark, d), "iptc", "pred"), "subset_accuracy", "subset_one", "h_loss", *_NAMES)


@query(f"with {_PAIR} select round(avg(len(g)), 6) cardinality_gold, round(count(distinct list_sort(g)) / count(*), 6) diversity_gold, round(avg(len(p)), 6) cardinality_pred, round(count(distinct list_sort(p)) / count(*), 6) diversity_pred from pair")
def label_cardinality(spark, d):
    return _round(metrics.label_shape(predictions(spark, d), "iptc", "pred"), "cardinality_gold", "diversity_gold", "cardinality_pred", "diversity_pred")


@query(f"with {_CONF} select label, printf('%-40s TP: %6d FP: %6d FN: %6d TN: %6d R: %.3f P: %.3f A: %.3f F: %.3f', label, tp, fp, fn, tn, recall, precision, accuracy, f_score) line from ({_FULL.replace('X', 'conf')})")
def metric_report(spark, d):
    return metrics.report_lines(metrics.per_label(metrics.confusion(predictions(spark, d), "iptc", "pred", CATEGORIES)))


@query(f"with {_PAIR} select id, label, case when list_contains(g, label) then 'tp' else 'fp' end outcome from (select id, g, unnest(p) as label from pair)")
def prediction_outcomes(spark, d):
    return metrics.outcomes(predictions(spark, d), "id", "iptc", "pred")


@query(f"with {_PAIR}, b as (select split_name bucket, count(*) n, min(wc) least, max(wc) most, sum(len(list_intersect(g, p))) tp, sum(len(p)) - sum(len(list_intersect(g, p))) fp, sum(len(g)) - sum(len(list_intersect(g, p))) fn from pair group by 1), m as (select *, case when fn = 0 then 1.0 else tp / (tp + fn) end recall, case when fp = 0 then 1.0 else tp / (tp + fp) end as precision from b) select bucket, n, least, most, tp::bigint tp, fp::bigint fp, fn::bigint fn, round(recall, 6) recall, round(precision, 6) as precision, round(2 * recall * precision / (recall + precision + 0.0001), 6) f_score from m")
def bucketed_evaluation(spark, d):
    rows = predictions(spark, d).withColumnRenamed("split_name", "bucket")
    return _round(metrics.by_bucket(rows, "bucket", "iptc", "pred", F.col("wc")), "recall", "precision", "f_score")


_SCORE = "s as (select round(embedding[1]::double, 2) score, label % 2 as label from embeddings)"


@query(f"with {_SCORE}, b as (select score threshold, sum(label) pos, count(*) n from s group by 1), r as (select threshold, sum(pos) over (order by threshold desc) tp, sum(n) over (order by threshold desc) - sum(pos) over (order by threshold desc) fp, sum(pos) over () a from b) select threshold, tp::bigint tp, fp::bigint fp, round(tp / (tp + fp), 6) as precision, round(tp / a, 6) recall, round(coalesce(2 * (tp / (tp + fp)) * (tp / a) / nullif(tp / (tp + fp) + tp / a, 0), 0), 6) f_beta from r")
def binary_curve(spark, d):
    return _round(metrics.binary_curve(_scores(spark, d), "score", "label"), "precision", "recall", "f_beta")


@query(f"with {_SCORE} select round(avg(case when p.score > q.score then 1.0 when p.score = q.score then 0.5 else 0.0 end), 6) auroc from s p, s q where p.label = 1 and q.label = 0")
def auroc(spark, d):
    return _round(metrics.auroc(_scores(spark, d), "score", "label"), "auroc")


def _scores(spark, d):
    first = F.get("embedding", F.lit(0)).cast("double")
    return table(spark, d, "embeddings").select(F.round(first, 2).alias("score"), (F.col("label") % 2).alias("label"))
