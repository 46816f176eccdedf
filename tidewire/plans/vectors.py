"""Vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import models, vectors
from tidewire.plans.base import ANN, ART, EMB, anns, arts, query, r6
from tidewire.plans.statistics import CATEGORIES
from tidewire.sources.tables import table

SIZE = 64


def emb(spark, d):
    return vectors.embeddings_of(table(spark, d, "annotations"), SIZE)


def _long(df, key, column="vector"):
    """Vectors as rows of key, place and rounded component."""
    return df.select(key, F.posexplode(column).alias("place", "x")).select(key, "place", r6(F.col("x").cast("double")).alias("x"))


def weighted(spark, d):
    """Annotations with a weight, as they are stored; unknown ones are 0."""
    return anns(spark, d).withColumn("tf_idf", F.when(F.col("tf_idf") > 0, F.col("tf_idf")).otherwise(0.0))


_W = f"{ANN}, w as (select * replace (case when tf_idf > 0 then tf_idf else 0 end as tf_idf) from ann), {EMB}"
_MM = lambda v: f"list_transform({v}, lambda x: case when list_max({v}) = list_min({v}) then 0 else (x - list_min({v})) / (list_max({v}) - list_min({v})) end)"


@query(f"with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), m as (select vec_id, {_MM('e')} v from v) select vec_id, generate_subscripts(v, 1) - 1 place, round(unnest(v), 6) x from m")
def vector_minmax(spark, d):
    rows = table(spark, d, "embeddings").withColumn("vector", vectors.minmax(F.col("embedding").cast("array<double>")))
    return _long(rows, "vec_id")


@query("select label, i - 1 place, round(avg(x), 6) x from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by all")
def vector_mean(spark, d):
    return _long(vectors.summed(table(spark, d, "embeddings"), "label", F.col("embedding").cast("array<double>"), mean=True), "label")


@query("select vec_id, round(unnest(embedding)::double, 6) x, generate_subscripts(embedding, 1) - 1 place from embeddings")
def vector_csv(spark, d):
    """Vectors as text and back."""
    rows = table(spark, d, "embeddings").withColumn("vector", vectors.from_csv(vectors.to_csv(F.col("embedding"))))
    return _long(rows, "vec_id")


@query(f"with {_W}, r as (select article_id, tf_idf * x::double x, i from (select article_id, tf_idf, unnest(v) x, generate_subscripts(v, 1) i from w join emb using (term))) select article_id, i - 1 place, round(sum(x), 6) x from r group by all")
def doc_vector(spark, d):
    return _long(vectors.document_vectors(weighted(spark, d), emb(spark, d)), "article_id")


_NB = "q as (select article_id, list_transform(v, lambda x: x::double * tf_idf) e from w join emb using (term))"


@query(f"with {_W}, {_NB}, m as (select article_id, {_MM('e')} v from q), r as (select article_id, unnest(v) x, generate_subscripts(v, 1) i from m) select article_id, i - 1 place, round(sum(x), 6) x from r group by all")
def nb_doc_vector(spark, d):
    return _long(vectors.document_vectors(weighted(spark, d), emb(spark, d), normalise=True), "article_id")


_VOC = "voc as (select term, row_number() over (order by term) - 1 idx from (select term from ann group by 1 having count(*) > 5))"


def _vocabulary(spark, d):
    return vectors.vocabulary_index(anns(spark, d).groupBy("term").agg(F.count("*").alias("n")).where("n > 5"))


@query(f"with {_W}, {_VOC} select article_id, string_agg(idx || ':' || round(tf_idf * 10000)::bigint, ' ' order by idx) bag from w join voc using (term) group by 1")
def bow_sparse(spark, d):
    rows = vectors.bag_of_words(weighted(spark, d), _vocabulary(spark, d))
    text = F.transform(F.arrays_zip("indices", "weights"), lambda z: F.concat(z["indices"].cast("string"), F.lit(":"), F.round(z["weights"] * 10000).cast("long").cast("string")))
    return rows.select("article_id", F.array_join(text, " ").alias("bag"))


@query(f"with {_W}, s as (select article_id, term, row_number() over (partition by article_id order by ann_offset nulls first, term) r from w join emb using (term)) select article_id, least(count(*), 100) n, string_agg(term, ' ' order by r) filter (where r <= 100) terms, 100::bigint length from s group by 1")
def sequence_cut(spark, d):
    """The first hundred annotations with a vector by offset; sequences are padded to that length."""
    held = emb(spark, d).withColumn("v", F.struct("term", "v"))
    rows = vectors.sequences(anns(spark, d), held)
    real = F.filter("steps", lambda s: s.isNotNull())
    return rows.select("article_id", F.col("n").cast("long").alias("n"), F.array_join(F.transform(real, lambda s: s["term"]), " ").alias("terms"), F.size("steps").cast("long").alias("length"))


@query(f"with {ART} select id, {' || '.join(f'list_contains(coalesce(iptc, []), {chr(39)}{c}{chr(39)})::int::varchar' for c in sorted(CATEGORIES))} bits from art")
def label_array(spark, d):
    bits = F.transform(vectors.label_array(F.col("iptc"), CATEGORIES), lambda x: x.cast("string"))
    return arts(spark, d, "iptc").select("id", F.array_join(bits, "").alias("bits"))


@query(f"with {_W} select article_id, string_agg(term, ' ' order by ann_offset nulls first, term) terms, round(sum(tf_idf), 6) total from w group by 1")
def weight_map(spark, d):
    rows = vectors.weight_map(weighted(spark, d), ordered=True)
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("article_id", F.array_join(F.map_keys("weights"), " ").alias("terms"), r6(total).alias("total"))


@query(f"with {ANN}, {EMB} select distinct term from ann where term in (select term from emb)")
def known_vectors(spark, d):
    """Keys of the collection that have a vector."""
    return anns(spark, d).select("term").distinct().join(emb(spark, d), "term", "left_semi")


@query("select vec_id, round(list_reduce(list_transform(embedding, lambda x: x::double * x::double), lambda a, b: a + b), 6) norm2, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) most from embeddings")
def vector_norms(spark, d):
    v = F.col("embedding").cast("array<double>")
    square = F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", r6(square).alias("norm2"), r6(F.array_max(F.transform(v, F.abs))).alias("most"))


@query("select vec_id, round(x / most, 6) x, place from (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 place, list_max(list_transform(embedding, lambda x: abs(x::double))) most from embeddings)")
def inf_normalise(spark, d):
    rows = models.normalised_by_max(models.features(table(spark, d, "embeddings"), "embedding"))
    return _long(models.as_array(rows, "scaled"), "vec_id", "scaled")


@query("select vec_id, place, round((x - avg(x) over (partition by place)) / stddev_samp(x) over (partition by place), 6) + 0.0 x from (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 place from embeddings)")
def standard_scale(spark, d):
    rows = models.standardised(models.features(table(spark, d, "embeddings"), "embedding"))
    return _long(models.as_array(rows, "scaled"), "vec_id", "scaled").withColumn("x", F.col("x") + 0.0)
