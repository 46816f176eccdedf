"""Vector features of documents, built from array functions and sums by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(vector: Column) -> Column:
    """A vector scaled to 0 to 1 by its own least and greatest component; one without a range is all 0."""
    # arrays of one entry bind the vector and its bounds, which are else found again for each component
    bound = F.transform(F.array(vector), lambda v: F.struct(v.alias("v"), F.array_min(v).alias("least"), (F.array_max(v) - F.array_min(v)).cast("double").alias("span")))
    return F.get(F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.coalesce(F.try_divide((x - s["least"]).cast("double"), s["span"]), F.lit(0.0)))), F.lit(0))


def to_csv(vector: Column) -> Column:
    """Components separated by commas."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")


def from_csv(text: Column) -> Column:
    """The vector of a comma-separated text; what isn't a number is null."""
    return F.transform(F.split(text, r",\s*"), lambda x: x.try_cast("float"))


def scaled(vector: Column, weight: Column) -> Column:
    """weight times vector."""
    return F.transform(vector, lambda x: x.cast("double") * weight)


def summed(rows: DataFrame, key: str | list[str], vector: Column, mean: bool = False) -> DataFrame:
    """(key, vector): sum or mean of vectors by component. Partial sums by key and place, so a key of many rows is no task's alone."""
    keys = [key] if isinstance(key, str) else key
    each = rows.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    parts = each.groupBy(*keys, "_i").agg((F.avg if mean else F.sum)("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("vector"))


def document_vectors(weighted: DataFrame, embeddings: DataFrame, normalise: bool = False) -> DataFrame:
    """(article_id, vector): the sum of tf_idf times the terms' embeddings; terms without one don't count. weighted: (article_id, term, tf_idf), embeddings: (term, v).

    normalise: each weighted embedding is scaled to 0 to 1 before the sum, for models that need features of no negative value.
    """
    rows = weighted.select("article_id", "term", "tf_idf").join(embeddings.select("term", "v"), "term")
    vector = scaled(F.col("v"), F.col("tf_idf"))
    return summed(rows.withColumn("_v", minmax(vector) if normalise else vector), "article_id", F.col("_v"))


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """(term, idx): the place from 0 of each term in order."""
    from tidewire.operators.splits import with_index

    return with_index(vocabulary.select("term").distinct(), "term")


def bag_of_words(weighted: DataFrame, index: DataFrame) -> DataFrame:
    """(article_id, indices, weights): each article's tf_idf at the terms' places, ascending; terms outside the index don't count. One article's terms are one row's."""
    rows = weighted.join(index, "term").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tf_idf"))).alias("_s"))
    return rows.select("article_id", F.transform("_s", lambda s: s["idx"]).alias("indices"), F.transform("_s", lambda s: s["tf_idf"]).alias("weights"))


def sequences(annotations: DataFrame, embeddings: DataFrame, length: int = 100) -> DataFrame:
    """(article_id, steps, n): the embeddings of an article's first ``length`` annotations by offset, padded with nulls to that length, and how many are real. Terms without an embedding don't count."""
    rows = annotations.join(embeddings.select("term", "v"), "term")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("article_id").orderBy("ann_offset", "term"))).where(F.col("_rank") <= length)
    grouped = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "v"))).alias("_s"))
    steps = F.transform("_s", lambda s: s["v"])
    pad = F.array_repeat(F.lit(None).cast(embeddings.schema["v"].dataType), F.lit(length) - F.size("_s"))
    return grouped.select("article_id", F.concat(steps, pad).alias("steps"), F.size("_s").alias("n"))


def label_array(labels: Column, categories: list[str]) -> Column:
    """0 or 1 for each category in order; null labels are none."""
    held = F.coalesce(labels, F.array().cast("array<string>"))
    return F.array(*[F.array_contains(held, c).cast("int") for c in sorted(categories)])


def weight_map(weighted: DataFrame, ordered: bool = False) -> DataFrame:
    """(article_id, weights): a map from term to tf_idf, by term or, ordered, by offset."""
    order = ["ann_offset", "term"] if ordered else ["term"]
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col("tf_idf"))))
    grouped = weighted.groupBy("article_id").agg(entries.alias("_e"))
    return grouped.select("article_id", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["term"], e["tf_idf"]))).alias("weights"))


def embeddings_of(annotations: DataFrame, size: int) -> DataFrame:
    """(term, v): the stored vector of each derived key; those of another size, with null or non-finite components or all 0 don't count."""
    from tidewire.sources.tables import derived_key

    key = derived_key(*(F.col(c) for c in ("fb", "wd", "db", "phrase")))
    rows = annotations.where("w2v is not null").select(key.alias("term"), F.col("w2v").alias("v")).where(F.size("v") == size)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("term is not null").where(finite & F.exists("v", lambda x: x != 0)).groupBy("term").agg(F.max("v").alias("v"))
