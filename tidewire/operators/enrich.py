"""Lookups, knowledge-graph ids and ontology expansion: joins by key, with the strategy left to Catalyst and AQE.

Small sides are broadcast by their measured size, skewed keys of shuffled joins are split at run time; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = "NONE"


def present(column: str):
    """A column of ids with its forms of absent - NONE, none, blank - as null."""
    c = F.col(column)
    return F.when(~F.lower(F.trim(c)).isin("none", ""), c)


def with_annotations(articles: DataFrame, annotations: DataFrame, keep_empty: bool = False) -> DataFrame:
    """articles with a map ann from term to (mc, offset, phrase). Articles without annotations are left out unless keep_empty. One article's annotations are one row's, as the map's size is the article's."""
    entry = F.struct("term", F.struct("mc", F.col("ann_offset").alias("offset"), "phrase").alias("value"))
    maps = annotations.groupBy(F.col("article_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ann_map"))
    return articles.join(maps, "id", "left" if keep_empty else "inner")


def merged_annotations(left: DataFrame, right: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Annotations of two sources by (article_id, term): right ones hold where both have a term. Only articles that both have, or with keep_unmatched all of left's."""
    ids = right.select("article_id").distinct()
    base = left if keep_unmatched else left.join(ids, "article_id", "left_semi")
    own = right.join(left.select("article_id").distinct(), "article_id", "left_semi")
    rest = base.join(own.select("article_id", "term"), ["article_id", "term"], "left_anti")
    return rest.unionByName(own)


def id_chain(rows: DataFrame, db: str, db_to_wd: DataFrame, wd_to_fb: DataFrame) -> DataFrame:
    """rows with wd and fb found from db by two lookups, NONE where there is none. Lookups: two columns each, keys unique."""
    first = db_to_wd.toDF("_db", "_wd")
    second = wd_to_fb.toDF("_wd2", "_fb")
    joined = rows.join(first, F.col(db) == F.col("_db"), "left").join(second, F.col("_wd") == F.col("_wd2"), "left")
    return joined.withColumn("wd_found", F.coalesce("_wd", F.lit(NONE))).withColumn("fb_found", F.coalesce("_fb", F.lit(NONE))).drop("_db", "_wd", "_wd2", "_fb")


def type_fanout(rows: DataFrame, types: str, db: str) -> DataFrame:
    """A row for each type of an entity, phrase ``type->db``; entities without types vanish."""
    return rows.withColumn("type", F.explode(types)).withColumn("phrase", F.concat(F.col("type"), F.lit("->"), F.col(db)))


def inverted(pairs: DataFrame) -> DataFrame:
    """A lookup the other way round; of several keys of a value the greatest holds."""
    a, b = pairs.columns
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(b)).agg(F.max(a).alias(a)).select(b, a)


def id_report(entities: DataFrame, key: str, wd: DataFrame, fb: DataFrame) -> DataFrame:
    """(key, n, wd, fb): rows of each entity with the ids that lookups have for it, fewest first."""
    counts = entities.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    joined = counts.join(wd.toDF(key, "wd"), key, "left").join(fb.toDF(key, "fb"), key, "left")
    return joined.select(key, "n", F.coalesce("wd", F.lit(NONE)).alias("wd"), F.coalesce("fb", F.lit(NONE)).alias("fb")).orderBy("n", key)


def lookup_pairs(annotations: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): ids that rows hold together; of several b of an a the greatest."""
    rows = annotations.select(present(a).alias(a), present(b).alias(b)).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(a).agg(F.max(b).alias(b))


def knowledge_graph_filter(annotations: DataFrame) -> DataFrame:
    """Annotations with a knowledge-graph id; articles left without any vanish with their last row."""
    return annotations.where(present("wd").isNotNull())


def expanded(annotations: DataFrame, broader: DataFrame, compat: bool = False) -> DataFrame:
    """Annotations and a row for each broader concept of their wd id, merged by (article_id, term): mc is summed, the least offset holds.

    broader: (wd, broader), any number for an id. compat: a broader row keeps the term it came from, so that each adds its mc to it.
    """
    pairs = broader.toDF("_wd", "_broader").distinct()
    more = annotations.join(pairs, present("wd") == F.col("_wd"))
    more = more.withColumn("term", F.col("term") if compat else F.col("_broader")).select("article_id", "term", "mc", "ann_offset")
    return annotations.select("article_id", "term", "mc", "ann_offset").unionByName(more).groupBy("article_id", "term").agg(F.sum("mc").alias("mc"), F.min("ann_offset").alias("ann_offset"))


def entity_collapse(mentions: DataFrame, doc: str, entity: str, offset: str) -> DataFrame:
    """(doc, entity, mc, offset): the mentions of an entity in a document and the first one's place; other columns of the first mention in ``first``."""
    return mentions.groupBy(doc, entity).agg(F.count("*").alias("mc"), F.min(offset).alias("offset"))


def inverted_index(pairs: DataFrame, doc: str, entity: str) -> DataFrame:
    """(doc, entities): sorted distinct entities of each document. A document's entities are one row's, as its size is the document's."""
    return pairs.where(F.col(doc).isNotNull() & F.col(entity).isNotNull()).groupBy(doc).agg(F.array_sort(F.collect_set(entity)).alias("entities"))


def with_vector(articles: DataFrame, annotations: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labelled articles that keep an annotation with a Freebase id and a stored vector. vectors: (term)."""
    kept = annotations.where(present("fb").isNotNull()).join(vectors.select("term").distinct(), "term", "left_semi")
    return articles.where(F.size("iptc") > 0).join(kept.select(F.col("article_id").alias("id")), "id", "left_semi")


def annotations_of_entities(rows: DataFrame, doc: str, entity: str) -> DataFrame:
    """(article_id, term, mc, ann_offset, phrase) of the present entities of each document, once each: mc is 1, the place unknown."""
    held = rows.select(F.col(doc).alias("article_id"), present(entity).alias("term")).where("article_id is not null and term is not null").distinct()
    return held.select("article_id", "term", F.lit(1).alias("mc"), F.lit(-1).alias("ann_offset"), F.col("term").alias("phrase"))


def annotations_of_names(rows: DataFrame, doc: str, name: str) -> DataFrame:
    """(article_id, term, mc, ann_offset, phrase) of the names of each document whatever their case: the term is ``name:`` and the name, mc their number, the place unknown."""
    held = rows.select(F.col(doc).alias("article_id"), F.col(name).alias("phrase")).where("article_id is not null and trim(phrase) <> ''")
    grouped = held.groupBy("article_id", F.concat(F.lit("name:"), F.lower("phrase")).alias("term")).agg(F.count("*").cast("int").alias("mc"), F.min("phrase").alias("phrase"))
    return grouped.select("article_id", "term", "mc", F.lit(-1).alias("ann_offset"), "phrase")
