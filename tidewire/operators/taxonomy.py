"""Topic taxonomy: ancestors, levels, and topics of descriptors.

The closure is a chain of joins of the edge table with itself, as deep as the taxonomy may be; edges are few, articles are joined with the closure once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.tables import normalised

#: Steps from a topic to its root at most.
DEPTH = 6


def parents(edges: DataFrame) -> DataFrame:
    """(child, parent): each topic's parent; self-edges don't count, of several parents the least holds."""
    return edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))


def closure(topics: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(topic_id, ancestor, distance) of every topic and each topic above it, itself with distance 0."""
    up = parents(edges).select(F.col("child").alias("ancestor"), "parent")
    step = topics.select("topic_id", F.col("topic_id").alias("ancestor"), F.lit(0).alias("distance"))
    out = step
    for i in range(1, depth + 1):
        step = step.join(up, "ancestor").select("topic_id", F.col("parent").alias("ancestor"), F.lit(i).alias("distance"))
        out = out.unionByName(step)
    return out


def levels(topics: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(topic_id, level, ancestor) for levels 0 to ``depth`` - 1: level 0 is the root, level k the k-th topic below it on the way; a topic with a shorter way stands for itself."""
    up = closure(topics, edges, depth)
    from_root = F.max("distance").over(Window.partitionBy("topic_id")) - F.col("distance")
    placed = up.withColumn("level", from_root).withColumn("most", F.max("distance").over(Window.partitionBy("topic_id")))
    own = placed.select("topic_id", "level", "ancestor", "most")
    every = own.where("level = most").select("topic_id", "most", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    filled = every.join(own.select("topic_id", "level", "ancestor"), ["topic_id", "level"], "left")
    return filled.select("topic_id", F.col("level").cast("int").alias("level"), F.coalesce("ancestor", "topic_id").alias("ancestor"))


def level_names(topics: DataFrame, edges: DataFrame, without: tuple[str, ...] = ("freemasonry",)) -> DataFrame:
    """(label, level, broad): topic labels with the label above them at each level; labels in ``without`` are left out."""
    named = topics.select(F.col("topic_id").alias("ancestor"), F.col("topic_label").alias("broad"))
    rows = levels(topics, edges).join(topics, "topic_id").join(named, "ancestor")
    return rows.where(~F.lower("topic_label").isin(*without)).select(F.col("topic_label").alias("label"), "level", "broad")


def descriptor_topics(articles: DataFrame, mapping: DataFrame, topics: DataFrame, descriptors: str = "desc_terms") -> DataFrame:
    """(id, topic_id) of each article's descriptors: by the mapping, else by a topic's own label, else none; unknown topics are left out.

    mapping: (descriptor, topic_id), compared in lower case; entries of ``n/a`` don't count, of several for a descriptor the greatest holds. A topic id may be the end of a path.
    """
    known = topics.select("topic_id", F.lower("topic_label").alias("descriptor"))
    entry = F.substring_index("topic_id", "/", -1)
    usable = mapping.where(F.col("descriptor").isNotNull() & (F.lower(F.trim("topic_id")) != "n/a"))
    by_map = usable.groupBy(normalised(F.col("descriptor")).alias("descriptor")).agg(F.max(entry).alias("mapped"))
    by_label = known.groupBy("descriptor").agg(F.min("topic_id").alias("labelled"))
    each = articles.select("id", F.explode(descriptors).alias("raw")).select("id", normalised(F.col("raw")).alias("descriptor")).distinct()
    found = each.join(by_map, "descriptor", "left").join(by_label, "descriptor", "left").select("id", F.coalesce("mapped", "labelled").alias("topic_id"))
    return found.join(topics.select("topic_id"), "topic_id", "left_semi").select("id", "topic_id").distinct()


def broad_topics(found: DataFrame, topics: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """(id, label): the labels at a level above each article's topics."""
    above = levels(topics, edges).where(F.col("level") == level).select("topic_id", "ancestor")
    named = topics.select(F.col("topic_id").alias("ancestor"), F.col("topic_label").alias("label"))
    return found.join(above, "topic_id").join(named, "ancestor").select("id", "label").distinct()


def top_categories(topics: DataFrame, edges: DataFrame, start: str | None = None) -> DataFrame:
    """(label): topics without a parent, in order; start: from this label on."""
    roots = topics.join(parents(edges), topics.topic_id == F.col("child"), "left_anti").select(F.col("topic_label").alias("label")).distinct()
    return (roots.where(F.col("label") >= start) if start else roots).orderBy("label")
