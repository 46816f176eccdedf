"""Subjects above the labels of a topic taxonomy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.sources.tables import normalised

#: Rows of a taxonomy that the driver may hold; a larger one is refused.
MOST = 200_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a taxonomy may have {MOST} rows at most")
    return rows


def subjects_of_labels(topics: DataFrame, edges: DataFrame) -> dict[str, list[str]]:
    """Label -> the labels of the topics above it that have no other parent, itself included. Self-edges, repeated edges, unknown topics and nulls count for nothing; a cycle ends where it began."""
    label = {r[0]: r[1] for r in _rows(topics.select("topic_id", "topic_label").where("topic_id is not null and topic_label is not null").distinct())}
    parents: dict[str, set[str]] = {}
    for child, parent in _rows(edges.select("child", "parent").where("child <> parent").distinct()):
        if child in label and parent in label:
            parents.setdefault(child, set()).add(parent)
    out: dict[str, set[str]] = {}
    for topic in label:
        seen, todo = {topic}, [topic]
        while todo:
            now = todo.pop()
            if now not in parents:
                out.setdefault(label[topic], set()).add(label[now])
            new = parents.get(now, set()) - seen
            seen |= new
            todo += new
    return {k: sorted(v) for k, v in sorted(out.items())}


def subjects_by(rows: DataFrame, key: str, labels: str, mapping: dict[str, list[str]]) -> DataFrame:
    """(key, subjects): the sorted subjects above the labels of an array column, for rows with at least one. key must be unique; null and unknown labels count for nothing.

    The mapping is broadcast, its size is bounded by ``MOST``. If rows are already partitioned by key they aren't shuffled.
    """
    pairs = [(k, s) for k, v in mapping.items() for s in v]
    if not pairs:
        return rows.select(key, F.array().cast("array<string>").alias("subjects")).where("false")
    small = rows.sparkSession.createDataFrame(pd.DataFrame(pairs, columns=["label", "subject"]))
    each = rows.select(key, F.explode(labels).alias("label")).select(key, normalised(F.col("label")).alias("label"))
    return each.join(F.broadcast(small), "label").groupBy(key).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
