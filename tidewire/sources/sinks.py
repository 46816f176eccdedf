"""Writing tables, texts, reports and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import trim_label


def file_name(label: str) -> str:
    """A label as a file name."""
    import re

    return re.sub(r"[,\s+]+", "_", label)


def save_text(rows: DataFrame, path: str, partitions: int = 1) -> None:
    """Write a text column over what is there, in so many files. Many files are written by as many tasks; one file is one task's, so ask for one only for reports."""
    (rows.coalesce(1) if partitions == 1 else rows.repartition(partitions)).write.mode("overwrite").text(path)


def save_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table as Parquet over what is there."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lines over what is there."""
    rows.write.mode("overwrite").json(path)


def append_report(lines: DataFrame, path: str) -> None:
    """Add lines to a report."""
    lines.coalesce(1).write.mode("append").text(path)


def save_outcomes(outcomes: DataFrame, path: str) -> None:
    """Write predicted labels into a folder for each outcome (tp, fp) and label."""
    outcomes.withColumn("label", trim_label(F.col("label"))).write.mode("overwrite").partitionBy("outcome", "label").parquet(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Write (term, v) as lines of the id and comma-separated numbers."""
    vectors.select(F.concat_ws(", ", "term", F.array_join(F.transform("v", lambda x: x.cast("string")), ", "))).write.mode("overwrite").text(path)


def save_vocabulary(vocabulary: DataFrame, documents: DataFrame, path: str) -> None:
    """Write a TF-IDF model (term, df and the number of documents); an empty vocabulary is an error."""
    if vocabulary.isEmpty():
        raise ValueError("the vocabulary is empty")
    save_table(vocabulary, f"{path}/vocabulary")
    save_table(documents, f"{path}/documents")


def load_vocabulary(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A TF-IDF model; a missing one is an error."""
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/documents")


def save_models(models: dict, path: str) -> None:
    """Write a fitted model of pyspark.ml for each label."""
    for label, model in models.items():
        model.write().overwrite().save(f"{path}/{file_name(label)}")


def load_model(kind, path: str, label: str):
    """The model of a label."""
    return kind.load(f"{path}/{file_name(label)}")


def save_nets(spark, nets: dict, path: str) -> None:
    """Write nets as rows of their label, kind, settings and weights."""
    import pickle

    save_table(spark.createDataFrame([(label, bytearray(pickle.dumps(net))) for label, net in sorted(nets.items())], "label string, net binary"), path)


def load_nets(spark, path: str, labels: list[str] | None = None) -> dict:
    """Nets by label, all or those asked for."""
    import pickle

    rows = spark.read.parquet(path)
    return {r["label"]: pickle.loads(bytes(r["net"])) for r in (rows.where(F.col("label").isin(labels)) if labels is not None else rows).collect()}
