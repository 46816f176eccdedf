"""Quality of multi-label predictions and of binary scores.

Rows hold the correct labels and the predicted ones as arrays. All labels' counts come from one pass: each row's labels are exploded once, so the
work is in proportion to the labels given, and true negatives follow from the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn, tn) of every label given, also of those that no row has. Null arrays are empty, repeated labels count once; other labels are left out."""
    spark = rows.sparkSession
    g, p = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (gold, pred))
    each = rows.select(g.alias("g"), p.alias("p")).select("g", "p", F.explode(F.array_union("g", "p")).alias("label"))
    held = each.select("label", F.array_contains("g", F.col("label")).alias("is"), F.array_contains("p", F.col("label")).alias("said"))
    counts = held.groupBy("label").agg(F.count_if(F.col("is") & F.col("said")).alias("tp"), F.count_if(~F.col("is") & F.col("said")).alias("fp"), F.count_if(F.col("is") & ~F.col("said")).alias("fn"))
    named = spark.createDataFrame([(c,) for c in labels], "label string")
    total = rows.agg(F.count("*").alias("n"))
    joined = named.join(counts, "label", "left").join(F.broadcast(total))
    joined = joined.select("label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")], "n")
    return joined.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("n")


def measure(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """recall, precision, accuracy and f_score. Recall is 1 where nothing was missed and precision 1 where nothing was wrong, even without a hit; the F-score's divisor has 0.0001 added."""
    recall = F.when(fn == 0, 1.0).otherwise(tp / (tp + fn))
    precision = F.when(fp == 0, 1.0).otherwise(tp / (tp + fp))
    return {"recall": recall, "precision": precision, "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "f_score": 2 * recall * precision / (recall + precision + 0.0001)}


def per_label(counts: DataFrame) -> DataFrame:
    """Counts by label with their measures."""
    return counts.withColumns(measure(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def micro_average(counts: DataFrame) -> DataFrame:
    """Measures of the counts' sums."""
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return per_label(sums)


def macro_average(counts: DataFrame) -> DataFrame:
    """Means of the labels' measures, each label alike."""
    return per_label(counts).agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "accuracy", "f_score")])


def example_metrics(rows: DataFrame, gold: str, pred: str, compat: bool = False) -> DataFrame:
    """One row of measures by example, all divided by the number of rows.

    subset_accuracy: equal sets; subset_one: some label in common; h_loss: the symmetric difference over the union; precision, recall, accuracy: the common labels over the
    predicted, correct and united ones; f_score: of that precision and recall. A row whose divisor is empty adds 0; with compat, empty correct labels or unions make
    recall, accuracy and h_loss NaN, as 0 / 0 does.
    """
    empty = F.array().cast("array<string>")
    g, p = (F.array_distinct(F.coalesce(F.col(c), empty)) for c in (gold, pred))
    rows = rows.select(g.alias("g"), p.alias("p"))
    common, union = F.size(F.array_intersect("g", "p")), F.size(F.array_union("g", "p"))
    none = F.lit(float("nan")) if compat else F.lit(0.0)
    part = lambda a, b, other: F.when(b == 0, other).otherwise(a / F.when(b != 0, b))
    each = rows.select(
        (F.array_sort("g") == F.array_sort("p")).cast("int").alias("same"),
        F.arrays_overlap("g", "p").cast("int").alias("one"),
        part(union - common, union, none).alias("h"),
        part(common, F.size("p"), F.lit(0.0)).alias("pr"),
        part(common, F.size("g"), none).alias("re"),
        part(common, union, none).alias("ac"),
    )
    sums = each.agg(F.avg("same").alias("subset_accuracy"), F.avg("one").alias("subset_one"), F.avg("h").alias("h_loss"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("ac").alias("accuracy"))
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return sums.withColumn("f_score", f)


def label_shape(rows: DataFrame, gold: str, pred: str, compat: bool = False) -> DataFrame:
    """Mean number of labels and the part of different label sets, correct and predicted. compat: the latter is always 1, as without counting sets once."""
    empty = F.array().cast("array<string>")
    out = []
    for c, name in ((gold, "gold"), (pred, "pred")):
        labels = F.array_sort(F.array_distinct(F.coalesce(F.col(c), empty)))
        out += [F.avg(F.size(labels)).alias(f"cardinality_{name}"), (F.lit(1.0) if compat else F.count_distinct(labels) / F.count("*")).alias(f"diversity_{name}")]
    return rows.agg(*out)


def report_lines(measures: DataFrame) -> DataFrame:
    """(label, line): the measures of each label as a line of fixed width."""
    line = F.format_string("%-40s TP: %6d FP: %6d FN: %6d TN: %6d R: %.3f P: %.3f A: %.3f F: %.3f", "label", "tp", "fp", "fn", "tn", "recall", "precision", "accuracy", "f_score")
    return measures.select("label", line.alias("line"))


def outcomes(rows: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """(key, label, outcome): each predicted label with tp or fp, as it is written into a folder each."""
    said = rows.select(key, gold, F.explode(F.array_distinct(pred)).alias("label"))
    hit = F.array_contains(F.coalesce(F.col(gold), F.array().cast("array<string>")), F.col("label"))
    return said.select(key, "label", F.when(hit, "tp").otherwise("fp").alias("outcome"))


def by_bucket(rows: DataFrame, bucket: str, gold: str, pred: str, criterion: Column) -> DataFrame:
    """For each bucket its rows, the least and greatest criterion, and micro-averaged measures over all labels said or correct."""
    empty = F.array().cast("array<string>")
    g, p = (F.array_distinct(F.coalesce(F.col(c), empty)) for c in (gold, pred))
    common = F.size(F.array_intersect(g, p))
    sums = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.min(criterion).alias("least"), F.max(criterion).alias("most"), F.sum(common).alias("tp"), F.sum(F.size(p) - common).alias("fp"), F.sum(F.size(g) - common).alias("fn"))
    named = measure(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0))
    return sums.withColumns({k: named[k] for k in ("recall", "precision", "f_score")})


def binary_curve(scores: DataFrame, score: str, label: str, beta: float = 1.0) -> DataFrame:
    """(threshold, tp, fp, precision, recall, f_beta) at every distinct score, from the greatest on. Scores are first counted by value; the running sums are in one task, of as many rows as distinct scores - round them first if they are very many."""
    by = scores.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("threshold"))
    every = Window.partitionBy()
    run = by.select("threshold", F.sum("pos").over(down).alias("tp"), (F.sum("n").over(down) - F.sum("pos").over(down)).alias("fp"), F.sum("pos").over(every).alias("all_pos"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.coalesce(F.try_divide("tp", "all_pos"), F.lit(0.0))
    f = F.coalesce(F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall), F.lit(0.0))
    return run.select("threshold", "tp", "fp", precision.alias("precision"), recall.alias("recall"), f.alias("f_beta"))


def auroc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auroc): the chance that a positive has a greater score than a negative, ties half; null without both kinds."""
    by = scores.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = by.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return area.agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))
