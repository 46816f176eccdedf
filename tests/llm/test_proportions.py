"""The sample's shares against the targets."""

import pytest
from pyspark.sql import functions as F

from tidewire.llm import proportions


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_reachable_subjects_share_one_factor(spark, folder):
    """Within 5 % of the common factor, or the two rows that rounding leaves; those out of reach are taken whole."""
    sample, report = proportions.article_sample(spark, f"/root/testdata/{folder}")
    size, rows = sample.count(), report.collect()
    factors = {round(r["expected"] / (size * r["target_permille"] / 1000), 6) for r in rows if r["expected"] is not None and r["expected"] < r["held"]}
    assert len(factors) == 1 and 4 <= sum(r["expected"] < r["held"] for r in rows)
    for r in rows:
        assert abs(r["sampled"] - r["expected"]) <= max(2, 0.05 * r["expected"])
        assert r["share_permille"] == pytest.approx(1000 * r["sampled"] / size)
        assert (r["gap"] > 0) == (r["shortage"] > 0)


def test_found_is_of_the_sample(spark, monkeypatch):
    """Without the draw the sample misses more targets than those that can't be met."""
    whole = {r["topic"] for r in proportions.p1_found(spark, "/root/testdata/sf0.01").collect()}
    monkeypatch.setattr(proportions, "draw", lambda rows, *a: rows.select("id").where("false"))
    monkeypatch.setattr(proportions, "settle", lambda drawn, *a: drawn)
    less = {r["topic"] for r in proportions.p1_found(spark, "/root/testdata/sf0.01").collect()}
    assert whole and whole < less


def test_exchange_fills_what_chance_left_out(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 20, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"))).alias("subjects"), F.lit(0.5).alias("chance"), F.lit(False).alias("sure"))
    drawn = rows.where("id between '30' and '59' and subjects[0] = 'b'")
    out = proportions.settle(drawn, rows, {"a": 7, "b": 10}, set(), 1)
    by = {r["s"]: r["count"] for r in out.groupBy(F.col("subjects")[0].alias("s")).count().collect()}
    assert by["a"] == 7 and sum(by.values()) == drawn.count() and out.select("id").distinct().count() == drawn.count()
    kept = proportions.settle(drawn, rows, {"a": 7, "b": drawn.count()}, set(), 1)  # nothing to give
    assert kept.count() == drawn.count()


def test_overlapping_categories_and_size(spark):
    """Categories that always come together, one that is everywhere, and a size of all rows or none."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 4 == 0, "x"), F.when(F.col("id") % 4 == 0, "y"), F.when(F.col("id") % 10 == 1, "z"))).alias("subjects"))
    targets = spark.createDataFrame([("all", 600, 1), ("x", 150, 1), ("y", 150, 1), ("z", 100, 1)], "topic string, target_permille int, min_rows int")
    for size in (0, 1, 500, 2000):
        out, report = proportions.sample(rows, targets, size)
        assert out.count() == size == out.select("id").distinct().count()
        assert {r["topic"] for r in report.collect()} == {"all", "x", "y", "z"}


def test_contradictory_targets_end(spark):
    """Two categories that always come together with targets that differ: one leaves the dual, the size is kept."""
    rows = spark.range(900).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("subjects"))
    targets = spark.createDataFrame([("a", 100, 0), ("b", 300, 0), ("c", 600, 0)], "topic string, target_permille int, min_rows int")
    out, report = proportions.sample(rows, targets, 300)
    by = {r["topic"]: r for r in report.collect()}
    assert out.count() == 300 and by["a"]["sampled"] == by["b"]["sampled"] and by["a"]["sampled"] + by["c"]["sampled"] == 300
    assert not any(r["gap"] for r in by.values())
