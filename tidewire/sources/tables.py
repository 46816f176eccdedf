"""Named Parquet tables of a data folder, and the views on them that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; filters and column choices reach the Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, each run of white space one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def derived_key(fb: Column, wd: Column, db: Column, phrase: Column) -> Column:
    """The first of fb, wd, db that is present, else phrase; absent is NONE, none, empty or null."""
    present = lambda c: F.when(~F.lower(F.trim(c)).isin("none", ""), c)
    return F.coalesce(present(fb), present(wd), present(db), phrase)


def latest(articles: DataFrame, *columns: str) -> DataFrame:
    """One row for each id: the one loaded last, with the columns asked for.

    Rows without an id are left out. A null loaded_at counts as the earliest. Rows that tie are taken by the greatest value of the
    columns, so that the result doesn't depend on the order of rows. Only the columns asked for are shuffled, after a partial maximum.
    """
    kept = articles.where(F.col("id").isNotNull()).select("id", F.struct("loaded_at", *columns).alias("row"))
    return kept.groupBy("id").agg(F.max("row").alias("row")).select("id", *[F.col(f"row.{c}").alias(c) for c in columns])
