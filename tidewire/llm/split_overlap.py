"""Problem 5: the same or nearly the same records in the train split and in an evaluation split.

Minimum hashes of an article's shingles make banded buckets: 40 bands of three hashes. Only buckets that hold both sides go on, and only
pairs across the sides come out of them; those are verified by the exact Jaccard similarity of the shingle sets. Articles with the same
shingles are one class that carries which sides its members are on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shingles import BAND, HASHES, bucket_pairs, classes, signed, texts_of, verified
from tidewire.llm.words import mix
from tidewire.sources.tables import table
from tidewire.storage import cut

RUN, WORDS, LEAST = 3, 20, 0.6
TRAIN, EVALUATION = ("train",), ("test", "validation")


def banded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the bands, and 16 bits of each minimum hash."""
    key = np.zeros((len(hashes), HASHES // BAND), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BAND):
            key = mix(key + hashes[:, i::BAND])
        key = mix(key * np.uint64(64) + np.arange(key.shape[1], dtype=np.uint64))
    return key, np.ascontiguousarray(hashes.astype(np.uint16)).view(np.uint8).reshape(len(hashes), -1)


def agreeing(least: float):
    """Test that enough minimum hashes agree: a pair of the least similarity passes but for a chance of 3e-7."""
    need = HASHES * least - 5 * np.sqrt(HASHES * least * (1 - least))

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.ascontiguousarray(x).view(np.uint16) == np.ascontiguousarray(y).view(np.uint16)).sum(1) >= need

    return close


def classed(articles: DataFrame, run: int = RUN, least_words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, tr, ev, any_tr, any_ev), the articles with enough words that are on a side, and links (a, b, similarity) of class representatives across the sides, both ways round."""
    split = F.lower(F.trim("split_name"))
    texts = texts_of(articles, tr=F.coalesce(F.max(split.isin(*TRAIN)), F.lit(False)), ev=F.coalesce(F.max(split.isin(*EVALUATION)), F.lit(False)))
    texts = texts.where("tr or ev")
    signs = cut(signed(texts, banded, run, least_words, ["tr", "ev"]), "p5-signed")
    members = cut(classes(signs, {"any_tr": F.max("tr"), "any_ev": F.max("ev")}), "p5-members")
    reps = signs.drop("tr", "ev").join(members.where("id = rep").select("id", F.col("any_tr").alias("tr"), F.col("any_ev").alias("ev")), "id")
    close = agreeing(least)
    links = cut(verified(bucket_pairs(reps, close, sides=True), signs, close, least), "p5-links")
    return members, links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def on_both_sides(articles: DataFrame) -> DataFrame:
    """(id) of the ids that have a train row and an evaluation row."""
    split = F.lower(F.trim("split_name"))
    rows = articles.where("id is not null").groupBy("id").agg(F.max(split.isin(*TRAIN)).alias("tr"), F.max(split.isin(*EVALUATION)).alias("ev"))
    return rows.where("tr and ev").select("id")


def overlaps(articles: DataFrame, run: int = RUN, least_words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(eval_id, train_id, similarity): every pair of which train_id has a train row and eval_id a test or validation row, with the same or nearly the same text, or the same id.

    Equal ids overlap whatever their text (similarity 1), also those of few words or none. split_name is compared in lower case without spaces
    around; rows of other or null splits and rows without an id don't count. A pair of two ids that are both on both sides comes out both ways round.
    """
    members, both = classed(articles, run, least_words, least)
    ev, tr = members.where("ev").select(F.col("rep").alias("a"), F.col("id").alias("eval_id")), members.where("tr").select(F.col("rep").alias("b"), F.col("id").alias("train_id"))
    across = both.join(ev, "a").join(tr, "b").select("eval_id", "train_id", "similarity")
    mixed = members.where("any_tr and any_ev")
    inside = mixed.where("ev").select("rep", F.col("id").alias("eval_id")).join(mixed.where("tr").select("rep", F.col("id").alias("train_id")), "rep")
    inside = inside.where("eval_id <> train_id").select("eval_id", "train_id", F.lit(1.0).alias("similarity"))
    same = on_both_sides(articles).select(F.col("id").alias("eval_id"), F.col("id").alias("train_id"), F.lit(1.0).alias("similarity"))
    return across.unionByName(inside).unionByName(same)


def overlap_counts(articles: DataFrame, run: int = RUN, least_words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, pairs): how many pairs of ``overlaps`` an evaluation article is in, if any. Counted by the sizes of classes; no pairs of copies are made."""
    members, both = classed(articles, run, least_words, least)
    sizes = cut(members.groupBy("rep").agg(F.count_if("tr").alias("n_tr")), "p5-sizes")
    near = both.join(sizes.select(F.col("rep").alias("b"), "n_tr"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n_tr").alias("near"))
    each = sizes.join(near, "rep", "left").select("rep", (F.col("n_tr") + F.coalesce("near", F.lit(0))).alias("pairs"))
    # an article on both sides has itself among the train articles of its class; one of too few words is in no class
    own = members.where("ev").select("id", "rep").join(each, "rep").select("id", "pairs")
    alone = on_both_sides(articles).join(members.select("id"), "id", "left_anti").select("id", F.lit(1).cast("long").alias("pairs"))
    return own.unionByName(alone).where("pairs > 0")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that overlap across the splits, each once, and ids that do."""
    found = overlaps(table(spark, folder, "articles"))
    return found.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation split and source: its articles, those that overlap with train, and the overlapping pairs. A null source is a source."""
    articles = table(spark, folder, "articles")
    pairs = overlap_counts(articles)
    split = F.lower(F.trim("split_name"))
    rows = articles.where(split.isin(*EVALUATION) & F.col("id").isNotNull()).select("id", split.alias("split_name"), "source").distinct()
    joined = rows.join(pairs, "id", "left")
    return joined.groupBy("split_name", "source").agg(F.count("*").alias("articles"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
