"""Problem 3: articles that were reprinted with edits.

Fingerprint: ``HASHES`` minimum hashes of an article's shingles, 32 bits of each. Segments: the 8 bits of each byte; the embedding is the
vector of bits set per segment, 480 counts from 0 to 8. Two fingerprints differ in at least as many bits as the Manhattan distance of their
vectors (each segment's counts differ by no more than its bits), so that distance is a lower bound that needs no fingerprints.

Grid range-join: a cell is the counts of the 12 segments of ``BAND`` minimum hashes, side 1; each article lies in one cell of each of
the 40 projections of the grid. A pair of the similarity looked for shares a cell of some projection but for a chance of 6e-5 at 0.6, less above.
Pairs that share a cell and whose whole vectors are within the Manhattan radius are verified by exact Jaccard similarity. The radius is the
expected distance at the least similarity and five deviations more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shingles import BAND, HASHES, bucket_pairs, classes, components, signed, texts_of, verified
from tidewire.llm.words import mix
from tidewire.sources.tables import table
from tidewire.storage import cut

#: Words of a shingle, words below which an article doesn't count, least similarity: as the problem states them.
RUN, WORDS, LEAST = 3, 20, 0.6
#: Mean and second moment of the difference of the bits set in two unrelated bytes, whose bits are fair coins.
_MEAN = float(np.mean([abs(a.bit_count() - b.bit_count()) for a in range(256) for b in range(256)]))
_SQUARE = 4.0


def embed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells and the vector (two counts a byte) of minimum hashes, a row each."""
    counts = np.bitwise_count(np.ascontiguousarray(hashes.astype(np.uint32)).view(np.uint8).reshape(len(hashes), -1))
    packed = counts[:, 0::2] | counts[:, 1::2] << 4
    cell = packed.reshape(len(hashes), HASHES // BAND, -1).astype(np.uint64)
    key = np.zeros(cell.shape[:2], np.uint64)
    for i in range(cell.shape[2]):
        key = key << np.uint64(8) | cell[:, :, i]
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(64) + np.arange(cell.shape[1], dtype=np.uint64)), packed


def radius(least: float = LEAST) -> float:
    """Manhattan distance that a pair of this similarity passes but for a chance of 3e-7."""
    differ = 1 - least
    mean = differ * 4 * _MEAN
    square = differ * (4 * _SQUARE + 12 * _MEAN**2)
    return HASHES * mean + 5 * np.sqrt(HASHES * (square - mean**2))


def within(least: float):
    """Test of two arrays of packed vectors, row by row."""
    most = radius(least)

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low = np.abs((x & 15).astype(np.int16) - (y & 15)).sum(1, dtype=np.int64)
        return low + np.abs((x >> 4).astype(np.int16) - (y >> 4)).sum(1, dtype=np.int64) <= most

    return close


def near_duplicates(articles: DataFrame, run: int = RUN, least_words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between class representatives, a < b, and members (id, rep) of all articles with enough words.

    An article's words are those of hl and then of body; null is empty. Rows of an id are one article, rows without an id are left out. Articles
    with the same set of shingles are one class (similarity 1), whatever their number. No link between classes is dropped for the size of a
    bucket. Other columns of any name aren't read.
    """
    signs = cut(signed(texts_of(articles), embed, run, least_words, []), "p3-signed")
    members = cut(classes(signs, {}), "p3-members")
    reps = signs.join(members.where("id = rep").select("id"), "id", "left_semi")
    close = within(least)
    links = cut(verified(bucket_pairs(reps, close), signs, close, least), "p3-links")
    return links, members


def groups(articles: DataFrame, **settings: float) -> DataFrame:
    """(id, group_id, class_id, class_size, links, similarity): articles that have a near duplicate or a copy.

    group_id: the least id connected by links; class_id: the least id with the same shingles; links: other classes that this class is linked to;
    similarity: the greatest similarity to another member (1 in a class of several).
    """
    links, members = near_duplicates(articles, **settings)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    degree = both.groupBy("a").agg(F.count("*").alias("links"), F.max("similarity").alias("best")).withColumnRenamed("a", "rep")
    size = members.groupBy("rep").agg(F.count("*").alias("class_size"))
    part = components(links).withColumnRenamed("id", "rep")
    rows = members.join(size, "rep").join(degree, "rep", "left").join(part, "rep", "left").where("class_size > 1 or links > 0")
    similarity = F.when(F.col("class_size") > 1, 1.0).otherwise(F.col("best"))
    return rows.select("id", F.coalesce("group", "rep").alias("group_id"), F.col("rep").alias("class_id"), "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.round(similarity, 6).alias("similarity"))


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """All (id_a, id_b), id_a < id_b, behind the links and classes; as many rows as there are such pairs."""
    a, b = (members.select(F.col("rep").alias(x), F.col("id").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    own = members.join(members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1"), "rep")
    inside = own.select("rep", F.col("id").alias("x")).join(own.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of near-duplicate articles."""
    return pairs(*near_duplicates(table(spark, folder, "articles")))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate articles."""
    return groups(table(spark, folder, "articles"))
