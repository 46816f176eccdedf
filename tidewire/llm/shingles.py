"""Word shingles of articles, classes of exact copies, buckets, and exact verification: what the near-duplicate operators share.

A signed article has the sorted set of its shingles' 64-bit hashes, one or more bucket keys and a small fingerprint. Articles with the
same set are one class with a representative; all later steps see representatives only. Buckets of up to ``HOT`` representatives are joined
with themselves; hotter ones are cut into blocks, and each pair of blocks is compared by fingerprint in one bounded task that emits only what
passes. Pairs are verified by the exact Jaccard similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import WordHasher, chunks, mix, runs_of_words, words
from tidewire.storage import cut

#: Representatives in a bucket beyond which it is cut into blocks of that many.
HOT = 128
#: Minimum hashes of an article, and how many of them make a bucket's key: at a similarity of 0.6 the chance that none of the 40 keys of a pair agrees is 6e-5.
HASHES, BAND = 120, 3
CHUNK = 2_000_000

Sign = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def texts_of(articles: DataFrame, **more: Column) -> DataFrame:
    """One row for each id: hl and body (of the row loaded last), and the aggregates asked for. Rows with a null id are left out."""
    rows = articles.where(F.col("id").isNotNull())
    grouped = rows.groupBy("id").agg(F.max(F.struct("loaded_at", "hl", "body")).alias("row"), *[c.alias(k) for k, c in more.items()])
    return grouped.select("id", F.col("row.hl").alias("hl"), F.col("row.body").alias("body"), *more)


def min_hashes(shingles: np.ndarray, first: np.ndarray, n: int = HASHES) -> np.ndarray:
    """n minimum hashes of each set. first: where each set begins; no set is empty."""
    out = np.empty((len(first), n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            seed = mix(np.array([2 * i + 1, 2 * i + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, i] = np.minimum.reduceat(shingles * (seed[0] | np.uint64(1)) + seed[1], first)
    return mix(out)


def signed(texts: DataFrame, sign: Sign, run: int, least_words: int, keep: list[str]) -> DataFrame:
    """(id, keep..., k1, k2, n_shingles, bands array<long>, print binary, shingles array<long>) of texts (id, keep..., hl, body) with enough words."""
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ["id", *keep])
    schema = f"{kinds}, k1 long, k2 long, n_shingles int, bands array<long>, print binary, shingles array<long>"
    names = ["id", *keep, "k1", "k2", "n_shingles", "bands", "print", "shingles"]

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int64)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            hl, body = batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep) + 2).to_pylist()
            size = np.array([len(a or "") + len(b or "") for a, b in zip(hl, body, strict=True)], np.int64)
            for part in chunks(size, CHUNK):
                split = [words(a) + words(b) for a, b in zip(hl[part], body[part], strict=True)]
                rows = [i for i, w in enumerate(split) if len(w) >= max(least_words, run)]
                if not rows:
                    continue
                split = [split[i] for i in rows]
                n = np.fromiter(map(len, split), np.int64, len(split))
                doc = np.repeat(np.arange(len(split)), n)
                h, at = runs_of_words(hasher(split), doc, run)
                doc = doc[at]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                h, doc = h[new], doc[new]
                sizes = np.bincount(doc, minlength=len(split))
                first = np.cumsum(sizes) - sizes
                with np.errstate(over="ignore"):
                    k1, k2 = np.add.reduceat(mix(h), first), np.bitwise_xor.reduceat(mix(h + np.uint64(77)), first)
                bands, fingerprint = sign(min_hashes(h, first))
                own = batch.slice(part.start, part.stop - part.start).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column(i) for i in range(len(keep) + 1)]
                    + [pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(sizes.astype(np.int32)), lists(bands.reshape(-1), np.full(len(bands), bands.shape[1])), pa.array([x.tobytes() for x in fingerprint], pa.binary()), lists(h, sizes)],
                    names,
                )

    return texts.select("id", *keep, "hl", "body").mapInArrow(go, schema)


def classes(table: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """(id, rep, own columns...): the representative of each article's class - the least id with the same shingles - beside the class's aggregates."""
    key = ["k1", "k2", "n_shingles"]
    reps = table.groupBy(*key).agg(F.min("id").alias("rep"), *[c.alias(k) for k, c in keep.items()])
    return table.select("id", *key, *[c for c in table.columns if c in ("tr", "ev")]).join(reps, key).drop(*key)


def bucket_pairs(table: DataFrame, close: Callable[[np.ndarray, np.ndarray], np.ndarray], sides: bool = False, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a < b, of representatives that share a bucket. table: (id, bands, print), with sides also tr, ev - then one of a pair must have tr and the other ev.

    close(prints, prints) is what hot buckets' blocks emit; it must hold for every pair that counts.
    """
    flags = ["tr", "ev"] if sides else []
    rows = table.select("id", *flags, F.explode("bands").alias("key"))  # an id is one row, and its keys differ
    measure = [F.count("*").alias("n"), *[F.max(c).alias(f"any_{c}") for c in flags]]
    sizes = rows.groupBy("key").agg(*measure).where("n > 1" + " and any_tr and any_ev" * sides).select("key", "n")
    live = cut(rows.join(sizes, "key"), "buckets")
    a, b = (live.where(F.col("n") <= hot).select("key", F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in flags]) for x in "ab")
    cross = F.expr("(tr_a and ev_b) or (ev_a and tr_b)") if sides else F.lit(True)
    small = a.join(b, "key").where((F.col("a") < F.col("b")) & cross).select("a", "b")

    # hot buckets: blocks of about `hot` rows, each pair of blocks a bounded group
    wide = live.where(F.col("n") > hot).join(table.select("id", "print"), "id")
    wide = wide.withColumn("blocks", F.ceil(F.col("n") / hot).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "key"), "blocks").cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "print", *flags)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(rows["print"]), np.uint8).reshape(len(rows), -1)
        left, right = (np.flatnonzero(rows["own"].to_numpy() == rows[x].iloc[0]) for x in "ij")
        found = []
        ids = rows["id"].to_numpy()
        for x in left:
            ys = right[ids[right] > ids[x]] if rows["i"].iloc[0] == rows["j"].iloc[0] else right
            if sides:
                tr, ev = rows["tr"].to_numpy(), rows["ev"].to_numpy()
                ys = ys[(tr[x] & ev[ys]) | (ev[x] & tr[ys])]
            ys = ys[close(np.broadcast_to(prints[x], (len(ys), prints.shape[1])), prints[ys])]
            found += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in ys if ids[x] != ids[y]]
        return pd.DataFrame(found, columns=["a", "b"])

    id_type = table.schema["id"].dataType.simpleString()
    large = wide.groupBy("key", "i", "j").applyInPandas(compare, f"a {id_type}, b {id_type}")
    return small.unionByName(large).distinct()


def verified(pairs: DataFrame, table: DataFrame, close: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> DataFrame:
    """(a, b, similarity) of the pairs with at least the similarity: first by fingerprint, then exactly."""
    id_type = table.schema["id"].dataType.simpleString()
    pairs = cut(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut(table.select("id", "print", "shingles").join(ids, "id", "left_semi"), "pair-sets")
    prints = pairs
    for x in "ab":
        prints = prints.join(wanted.select(F.col("id").alias(x), F.col("print").alias(f"print_{x}")), x)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(close(x, y)))

    near = prints.select("a", "b", "print_a", "print_b").mapInArrow(go, f"a {id_type}, b {id_type}")
    for x in "ab":
        near = near.join(wanted.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")), x)
    common = F.size(F.array_intersect("s_a", "s_b"))
    near = near.select("a", "b", common.alias("common"), (F.size("s_a") + F.size("s_b")).alias("total"))
    similarity = F.col("common") / (F.col("total") - F.col("common"))
    return near.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group): the least id that each node of edges (a, b) is connected with. Minimum labels with pointer jumping; each round is a written table."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).withColumnRenamed("a", "id"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("near")).withColumnRenamed("a", "id")
        step = labels.join(near, "id", "left").select("id", F.col("group").alias("old"), F.least("group", F.coalesce("near", "group")).alias("group"))
        jump = labels.select(F.col("id").alias("group"), F.col("group").alias("far"))
        step = cut(step.join(jump, "group", "left").select("id", "old", F.least("group", F.coalesce("far", "group")).alias("group")), "labels")
        labels = step.select("id", "group")
        if step.where("old <> group").isEmpty():
            return labels
    raise RuntimeError("components didn't settle")
