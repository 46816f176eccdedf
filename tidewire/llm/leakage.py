"""Problem 9: evaluation passages that leaked into training texts.

The items are indexed for BM25: postings by term, cut into blocks of items, each block with the term's greatest contribution. Every
text is cut into overlapping passages, so that every run of ``RUN`` words lies whole in one, and every passage is a query. A passage that
holds ``RUN`` consecutive words of an item scores at least what those words contribute to the item, so each item has a safe threshold:
the least sum over its own runs. Pruning is that of block-max WAND, for a batch of passages at once: first the terms' greatest contributions,
then those of the blocks, against the least threshold they have to reach; only blocks that can reach it are scored. All above threshold are
kept - there is no top k - and verified word by word.

The texts aren't shuffled: the index is broadcast. Its size is bounded by ``INDEX_CHARS``; more items are cut into several indexes, and the
texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.words import WORD, chunks, ranges
from tidewire.sources.tables import table

#: Consecutive words that count as a leak; words of a passage; items of a block.
RUN, PASSAGE, BLOCK = 12, 48, 16
#: Characters of items in one broadcast index (an index takes some ten bytes for each).
INDEX_CHARS = 4_000_000
CHUNK = 1_000_000
K1, B = 1.2, 0.75


class Index:
    """BM25 postings of items in blocks, with the greatest contribution of each term in all and in each block."""

    def __init__(self, ids: list[int], texts: list[str | None], run: int = RUN) -> None:
        listed = [(i, w) for i, t in zip(ids, texts, strict=True) if len(w := WORD.findall((t or "").lower())) >= run]
        self.ids, self.words, self.run = np.array([i for i, _ in listed], np.int64), [w for _, w in listed], run
        self.vocab: dict[str, int] = {}
        rows = [(self.vocab.setdefault(w, len(self.vocab)), i) for i, ws in enumerate(self.words) for w in ws]
        if not rows:
            return
        pair, tf = np.unique(np.array(rows, np.int64), axis=0, return_counts=True)
        self.term, self.item = pair[:, 0], pair[:, 1]
        n, size = len(self.ids), np.array([len(w) for w in self.words])
        df = np.bincount(self.term, minlength=len(self.vocab))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.gain = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.item] / size.mean()))
        self.first = np.searchsorted(self.term, np.arange(len(self.vocab) + 1))
        own = dict(zip(zip(self.item.tolist(), self.term.tolist(), strict=True), self.gain.tolist(), strict=True))
        self.threshold = np.array([min(sum(own[i, self.vocab[w]] for w in set(ws[k : k + run])) for k in range(len(ws) - run + 1)) for i, ws in enumerate(self.words)]) * (1 - 1e-9)
        # blocks: postings are in order of term and item, so a term's block is a run of them
        block = self.item // BLOCK
        self.block_from = np.flatnonzero(np.concatenate([[True], (np.diff(self.term) != 0) | (np.diff(block) != 0)]))
        self.block_to = np.append(self.block_from[1:], len(self.term))
        self.block_of, self.block_gain = block[self.block_from], np.maximum.reduceat(self.gain, self.block_from)
        self.block_first = np.searchsorted(self.term[self.block_from], np.arange(len(self.vocab) + 1))
        self.best = np.maximum.reduceat(self.gain, self.first[:-1])
        self.block_least = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK))

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) that reach the item's threshold. passage, term: the distinct pairs, by passage; n: passages."""
        # 1. no block can give more than the terms' best: passages below every threshold end here
        reach = np.bincount(passage, self.best[term], n) >= self.threshold.min()
        passage, term = passage[keep := reach[passage]], term[keep]
        # 2. what the blocks can give
        count = self.block_first[term + 1] - self.block_first[term]
        at = ranges(self.block_first[term], count)
        owner = np.repeat(np.arange(len(term)), count)
        blocks = len(self.block_least)
        key = passage[owner] * blocks + self.block_of[at]
        cell, place = np.unique(key, return_inverse=True)
        live = (np.bincount(place, self.block_gain[at], len(cell)) >= self.block_least[cell % blocks])[place]
        at, owner = at[live], owner[live]
        # 3. the postings of the blocks that are left
        count = self.block_to[at] - self.block_from[at]
        post, owner = ranges(self.block_from[at], count), np.repeat(owner, count)
        key = passage[owner] * len(self.ids) + self.item[post]
        cell, place = np.unique(key, return_inverse=True)
        score = np.bincount(place, self.gain[post], len(cell))
        hit = score >= self.threshold[cell % len(self.ids)]
        return cell[hit] // len(self.ids), cell[hit] % len(self.ids), score[hit]


def passages(sizes: np.ndarray, run: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in all words) and size of overlapping passages; two neighbours share run - 1 words."""
    step = length - run + 1
    count = np.where(sizes >= run, np.maximum(1, -(-(sizes - run + 1) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    within = ranges(np.zeros(len(sizes), np.int64), count) * step
    start = (np.cumsum(sizes) - sizes)[doc] + within
    return doc, start, np.minimum(length, sizes[doc] - within)


def leaks(texts: DataFrame, items: DataFrame, run: int = RUN, passage: int = PASSAGE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Items that leaked into texts: (doc_id, item_id, run_words, score), a row for each text and item with ``run`` consecutive words in common.

    run_words is the longest common run of the whole text, also where it goes on beyond a passage; score the greatest BM25 score of a passage. Null, empty and short texts
    and items have no rows; so have rows with a null id. Repeated rows of an id count as one text each and give one row. Other columns aren't
    read. Texts are searched whole.
    """
    spark = texts.sparkSession
    docs = texts.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    listed = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, found = -(-chars // index_chars), []
    for part in range(parts):  # each index is bounded; the number of passes over the texts is the items' size over the bound
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().toPandas().sort_values(["item_id", "text"])
        index = Index(rows["item_id"].tolist(), rows["text"].tolist(), run)
        if len(index.ids):
            found.append(docs.mapInArrow(_search(spark, index, run, passage), "doc_id long, item_id long, run_words int, score double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, run_words int, score double")
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    return union.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("score").alias("score"))


def _search(spark: SparkSession, index: Index, run: int, length: int):
    shared = spark.sparkContext.broadcast(index)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        get, runs = index.vocab.get, {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                split = [WORD.findall(t.lower()) for t in texts[part]]
                size = np.fromiter(map(len, split), np.int64, len(split))
                flat = [w for ws in split for w in ws]
                number = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
                doc, start, n = passages(size, run, length)
                pair = np.unique(np.repeat(np.arange(len(doc)), n) * (len(index.vocab) + 1) + number[ranges(start, n)] + 1)
                owner, term = pair // (len(index.vocab) + 1), pair % (len(index.vocab) + 1) - 1
                of, item, score = index.search(owner[term >= 0], term[term >= 0], len(doc))
                out, end = [], np.cumsum(size)
                for p, i, s in zip(of.tolist(), item.tolist(), score.tolist(), strict=True):
                    if i not in runs:
                        if len(runs) > 50_000:
                            runs.clear()
                        runs[i] = {}
                        for k in range(len(index.words[i]) - run + 1):
                            runs[i].setdefault(tuple(index.words[i][k : k + run]), []).append(k)
                    words, most = index.words[i], 0
                    for k in range(start[p], start[p] + n[p] - run + 1):
                        for at in runs[i].get(tuple(flat[k : k + run]), ()):
                            if k > start[p] and at and flat[k - 1] == words[at - 1]:
                                continue  # within the run that began before
                            left = 0
                            while left < at and k - left > end[doc[p]] - size[doc[p]] and flat[k - left - 1] == words[at - left - 1]:
                                left += 1
                            right = run
                            while at + right < len(words) and k + right < end[doc[p]] and flat[k + right] == words[at + right]:
                                right += 1
                            most = max(most, left + right)
                    if most:
                        out.append((int(ids[part.start + doc[p]]), int(index.ids[i]), most, s))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "item_id", "run_words", "score"]).astype({"run_words": "int32"}), preserve_index=False)

    return go


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each item that leaked: in how many documents, and the longest run of words found there."""
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("run_words").alias("run_words"))
