"""Problem 10: long stretches of text that another record holds character for character.

Tokens are the ``GRAM`` characters that begin at each place, so that a stretch may begin anywhere, inside a word too. Each has a hash under each of ``HASHES``
functions; a subsequence's signature is its least token hash under each.

1. compact windows: the nodes of the Cartesian tree over a text's token hashes that span the least length - about two for every 270 characters. A node
   is (l, c, r): all subsequences within l to r that hold the token c have its hash as least one. Nodes that can't hold a stretch aren't
   visited. Equal least hashes close together, as in repeats, are one node with a range of c.
2. interval join: a node stands for an interval of starts of stretches of exactly ``LEAST`` characters; longer ones are unions of those. The intervals of
   all hash functions are joined where they overlap, which gives intervals of starts with the same least hash under every function: (signatures, document, interval).
   Two texts that hold the same stretch have an interval of the same signatures for it, whatever the functions, so nothing is lost; two functions in place of one leave
   few that agree by chance, as when texts share a phrase that is too short. Signatures of two documents or more are live, by a partial minimum and maximum of the
   document: no pairs of documents are made, so a signature of a third of all texts is no more work than another.
3. verification: the texts of live intervals, met by document (one shuffle of the texts that have any, each whole text once). Each start in a live interval stands for
   a stretch; stretches of one signature with the same 128 bits of hash are the same. Those of two documents are shared. Intervals with up to ``HOT`` documents
   are grouped as they are, all stretches of an interval in one row; the stretches of hotter ones are rows of their own, counted by partial aggregation.
4. the union of the shared starts' stretches gives maximal runs.

Exact copies of a whole text are one text with a number of copies: with two or more, the whole text is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.words import chunks, mix, ranges
from tidewire.sources.tables import table
from tidewire.storage import cut

#: Characters of the least stretch and of a token; hash functions.
LEAST, GRAM, HASHES = 300, 32, 2
#: Texts of an interval up to which its stretches are grouped in one row each.
HOT = 128
CHUNK = 1_000_000


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the number of each text's."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def rolling(points: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the ``length`` characters from each place on (as if zeros followed), by doubling: polynomial, modulo 2 ** 64, then mixed."""
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1) | 1
    n = len(points)
    now = mix(points.astype(np.uint64) + np.uint64(1 + 0x51ED27 * seed))
    out, have, width = np.zeros(n, np.uint64), 0, 1

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        y = np.zeros(n, np.uint64)
        if k < n:
            y[: n - k] = x[k:]
        return y

    with np.errstate(over="ignore"):
        while width <= length:
            if length & width:
                out = out * np.uint64(pow(base, width, 2**64)) + ahead(now, have)
                have += width
            if width * 2 <= length:
                now = now * np.uint64(pow(base, width, 2**64)) + ahead(now, width)
            width *= 2
    return mix(out)


def compact_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Rows (l, first c, last c, r) of the Cartesian tree's nodes over values that span ``width`` or more.

    The subsequences of a row are those within l to r that begin at last c or before and end at first c or after; their least value is that of c. Every
    subsequence of ``width`` values or more is of exactly one row. Of several equal least values those less than ``width`` apart are one row; parts between others are nodes of their own.
    """
    out, todo = [], [(0, len(values) - 1)]
    while todo:
        left, right = todo.pop()
        if right - left + 1 < width:
            continue
        part = values[left : right + 1]
        at = np.flatnonzero(part == part.min()) + left
        if len(at) == 1:
            first = last = int(at[0])
            out.append((left, first, last, right))
        else:
            gap = np.flatnonzero(np.diff(at) > width)
            firsts, lasts = at[np.concatenate([[0], gap + 1])].tolist(), at[np.concatenate([gap, [len(at) - 1]])].tolist()
            first, last = firsts[0], lasts[-1]
            begin = left
            for f, e in zip(firsts, lasts, strict=True):
                if begin != left:
                    todo.append((begin, f - 1))
                out.append((begin, f, e, right))
                begin = e + 1
        todo.append((left, first - 1))
        todo.append((last + 1, right))
    return np.array(out, np.int64).reshape(-1, 4)


def start_runs(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of starts of subsequences of exactly ``width`` values with the same least one: where each begins, in order, and that value. An interval ends where the next begins."""
    w = compact_windows(values, width)
    begin = np.maximum(w[:, 0], w[:, 1] - width + 1)
    order = np.argsort(begin)
    return begin[order], values[w[order, 1]]


def intervals(points: np.ndarray, sizes: np.ndarray, length: int, gram: int, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, signature) of the intervals of starts, in all texts, that have the same least token hash under every function."""
    begin, width = np.cumsum(sizes) - sizes, length - gram + 1
    tokens = rolling(points, gram, 0)
    views = [tokens] + [mix(tokens ^ mix(np.array([j], np.uint64))) for j in range(1, hashes)]
    docs, firsts, marks = [], [], []
    for d in np.flatnonzero(sizes >= length).tolist():
        runs = [start_runs(v[begin[d] : begin[d] + sizes[d] - gram + 1], width) for v in views]
        cells = np.unique(np.concatenate([r[0] for r in runs]))
        mark = np.zeros(len(cells), np.uint64)
        with np.errstate(over="ignore"):
            for at, least in runs:  # a cell lies in one interval of each function
                mark = mix(mark * np.uint64(0x9E3779B97F4A7C15) + least[np.searchsorted(at, cells, side="right") - 1])
        docs.append(np.full(len(cells), d))
        firsts.append(cells)
        marks.append(mark)
    if not docs:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    doc, first, mark = np.concatenate(docs), np.concatenate(firsts), np.concatenate(marks)
    last = np.append(first[1:], 0) - 1
    end = np.append(doc[1:] != doc[:-1], True)
    last[end] = sizes[doc[end]] - length
    return doc, first, last, mark


def shared_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, hashes: int = HASHES) -> DataFrame:
    """Maximal runs of characters shared with another record: (doc_id, span_start, span_end), offsets in code points, end exclusive.

    A character is shared if it lies in a stretch of ``least`` characters that occurs, character by character, in the text of another
    doc_id. Null, empty and shorter texts have no rows, nor have rows with a null id. Rows that repeat an id and its text count once; a stretch
    held twice by one document only isn't shared. Other columns aren't read. Texts are read whole.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = texts.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & (F.char_length("text") >= least))

    # exact copies: one text stands for all of them; 128 bits of hash and the length tell texts apart
    copy_key = ["k1", "k2", "n_chars"]
    members = cut(docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), F.char_length("text").alias("n_chars")), "spans-keys")
    copied = members.groupBy(*copy_key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last")
    copies = cut(members.join(copied, copy_key).select("doc_id", "rep", "n_chars").distinct(), "spans-copies")
    others = copies.where("doc_id <> rep").select("doc_id")

    # 1. and 2. intervals, and those of two documents
    marks = cut(docs.mapInArrow(_signatures(least, gram, hashes), "signature long, doc_id long, first int, last int").join(others, "doc_id", "left_anti"), "spans-intervals")
    live = marks.groupBy("signature").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    live = marks.join(live.select("signature", (F.col("n") > hot).alias("hot")), "signature")

    # 3. the live intervals' text; a document has at most one for each character
    wanted = live.groupBy("doc_id").agg(F.collect_list(F.struct("signature", "hot", "first", "last")).alias("live"))
    kinds = "signature long, hot boolean, doc_id long, start int, context string"
    contexts = cut(docs.join(wanted, "doc_id").select("doc_id", "text", "live").mapInArrow(_contexts(least), kinds), "spans-contexts")

    spans = "doc_id long, span_start int, span_end int"
    cold = contexts.where("not hot").repartition(n, "signature").sortWithinPartitions("signature").mapInArrow(_shared(least), spans)
    starts = contexts.where("hot").mapInArrow(_starts(least), "signature long, h1 long, h2 long, doc_id long, start int")
    same = ["signature", "h1", "h2"]
    two = starts.groupBy(*same).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select(*same)
    warm = starts.join(two, same).select("doc_id", F.col("start").alias("span_start"), (F.col("start") + least).alias("span_end"))
    whole = copies.select("doc_id", F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end"))

    # 4. maximal runs
    by_doc = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    spans = cold.unionByName(warm).unionByName(whole).withColumn("reach", F.max("span_end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.count_if(F.col("reach").isNull() | (F.col("span_start") > F.col("reach"))).over(by_doc))
    runs = spans.groupBy("doc_id", "run").agg(F.min("span_start").cast("long").alias("span_start"), F.max("span_end").cast("long").alias("span_end"))
    return runs.select("doc_id", "span_start", "span_end")


def _signatures(least: int, gram: int, hashes: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                doc, first, last, mark = intervals(*code_points(texts[part]), least, gram, hashes)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(mark.astype(np.int64)), pa.array(ids[part][doc]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["signature", "doc_id", "first", "last"])

    return go


def _contexts(least: int):
    """Of each text the characters that the stretches of its live intervals cover."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(live.offsets.to_numpy()))
            texts, flat = batch.column(1).to_pylist(), live.flatten()
            signature, hot, first, last = (flat.field(i) for i in range(4))
            start, end = first.to_numpy().tolist(), (last.to_numpy() + least).tolist()
            for part in chunks(np.asarray(last.to_numpy() - first.to_numpy() + least, np.int64), CHUNK):
                own, n = owner[part], part.stop - part.start
                context = [texts[d][s:e] for d, s, e in zip(own.tolist(), start[part], end[part], strict=True)]
                ids = batch.column(0).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([signature.slice(part.start, n), hot.slice(part.start, n), ids, first.slice(part.start, n), pa.array(context, pa.string())], ["signature", "hot", "doc_id", "start", "context"])

    return go


def _hashes(contexts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every stretch in the contexts: the context's number, the place in it, and two hashes."""
    points, sizes = code_points(contexts)
    count = np.maximum(0, sizes - least + 1)
    places, which = ranges(np.cumsum(sizes) - sizes, count), np.repeat(np.arange(len(sizes)), count)
    return which, ranges(np.zeros(len(sizes), np.int64), count), rolling(points, least, 1)[places], rolling(points, least, 2)[places]


def _shared(least: int):
    """Shared stretches of intervals: rows come in order of signature, and all rows of a signature to one task."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        signature, doc, start = (rows.column(i).to_numpy() for i in ("signature", "doc_id", "start"))
        which, place, h1, h2 = _hashes(rows.column("context").to_pylist(), least)
        order = np.lexsort((h2, h1, signature[which]))
        s, a, b, d = signature[which][order], h1[order], h2[order], doc[which][order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        shared = np.zeros(len(which), bool)
        shared[order] = np.repeat(two, np.diff(np.append(first, len(order))))
        # runs of neighbouring shared starts of one context
        on = np.flatnonzero(shared)
        cut_at = np.concatenate([[True], (np.diff(on) != 1) | (np.diff(which[on]) != 0)]) if len(on) else np.empty(0, bool)
        head = on[cut_at]
        tail = on[np.append(np.flatnonzero(cut_at)[1:], len(on)) - 1] if len(on) else head
        at = start[which[head]] + place[head]
        end = start[which[tail]] + place[tail] + least
        return pa.RecordBatch.from_arrays([pa.array(doc[which[head]], pa.int64()), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "span_start", "span_end"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, chars = [], 0
        for batch in batches:
            sizes = np.fromiter(map(len, batch.column(4).to_pylist()), np.int64, batch.num_rows)
            for part in chunks(sizes, CHUNK // 4):
                kept.append(pa.Table.from_batches([batch.slice(part.start, part.stop - part.start)]))
                chars += int(sizes[part].sum())
                if chars >= CHUNK:  # all but the last signature, which may go on
                    rows = pa.concat_tables(kept)
                    signature = rows.column("signature").to_numpy()
                    upto = int(np.flatnonzero(signature != signature[-1])[-1]) + 1 if (signature != signature[-1]).any() else 0
                    if upto:
                        yield solve(rows.slice(0, upto))
                    kept = [rows.slice(upto)]
                    chars = sum(map(len, kept[0].column("context").to_pylist()))
        if kept and (rows := pa.concat_tables(kept)).num_rows:
            yield solve(rows)

    return go


def _starts(least: int):
    """Every stretch of hot intervals as a row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for part in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK):
                signature, doc, start = (batch.column(i).to_numpy()[part] for i in (0, 2, 3))
                which, place, h1, h2 = _hashes(texts[part], least)
                yield pa.RecordBatch.from_arrays([pa.array(signature[which]), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), pa.array(doc[which]), pa.array((start[which] + place).astype(np.int32))], ["signature", "h1", "h2", "doc_id", "start"])

    return go


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal shared runs of every document."""
    return shared_spans(table(spark, folder, "documents"))


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every text is shared elsewhere: (doc_id, n_chars, shared_chars, share); documents with nothing shared have 0, null texts null."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    shared = shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"))
    joined = sized.join(shared, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return joined.withColumn("share", F.round(F.try_divide("shared_chars", "n_chars"), 6))
