"""Problem 2: the most similar vectors for every vector.

Inverted file with product quantisation. Coarse centroids and the codebooks of residuals are fitted on a bounded sample; every vector is then
indexed: it is in the list of its nearest centroid, with a byte for each of ``PARTS`` parts of its residual. Each vector is also a query and visits the lists nearest to it. How many is
measured: for ``TESTED`` vectors of each field the exact neighbours are found by one pass over all vectors, and the visits are as many as ``TARGET`` of those neighbours lie in. So the loss of
accuracy is known at any size and for any data: the sharper the clusters, the fewer lists are visited. ``accuracy`` states what came out.

In a list, a matrix product of the queries with the decoded codes gives a score for every entry. What a code leaves out of its vector is known for each
entry, so a score says how great the cosine can be: entries that can't be among the best so far, by ``DEVIATIONS`` times the score's deviation, are left (at 4 a neighbour were lost once in 30,000 if errors were normal; at 8 the bound is a proof);
all others are ranked by their exact cosine, in double precision, from the vectors that lie beside the codes. Entries of the same cosine come by key,
however many they are. The best of all lists visited are the result. Vectors are unit vectors, so the inner product is the cosine. With a target of 1 and 8 deviations the search is exact but for neighbours of vectors not tested; ``visits`` set to all lists makes it exact.

Keys whose vectors have the same direction to twelve digits are one entry with its least keys, so a vector that a third of all keys share is searched once. Lists that follow one another are a shelf of
about ``ROWS`` entries, written once, as one or several files of the shared folder. A task takes at most ``PIECE`` queries of a file and reads the shelves with lists that they visit, the nearest first and ``ROWS`` entries at a time;
it keeps the k best of each query. So no vector is shuffled for a visit and disk grows as the vectors, not as the visits; reading grows as the visits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.sources.tables import derived_key, table
from tidewire.storage import cut

#: Components, neighbours, and the least cosine of a case.
SIZE, K, LEAST = 64, 5, 0.85
#: Vectors of each field that centroids and codebooks are fitted on: eight for each list, but these at least and at most; parts of a vector; codewords of a part.
SAMPLE, SAMPLE_MOST, PARTS, WORDS = 20_000, 65_536, 16, 256
#: Lists at most (there are as many as the root of the vectors), lists that a query visits at least, entries of a shelf, about, and of what is read at a time; queries of a task at most.
LISTS, PROBES, ROWS, PIECE = 8192, 24, 4096, 4096
#: Vectors of each field whose exact neighbours are looked up, and the part of those neighbours that must lie in the lists visited.
TESTED, TARGET = 256, 0.98
#: Deviations of a score within which an entry is ranked exactly.
DEVIATIONS = 4.0


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to a row far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        distance = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        own = distance.argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-(distance[np.arange(len(x)), own]))[: len(empty)]
            c[empty[: len(far)]] = x[far]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Quantiser:
    """Coarse centroids and codebooks of one field."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 5) -> None:
        lists = int(max(1, min(LISTS, round(np.sqrt(total)), len(sample))))
        self.centroids = kmeans(sample, lists, 8, seed, spherical=True)
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(1)]
        width = SIZE // PARTS
        self.words = np.zeros((PARTS, WORDS, width), np.float32)
        for m in range(PARTS):
            part = np.ascontiguousarray(rest[:, m * width : (m + 1) * width])
            k = min(WORDS, len(part))
            self.words[m, :k] = kmeans(part, k, 6, seed + m)
            self.words[m, k:] = self.words[m, 0]

    def code(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Codewords of the residuals, a byte a part."""
        rest = (x - self.centroids[own]).reshape(len(x), PARTS, -1)
        out = np.empty((len(x), PARTS), np.uint8)
        for m in range(PARTS):
            out[:, m] = ((self.words[m] ** 2).sum(1)[None, :] - 2 * rest[:, m] @ self.words[m].T).argmin(1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, also of very large or small ones."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (field_name, key, v) with ``d``: the unit vector's components in units of 1e-12, the same for vectors that differ in length only, but for rounding."""
    for batch in batches:
        x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE).astype(np.float64)) if len(batch) else np.zeros((0, SIZE))
        d = [r.tobytes() for r in np.rint(x * 1e12).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.binary())], ["field_name", "key", "v", "d"])


def valid(rows: DataFrame) -> DataFrame:
    """Rows of (field_name, key, v) with a key and a vector of ``SIZE`` finite components, not all zero; each key once (of several vectors the greatest)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("key").isNotNull() & (F.size("v") == SIZE)).where(finite & F.exists("v", lambda x: x != 0))
    return kept.groupBy("field_name", "key").agg(F.max("v").alias("v"))


def merged(best: np.ndarray, row: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The greatest k of each row of best (ascending) and of the cosines of that row."""
    k = best.shape[1]
    order = np.lexsort((-cosine, row))
    row, cosine = row[order], cosine[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    more = np.full(best.shape, -9.0)
    on = rank < k
    more[row[on], rank[on]] = cosine[on]
    return np.sort(np.concatenate([best, more], axis=1), axis=1)[:, -k:]


def exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows of q and x, some at a time."""
    out = [np.einsum("nd,nd->n", q[row[i : i + 65_536]], x[column[i : i + 65_536]]) for i in range(0, len(row), 65_536)]
    return np.concatenate(out) if out else np.zeros(0)


class Search:
    """The k entries of greatest cosine for each of some queries, list after list; of cosines that are the same to ten digits the least keys.

    q: unit vectors; what is held beside them is k entries for each and ties. Entries are told apart by a number, ``itself`` is a query's own.
    """

    def __init__(self, q: np.ndarray, itself: np.ndarray, k: int, deviations: float = DEVIATIONS) -> None:
        self.q, self.itself, self.k, self.deviations = q, itself, k, deviations
        self.near = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32)
        self.best = np.full((len(q), k), -9.0)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, key, cosine
        self.held = 0

    def visit(self, asking: np.ndarray, x: np.ndarray, decoded: np.ndarray, number: np.ndarray, keys: np.ndarray) -> None:
        """asking: queries; x, decoded: unit vectors of a list's entries and what their codes say; number, keys: of the entries."""
        rest, k, best = x - decoded, self.k, self.best
        # the score of an entry of cosine c is c (1 - x rest) but for what is at right angles to x, whose deviation is that of a random direction
        kept_part = 1 - np.minimum((x * rest).sum(1), 0.999)
        spread = self.deviations / np.sqrt(SIZE) * np.linalg.norm(rest, axis=1) + 1e-5  # single precision adds less than 1e-5
        most = (np.concatenate([decoded, spread[:, None]], axis=1) / kept_part[:, None]).astype(np.float32)
        for begin in range(0, len(asking), 2048):
            part = asking[begin : begin + 2048]
            able_at = self.near[part] @ most.T  # the greatest cosine that an entry can have
            least = best[part, 0].copy()
            new = np.flatnonzero(least < -8)  # a first guess of the k-th best
            if len(new) and len(x) > 4 * k:
                guess = np.argpartition(-able_at[new], 4 * k, axis=1)[:, : 4 * k]
                row, column = np.repeat(new, 4 * k), guess.reshape(-1)
                other = number[column] != self.itself[part[row]]
                row, column = row[other], column[other]
                least[new] = merged(best[part], row, np.round(exact(self.q[part], x, row, column), 10))[new, 0]
            row, column = np.nonzero(able_at >= (least - 1e-6).astype(np.float32)[:, None])
            other = number[column] != self.itself[part[row]]
            row, column = row[other], column[other]
            cosine = exact(self.q[part], x, row, column)
            on = np.round(cosine, 10) >= least[row] - 1e-9
            row, column, cosine = row[on], column[on], cosine[on]
            if len(row):
                best[part] = merged(best[part], row, np.round(cosine, 10))
                on = np.round(cosine, 10) >= best[part[row], 0]
                self.found.append((part[row[on]], keys[column[on]], cosine[on]))
                self.held += int(on.sum())
        if self.held > 8 * k * len(self.q):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, cosine) of the best so far, by query and place."""
        if not self.found:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        query, key, cosine = (np.concatenate(a) for a in zip(*self.found, strict=True))
        on = np.round(cosine, 10) >= self.best[query, 0]
        query, key, cosine = query[on], key[on], cosine[on]
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -np.round(cosine, 10), query))
        query, key, cosine = query[order], key[order], cosine[order]
        on = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.found, self.held = [(query[on], key[on], cosine[on])], int(on.sum())
        return self.found[0]


def stored(file: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a Parquet file of the shared folder, ``ROWS`` at a time; pyarrow reads file, hdfs, s3 and gs."""
    where, path = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", file))
    with where.open_input_file(path) as handle:
        yield from pq.ParquetFile(handle).iter_batches(ROWS, columns=columns, use_threads=False)


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """Unit vectors of a batch's raw ones."""
    return unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float32).reshape(batch.num_rows, SIZE).astype(np.float64))


def tested_ranks(entries: DataFrame, tested: DataFrame, fitted: dict[str, Quantiser], k: int) -> dict[str, tuple[np.ndarray, list]]:
    """For each field the place, in the order of nearness to the tested vector, of the list that holds each of its exact neighbours; and (key, other, cosine) of those.

    One pass over all entries (field_name, key, v) against the tested ones, whose number is bounded; each task passes on k for each.
    """
    spark = entries.sparkSession
    asked = {f: g.sort_values("key") for f, g in tested.toPandas().groupby("field_name")}  # TESTED of each field
    vectors = {f: unit(np.stack(g["v"].to_list()).astype(np.float64)) for f, g in asked.items()}
    shared = spark.sparkContext.broadcast({f: (g["key"].tolist(), vectors[f]) for f, g in asked.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column(0).to_pylist(), object)
            all_keys, raw = np.array(batch.column(1).to_pylist(), object), batch.column(2).flatten().to_numpy().reshape(-1, SIZE)
            for field in sorted(set(fields.tolist()) & set(shared.value)):
                asked_keys, q = shared.value[field]
                at = np.flatnonzero(fields == field)
                keys, x = all_keys[at], unit(raw[at].astype(np.float64))
                order = np.argsort(keys.astype(str))
                keys, x = keys[order], x[order]
                cosine = np.round(q @ x.T, 10)
                cosine[np.array(asked_keys, object)[:, None] == keys[None, :]] = -9
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(q)), top.shape[1])
                column = top.reshape(-1)
                real = cosine[row, column] > -8
                row, column = row[real], column[real]
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(row), pa.string()), pa.array([asked_keys[i] for i in row], pa.string()), pa.array(keys[column].tolist(), pa.string()), pa.array(cosine[row, column])], ["field_name", "key", "other", "cosine"])

    found = entries.mapInArrow(nearest, "field_name string, key string, other string, cosine double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("field_name", "key").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k)
    held = found.join(entries.select("field_name", F.col("key").alias("other"), "v"), ["field_name", "other"]).toPandas()  # k for each tested vector
    out = {}
    for field, group in held.groupby("field_name"):
        centroids, place = fitted[field].centroids, {key: i for i, key in enumerate(asked[field]["key"])}
        own = (unit(np.stack(group["v"].to_list()).astype(np.float64)).astype(np.float32) @ centroids.T).argmax(1)
        near = vectors[field].astype(np.float32)[[place[key] for key in group["key"]]] @ centroids.T
        out[field] = ((near > near[np.arange(len(group)), own][:, None]).sum(1), group[["key", "other", "cosine"]].values.tolist())
    return out


def visits_for(ranks: np.ndarray, lists: int, target: float = TARGET, probes: int = PROBES) -> int:
    """The least number of lists in which ``target`` of the neighbours lie, at least ``probes`` if there are as many."""
    needed = int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1 if len(ranks) else 1
    return min(lists, max(probes, needed))


def by_direction(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (field_name, key, rep, n) of all valid keys, and entries (field_name, key, v), one for each direction."""
    vectors = cut(valid(rows).select("field_name", "key", "v").mapInArrow(direction, "field_name string, key string, v array<float>, d binary").withColumn("h1", F.xxhash64("d")).withColumn("h2", F.xxhash64(F.lit(3), "d")).drop("d"), "p2-vectors")
    same = ["field_name", "h1", "h2"]
    sized = vectors.groupBy(*same).agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    members = cut(vectors.select("key", *same).join(sized, same).drop("h1", "h2"), "p2-members")
    entries = vectors.join(sized.select("field_name", F.col("rep").alias("key")), ["field_name", "key"], "left_semi").select("field_name", "key", "v")
    return members, cut(entries, "p2-entries")


def fit(entries: DataFrame) -> tuple[dict[str, Quantiser], dict[str, int]]:
    """A quantiser for each field, fitted on a bounded sample, and the number of the field's entries."""
    totals = {r[0]: r[1] for r in entries.groupBy("field_name").agg(F.count("*")).collect()}
    fitted = {}
    for field, n in sorted(totals.items()):
        size = min(SAMPLE_MOST, max(SAMPLE, 8 * round(math.sqrt(n))))
        some = entries.where(F.col("field_name") == field).orderBy(F.xxhash64(F.lit(9), "key"), "key").limit(size).select("v").toPandas()["v"]
        fitted[field] = Quantiser(unit(np.stack(some.to_list()).astype(np.float64)).astype(np.float32), n)
    return fitted, totals


def tested_of(entries: DataFrame, fields: list[str], seed: int, tested: int = TESTED) -> DataFrame:
    """``tested`` entries of each field, by hash."""
    some = [entries.where(F.col("field_name") == f).orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(tested) for f in fields]
    out = some[0]
    for more in some[1:]:
        out = out.unionByName(more)
    return out


def neighbours(rows: DataFrame, k: int = K, target: float = TARGET, visits: int | None = None, deviations: float = DEVIATIONS) -> DataFrame:
    """(field_name, key, other, cosine, rank): the k most similar other keys of the same field, by greatest cosine, of equal ones the least key.

    rows: (field_name, key, v array<float>). Null, wrong-sized, non-finite and all-zero vectors and null keys are left out; a key that repeats counts once. Keys with
    the same direction have cosine 1. Cosines equal to ten digits are ties. Fields may be of any number but few, as each has its own centroids.
    target: the part of the neighbours that must lie in the lists visited, measured; visits: lists that a query visits in place of that.
    """
    spark = rows.sparkSession
    members, entries = by_direction(rows)
    fitted, totals = fit(entries)
    if not fitted:
        return spark.createDataFrame([], "field_name string, key string, other string, cosine double, rank int")
    if visits is None:
        ranks = tested_ranks(entries, tested_of(entries, list(fitted), 13), fitted, k)
        visit = {f: visits_for(ranks[f][0] if f in ranks else np.zeros(0), len(q.centroids), target) for f, q in fitted.items()}
    else:
        visit = {f: min(visits, len(q.centroids)) for f, q in fitted.items()}
    per = {f: max(1, ROWS * len(q.centroids) // totals[f]) for f, q in fitted.items()}  # lists of a shelf
    shared = spark.sparkContext.broadcast({f: (q.centroids, q.words) for f, q in fitted.items()})  # bounded by LISTS and WORDS

    names = list(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(2).flatten().to_numpy().reshape(-1, SIZE).astype(np.float32)
            for field in sorted(set(fields.tolist())):
                at = np.flatnonzero(fields == field)
                q = Quantiser.__new__(Quantiser)
                q.centroids, q.words = shared.value[field]
                for part in np.array_split(at, len(at) // 4096 + 1):
                    u = unit(x[part].astype(np.float64)).astype(np.float32)
                    own = (u @ q.centroids.T).argmax(1)
                    code = q.code(u, own)
                    place = [pa.array(np.full(len(part), names.index(field), np.int32)), pa.array((own // per[field]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(part)), pa.array([r.tobytes() for r in x[part]], pa.binary()), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), *place], ["key", "raw", "own", "code", "field", "shelf"])

    placed = entries.mapInArrow(assign, "key string, raw binary, own int, code binary, field int, shelf int")
    placed = cut(placed.hint("rebalance", F.col("field"), F.col("shelf")).sortWithinPartitions("field", "shelf", "own", "key"), "p2-placed", ["field", "shelf"])
    # files of a shelf: what queries read, and what they are read from, some rows at a time; no more numbers than lists and rows / PIECE
    files: dict[int, dict[int, list[str]]] = {}
    for file in sorted(placed.inputFiles()):
        field, shelf = map(int, re.search(r"/field=(\d+)/shelf=(\d+)/", file).groups())
        files.setdefault(field, {}).setdefault(shelf, []).append(file)
    piece = max(PIECE // 16, min(PIECE, -(-sum(totals.values()) // (4 * spark.sparkContext.defaultParallelism))))
    sizes = {tuple(r[0].split("/")[-3:]): r[1] for r in placed.groupBy(F.input_file_name()).agg(F.count("*")).collect()}
    pieces = [(field, shelf, file, begin) for field, of in files.items() for shelf, some in of.items() for file in some for begin in range(0, sizes[tuple(file.split("/")[-3:])], piece)]
    told = spark.sparkContext.broadcast((files, pieces))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield _answers(i, *told.value)

    def _answers(i: int, files: dict, pieces: list) -> pa.RecordBatch:
        """The k nearest of a piece of queries in the lists they visit, read one after the other, the nearest first: what is held is the best so far."""
        field, shelf, file, begin = pieces[i]
        centroids, words = shared.value[names[field]]
        seen, asked, key = 0, [], []
        for rows in stored(file, ["key", "raw"]):
            some = rows.slice(max(0, begin - seen), max(0, min(begin + piece, seen + rows.num_rows) - max(begin, seen))) if seen < begin + piece and begin < seen + rows.num_rows else None
            seen += rows.num_rows
            if some is not None:
                asked.append(unpacked(some))
                key += some.column(0).to_pylist()
            if seen >= begin + piece:
                break
        q = np.concatenate(asked)
        near, visits = q.astype(np.float32) @ centroids.T, visit[names[field]]
        wanted = np.zeros(near.shape, bool)
        np.put_along_axis(wanted, np.argpartition(-near, visits - 1, axis=1)[:, :visits], True, axis=1)
        lists = np.flatnonzero(wanted.any(0))
        number = {other: n for n, other in enumerate(f for of in files[field].values() for f in of)}
        search = Search(q, (number[file] << 40) + begin + np.arange(len(q)), k, deviations)
        closest = near.sum(0)
        order = sorted({int(x) // per[names[field]] for x in lists} & set(files[field]), key=lambda s: (s != shelf, -closest[s * per[names[field]] : (s + 1) * per[names[field]]].max(), s))
        for other in (f for s in order for f in files[field][s]):
            row = number[other] << 40
            for rows in stored(other, ["key", "raw", "own", "code"]):
                own, every = rows.column("own").to_numpy(), np.arange(rows.num_rows)
                keys, x = np.array(rows.column("key").to_pylist(), object), unpacked(rows)
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
                decoded = centroids[own] + np.concatenate([words[m, codes[:, m]] for m in range(PARTS)], axis=1)
                for at in np.split(every, np.flatnonzero(np.diff(own)) + 1):
                    asking = np.flatnonzero(wanted[:, own[at[0]]])
                    if len(asking):
                        search.visit(asking, x[at], decoded[at], row + at, keys[at])
                row += rows.num_rows
        query, others, cosine = search.settle()
        return pa.RecordBatch.from_arrays([pa.array([names[field]] * len(query), pa.string()), pa.array([key[x] for x in query], pa.string()), pa.array(others.tolist(), pa.string()), pa.array(cosine, pa.float64())], ["field_name", "key", "other", "cosine"])

    found = cut(spark.range(0, len(pieces), 1, max(1, len(pieces))).mapInArrow(compare, "field_name string, key string, other string, cosine double"), "p2-found")
    ranked = lambda df, *key: df.withColumn("rank", F.row_number().over(Window.partitionBy("field_name", *key).orderBy(F.round("cosine", 10).desc(), "other"))).where(F.col("rank") <= k)

    # keys with the same vector: any of them is near through its class's least keys; more than k + 1 of those can't be among the k
    least = Window.partitionBy("field_name", "rep").orderBy("key")
    several = members.where("n > 1")
    few = cut(several.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).select("field_name", "rep", F.col("key").alias("twin")), "p2-few")
    wide = found.join(few.withColumnRenamed("rep", "other"), ["field_name", "other"], "left").select("field_name", "key", F.coalesce("twin", "other").alias("other"), "cosine")
    wide = ranked(wide, "key").drop("rank")  # the same for all keys of a class
    mine = several.select("field_name", F.col("rep"), F.col("key").alias("own"))
    wide = wide.join(mine.withColumnRenamed("rep", "key"), ["field_name", "key"], "left").select("field_name", F.coalesce("own", "key").alias("key"), "other", "cosine")
    twins = mine.join(few, ["field_name", "rep"]).where("own <> twin").select("field_name", F.col("own").alias("key"), F.col("twin").alias("other"), F.lit(1.0).alias("cosine"))
    return ranked(wide.unionByName(twins), "key")


def accuracy(rows: DataFrame, k: int = K, target: float = TARGET, tested: int = TESTED) -> DataFrame:
    """(field_name, vectors, lists, visited, recall): the part of the exact neighbours of ``tested`` vectors, others than those the visits were set by, that ``neighbours`` gives. Any key counts as one of the k neighbours if its cosine is that of the last of them or more."""
    spark = rows.sparkSession
    _, entries = by_direction(rows)
    fitted, totals = fit(entries)
    schema = "field_name string, vectors long, lists int, visited int, recall double"
    if not fitted:
        return spark.createDataFrame([], schema)
    ranks = tested_ranks(entries, tested_of(entries, list(fitted), 13), fitted, k)
    other = tested_ranks(entries, tested_of(entries, list(fitted), 29, tested), fitted, k)
    wanted = [(f, *pair) for f, (_, pairs) in other.items() for pair in pairs]
    listed = spark.createDataFrame(wanted, "field_name string, key string, other string, cosine double").groupBy("field_name", "key").agg(F.sort_array(F.collect_list("cosine"), False).alias("wanted"))  # k for each of the tested
    got = neighbours(rows, k, target).groupBy("field_name", "key").agg(F.sort_array(F.collect_list("cosine"), False).alias("got"))
    hits = F.least(F.size("wanted"), F.size(F.filter("got", lambda g: g >= F.element_at("wanted", -1) - 1e-9)))
    by = {r["field_name"]: r["recall"] for r in listed.join(got, ["field_name", "key"], "left").groupBy("field_name").agg((F.sum(F.coalesce(hits, F.lit(0))) / F.sum(F.size("wanted"))).alias("recall")).collect()}
    return spark.createDataFrame([(f, totals[f], len(q.centroids), visits_for(ranks[f][0] if f in ranks else np.zeros(0), len(q.centroids), target), by.get(f)) for f, q in fitted.items()], schema)


def stored_vectors(models: DataFrame, annotations: DataFrame) -> DataFrame:
    """(field_name, key, v) of neural_models.features by id and of annotations.w2v by derived key."""
    own = models.select(F.lit("features").alias("field_name"), F.col("id").alias("key"), F.col("features").alias("v"))
    key = derived_key(*(F.col(c) for c in ("fb", "wd", "db", "phrase")))
    return own.unionByName(annotations.where("w2v is not null").select(F.lit("w2v").alias("field_name"), key.alias("key"), F.col("w2v").alias("v")))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar others of every key."""
    return neighbours(stored_vectors(table(spark, folder, "neural_models"), table(spark, folder, "annotations")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keys, one of which is among the five most similar of the other, with a cosine of 0.85 or more."""
    near = p2_neighbours(spark, folder).where(F.col("cosine") >= LEAST)
    return near.select("field_name", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def p2_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """The stated loss of accuracy of p2_neighbours."""
    return accuracy(stored_vectors(table(spark, folder, "neural_models"), table(spark, folder, "annotations")))
