"""Problem 6: how often every distinct term occurs and in how many records, with a mark on the too rare and the too common.

Heavy-light aggregation. Rows are (field, record, term, occurrences, records): with a record they may repeat and a record counts once for a term; without one, records says how many
the row stands for. Heavy terms are detected in a sample; which are found only decides the way their counts take, never the counts. The heavy terms, at most ``HEAVY``, are broadcast
before anything is shuffled: each task counts their occurrences exactly in local arrays, and of their rows only (record, place of the term) goes on, each once. Those are
brought together by record, all places of a record in one row, and counted in local arrays again, so a term of a third of all rows is a number for each record that holds it.
All other rows are shuffled once, by term: as no light term is more than a small part of the rows, both distinct records and sums are made where they arrive. The union of both tables is summed by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.tables import latest, normalised, table
from tidewire.storage import cut

#: Heavy terms at most; rows of the sample in which they are detected (about); their least share of it.
HEAVY, SAMPLE, SHARE = 2048, 200_000, 1 / 4000
#: Records up to which a term is rare, and the part of all records beyond which it is common (one in so many).
RARE, COMMON = 2, 10

SCHEMA = "field_name string, record string, term string, occurrences long, records long"


def in_records(rows: DataFrame, field: str, record: str, term: Column) -> DataFrame:
    """Rows of (record, term) that may repeat, as rows of ``SCHEMA``. Nothing is shuffled."""
    pairs = rows.select(F.col(record).cast("string").alias("record"), term.alias("term")).where("record is not null and trim(term) <> ''")
    return pairs.select(F.lit(field).alias("field_name"), "record", "term", F.lit(1).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("records"))


def in_arrays(rows: DataFrame, field: str, terms: Column) -> DataFrame:
    """Rows that each hold an array of terms and are one record each -> one row for each record and term: its runs in the sorted array. Nothing is shuffled."""
    held = rows.select(F.array_sort(F.filter(terms, lambda x: x.isNotNull() & (F.trim(x) != ""))).alias("s"))
    held = held.select("s", F.expr("filter(transform(s, (x, i) -> if(i = 0 or x <> s[i - 1], i, -1)), i -> i >= 0)").alias("at"))
    # the outer form, as of a plain explode the optimiser makes a filter that sorts the array once for each entry
    runs = held.select(F.explode_outer(F.expr("transform(at, (i, j) -> struct(s[i] as term, cast(if(j + 1 < size(at), at[j + 1], size(s)) - i as bigint) as n))")).alias("x")).where("x is not null")
    return runs.select(F.lit(field).alias("field_name"), F.lit(None).cast("string").alias("record"), "x.term", F.col("x.n").alias("occurrences"), F.lit(1).cast("long").alias("records"))


def heavy_terms(rows: DataFrame, heavy: int = HEAVY, sample: int = SAMPLE, share: float = SHARE) -> list[tuple[str, str]]:
    """(field_name, term) of the terms of many rows, at most ``heavy``, by a sample."""
    total = rows.count()
    if not total or not heavy:
        return []
    taken = rows.sample(False, min(1.0, sample / total), 17).groupBy("field_name", "term").agg(F.count("*").alias("n"))
    least = max(8, int(min(total, sample) * share))
    return [(r["field_name"], r["term"]) for r in taken.where(F.col("n") >= least).orderBy(F.desc("n"), "field_name", "term").limit(heavy).collect()]


def heavy_light(rows: DataFrame, heavy: int = HEAVY, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """Sums of occurrences and numbers of records by (field_name, term); rows as in ``SCHEMA``. Rows with a null term are left out."""
    spark = rows.sparkSession
    rows = cut(rows.where("term is not null").select("field_name", "record", "term", F.col("occurrences").cast("long"), F.col("records").cast("long")), "p6-rows")
    keys = heavy_terms(rows, heavy, sample, share)
    shared = spark.sparkContext.broadcast({k: i for i, k in enumerate(keys)})  # at most ``heavy`` terms
    names = ["record", "place", "field_name", "term", "occurrences", "records"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        counters = np.zeros((len(place), 2), np.int64)
        for batch in batches:
            field, term = (batch.column(i).dictionary_encode() for i in (0, 2))
            fields, terms = field.dictionary.to_pylist(), term.dictionary.to_pylist()
            table_ = np.array([[place.get((f, t), -1) for t in terms] for f in fields], np.int32).reshape(len(fields), len(terms))
            at = table_[field.indices.to_numpy(), term.indices.to_numpy()] if batch.num_rows else np.empty(0, np.int32)
            hit, alone = at >= 0, pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
            np.add.at(counters[:, 0], at[hit], batch.column(3).to_numpy()[hit])
            np.add.at(counters[:, 1], at[hit & alone], batch.column(4).to_numpy()[hit & alone])
            light = batch.filter(pa.array(~hit))
            yield pa.RecordBatch.from_arrays([light.column(1), pa.nulls(light.num_rows, pa.int32()), light.column(0), light.column(2), light.column(3), light.column(4)], names)
            own = np.flatnonzero(hit & ~alone)
            if len(own):  # each record and place once
                record = batch.column(1).take(pa.array(own)).dictionary_encode()
                _, once = np.unique(record.indices.to_numpy().astype(np.int64) * len(place) + at[own], return_index=True)
                none = [pa.nulls(len(once), kind) for kind in (pa.string(), pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([record.take(pa.array(once)).dictionary_decode(), pa.array(at[own][once]), *none], names)
        seen = np.flatnonzero(counters.any(axis=1))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.nulls(len(seen), pa.string()), pa.nulls(len(seen), pa.string()), pa.array(counters[seen, 0]), pa.array(counters[seen, 1])], names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            counters += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(counters))
        seen = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(np.zeros(len(seen), np.int64)), pa.array(counters[seen])], ["place", "occurrences", "records"])

    parts = cut(rows.mapInArrow(split, "record string, place int, field_name string, term string, occurrences long, records long"), "p6-split")
    # light terms: one shuffle, by term
    light = parts.where("place is null").repartition("field_name", "term")
    light = light.groupBy("field_name", "term", "record").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    light = light.withColumn("records", F.when(F.col("record").isNull(), F.col("records")).otherwise(1)).groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    if not keys:
        return light
    # heavy terms: counters of the tasks, and distinct records by record
    heavy_rows = parts.where("place is not null")
    distinct = heavy_rows.where("record is not null").groupBy("record").agg(F.collect_set("place").alias("places")).select("places").mapInArrow(tally, "place int, occurrences long, records long")
    sums = heavy_rows.where("record is null").select("place", "occurrences", "records").unionByName(distinct).groupBy("place").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    listed = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(keys)], "place int, field_name string, term string")
    return light.unionByName(sums.join(F.broadcast(listed), "place").select("field_name", "term", "occurrences", "records"))


def marked(counts: DataFrame, totals: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """counts with a column mark: ``rare``, ``common`` or null. totals: (field_name, all_records), a row for each field."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common > F.col("all_records"), "common")
    return counts.join(F.broadcast(totals), "field_name").withColumn("mark", mark).drop("all_records")


def term_counts(annotations: DataFrame, articles: DataFrame, tfidf: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records, mark) of every phrase, descriptor and vocabulary term.

    phrase: normalised; an annotation row is an occurrence, its article_id the record. desc: normalised entries of an article's latest row.
    tfidf: the term as it is, df is both numbers, repeated rows once. Null and blank terms and rows without a record don't count.
    """
    single = tfidf.select("model_name", "term", "df", "document_count").distinct()
    newest = latest(articles, "desc_terms")
    df = F.sum(F.col("df").cast("long"))
    own = single.where("trim(term) <> ''").groupBy("term").agg(df.alias("occurrences"), df.alias("records")).select(F.lit("tfidf").alias("field_name"), F.lit(None).cast("string").alias("record"), "term", "occurrences", "records")
    rows = in_records(annotations, "phrase", "article_id", normalised(F.col("phrase")))
    rows = rows.unionByName(in_arrays(newest, "desc", F.transform("desc_terms", normalised))).unionByName(own)
    models = single.groupBy("model_name").agg(F.max("document_count").cast("long").alias("n"))
    totals = annotations.agg(F.count_distinct("article_id").alias("all_records")).select(F.lit("phrase").alias("field_name"), "all_records")
    totals = totals.unionByName(articles.agg(F.count_distinct("id").alias("all_records")).select(F.lit("desc").alias("field_name"), "all_records"))
    totals = totals.unionByName(models.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_records")).select(F.lit("tfidf").alias("field_name"), "all_records"))
    return marked(heavy_light(rows), totals)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(*(table(spark, folder, name) for name in ("annotations", "articles", "tfidf")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return _counts(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every term."""
    return _counts(spark, folder)


_TERMS = r"""
with newest as (select id, r.desc_terms from (select id, arg_max({'desc_terms': desc_terms}, loaded_at) r from articles where id is not null group by id)),
norm as (select 'phrase' field_name, trim(regexp_replace(lower(phrase), '\s+', ' ', 'g')) term, article_id record, 1 n, 1 one from annotations where article_id is not null
 union all select 'desc', trim(regexp_replace(lower(t), '\s+', ' ', 'g')), id, 1, 1 from (select id, unnest(desc_terms) t from newest)),
counts as (select field_name, term, count(*) occurrences, count(distinct record) records from norm where term <> '' group by all
 union all select 'tfidf', term, sum(df), sum(df) from (select distinct * from tfidf) where trim(term) <> '' group by term),
totals as (select 'phrase' field_name, count(distinct article_id) n from annotations
 union all select 'desc', count(distinct id) from articles
 union all select 'tfidf', sum(c) from (select model_name, max(document_count) c from tfidf group by 1))
"""
_MARK = "case when records <= 2 then 'rare' when records * 10 > n then 'common' end"

ORACLES = {
    "p6_found": f"{_TERMS} select field_name, term, {_MARK} mark from counts join totals using (field_name) where {_MARK} is not null",
    "p6_counts": f"{_TERMS} select field_name, term, occurrences::bigint occurrences, records::bigint records, {_MARK} mark from counts join totals using (field_name)",
}
