"""Orders, samples, splits, balance and set operations on the articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import enrich, splits, stats
from tidewire.plans.base import ANN, ART, LAB, anns, arts, norm, query
from tidewire.sources.tables import normalised, table


#: Sizes of the training sets of a learning curve; one beyond the table takes the whole table.
SWEEP = sorted({100, 250, 500, 1000, 2000, 3000, 5000, 10_000, 20_000, 50_000, 100_000, 200_000, 500_000, *range(5000, 200_000, 5000)})


def _luck(*parts: str, seed: int = splits.SEED) -> str:
    return f"md5('{seed}|' || {' || \'|\' || '.join(f'{p}::varchar' for p in parts)})"


def _share(*parts: str, seed: int = splits.SEED) -> str:
    return f"(('0x' || substr({_luck(*parts, seed=seed)}, 1, 8))::bigint / 4294967296.0)"


@query(f"with {ART} select id, wc, row_number() over (order by wc desc nulls last, id) place from art")
def sorted_articles(spark, d):
    """Articles by length, longest first, with their place."""
    rows = splits.with_index(arts(spark, d, "wc"), F.coalesce(-F.col("wc"), F.lit(2**31 - 1)), "id")
    return rows.select("id", "wc", (F.col("idx") + 1).alias("place"))


@query(f"with {ART} select id, row_number() over (order by {_luck('id')}, id) - 1 idx from art")
def hash_shuffle(spark, d):
    """Articles in a random order that the seed fixes."""
    return splits.with_index(arts(spark, d, "split_name"), splits.luck("id"), "id").select("id", "idx")


@query(f"with {ART} select id, id::bigint number from art where len(iptc) > 0 and regexp_full_match(id, '[0-9]{{1,18}}') order by number desc limit 100000")
def newest_articles(spark, d):
    return splits.newest(arts(spark, d, "iptc")).select("id", "number")


@query(f"with {ART}, {LAB} select label, id from (select *, row_number() over (partition by label order by id) r from lab) where r <= 3")
def first_per_label(spark, d):
    return splits.first_of_each(stats.labels_of(arts(spark, d, "iptc")), "label", 3, "id").select("label", "id")


@query(f"with {ANN} select article_id, term, ann_offset from (select *, row_number() over (partition by article_id order by ann_offset, term) r from ann) where r <= 5")
def first_by_offset(spark, d):
    return splits.first_of_each(anns(spark, d), "article_id", 5, F.asc_nulls_last("ann_offset"), "term").select("article_id", "term", "ann_offset")


@query(f"with {ART} select id from art where {_share('id')} < 0.3")
def bernoulli_sample(spark, d):
    return splits.bernoulli(arts(spark, d, "split_name"), 0.3, "id").select("id")


@query(f"with {ART}, n as (select count(*) n from art), c as (select range copy, floor({_share('range', seed=0)} * n)::bigint idx from n, range(50)), o as (select id, row_number() over (order by id) - 1 idx from art) select id || '_' || copy id from c join o using (idx)")
def sample_with_replacement(spark, d):
    rows = arts(spark, d, "split_name").select("id")
    return splits.draw_with_replacement(rows, spark.range(1).select(F.lit(50).alias("n")), "id")


@query(f"with {ART} select id, case when u < 0.6 then 'train' when u < 0.8 then 'validation' else 'test' end part from (select id, {_share('id')} u from art)")
def random_split(spark, d):
    return splits.random_split(arts(spark, d, "split_name"), {"train": 0.6, "validation": 0.2, "test": 0.2}, "id").select("id", "part")


@query(f"with {ART} select id, case when r < floor(n * 6 / 10) then 'train' when r < floor(n * 8 / 10) then 'test' else 'validation' end part from (select id, row_number() over (order by id) - 1 r, count(*) over () n from art)")
def ordered_split(spark, d):
    return splits.ordered_split(arts(spark, d, "split_name").select("id"), "id")


_LEN = "row_number() over (order by wc nulls first, id) - 1 r, count(*) over () n"


@query(f"with {ART} select id, least(r // (n // 5), 4)::int bucket from (select id, {_LEN} from art)")
def static_buckets(spark, d):
    return splits.static_buckets(arts(spark, d, "wc"), 5, F.coalesce("wc", F.lit(-(2**31))), "id").select("id", "bucket")


@query(f"with {ART}, p as (select id, r, n // 5 s from (select id, {_LEN} from art)) select id, (r // s)::int bucket from p where r < 5 * s union all select id, (r // s + 1)::int bucket from p where r < 4 * s and r % s = s - 1")
def static_buckets_compat(spark, d):
    return splits.static_buckets(arts(spark, d, "wc"), 5, F.coalesce("wc", F.lit(-(2**31))), "id", compat=True).select("id", "bucket")


@query(f"with {ART}, p as (select id, row_number() over (order by id) - 1 r, count(*) over () / 2.6 s from art), q as (select id, r, round(0.6 * s)::bigint t, round(0.2 * s)::bigint h from p), b as (select id, h, case when r < t then -1 else (r - t) // (2 * h) end bucket from q) select id, bucket::int bucket, case when bucket < 0 then 'train' when row_number() over (partition by bucket order by {_luck('id')}, id) <= h then 'test' else 'validation' end part from b where bucket < 5")
def relative_buckets(spark, d):
    return splits.relative_buckets(arts(spark, d, "split_name").select("id"), 5, "id", "id").select("id", "bucket", "part")


@query(f"with {ART}, {ANN}, r as (select term, split_name from ann join art on article_id = id) select term from r where split_name = 'train' intersect select term from r where split_name <> 'train'")
def excluded_terms(spark, d):
    rows = anns(spark, d).join(arts(spark, d, "split_name").withColumnRenamed("id", "article_id"), "article_id")
    return splits.excluded_terms(rows.select("term", "split_name"), "split_name", "term")


_POS = f"coalesce(list_contains(list_transform(iptc, lambda x: {norm('x')}), 'sport'), false)"


def _sport():
    return F.exists(F.transform("iptc", normalised), lambda x: F.coalesce(x == "sport", F.lit(False)))


@query(f"with {ART}, p as (select id, {_POS} pos from art), n as (select count(*) n from p where pos) select id, pos from (select *, row_number() over (partition by pos order by {_luck('id')}, id) r from p), n where pos or r <= n")
def balanced_subsample(spark, d):
    rows = arts(spark, d, "iptc").select("id", F.coalesce(_sport(), F.lit(False)).alias("pos"))
    return splits.balanced(rows, "id", F.col("pos"))


@query(f"with {ART}, p as (select id, {_POS} pos from art), k as (select count(*) filter (where pos) n, count(*) filter (where not pos) m from p), c as (select unnest(range(m)) copy, n from k), o as (select id, row_number() over (order by id) - 1 idx from p where pos) select id, pos from p union all select o.id || '_' || copy, true from (select copy, floor({_share('copy', seed=0)} * n)::bigint idx from c) join o using (idx)")
def supersample(spark, d):
    rows = arts(spark, d, "iptc").select("id", F.coalesce(_sport(), F.lit(False)).alias("pos"))
    return splits.supersampled(rows, "id", F.col("pos"))


@query(f"with {ART}, {LAB}, n as (select min(c) n from (select count(*) c from lab group by label)) select distinct id from (select id, row_number() over (partition by label order by {_luck('id', 'label')}, id) r from lab), n where r <= n")
def label_subsample(spark, d):
    return splits.subsample_labels(arts(spark, d, "iptc"))


@query(f"with {ART}, {LAB}, c as (select label, count(*) n from lab group by 1), m as (select max(n) m from c), w as (select label, n, unnest(range(1, m - n + 1)) copy from c, m), o as (select label, id, row_number() over (partition by label order by id) - 1 idx from lab) select label, id, 0::bigint copy from lab union all select label, id, copy from (select label, copy, floor({_share('label', 'copy')} * n)::bigint idx from w) join o using (label, idx)")
def label_supersample(spark, d):
    return splits.supersample_labels(arts(spark, d, "iptc"))


@query(f"with {ART}, p as (select id, row_number() over (order by id) - 1 r from art) select id, s.prefix from p join (select unnest({SWEEP}) prefix) s on r < s.prefix")
def prefix_sweep(spark, d):
    return splits.prefixes(arts(spark, d, "split_name").select("id"), SWEEP, "id")


@query("select c_custkey k, c_nationkey n from customer union all select s_suppkey, s_nationkey from supplier")
def union_all(spark, d):
    a, b = _keys(spark, d)
    return a.unionByName(b)


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))


@query("select c_nationkey n from customer union select s_nationkey from supplier")
def set_union_distinct(spark, d):
    a, b = _keys(spark, d)
    return a.select("n").union(b.select("n")).distinct()


@query("select c_custkey k from customer intersect select s_suppkey from supplier")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.select("k").intersect(b.select("k"))


@query("select c_custkey k from customer except select s_suppkey from supplier")
def set_except(spark, d):
    a, b = _keys(spark, d)
    return a.select("k").subtract(b.select("k"))


@query(f"with {ART} select id, array_to_string(list_sort(list_intersect(a, b)), ',') common, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') united, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') rest, list_sort(a) = list_sort(b) same from (select id, coalesce(list_distinct(list_filter(iptc, lambda x: x is not null)), []) a, coalesce(list_distinct(list_filter(pred, lambda x: x is not null)), []) b from art)")
def row_sets(spark, d):
    """Set operations between two arrays of a row."""
    clean = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    rows = arts(spark, d, "iptc", "pred").select("id", clean("iptc").alias("a"), clean("pred").alias("b"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.select("id", text(F.array_intersect("a", "b")).alias("common"), text(F.array_union("a", "b")).alias("united"), text(F.array_except("a", "b")).alias("rest"), (F.array_sort("a") == F.array_sort("b")).alias("same"))


@query(f"with {ART}, {ANN} select distinct phrase from ann join art on article_id = id where split_name = 'train' and phrase is not null")
def phrase_vocabulary(spark, d):
    """Phrases of the train split, to keep."""
    train = arts(spark, d, "split_name").where("split_name = 'train'").withColumnRenamed("id", "article_id")
    return anns(spark, d).join(train, "article_id", "left_semi").where("phrase is not null").select("phrase").distinct()


@query(f"with {ANN} select term, row_number() over (order by term) - 1 idx from (select distinct term from ann)")
def row_index(spark, d):
    """Terms with their place in order."""
    return splits.with_index(anns(spark, d).select("term").distinct(), "term")


@query(f"with {ART} select split_name, count(*) n from art group by 1")
def repartitioned(spark, d):
    """The same rows over other partitions: nothing is lost."""
    return arts(spark, d, "split_name").repartition(16, "id").coalesce(4).groupBy("split_name").agg(F.count("*").alias("n"))


@query(f"with {ART} select id, '' hl, '' body, wc from art")
def minimal_projection(spark, d):
    return arts(spark, d, "wc").select("id", F.lit("").alias("hl"), F.lit("").alias("body"), "wc")


@query(f"with {ART} select id, list_sort(list_distinct(list_transform(list_filter(desc_terms, lambda x: x is not null), lambda x: lower(x)))) as descr from art where desc_terms is not null")
def descriptor_set(spark, d):
    held = F.transform(F.array_compact("desc_terms"), F.lower)
    return arts(spark, d, "desc_terms").where("desc_terms is not null").select("id", F.array_sort(F.array_distinct(held)).alias("descr"))


@query(f"with {ANN} select article_id, term from ann where mc > 1 and lower(trim(fb)) not in ('none', '')")
def annotation_filter(spark, d):
    return anns(spark, d).where((F.col("mc") > 1) & enrich.present("fb").isNotNull()).select("article_id", "term")


@query(f"with {ART}, {ANN} select id from art where len(iptc) > 0 and id in (select article_id from ann)")
def nonempty_articles(spark, d):
    return arts(spark, d, "iptc").where(F.size("iptc") > 0).join(anns(spark, d).withColumnRenamed("article_id", "id"), "id", "left_semi").select("id")


@query(f"with {ART} select id from art where list_contains(iptc, 'science')")
def label_contains(spark, d):
    return arts(spark, d, "iptc").where(F.array_contains("iptc", "science")).select("id")


@query(f"with {ANN} select article_id, term from ann where lower(trim(wd)) not in ('none', '')")
def wikidata_filter(spark, d):
    return enrich.knowledge_graph_filter(anns(spark, d)).select("article_id", "term")


@query(f"with {ART} select id, length(body) n from art where length(body) > 2000")
def long_bodies(spark, d):
    return arts(spark, d, "body").where(F.length("body") > 2000).select("id", F.length("body").cast("long").alias("n"))


@query(f"with {ART} select id, format('{{}} {{}} [{{}}] [{{}}]', id, coalesce(wc, -1), coalesce(array_to_string(iptc, '~'), ''), coalesce(array_to_string(pred, '~'), '')) line from art")
def article_lines(spark, d):
    empty = F.array().cast("array<string>")
    text = lambda c: F.array_join(F.coalesce(F.col(c), empty), "~")
    return arts(spark, d, "wc", "iptc", "pred").select("id", F.format_string("%s %d [%s] [%s]", "id", F.coalesce("wc", F.lit(-1)), text("iptc"), text("pred")).alias("line"))
