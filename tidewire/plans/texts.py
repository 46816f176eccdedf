"""Terms of documents and annotations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import terms
from tidewire.plans.base import ANN, ART, SPACE, TERM, anns, arts, query, r6
from tidewire.sources.tables import table
from tidewire.storage import cut

#: Documents that a term has to be in more than, in these queries.
DF = 10


def docs(spark, d):
    return table(spark, d, "documents")


def text_terms(spark, d):
    return terms.text_terms(docs(spark, d), "doc_id", "text")


def kept_terms(spark, d):
    """The same, written once for queries that read them several times with different columns: texts are tokenised once."""
    return cut(terms.text_terms(docs(spark, d), "doc_id", "text", totals=True), "terms")


@query(rf"select token, count(*) n from (select regexp_replace(w, '[^A-Za-z0-9]', '', 'g') token from (select unnest(string_split_regex(text, '{SPACE}')) w from documents)) where token <> '' group by 1")
def token_counts(spark, d):
    return terms.word_count(docs(spark, d))


@query(f"with {TERM} select * from terms")
def doc_term_freq(spark, d):
    return text_terms(spark, d)


@query()
def doc_stem_freq(spark, d):
    return terms.text_terms(docs(spark, d), "doc_id", "text", stem=True)


@query(f"with {TERM} select term, count(*) df from terms group by 1 having count(*) > {DF}")
def doc_frequency(spark, d):
    return terms.document_frequency(text_terms(spark, d), "doc", "term", DF)


@query(f"with {ANN} select term, count(*) df from ann group by 1 having count(*) > {DF}")
def frequent_terms(spark, d):
    return terms.frequent_terms(anns(spark, d), "article_id", "term", DF)


_FIT = f"{TERM}, vocab as (select term, count(*) df from terms group by 1 having count(*) > {DF}), n as (select count(distinct doc) documents from terms where term in (select term from vocab))"


@query(f"with {_FIT} select term, df, documents, round(ln(documents / df), 6) idf from vocab, n")
def idf(spark, d):
    vocabulary, n = terms.fit_tfidf(kept_terms(spark, d), "doc", "term", DF)
    return vocabulary.join(F.broadcast(n)).withColumn("idf", r6(F.log(F.col("documents") / F.col("df"))))


@query(f'with {_FIT}, t as (select doc, terms.term, mc, "offset", mc / sum(mc) over (partition by doc) tf, case when df is null then 0 else ln(documents / df) end idf from terms left join vocab using (term), n) select doc, term, mc, "offset", round(tf, 6) tf, round(idf, 6) idf, round(tf * idf, 6) tf_idf from t')
def tfidf(spark, d):
    rows = kept_terms(spark, d)
    out = terms.tfidf(rows, *terms.fit_tfidf(rows, "doc", "term", DF), "doc", "term", total="total")
    return out.withColumns({c: r6(c) for c in ("tf", "idf", "tf_idf")})


_ANN_FIT = f"{ANN}, vocab as (select term, count(*) df from ann group by 1 having count(*) > 1), n as (select count(distinct article_id) documents from ann where term in (select term from vocab))"


@query(f"with {_ANN_FIT}, k as (select article_id, term, mc, df from ann join vocab using (term)) select article_id, term, round(coalesce(mc / nullif(sum(mc) over (partition by article_id), 0), 0) * ln(documents / df), 6) tf_idf from k, n")
def tfidf_annotations(spark, d):
    """TF-IDF of annotations over the terms of the vocabulary."""
    rows = anns(spark, d)
    out = terms.tfidf(rows.select("article_id", "term", "mc"), *terms.fit_tfidf(rows, "article_id", "term", 1), "article_id", "term", all_terms=False)
    return out.select("article_id", "term", r6("tf_idf").alias("tf_idf"))


@query(f"with {_FIT}, t as (select doc, term, mc, sum(mc) over (partition by doc) s, max(mc) over (partition by doc) m, df, documents from terms join vocab using (term), n) select doc, term, round(mc / s, 6) tf_simple, round(1 + ln(mc), 6) tf_log, round(0.5 + 0.5 * mc / m, 6) tf_half, round(ln(documents / df), 6) idf, round(ln(1 + documents / df), 6) idf_smooth from t")
def tf_variants(spark, d):
    rows = kept_terms(spark, d)
    vocabulary, n = terms.fit_tfidf(rows, "doc", "term", DF)
    w = Window.partitionBy("doc")  # the sums are over the terms of the vocabulary
    joined = rows.join(vocabulary, "term").join(F.broadcast(n))
    made = terms.tf_variants(F.col("mc"), F.sum("mc").over(w), F.max("mc").over(w), F.col("df"), F.col("documents"))
    return joined.select("doc", "term", *[r6(c).alias(k) for k, c in made.items()])


@query(f'with {_FIT} select doc, term, mc, "offset" from terms where term in (select term from vocab)')
def vocab_filter(spark, d):
    rows = kept_terms(spark, d)
    return terms.vocabulary_filter(rows, terms.document_frequency(rows, "doc", "term", DF)).select("doc", "term", "mc", "offset")


@query(f"with {_FIT}, t as (select lang, term, max(mc / s * ln(documents / df)) w from (select doc, term, mc, sum(mc) over (partition by doc) s from terms) join vocab using (term) join documents on doc_id = doc, n where lang is not null group by all) select lang, term, round(w, 6) tf_idf, rank from (select *, row_number() over (partition by lang order by round(w, 6) desc, term) rank from t) where rank <= 10")
def top_terms_per_lang(spark, d):
    """The ten terms of greatest TF-IDF in each language."""
    rows = kept_terms(spark, d)
    vocabulary, n = terms.fit_tfidf(rows, "doc", "term", DF)
    named = terms.tfidf(terms.vocabulary_filter(rows, vocabulary), vocabulary, n, "doc", "term", total="total").select("doc", "term", "tf_idf")
    langs = docs(spark, d).where("lang is not null").select(F.col("doc_id").alias("doc"), "lang")
    joined = named.withColumn("tf_idf", r6("tf_idf")).join(langs, "doc")
    return terms.top_terms(joined, "lang", "term", "tf_idf", 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {ART} select id, count(*) mc from (select id, unnest(string_split_regex(trim(body), '{SPACE}')) w from art where trim(body) <> '') group by 1")
def word_totals(spark, d):
    """Whitespace words of each body."""
    rows = arts(spark, d, "body").where("trim(body) <> ''")
    return rows.select("id", F.size(F.split(F.trim("body"), SPACE)).cast("long").alias("mc"))


@query(rf"with {ART} select id, regexp_replace(hl, '[, \t\n\x0B\f\r+]+', '_', 'g') file_name, regexp_replace(regexp_replace(hl, '[\n\[\]~]', ' ', 'g'), '{SPACE}', ' ', 'g') safe, regexp_replace(hl, '[^A-Za-z0-9]', '', 'g') bare, regexp_matches(hl, '^[A-Za-z0-9 \t\n\x0B\f\r]*$') ordinary from art")
def text_functions(spark, d):
    h = F.col("hl")
    return arts(spark, d, "hl").select("id", T.trim_label(h).alias("file_name"), T.safe_string(h).alias("safe"), T.strip_token(h).alias("bare"), T.is_ordinary(h).alias("ordinary"))


@query(rf"with {ART} select id, regexp_extract(url, '[^/]*$') last, case when length(regexp_extract(url, '[^/]*$')) > 0 then left(regexp_extract(url, '[^/]*$'), length(regexp_extract(url, '[^/]*$')) - 1) else '' end resource, lower(trim(url)) low, starts_with(url, 'http') begins, contains(url, '.example') has, replace(url, 'http', 'ftp') swapped from art where url is not null")
def url_parts(spark, d):
    u = F.col("url")
    return arts(spark, d, "url").where("url is not null").select("id", T.last_segment(u).alias("last"), T.resource_id(u).alias("resource"), F.lower(F.trim(u)).alias("low"), u.startswith("http").alias("begins"), u.contains(".example").alias("has"), F.replace(u, F.lit("http"), F.lit("ftp")).alias("swapped"))


@query(rf"with {ART}, m as (select id, cast(pub_date as bigint) ms from art where regexp_matches(pub_date, '^-?[0-9]{{1,15}}$')) select id, epoch_ms(ms) published, cast(ms // 1000 // 86400 as varchar) || 'd' n_days, strftime(epoch_ms(ms), '%Y%m%dT%H%M%S') nitf from m where ms >= 0")
def dates(spark, d):
    """Publication dates: text of epoch milliseconds to a timestamp and back to the markup form."""
    rows = arts(spark, d, "pub_date").withColumn("published", T.from_epoch_millis(F.col("pub_date"))).where("published >= timestamp'1970-01-01'")
    days = F.split(T.pretty_time(F.unix_millis("published")), " ")[0]
    again = T.nitf_date(F.date_format("published", "yyyyMMdd'T'HHmmss"))
    return rows.select("id", F.col("published").cast("timestamp_ntz").alias("published"), days.alias("n_days"), F.date_format(again, "yyyyMMdd'T'HHmmss").alias("nitf"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as js from events")
def json_props(spark, d):
    """Fields read from JSON, and rows written as JSON."""
    rows = table(spark, d, "events")
    js = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), js.alias("js"))


@query(f"with {ART} select id, len(iptc)::bigint n, list_contains(iptc, 'science') has, iptc[1] first, array_to_string(list_sort(list_distinct(iptc)), ',') uniq, array_to_string(iptc[1:2], ',') two from art where iptc is not null and len(iptc) > 0 and len(list_filter(iptc, lambda x: x is null)) = 0")
def array_functions(spark, d):
    rows = arts(spark, d, "iptc").where("size(iptc) > 0 and not exists(iptc, x -> x is null)")
    return rows.select("id", F.size("iptc").cast("long").alias("n"), F.array_contains("iptc", "science").alias("has"), F.get("iptc", F.lit(0)).alias("first"), F.array_join(F.array_sort(F.array_distinct("iptc")), ",").alias("uniq"), F.array_join(F.slice("iptc", 1, 2), ",").alias("two"))


@query(f"with {ANN} select article_id, count(*) n, string_agg(term, ',' order by term) keys, sum(mc) total, count(*) filter (where mc > 1) often from ann group by 1")
def map_functions(spark, d):
    """Annotations of an article as a map, and what can be asked of it."""
    entries = F.array_sort(F.collect_list(F.struct("term", "mc")))
    m = anns(spark, d).groupBy("article_id").agg(F.map_from_entries(entries).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("article_id", F.size("m").cast("long").alias("n"), F.array_join(F.map_keys("m"), ",").alias("keys"), total.alias("total"), F.size(F.map_filter("m", lambda k, v: v > 1)).cast("long").alias("often"))


@query("select o_orderkey, ceil(o_totalprice)::bigint up, round(o_totalprice, 1) near, greatest(o_totalprice, 1000.0) most, least(o_totalprice, 1000.0) small, round(ln(o_totalprice), 6) log, round(ln(1 + o_totalprice), 6) log1 from orders")
def math_functions(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.ceil(p).alias("up"), F.round(p, 1).alias("near"), F.greatest(p, F.lit(1000.0)).alias("most"), F.least(p, F.lit(1000.0)).alias("small"), r6(F.log(p)).alias("log"), r6(F.log1p(p)).alias("log1"))
