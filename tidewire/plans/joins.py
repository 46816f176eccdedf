"""Lookups, expansion, entities and the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import enrich, language, taxonomy
from tidewire.plans.base import ANN, ART, anns, arts, norm, query
from tidewire.sources.tables import table

_PRESENT = lambda c: f"case when lower(trim({c})) not in ('none', '') then {c} end"


@query(f"with {ART}, {ANN} select id, count(term) n, coalesce(string_agg(term || ':' || mc, ',' order by term), '') held from art left join ann on article_id = id group by 1")
def enrich_left(spark, d):
    """Articles with a map of their annotations; those without have an empty one."""
    rows = enrich.with_annotations(arts(spark, d, "split_name"), anns(spark, d), keep_empty=True)
    entries = F.coalesce(F.map_entries("ann_map"), F.array().cast("array<struct<key:string,value:struct<mc:int,offset:int,phrase:string>>>"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]["mc"].cast("string"))), ",")
    return rows.select("id", F.size(entries).cast("long").alias("n"), text.alias("held"))


_TWO = f"{ANN}, l as (select article_id, term, mc, ann_offset from ann where mc < 3), r as (select article_id, term, mc + 100 mc, ann_offset from ann where ann_offset >= 0 and ann_offset % 2 = 0)"


def _two(spark, d):
    rows = anns(spark, d).select("article_id", "term", "mc", "ann_offset")
    return rows.where("mc < 3"), rows.where("ann_offset >= 0 and ann_offset % 2 = 0").withColumn("mc", F.col("mc") + 100)


_OWN = "own as (select * from r where article_id in (select article_id from l))"


@query(f"with {_TWO}, {_OWN} select * from own union all select * from l where article_id in (select article_id from r) and (article_id, term) not in (select article_id, term from own)")
def enrich_merge(spark, d):
    """Two sources of annotations, of articles that both have; the right one holds."""
    return enrich.merged_annotations(*_two(spark, d))


@query(f"with {_TWO}, {_OWN} select * from own union all select * from l where (article_id, term) not in (select article_id, term from own)")
def enrich_outer_merge(spark, d):
    """The same with all articles of the left one."""
    return enrich.merged_annotations(*_two(spark, d), keep_unmatched=True)


@query(f"with {ART} select id from art where id in (select article_id from annotations where mc > 3)")
def semi_restrict(spark, d):
    other = table(spark, d, "annotations").where("mc > 3").select(F.col("article_id").alias("id"))
    return arts(spark, d, "split_name").join(other, "id", "left_semi").select("id")


@query(f"with {ART} select id from art where id not in (select article_id from annotations where mc > 3 and article_id is not null)")
def anti_restrict(spark, d):
    other = table(spark, d, "annotations").where("mc > 3").select(F.col("article_id").alias("id"))
    return arts(spark, d, "split_name").join(other, "id", "left_anti").select("id")


_PAIRS = f"dw as (select db, max(wd) wd from (select {_PRESENT('db')} db, {_PRESENT('wd')} wd from annotations) where db is not null and wd is not null group by 1), wf as (select wd, max(fb) fb from (select {_PRESENT('wd')} wd, {_PRESENT('fb')} fb from annotations) where wd is not null and fb is not null group by 1)"


def _pairs(spark, d):
    rows = table(spark, d, "annotations")
    return enrich.lookup_pairs(rows, "db", "wd"), enrich.lookup_pairs(rows, "wd", "fb")


@query(f"with {ANN}, {_PAIRS} select article_id, term, coalesce(dw.wd, 'NONE') wd_found, coalesce(wf.fb, 'NONE') fb_found from ann left join dw on dw.db = ann.db left join wf on wf.wd = dw.wd")
def id_chain(spark, d):
    """Ids found from one another by two lookups."""
    return enrich.id_chain(anns(spark, d), "db", *_pairs(spark, d)).select("article_id", "term", "wd_found", "fb_found")


@query(f"with {ART} select id, type, type || '->' || id phrase from (select id, unnest(desc_terms) as type from art) where type is not null")
def type_fanout(spark, d):
    return enrich.type_fanout(arts(spark, d, "desc_terms"), "desc_terms", "id").where("type is not null").select("id", "type", "phrase")


@query(f"with {_PAIRS} select wd, max(db) db from dw group by 1")
def map_inversion(spark, d):
    return enrich.inverted(_pairs(spark, d)[0])


@query(f"with {_PAIRS}, fb as (select dw.db, max(wf.fb) fb from dw join wf using (wd) group by 1) select e.db, n, coalesce(dw.wd, 'NONE') wd, coalesce(fb.fb, 'NONE') fb from (select {_PRESENT('db')} db, count(*) n from annotations group by 1) e left join dw using (db) left join fb using (db) where e.db is not null")
def id_report(spark, d):
    db_wd, wd_fb = _pairs(spark, d)
    rows = table(spark, d, "annotations").select(enrich.present("db").alias("db"))
    return enrich.id_report(rows, "db", db_wd, db_wd.join(wd_fb, "wd").groupBy("db").agg(F.max("fb").alias("fb")))


_BROAD = f"b as (select distinct wd, 'B' || right(wd, 1) broader from (select {_PRESENT('wd')} wd from annotations) where wd is not null)"


def _broader(spark, d):
    """A broader concept of each id, by its last sign."""
    ids = table(spark, d, "annotations").select(enrich.present("wd").alias("wd")).where("wd is not null")
    return ids.select("wd", F.concat(F.lit("B"), F.right("wd", F.lit(1))).alias("broader")).distinct()


@query(f"with {ANN}, {_BROAD}, u as (select article_id, term, mc, ann_offset from ann union all select article_id, broader, mc, ann_offset from ann join b on b.wd = {_PRESENT('ann.wd')}) select article_id, term, sum(mc)::bigint mc, min(ann_offset) ann_offset from u group by all")
def ontology_expansion(spark, d):
    return enrich.expanded(anns(spark, d), _broader(spark, d))


@query(f"with {ANN}, {_BROAD}, u as (select article_id, term, mc, ann_offset from ann union all select article_id, term, mc, ann_offset from ann join b on b.wd = {_PRESENT('ann.wd')}) select article_id, term, sum(mc)::bigint mc, min(ann_offset) ann_offset from u group by all")
def ontology_expansion_compat(spark, d):
    return enrich.expanded(anns(spark, d), _broader(spark, d), compat=True)


@query("select article_id, fb entity, count(*) mc, min(ann_offset) \"offset\" from annotations where lower(trim(fb)) not in ('none', '') group by all")
def entity_collapse(spark, d):
    rows = table(spark, d, "annotations").withColumn("entity", enrich.present("fb")).where("entity is not null")
    return enrich.entity_collapse(rows, "article_id", "entity", "ann_offset")


@query(f"with {ANN} select article_id doc, list_sort(list(distinct term)) entities from ann group by 1")
def inverted_index(spark, d):
    return enrich.inverted_index(anns(spark, d).select(F.col("article_id").alias("doc"), F.col("term").alias("entity")), "doc", "entity")


@query(f"with {ANN} select term, list_sort(list(article_id)) articles from ann group by 1")
def grouped_lists(spark, d):
    """Articles of each key, as a list."""
    return anns(spark, d).groupBy("term").agg(F.array_sort(F.collect_list("article_id")).alias("articles"))


@query(f"with {ART}, {ANN}, v as (select distinct {_PRESENT('fb')} term from annotations where w2v is not null) select id from art where len(iptc) > 0 and id in (select article_id from ann join v using (term) where lower(trim(fb)) not in ('none', ''))")
def fb_vector_filter(spark, d):
    vectors = table(spark, d, "annotations").where("w2v is not null").select(enrich.present("fb").alias("term"))
    return enrich.with_vector(arts(spark, d, "iptc"), anns(spark, d), vectors).select("id")


# --- taxonomy --------------------------------------------------------------------------------------------------------------------------------------

_UP = "par as (select child, min(parent) parent from topic_edges where child <> parent group by 1), up as (select topic_id, topic_id ancestor, 0 distance from topics union all select topic_id, parent, distance + 1 from up join par on child = ancestor where distance < 6)"
_LEVELS = "lev as (select topic_id, ancestor, max(distance) over (partition by topic_id) - distance as lvl, max(distance) over (partition by topic_id) most from up), filled as (select t.topic_id, k.lvl, coalesce(l.ancestor, t.topic_id) ancestor from topics t cross join (select unnest(range(6)) lvl) k left join lev l on l.topic_id = t.topic_id and l.lvl = k.lvl)"


def _tax(spark, d):
    return table(spark, d, "topics"), table(spark, d, "topic_edges")


@query(f"with recursive {_UP} select topic_id, ancestor, distance from up")
def taxonomy_closure(spark, d):
    return taxonomy.closure(*_tax(spark, d))


@query(f"with recursive {_UP}, {_LEVELS} select a.topic_label as label, lvl::int as \"level\", b.topic_label broad from filled join topics a using (topic_id) join topics b on b.topic_id = ancestor where lower(a.topic_label) <> 'freemasonry'")
def taxonomy_levels(spark, d):
    return taxonomy.level_names(*_tax(spark, d))


_DT = f"m as (select {norm('descriptor')} descriptor, max(regexp_extract(topic_id, '[^/]*$')) mapped from descriptor_map where descriptor is not null and lower(trim(topic_id)) <> 'n/a' group by 1), own as (select lower(topic_label) descriptor, min(topic_id) labelled from topics group by 1), dt as (select distinct id, coalesce(mapped, labelled) topic_id from (select distinct id, {norm('x')} descriptor from (select id, unnest(desc_terms) x from art)) left join m using (descriptor) left join own using (descriptor)), found as (select id, topic_id from dt where topic_id in (select topic_id from topics))"


@query(f"with {ART}, {_DT} select * from found")
def descriptor_topics(spark, d):
    return taxonomy.descriptor_topics(arts(spark, d, "desc_terms"), table(spark, d, "descriptor_map"), table(spark, d, "topics"))


@query(f"with recursive {ART}, {_DT}, {_UP}, {_LEVELS} select distinct id, topic_label as label from found join filled using (topic_id) join topics t on t.topic_id = ancestor where lvl = 0")
def broad_topics(spark, d):
    found = taxonomy.descriptor_topics(arts(spark, d, "desc_terms"), table(spark, d, "descriptor_map"), table(spark, d, "topics"))
    return taxonomy.broad_topics(found, *_tax(spark, d), 0)


@query("select distinct topic_label as label from topics where topic_id not in (select child from topic_edges where child <> parent) and topic_label >= 'm'")
def top_categories(spark, d):
    return taxonomy.top_categories(*_tax(spark, d), start="m")


@query("select topic_id, topic_label from topics")
def topic_names(spark, d):
    return table(spark, d, "topics").select("topic_id", "topic_label")


# --- names -----------------------------------------------------------------------------------------------------------------------------------------


@query(f"with {ANN}, k as (select article_id, ann_offset // 200 place, min(term) raw, case when count(*) > 1 then 'many' when min(mc) > 1 then 'often' else 'O' end ner from ann where ann_offset >= 0 group by all), n as (select *, place - row_number() over (partition by article_id, ner order by place) g from k where ner <> 'O') select article_id, min(place) start, string_agg(raw, ' ' order by place) name, ner kind from n group by article_id, ner, g")
def ner_merge_islands(spark, d):
    """Neighbouring places of the same kind, merged: of the annotations in each stretch of 200 characters."""
    kind = F.when(F.count("*") > 1, "many").when(F.min("mc") > 1, "often").otherwise("O")
    rows = anns(spark, d).where("ann_offset >= 0").groupBy("article_id", F.expr("ann_offset div 200").cast("int").alias("place")).agg(F.min("term").alias("raw"), kind.alias("ner"))
    return language.merged_names(rows, "article_id")


@query()
def names(spark, d):
    """Names in article bodies by kind, found by rules."""
    words = language.extracted(arts(spark, d, "body"), "id", "body")
    return language.name_counts(language.merged_names(language.word_rows(words, "id"), "id"))


@query()
def sentence_words(spark, d):
    """Nouns of article bodies with their stems."""
    words = language.extracted(arts(spark, d, "body"), "id", "body")
    return language.nouns(language.word_rows(words, "id")).groupBy("lemma").agg(F.count("*").alias("n"))


@query(f"with {ART} select id, list_transform(range(1, least(len(iptc), len(pred)) + 1), lambda i: iptc[i] || '/' || pred[i]) words from art where len(iptc) > 0 and len(iptc) = len(pred) and len(list_filter(list_concat(iptc, pred), lambda x: x is null)) = 0")
def zipped_words(spark, d):
    """Parallel arrays as one."""
    rows = arts(spark, d, "iptc", "pred").where("size(iptc) > 0 and size(iptc) = size(pred) and not exists(concat(iptc, pred), x -> x is null)")
    return language.zipped(rows, "iptc", "pred").select("id", F.transform("words", lambda w: F.concat(w["iptc"], F.lit("/"), w["pred"])).alias("words"))
