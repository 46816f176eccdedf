"""Readers of files, sinks and models that are kept: what is written is read again; and the named datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import experiments
from tidewire.operators import enrich, language, metrics, models, neural, stats, terms
from tidewire.plans.base import ANN, ART, EMB, LAB, ORACLES, anns, arts, query, r6
from tidewire.plans.joins import ner_merge_islands
from tidewire.plans.learning import _documents, bags, labels
from tidewire.plans.statistics import CATEGORIES, predictions
from tidewire.plans.texts import DF, kept_terms
from tidewire.sources import formats, sinks
from tidewire.sources.catalogue import Catalogue
from tidewire.sources.tables import table
from tidewire.storage import new_path


@query("select user_id::varchar id, array_to_string(list_sort(list(distinct event_type)), ',') vs from events where event_type is not null group by 1")
def property_lines(spark, d):
    """Ids with several values, a line each."""
    path = new_path(spark, "properties")
    rows = table(spark, d, "events").where("event_type is not null").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    rows.select(F.concat_ws(" ", F.col("user_id").cast("string"), F.array_join("types", ","))).write.text(path)
    return formats.property_pairs(spark, path).select("id", F.array_join(F.array_sort("values"), ",").alias("vs"))


@query("select c_custkey::varchar doc, 'n' || c_nationkey entity from customer")
def mapping_lines(spark, d):
    """Entities with the documents that hold them, a line each, the other way round."""
    path = new_path(spark, "mapping")
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.col("c_custkey").cast("string")).alias("docs"))
    rows.select(F.concat_ws(" ", F.concat(F.lit("n"), "c_nationkey"), F.array_join("docs", " "))).write.text(path)
    return formats.article_mapping(spark, path)


@query("select 'e' || (p_partkey % 100) id, max(p_name) as name from part group by 1")
def entity_lines(spark, d):
    """Entities as JSON lines, ids that repeat among them: the greatest row holds."""
    path = new_path(spark, "entities")
    table(spark, d, "part").select(F.concat(F.lit("e"), F.col("p_partkey") % 100).alias("id"), F.col("p_name").alias("name"), F.lit(0).alias("offset"), F.lit(["Q1"]).alias("types")).write.json(path)
    return formats.entities(spark, path).select("id", "name")


@query("select c_name || ' é ß, \"' || c_custkey || '\"' as value from customer")
def latin_lines(spark, d):
    """Lines of a file in ISO-8859-1."""
    path = new_path(spark, "latin")
    rows = table(spark, d, "customer").select(F.concat("c_name", F.lit(' é ß, "'), "c_custkey", F.lit('"')).alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").option("emptyValue", "").csv(path)
    return formats.latin_lines(spark, path)


@query(f"with {ART} select id, hl, wc, iptc is null none from art")
def json_dump(spark, d):
    """Articles as JSON lines."""
    path = new_path(spark, "dump")
    sinks.save_json(arts(spark, d, "hl", "wc", "iptc"), path)
    return spark.read.schema("id string, hl string, wc int, iptc array<string>").json(path).select("id", "hl", "wc", F.col("iptc").isNull().alias("none"))


@query(f"with {ART}, {LAB}, n as (select label, count(*) n from lab group by 1) select printf('%s %d', label, n) line, 2::bigint times from n")
def appended_report(spark, d):
    """A report that is added to."""
    path = new_path(spark, "report")
    lines = stats.count_by(labels(spark, d), "label").select(F.format_string("%s %d", "label", "n").alias("value"))
    for _ in range(2):
        sinks.append_report(lines, path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


@query(ORACLES["prediction_outcomes"].replace("select id, label,", r"select id, regexp_replace(label, '[,\s+]+', '_', 'g') as label,"))
def kept_outcomes(spark, d):
    """Predicted labels in a folder for each outcome and label."""
    path = new_path(spark, "outcomes")
    sinks.save_outcomes(metrics.outcomes(predictions(spark, d), "id", "iptc", "pred"), path)
    return spark.read.schema("id string, outcome string, label string").parquet(path).select("id", "label", "outcome")


@query(ORACLES["idf"])
def kept_vocabulary(spark, d):
    """A TF-IDF model that is written and loaded."""
    path = new_path(spark, "tfidf")
    sinks.save_vocabulary(*terms.fit_tfidf(kept_terms(spark, d), "doc", "term", DF), path)
    vocabulary, n = sinks.load_vocabulary(spark, path)
    return vocabulary.join(F.broadcast(n)).withColumn("idf", r6(F.log(F.col("documents") / F.col("df"))))


@query(ORACLES["nb_predict"])
def kept_bayes(spark, d):
    """Naive Bayes models that are written and loaded, on the test split."""
    path, rows = new_path(spark, "bayes"), anns(spark, d)
    vocabulary, documents = terms.fit_tfidf(rows, "article_id", "term", 0)
    experiments.save(experiments.Fitted("nb_bow", [models.nb_fit(bags(spark, d), labels(spark, d), CATEGORIES)], vocabulary, documents), path)
    (model,) = experiments.load(spark, "nb_bow", path).models
    test = arts(spark, d, "split_name").where("split_name = 'test'").select("id")
    held = rows.select(F.col("article_id").alias("id"), "term", F.col("mc").alias("w")).join(test, "id", "left_semi")
    return models.nb_margins(held, model).select("id", "category", F.round("margin", 5).alias("margin"), (F.col("margin") > 0).alias("predicted"))


@query(f"with {ART}, {ANN}, {EMB} select distinct article_id id, true same from ann join emb using (term) where article_id in (select id from art where split_name = 'test')")
def kept_nets(spark, d):
    """Nets that are written and loaded say of the test split what those in memory say."""
    path = new_path(spark, "nets")
    rows = _documents(spark, d).withColumnRenamed("numbers", "features")
    nets = neural.fit_each(rows.where("split_name = 'train'"), "iptc", CATEGORIES, lambda: neural.FeedForward((64, 8, 2)), rounds=1)
    sinks.save_nets(spark, nets, path)
    test = rows.where("split_name = 'test'")
    again = neural.predict(test, sinks.load_nets(spark, path)).withColumnRenamed("pred", "loaded")
    return neural.predict(test, nets).join(again, "id").select("id", (F.col("pred") == F.col("loaded")).alias("same"))


_NUMBER = "case when regexp_full_match(id, '[0-9]{1,18}') then id::bigint else -1 end"
_SETS = f"""{ART}, {ANN}, raw as (select id, {_NUMBER} number, coalesce(len(iptc), 0) labels from art), noted as (select * from raw where id in (select article_id from ann)),
placed as (select 'full' kind, id, row_number() over (order by number, id) - 1 i, count(*) over () n from raw union all select 'some', id, row_number() over (order by number, id) - 1, count(*) over () from noted),
part as (select kind, id, case when i < floor(n * 6 / 10) then 'train' when i < floor(n * 8 / 10) then 'test' else 'validation' end part from placed),
named as (select 'raw' as name, id, false has from raw union all select 'minimal', id, false from raw union all select 'annotated', id, true from noted
 union all select part || '_ordered' || case kind when 'full' then '_full' else '' end, id, true from part
 union all select 'mini', id, true from (select id from noted where labels > 0 and number >= 0 order by number desc limit 100000)),
notes as (select article_id id, count(*) n from ann group by 1)"""


@query(f"with {_SETS} select name, count(*) articles, coalesce(sum(case when has then n end), 0)::bigint annotations from named left join notes using (id) group by 1")
def named_sets(spark, d):
    """Articles and annotations of the named datasets that no chance is in."""
    sets, out = Catalogue(spark, d), None
    for name in ("raw", "minimal", "annotated", "mini", *(f"{p}_{k}" for p in ("train", "test", "validation") for k in ("ordered", "ordered_full"))):
        made = sets.by(name)
        n, m = (x.agg(F.count("*").alias(c)) for x, c in ((made.articles, "articles"), (made.annotations, "annotations")))
        row = n.join(F.broadcast(m)).select(F.lit(name).alias("name"), "articles", "annotations")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query(f"with {_SETS}, own as (select id from part where kind = 'some' and part = 'train'), lab as (select id, list_contains(iptc, 'science') yes from art where id in (select id from own)) select coalesce(yes, false) yes, least(count(*), (select count(*) from lab where yes)) n from lab group by 1")
def balanced_set(spark, d):
    """A label's articles of the train part and as many others."""
    rows = Catalogue(spark, d).balanced("science").articles
    return rows.groupBy(F.coalesce(F.array_contains("iptc", "science"), F.lit(False)).alias("yes")).agg(F.count("*").alias("n"))


@query(f"with {ART} select id from art order by id limit 60")
def row_limit(spark, d):
    """A count of a hundred rows, and six tenths of it."""
    return formats.limited(arts(spark, d, "wc").select("id"), 100, 0.6, "id")


@query(f"select article_id, kind, list_sort(list(distinct name)) names from ({ORACLES['ner_merge_islands']}) group by all")
def names_by_kind(spark, d):
    """Sorted distinct names of each document and kind, of merged neighbours."""
    return language.names_by_kind(ner_merge_islands(spark, d), "article_id")


@query(f"with {ANN} select article_id, wd term, 1 mc, -1 ann_offset, wd phrase from ann where lower(trim(wd)) not in ('none', '') group by all union all select article_id, 'name:' || lower(phrase), count(*)::int, -1, min(phrase) from ann where trim(phrase) <> '' group by article_id, lower(phrase)")
def made_annotations(spark, d):
    """Annotations made of entities, once each, and of names, with their number."""
    rows = anns(spark, d)
    return enrich.annotations_of_entities(rows, "article_id", "wd").unionByName(enrich.annotations_of_names(rows, "article_id", "phrase"))
