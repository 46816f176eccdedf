"""Reading and writing of text formats: what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import language
from tidewire.plans.base import ANN, ART, SPACE, anns, arts, query
from tidewire.sources import codec, formats, nitf, sinks
from tidewire.sources.tables import table
from tidewire.storage import new_path

_SAFE = lambda c: rf"regexp_replace(regexp_replace({c}, '[\n\[\]~]', ' ', 'g'), '{SPACE}', ' ', 'g')"


def _whole(spark, d):
    """Articles with their annotations in the shape that the line format writes."""
    fields = ("article_id", "phrase", "mc", "ann_offset", "fb", "wd", "db", "tf_idf")
    notes = anns(spark, d).groupBy(F.col("article_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.struct(*fields))))).alias("ann"))
    rows = arts(spark, d, "hl", "body", "wc", "pub_date", "iptc", "url", "desc_terms", "pred").join(notes, "id", "left")
    return rows.withColumnsRenamed({"pub_date": "date", "desc_terms": "desc"})


@query(rf"with {ART}, {ANN} select id, trim(coalesce({_SAFE('hl')}, '')) hl, trim(coalesce({_SAFE('body')}, '')) body, coalesce(wc, -1) wc, (select count(*) from ann where article_id = id) n_ann, (select coalesce(sum(mc), 0)::bigint from ann where article_id = id) mentions from art")
def article_codec(spark, d):
    """Articles written as lines and read again."""
    path = new_path(spark, "lines")
    sinks.save_text(codec.article_line(_whole(spark, d)), path, 4)
    rows = codec.read_articles(spark, path)
    mentions = F.aggregate(F.map_values("ann"), F.lit(0).cast("long"), lambda s, a: s + a["mc"])
    return rows.select("id", F.trim("hl").alias("hl"), F.trim("body").alias("body"), "wc", F.size("ann").cast("long").alias("n_ann"), mentions.alias("mentions"))


@query(rf"with {ART}, {ANN} select id, {_SAFE('hl')} hl, wc, (select count(*) from ann where article_id = id) n_ann from art")
def article_json(spark, d):
    """Articles written as JSON lines and read again."""
    path = new_path(spark, "json")
    sinks.save_text(codec.to_json(_whole(spark, d)), path, 4)
    return codec.read_articles_json(spark, path).select("id", "hl", "wc", F.coalesce(F.nullif(F.size("ann"), F.lit(-1)), F.lit(0)).cast("long").alias("n_ann"))


@query(f"with {ANN} select article_id || '_' || term id, mc, term name, coalesce(ann_offset, -1) \"offset\" from ann")
def entity_codec(spark, d):
    """Entity annotations written as lines and read again."""
    entity = F.struct(F.col("term").alias("id"), F.col("term").alias("name"), F.coalesce("ann_offset", F.lit(-1)).alias("offset"), F.lit(0.5).cast("float").alias("similarity_score"), F.lit(1).alias("support"), F.array().cast("array<string>").alias("types"))
    lines = anns(spark, d).select(F.struct("article_id", "mc", entity.alias("entity")).alias("a")).select(codec.entity_annotation_line(F.col("a")).alias("value"))
    path = new_path(spark, "entities")
    sinks.save_text(lines, path, 4)
    return formats.entity_annotations(spark, path).select("id", "mc", "entity.name", "entity.offset")


@query(f"with {ANN} select article_id, term phrase, mc, coalesce(ann_offset, -1) ann_offset, 'NONE' wd from ann")
def annotation_blocks(spark, d):
    """Annotations written as blocks of lines and read again."""
    row = F.concat_ws("\t", F.lit("0"), F.lit("0"), F.col("mc").cast("string"), F.col("term"), F.coalesce("ann_offset", F.lit(-1)).cast("string"), F.lit("0"), F.col("term"))
    blocks = anns(spark, d).withColumn("row", row).groupBy("article_id").agg(F.concat_ws("\n", F.concat(F.first("article_id"), F.lit("\thead")), F.collect_list("row")).alias("value"))
    path = new_path(spark, "blocks")
    blocks.select(F.concat("value", F.lit("\n")).alias("value")).write.text(path)
    return formats.annotation_blocks(spark, path).select("article_id", "phrase", "mc", "ann_offset", "wd")


@query("select vec_id::varchar term, label from embeddings")
def vector_text(spark, d):
    """Vectors written as lines and read again; a label stands for their content."""
    path = new_path(spark, "vectors")
    rows = table(spark, d, "embeddings")
    sinks.save_vectors(rows.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("v")), path)
    again = formats.vector_text(spark, path, 64)
    same = rows.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("was"), "label")
    return again.join(same, "term").where("v = was").select("term", "label")


@query(f"with {ART} select id, array_to_string(list_filter(iptc, lambda x: x is not null and x <> '' and not contains(x, ' ') and not contains(x, ',')), ',') iptc from art")
def minimal_lines(spark, d):
    """The shortest form of the articles, written and read again."""
    held = F.array_join(F.filter(F.coalesce("iptc", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & ~x.contains(" ") & ~x.contains(",")), ",")
    rows = arts(spark, d, "iptc").select("id", held.alias("iptc"), F.col("iptc").isNull().alias("none"))
    path = new_path(spark, "minimal")
    rows.select(F.concat_ws(" ", "id", "iptc", F.lit("x"))).write.text(path)
    again = formats.minimal_articles(spark, path).select("id", F.array_join("iptc", ",").alias("iptc"))
    return again.join(rows.select("id", "none"), "id").select("id", F.when(~F.col("none"), F.col("iptc")).alias("iptc"))


@query("select distinct on (descriptor) lower(descriptor) descriptor, regexp_extract(topic_id, '[^/]*$') topic_id from descriptor_map where descriptor is not null and lower(trim(topic_id)) <> 'n/a' order by descriptor, topic_id desc", name="descriptor_lines")
def descriptor_lines(spark, d):
    """The descriptor mapping as a tab-separated file."""
    rows = table(spark, d, "descriptor_map").where("descriptor is not null")
    rows = rows.groupBy("descriptor").agg(F.max(F.when(F.lower(F.trim("topic_id")) != "n/a", F.col("topic_id"))).alias("topic_id"))
    path = new_path(spark, "mapping")
    rows.select(F.concat_ws("\t", "descriptor", F.lit("-"), F.lit("-"), F.coalesce("topic_id", F.lit("n/a")))).write.text(path)
    return formats.descriptor_mapping(spark, path)


@query("select c_custkey::varchar a, c_name b from customer where c_name not like '% %'")
def id_pairs(spark, d):
    """Pairs of words, a line each."""
    path = new_path(spark, "pairs")
    table(spark, d, "customer").select(F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name")).write.text(path)
    return formats.id_pairs(spark, path)


@query("select 'Q' || c_custkey subject, 'm' || c_nationkey as object from customer where c_nationkey % 2 = 0")
def statement_dump(spark, d):
    """Pairs out of a dump of statements with a predicate."""
    path = new_path(spark, "dump")
    iri = lambda *x: F.concat(F.lit("<http://e.example/"), *x, F.lit(">"))
    predicate = F.when(F.col("c_nationkey") % 2 == 0, F.lit("<http://e.example/P646c>")).otherwise(F.lit("<http://e.example/P1>"))
    table(spark, d, "customer").select(F.concat_ws(" ", iri(F.lit("Q"), F.col("c_custkey")), predicate, iri(F.lit("m"), F.col("c_nationkey")), F.lit("."))).write.text(path)
    return formats.statement_pairs(spark, path, "P646c")


@query(f"with {ART} select id, case when trim(coalesce(hl, '')) <> '' then trim(regexp_replace(hl, '{SPACE}', ' ', 'g')) end hl, split_name descr from art where regexp_full_match(coalesce(hl, ''), '[ -~]*')")
def nitf_articles(spark, d):
    """Headlines in news markup: written, parsed and made into articles."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.concat(F.lit('<!DOCTYPE nitf SYSTEM "x.dtd"><nitf><head><docdata><doc-id id-string="'), F.col("id"), F.lit('"/><identified-content><classifier class="online_producer" type="descriptor">'), F.col("split_name"), F.lit("</classifier></identified-content></docdata></head><body><body.head><hedline><hl1>"), esc(F.col("hl")), F.lit("</hl1></hedline></body.head></body></nitf>"))
    rows = arts(spark, d, "hl", "split_name").where(F.coalesce("hl", F.lit("")).rlike("^[ -~]*$")).select(text.alias("value"))
    return nitf.to_articles(nitf.parsed(rows)).select("id", "hl", F.array_join("desc", ",").alias("descr"))


@query("select event_type, extract(hour from ts)::int as hour, count(*) n from events group by all")
def stream_counts(spark, d):
    """Events counted in windows of an hour by a stream over the table; here summed by hour of the day."""
    from tidewire.streaming import scoring

    source = table(spark, d, "events")
    path = new_path(spark, "stream")
    source.select("event_id", "ts", "event_type").write.parquet(path)
    rows = scoring.arriving(spark, path, "event_id long, ts timestamp, event_type string")
    counts = scoring.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="3650 days")
    name = "tidewire_stream_" + path.rpartition("-")[2]
    out = scoring.run_to_end(counts, name, new_path(spark, "stream-state"), "complete")
    return out.groupBy("event_type", F.hour("start").alias("hour")).agg(F.sum("n").alias("n"))


@query()
def random_normals(spark, d):
    """The mean and deviation of random normal numbers."""
    return formats.random_normals(spark, 1_000_000).agg(F.round(F.avg("x"), 1).alias("mean"), F.round(F.stddev("x"), 1).alias("deviation"))
