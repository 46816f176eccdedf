"""The line formats of articles, annotations and entities, and their JSON form. All parsing and writing are JVM expressions.

Article line: nine fields joined by a tab and a space - id, hl, body, wc, date, [iptc], url, [desc], [pred], sets in brackets and joined by ~, N for null - then
two tabs and the annotations joined by ~. Annotation: eight fields joined by a tab and a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import safe_string
from tidewire.sources.tables import derived_key

ANNOTATION = "struct<article_id:string,phrase:string,mc:int,ann_offset:int,fb:string,wd:string,db:string,tf_idf:double>"
ARTICLE = f"id string, hl string, body string, wc int, date string, iptc array<string>, url string, desc array<string>, pred array<string>, ann map<string,{ANNOTATION}>"
ENTITY = "struct<id:string,name:string,offset:int,similarity_score:float,support:int,types:array<string>>"
_FIELDS = ("article_id", "phrase", "mc", "ann_offset", "fb", "wd", "db", "tf_idf")


def _set_text(column: str) -> Column:
    held = F.transform(F.array_sort(F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>")))), safe_string)
    return F.concat(F.lit("["), F.array_join(held, "~"), F.lit("]"))


def _set_of(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "~"))


def annotation_line(a: Column) -> Column:
    """An annotation as text; its vector isn't written."""
    none = lambda c: F.coalesce(c, F.lit("NONE"))
    parts = [F.coalesce(a["article_id"], F.lit("")), safe_string(F.coalesce(a["phrase"], F.lit(""))), a["mc"].cast("string"), F.coalesce(a["ann_offset"], F.lit(-1)).cast("string"), none(a["fb"]), none(a["wd"]), none(a["db"]), F.coalesce(a["tf_idf"], F.lit(-1.0)).cast("string")]
    return F.concat_ws("\t ", *parts)


def annotation_of(line: Column) -> Column:
    """The annotation of a text."""
    x = F.split(line, "\t ", -1)
    kinds = {"mc": "int", "ann_offset": "int", "tf_idf": "double"}
    return F.struct(*[F.get(x, F.lit(i)).try_cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(_FIELDS)])


def article_line(articles: DataFrame) -> DataFrame:
    """(value): a line for each article of columns as in ``ARTICLE``. Signs that the format uses are spaces in texts."""
    text = lambda c: F.coalesce(safe_string(F.col(c)), F.lit(""))
    opt = lambda c: F.coalesce(safe_string(F.col(c)), F.lit("N"))
    fields = [text("id"), text("hl"), text("body"), F.coalesce("wc", F.lit(-1)).cast("string"), opt("date"), _set_text("iptc"), opt("url"), _set_text("desc"), _set_text("pred")]
    notes = F.array_join(F.transform(F.map_values(F.coalesce("ann", F.from_json(F.lit("{}"), f"map<string,{ANNOTATION}>"))), annotation_line), "~")
    return articles.select(F.concat(F.concat_ws("\t ", *fields), F.lit("\t\t"), notes).alias("value"))


def article_of(lines: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """Articles of lines; annotations are keyed anew by their derived key, of equal keys the last holds. A line without exactly nine fields is an error, or with strict off left out."""
    head = F.split(F.substring_index(F.col(value), "\t\t", 1), "\t ", -1)
    tail = F.when(F.instr(F.col(value), "\t\t") > 0, F.expr(f"substring({value}, instr({value}, '\t\t') + 2)")).otherwise("")
    rows = lines.select(head.alias("h"), tail.alias("t"))
    good = F.size("h") == 9
    rows = rows.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("an article line has 9 fields, not "), F.size("h").cast("string")))).cast("boolean")) if strict else rows.where(good)
    opt = lambda i: F.when(F.get("h", F.lit(i)) != "N", F.get("h", F.lit(i)))
    notes = F.transform(F.filter(F.split("t", "~"), lambda x: x != ""), annotation_of)
    keyed = F.transform(notes, lambda a: F.struct(derived_key(a["fb"], a["wd"], a["db"], a["phrase"]).alias("key"), a.alias("value")))
    last = F.aggregate(keyed, F.array().cast(f"array<struct<key:string,value:{ANNOTATION}>>"), lambda s, x: F.concat(F.filter(s, lambda y: y["key"] != x["key"]), F.array(x)))
    h = lambda i: F.get("h", F.lit(i))
    return rows.select(h(0).alias("id"), h(1).alias("hl"), h(2).alias("body"), h(3).try_cast("int").alias("wc"), opt(4).alias("date"), _set_of(h(5)).alias("iptc"), opt(6).alias("url"), _set_of(h(7)).alias("desc"), _set_of(h(8)).alias("pred"), F.map_from_entries(last).alias("ann"))


def entity_line(e: Column) -> Column:
    """An entity as six fields joined by tabs, types by commas."""
    return F.concat_ws("\t", e["id"], e["name"], e["offset"].cast("string"), e["similarity_score"].cast("string"), e["support"].cast("string"), F.array_join(e["types"], ","))


def entity_of(line: Column) -> Column:
    """The entity of a text; five fields are one without types."""
    x = F.split(line, "\t", -1)
    kinds = ["string", "string", "int", "float", "int"]
    names = ["id", "name", "offset", "similarity_score", "support"]
    types = F.filter(F.split(F.coalesce(F.get(x, F.lit(5)), F.lit("")), ","), lambda t: t != "")
    return F.struct(*[F.get(x, F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], types.alias("types"))


def entity_annotation_line(a: Column) -> Column:
    """Article, number and entity of an entity annotation (article_id, mc, entity)."""
    return F.concat(a["article_id"], F.lit("\t"), a["mc"].cast("string"), F.lit("\t\t"), entity_line(a["entity"]))


def entity_annotation_of(line: Column) -> Column:
    """The entity annotation of a text; its id is article and entity joined by _."""
    head = F.split(F.substring_index(line, "\t\t", 1), "\t")
    entity = entity_of(F.substring(line, F.instr(line, "\t\t") + 2, F.length(line)))
    return F.struct(F.get(head, F.lit(0)).alias("article_id"), F.get(head, F.lit(1)).try_cast("int").alias("mc"), entity.alias("entity"), F.concat_ws("_", F.get(head, F.lit(0)), entity["id"]).alias("id"))


def to_json(rows: DataFrame) -> DataFrame:
    """(value): a JSON line for each row; line ends in a body are spaces."""
    rows = rows.withColumn("body", F.regexp_replace("body", r"[\r\n]+", " ")) if "body" in rows.columns else rows
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def read_articles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Articles of a text file or folder."""
    return article_of(spark.read.text(path), strict=strict)


def read_articles_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON lines, their texts without the signs that the line format uses."""
    rows = spark.read.schema(ARTICLE).json(path)
    return rows.withColumns({c: safe_string(F.col(c)) for c in ("hl", "body")}).withColumn("desc", F.transform("desc", safe_string))
