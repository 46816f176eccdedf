"""Text formats of annotations, ids, vectors and dumps. A reader gives a DataFrame; bad lines are left out unless stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources import codec


def limited(rows: DataFrame, count: int | None, fraction: float = 1.0, *order: str) -> DataFrame:
    """The first count * fraction rows, in an order if one is given; all with count None."""
    if count is None:
        return rows
    return (rows.orderBy(*order) if order else rows).limit(int(count * fraction))


def annotation_blocks(spark: SparkSession, path: str, wd: DataFrame | None = None) -> DataFrame:
    """Annotations of blocks that blank lines separate: a header line that begins with the article's id, then rows of tab fields - number (2), phrase (3), offset (4), Freebase id (6), counted from 0. wd: (fb, wd)."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    lines = blocks.select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("x"))
    rows = lines.select(F.trim(F.get(F.split(F.get("x", F.lit(0)), "\t"), F.lit(0))).alias("article_id"), F.explode(F.slice("x", 2, 1_000_000)).alias("row")).select("article_id", F.split("row", "\t").alias("c"))
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    rows = rows.select("article_id", at(3).alias("phrase"), at(2).try_cast("int").alias("mc"), at(4).try_cast("int").alias("ann_offset"), at(6).alias("fb")).where("fb is not null")
    joined = rows.join(wd.select(F.col("fb").alias("_fb"), F.col("wd").alias("_wd")), F.col("fb") == F.col("_fb"), "left").drop("_fb") if wd is not None else rows.withColumn("_wd", F.lit(None).cast("string"))
    return joined.withColumn("wd", F.coalesce("_wd", F.lit("NONE"))).drop("_wd")


def id_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of lines of exactly two words."""
    words = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("w")).where(F.size("w") == 2)
    return words.select(F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))


def property_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, values) of lines of an id and comma-separated values."""
    words = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("w")).where(F.size("w") == 2)
    return words.select(F.get("w", F.lit(0)).alias("id"), F.array_distinct(F.split(F.get("w", F.lit(1)), ",")).alias("values"))


def statement_pairs(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """(subject, object) of a statement dump's lines with a predicate whose IRI ends so; IRIs are cut to their last part, quotes fall."""
    words = spark.read.text(path).select(F.split("value", " ").alias("w"))
    clean = lambda i: F.regexp_replace(F.substring_index(F.get("w", F.lit(i)), "/", -1), r"[<>\"]", "")
    return words.where(F.get("w", F.lit(1)).endswith(f"{predicate}>")).select(clean(0).alias("subject"), clean(2).alias("object"))


def same_as_pairs(spark: SparkSession, path: str, prefix: str = "<http://dbpedia.org") -> DataFrame:
    """(subject, object) of a dump's lines whose object begins so, IRIs cut to their last part."""
    words = spark.read.text(path).select(F.split("value", " ").alias("w"))
    clean = lambda i: F.regexp_replace(F.substring_index(F.get("w", F.lit(i)), "/", -1), r"[<>\"]", "")
    return words.where(F.get("w", F.lit(2)).startswith(prefix)).select(clean(0).alias("subject"), clean(2).alias("object"))


def descriptor_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(descriptor, topic_id) of a tab-separated file: lower-cased column 0, last part of column 3; n/a is left out."""
    c = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") > 3)
    rows = c.select(F.lower(F.get("c", F.lit(0))).alias("descriptor"), F.get("c", F.lit(3)).alias("t"))
    return rows.where(F.lower(F.trim("t")) != "n/a").select("descriptor", F.substring_index("t", "/", -1).alias("topic_id"))


def vector_text(spark: SparkSession, path: str, size: int, only: DataFrame | None = None) -> DataFrame:
    """(term, v) of lines of an id and comma-separated numbers. only: (term) of those wanted. A vector of another size is an error."""
    parts = spark.read.text(path).select(F.split("value", r",\s*").alias("p")).where(F.size("p") > 1)
    rows = parts.select(F.get("p", F.lit(0)).alias("term"), F.transform(F.slice("p", 2, 1_000_000), lambda x: x.try_cast("float")).alias("v"))
    rows = rows.join(only.select("term"), "term", "left_semi") if only is not None else rows
    wrong = F.assert_true(F.size("v") == size, F.lit(f"a vector must have {size} components"))
    return rows.withColumn("_ok", wrong.isNull()).where("_ok").drop("_ok")


def minimal_articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, iptc, fb) of lines of an id and two comma-separated lists."""
    w = spark.read.text(path).select(F.split("value", " ").alias("w")).where(F.size("w") >= 1)
    some = lambda i: F.filter(F.split(F.coalesce(F.get("w", F.lit(i)), F.lit("")), ","), lambda x: x != "")
    return w.select(F.get("w", F.lit(0)).alias("id"), some(1).alias("iptc"), some(2).alias("fb"))


def article_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(doc, entity) of lines of an entity and the documents that hold it."""
    w = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("w"))
    return w.select(F.get("w", F.lit(0)).alias("entity"), F.explode(F.slice("w", 2, 1_000_000)).alias("doc")).select("doc", "entity")


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of JSON lines, each id once; of several the greatest row holds."""
    rows = spark.read.schema("id string, name string, offset int, similarity_score float, support int, types array<string>").json(path)
    return rows.where("id is not null").groupBy("id").agg(F.max(F.struct(*rows.columns)).alias("r")).select("r.*")


def entity_annotations(spark: SparkSession, path: str, as_json: bool = False, count: int | None = None) -> DataFrame:
    """Entity annotations (article_id, mc, entity, id) of text or JSON lines."""
    if as_json:
        rows = spark.read.schema(f"article_id string, mc int, entity {codec.ENTITY}").json(path).withColumn("id", F.concat_ws("_", "article_id", "entity.id"))
    else:
        rows = spark.read.text(path).select(codec.entity_annotation_of(F.col("value")).alias("a")).select("a.*")
    return limited(rows, count, 1.0, "id")


def linked_resources(responses: DataFrame, column: str = "response") -> DataFrame:
    """Entities of stored answers of an entity linker in JSON: those with an address, offset, score, types, support and surface form. The id is the address's last part, types are those that begin with Q."""
    kind = "Resources array<struct<`@URI`:string,`@support`:string,`@types`:string,`@surfaceForm`:string,`@offset`:string,`@similarityScore`:string>>"
    r = responses.select(*[c for c in responses.columns if c != column], F.explode(F.from_json(column, kind)["Resources"]).alias("r"))
    types = F.filter(F.split(F.col("r.`@types`"), "[,:]"), lambda t: t.startswith("Q"))
    rows = r.withColumn("entity", F.struct(F.substring_index(F.col("r.`@URI`"), "/", -1).alias("id"), F.col("r.`@surfaceForm`").alias("name"), F.col("r.`@offset`").try_cast("int").alias("offset"), F.col("r.`@similarityScore`").try_cast("float").alias("similarity_score"), F.col("r.`@support`").try_cast("int").alias("support"), types.alias("types")))
    return rows.drop("r").where("entity.id is not null and entity.offset is not null and entity.similarity_score is not null and entity.support is not null and entity.name is not null")


def latin_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a file in ISO-8859-1."""
    return spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("value string").csv(path)


def random_normals(spark: SparkSession, n: int, partitions: int = 10, seed: int = 123) -> DataFrame:
    """(id, x): n normal numbers."""
    return spark.range(0, n, 1, partitions).select("id", F.randn(seed).alias("x"))
