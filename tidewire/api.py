"""Questions about one text, as small DataFrames; a server may give them out as JSON lines (``answer``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import language, models

NO_MATCH = "NO_MATCH"


class TextService:
    """Holds what texts are looked up in: surface forms of keys, their types and vectors, and a naive Bayes model. All are DataFrames.

    surfaces: (phrase, term), phrases lower-cased; types: (term, type); vectors: (term, v); prior, weights: of ``nb_counts``.
    """

    def __init__(self, spark: SparkSession, surfaces: DataFrame, types: DataFrame | None = None, vectors: DataFrame | None = None, prior: DataFrame | None = None, weights: DataFrame | None = None) -> None:
        self.spark, self.surfaces, self.types, self.vectors, self.prior, self.weights = spark, surfaces, types, vectors, prior, weights

    def _text(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([("text", text)], "id string, text string")

    def extract(self, text: str) -> DataFrame:
        """(name, kind, start): names found by rules."""
        words = language.word_rows(language.extracted(self._text(text), "id", "text"), "id")
        return language.merged_names(words, "id").select("name", "kind", "start").orderBy("start")

    def annotate(self, text: str) -> DataFrame:
        """(term, name, mc, offset): names that are a key's surface form, each key once with its number and first place."""
        names = self.extract(text).withColumn("phrase", F.lower("name"))
        found = names.join(self.surfaces, "phrase").groupBy("term").agg(F.min_by("name", "start").alias("name"), F.count("*").alias("mc"), F.min("start").alias("offset"))
        return found.orderBy("offset", "term")

    def annotate_with_types(self, text: str) -> DataFrame:
        """The same, a row for each type too, with names ``type->term``."""
        base = self.annotate(text)
        if self.types is None:
            return base
        more = base.join(self.types, "term").select(F.col("type").alias("term"), F.concat_ws("->", "type", "term").alias("name"), "mc", "offset")
        return base.unionByName(more).orderBy("offset", "term")

    def vector_of(self, term: str) -> DataFrame:
        """(term, v): the stored vector of a key, null if there is none."""
        asked = self.spark.createDataFrame([(term,)], "term string")
        return asked.join(self.vectors, "term", "left") if self.vectors is not None else asked.withColumn("v", F.lit(None).cast("array<float>"))

    def text_vectors(self, text: str) -> DataFrame:
        """(term, name, offset, vector): the vectors of a text's keys as text, NO_MATCH without one."""
        rows = self.annotate(text)
        joined = rows.join(self.vectors, "term", "left") if self.vectors is not None else rows.withColumn("v", F.lit(None).cast("array<float>"))
        shown = F.coalesce(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit(NO_MATCH))
        return joined.select("term", "name", "offset", shown.alias("vector")).orderBy("offset")

    def predict(self, text: str) -> DataFrame:
        """(line): ``label: true`` or ``label: false`` for each label of the model."""
        if self.prior is None or self.weights is None:
            return self.spark.createDataFrame([], "line string")
        bag = self.annotate(text).select(F.lit("text").alias("id"), "term", F.col("mc").alias("w"))
        said = models.nb_predict(bag, self.prior, self.weights).select("category", (F.col("margin") > 0).alias("is"))
        labels = self.prior.select("category").distinct().join(said, "category", "left")
        return labels.orderBy("category").select(F.concat_ws(": ", "category", F.coalesce("is", F.lit(False)).cast("string")).alias("line"))

    def details(self, text: str) -> DataFrame:
        """(part, offset, line): all of the above for one text, each part by offset."""
        entity = self.extract(text).select(F.lit("names").alias("part"), F.col("start").alias("offset"), F.concat_ws(" ", "kind", "name").alias("line"))
        notes = self.annotate_with_types(text).select(F.lit("annotations").alias("part"), "offset", F.concat_ws(" ", "term", "name", F.col("mc").cast("string")).alias("line"))
        held = self.text_vectors(text).select(F.lit("vectors").alias("part"), "offset", F.concat_ws(" ", "term", "vector").alias("line"))
        said = self.predict(text).select(F.lit("prediction").alias("part"), F.lit(0).alias("offset"), "line")
        return entity.unionByName(notes).unionByName(held).unionByName(said).orderBy("part", "offset", "line")


def answer(rows: DataFrame) -> list[str]:
    """JSON lines of an answer, of ten thousand rows at most."""
    return [r[0] for r in rows.select(F.to_json(F.struct("*"))).limit(10_000).collect()]
