"""Named datasets of a data folder: articles with the annotations that belong to them. A dataset is made when it is asked for.

Names: ``raw`` and ``minimal`` (without texts) have no annotations; ``annotated``, ``annotated_types`` and ``annotated_minimal`` have those articles that have some. ``mini`` are the newest
labelled ones, ``mini_25`` to ``mini_100`` the same with the annotations of at least that confidence in hundredths. ``train``, ``test`` and ``validation`` with ``_ordered`` are the annotated
articles split by their number, ``_ordered_full`` all articles, ``_ordered_types`` with types, ``_shuffled`` split at random; with ``mini_`` before them those of ``mini``, with ``sub_`` every label
cut to the size of the rarest.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import enrich, splits, taxonomy, terms, vectors
from tidewire.sources.formats import limited
from tidewire.sources.tables import latest, table

PARTS = ("train", "test", "validation")
NAMES = (
    "raw", "minimal", "annotated", "annotated_types", "annotated_minimal", "mini", *(f"mini_{p}" for p in PARTS), *(f"mini_{c}" for c in (25, 50, 75, 100)),
    *(f"{p}_{k}" for k in ("ordered", "ordered_full", "ordered_types", "shuffled") for p in PARTS), *(f"sub_{p}_{k}" for k in ("ordered", "shuffled") for p in PARTS), "sub_train_ordered_types",
)
COLUMNS = ("hl", "body", "wc", "pub_date", "iptc", "url", "desc_terms", "pred", "split_name")
#: Articles of ``mini``.
MINI = 100_000


class Dataset(NamedTuple):
    """Articles, one row for each id, and their annotations, one row for each article and term."""

    articles: DataFrame
    annotations: DataFrame

    def joined(self) -> DataFrame:
        """Articles with a map of their annotations."""
        return enrich.with_annotations(self.articles, self.annotations)

    def part(self, articles: DataFrame) -> Dataset:
        """Some of the articles, with their annotations."""
        return Dataset(articles, self.annotations.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"))


class Catalogue:
    """The datasets of a folder. count: articles of each dataset at most, by id; a train part has six tenths of it, the others two."""

    def __init__(self, spark: SparkSession, folder: str, count: int | None = None, size: int = 64, seed: int = splits.SEED) -> None:
        self.spark, self.folder, self.count, self.size, self.seed = spark, folder, count, size, seed

    def table(self, name: str, fraction: float = 1.0) -> DataFrame:
        """A table by its name; part of it by hash of its rows with a fraction below 1."""
        rows = table(self.spark, self.folder, name)
        return rows if fraction >= 1 else rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) < int(fraction * 1_000_000))

    def articles(self) -> DataFrame:
        """All articles, each id once, as loaded last."""
        return latest(self.table("articles"), *COLUMNS)

    def annotations(self, types: bool = False, confidence: float = 0.5) -> DataFrame:
        """Annotations (article_id, term, mc, ann_offset, phrase, fb). confidence: the least; rows without a column ``confidence`` are sure. types: with one for each topic of an article's descriptors too."""
        rows = self.table("annotations")
        rows = terms.annotation_map(rows.where(F.col("confidence") >= confidence) if "confidence" in rows.columns else rows).select("article_id", "term", "mc", "ann_offset", "phrase", "fb")
        if not types:
            return rows
        found = taxonomy.descriptor_topics(latest(self.table("articles"), "desc_terms"), self.table("descriptor_map"), self.table("topics")).select("id", "topic_id").distinct()
        more = found.select(F.col("id").alias("article_id"), F.col("topic_id").alias("term"), F.lit(1).alias("mc"), F.lit(-1).alias("ann_offset"), F.concat(F.col("topic_id"), F.lit("->"), F.col("id")).alias("phrase"), F.lit(None).cast("string").alias("fb"))
        return rows.unionByName(more.join(rows.select("article_id", "term"), ["article_id", "term"], "left_anti"))

    def embeddings(self) -> DataFrame:
        """(term, v)."""
        return vectors.embeddings_of(self.table("annotations"), self.size)

    def annotated(self, types: bool = False, confidence: float = 0.5) -> Dataset:
        """The articles that have annotations."""
        notes = self.annotations(types, confidence)
        return Dataset(self.articles().join(notes.select(F.col("article_id").alias("id")), "id", "left_semi"), notes)

    def mini(self, confidence: float = 0.5) -> Dataset:
        whole = self.annotated(confidence=confidence)
        return whole.part(splits.newest(whole.articles, MINI).drop("number"))

    def split(self, whole: Dataset, part: str, shuffled: bool = False) -> Dataset:
        """A part of six, two and two tenths: by number, ids that aren't numbers first, or at random."""
        if shuffled:
            rows = splits.random_split(whole.articles, {"train": 6, "test": 2, "validation": 2}, "id", seed=self.seed, into="part_")
        else:
            number = F.try_to_number("id", F.lit("999999999999999999")).cast("long")
            rows = splits.ordered_split(whole.articles, F.coalesce(number, F.lit(-1).cast("long")), "id", into="part_")
        return whole.part(rows.where(F.col("part_") == part).drop("part_"))

    def sub(self, whole: Dataset) -> Dataset:
        """Every label cut to the size of the rarest."""
        return whole.part(whole.articles.join(splits.subsample_labels(whole.articles, self.seed), "id", "left_semi"))

    def by(self, name: str) -> Dataset:
        """A dataset by its name."""
        if name not in NAMES:
            raise KeyError(f"no dataset {name}; there are {', '.join(NAMES)}")
        part = next((p for p in PARTS if p in name), None)
        fraction = {"train": 0.6, "test": 0.2, "validation": 0.2, None: 1.0}[part]
        made = self._made(name, part)
        return made if self.count is None else made.part(limited(made.articles, self.count, fraction, "id"))

    def _made(self, name: str, part: str | None) -> Dataset:
        if name in ("raw", "minimal"):
            rows = self.articles()
            return Dataset(rows if name == "raw" else rows.withColumns({"body": F.lit(""), "hl": F.lit("")}), self.annotations().where("false"))
        if name == "annotated_minimal":
            whole, held = self.annotated(), self.embeddings()
            kept = whole.annotations.where(enrich.present("fb").isNotNull()).join(held.select("term"), "term", "left_semi")
            return Dataset(enrich.with_vector(whole.articles, whole.annotations, held).withColumns({"body": F.lit(""), "hl": F.lit("")}), kept)
        if name.startswith("mini"):
            share = name.removeprefix("mini_")
            whole = self.mini(int(share) / 100 if share.isdigit() else 0.5)
            return self.split(whole, part) if part else whole
        if part is None:
            return self.annotated(types=name.endswith("types"))
        whole = Dataset(self.articles(), self.annotations()) if name.endswith("full") else self.annotated(types=name.endswith("types"))
        made = self.split(whole, part, name.endswith("shuffled"))
        return self.sub(made) if name.startswith("sub") else made

    def ordered(self, types: bool = False, confidence: float = 0.5, time: int = 0) -> tuple[Dataset, Dataset]:
        """Train and validation in the order of numbers. types: with types; confidence: of the train annotations; time: so many buckets follow the train part, the first of them is the validation."""
        if time:
            whole = self.annotated()
            rows = splits.relative_buckets(whole.articles, time, "id", "id", seed=self.seed)
            return whole.part(rows.where("part = 'train'").drop("part", "bucket")), whole.part(rows.where("bucket = 0 and part = 'validation'").drop("part", "bucket"))
        if types or confidence == 0.5:
            return tuple(self.by(f"{p}_ordered{'_types' * types}") for p in ("train", "validation"))
        train = self.by("train_ordered")
        return Dataset(train.articles, self.annotations(types, confidence)).part(train.articles), self.by("validation_ordered")

    def subsampled(self) -> tuple[Dataset, Dataset]:
        """Train and validation with every label cut to the rarest."""
        return self.by("sub_train_ordered"), self.by("sub_validation_ordered")

    def shuffled(self) -> tuple[Dataset, Dataset]:
        """Train and validation split at random."""
        return self.by("train_shuffled"), self.by("validation_shuffled")

    def balanced(self, label: str, train: bool = True) -> Dataset:
        """The train or validation part with as many articles of a label as others."""
        whole = self.by("train_ordered" if train else "validation_ordered")
        return whole.part(splits.balanced(whole.articles, "id", F.array_contains("iptc", label), self.seed))

    def views(self) -> None:
        """Register the articles of all datasets as views for SQL, named like the datasets."""
        for name in NAMES:
            self.by(name).articles.createOrReplaceTempView(name)
