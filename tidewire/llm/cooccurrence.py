"""Problem 7: how often two items occur in the same record, and how much more often than chance.

The pair table is incremental and lives in a folder. A batch of baskets is compared with the stored ones of the buckets it falls in; each changed basket emits
its new pairs and items with +1 and its old ones with -1, and equal deltas are summed before they are shuffled. Baskets, counts and scores are kept in hash
buckets, each a folder of Parquet files; a merge reads and rewrites the buckets that its deltas fall in, and nothing else. The association of a pair is k * N / (n_a * n_b). N is the same for
all pairs and joins when scores are read, so what batches affect are pairs with a changed count or a changed item: their k, n_a and n_b are recomputed, either when scores are read
or by ``refresh``, which merges them into the stored scores; the rest is read as it is stored.

A manifest with a number of its own says which version of each bucket holds, and how many baskets there are. It is written under another name and then renamed, so a
reader sees the old state or the new one. The state before the last is removed with the files that only it used; readers of the last one still find theirs.

Pairs are made item by item, a row for each, so that a basket of thousands of items is never held as one array of pairs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.tables import normalised, table
from tidewire.storage import new_path

#: Hash buckets of each table of the state at least; a new table has as many as the session's shuffles have partitions.
BUCKETS = 32
KEYS = {"baskets": ["field_name", "basket"], "pairs": ["field_name", "item_a", "item_b"], "items": ["field_name", "item"], "scores": ["field_name", "item_a", "item_b"]}
SCHEMAS = {
    "baskets": "field_name string, basket string, version timestamp, items array<string>",
    "pairs": "field_name string, item_a string, item_b string, n long",
    "items": "field_name string, item string, n long",
    "scores": "field_name string, item_a string, item_b string, k long, n_a long, n_b long",
}


class PairTable:
    """Persistent counts of pairs and items and scores of pairs, by field. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        """Open the table at ``path``, or make one there; without a path in the session's shared folder."""
        self.spark, self.path = spark, path or new_path(spark, "pairs")
        self.manifest: dict[str, dict[str, str]] = {name: {} for name in KEYS}
        self.totals: dict[str, int] = {}
        self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.pending: list[str] = []  # folders of the deltas since scores were stored
        self.number, self._scratch = 0, ""
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if numbers := self._manifests():
            self.number = numbers[-1]
            kept = self._load(self.number)
            self.manifest, self.totals, self.buckets, self.pending = kept["tables"], kept["totals"], kept["buckets"], kept["pending"]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[int]:
        where = self._at("manifests")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(where) if s.getPath().getName().isdigit()) if self._fs.exists(where) else []

    def _load(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number}", wholetext=True).first()[0])

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        """One of baskets, pairs, items and scores; only: the buckets to read."""
        paths = [f"{self.path}/{name}/{version}/bucket={b}" for b, version in self.manifest[name].items() if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(name)).distinct().collect()]  # as many numbers as buckets at most

    def _write(self, name: str, rows: DataFrame, touched: list[int], summed: bool = False) -> dict[str, str]:
        """Write rows as a new version of the touched buckets; those that nothing is left of have no version. Each bucket is one task's. summed: rows of a key are summed there, so they are shuffled once."""
        version = uuid.uuid4().hex[:12]
        where = f"{self.path}/{name}/{version}"
        dealt = rows.withColumn("bucket", self._bucket(name)).repartition(len(touched), "bucket")
        if summed:
            dealt = dealt.groupBy("bucket", *KEYS[name]).agg(F.sum("n").alias("n")).where("n <> 0").select(*KEYS[name], "n", "bucket")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(where)
        listed = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{name}/{version}"))]
        kept = {b: v for b, v in self.manifest[name].items() if int(b) not in touched}
        return kept | {n.split("=")[1]: version for n in listed if n.startswith("bucket=")}

    def _merge(self, name: str, deltas: DataFrame) -> dict[str, str]:
        if not self.manifest[name]:
            return self._write(name, deltas.select(*KEYS[name], "n"), list(range(self.buckets)))
        touched = self._touched(name, deltas)
        if not touched:
            return self.manifest[name]
        return self._write(name, self.read(name, touched).unionByName(deltas.select(*KEYS[name], "n")), touched, summed=True)

    def update(self, baskets: DataFrame) -> DataFrame:
        """Take in a batch of (field_name, basket, version, items): later versions replace earlier ones, a null version is the earliest.

        Within the batch the greatest version of a basket counts, of equal ones that with the greatest items. Null and blank items are left out,
        repeated ones count once; a basket may be empty. Gives the affected scores, as ``scores`` does; they can be read until scores are stored or the next batch comes.
        """
        early = F.coalesce("version", F.lit("1900-01-01").cast("timestamp"))
        clean = F.array_sort(F.array_distinct(F.filter(F.coalesce("items", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))))
        batch = baskets.where("field_name is not null and basket is not null").select("field_name", "basket", F.struct(early.alias("version"), clean.alias("items")).alias("row"))
        self._scratch = f"scratch/{uuid.uuid4().hex[:12]}"
        batch = self._kept(batch.groupBy("field_name", "basket").agg(F.max("row").alias("row")).select("field_name", "basket", "row.*"), "batch")
        touched = self._touched("baskets", batch) if self.manifest["baskets"] else list(range(self.buckets)) * (not batch.isEmpty())
        if not touched:
            return self.scores().where("false")
        old = self.read("baskets", touched).select("field_name", "basket", F.col("version").alias("was"), F.col("items").alias("old"))
        both = old.join(batch, ["field_name", "basket"], "full_outer")
        newer = F.col("version").isNotNull() & (F.col("was").isNull() | (F.col("version") >= F.col("was")))
        both = both.withColumn("newer", newer)
        changed = both.where(F.col("newer") & ~F.coalesce(F.col("old") == F.col("items"), F.lit(False))).select("field_name", "items", "old")
        whole = both.select("field_name", "basket", F.when(F.col("newer"), F.col("version")).otherwise(F.col("was")).alias("version"), F.when(F.col("newer"), F.col("items")).otherwise(F.col("old")).alias("items"))
        changed = self._kept(changed, "changed")
        fresh = {r[0]: r[1] for r in changed.where("old is null").groupBy("field_name").agg(F.count("*")).collect()}  # as many as fields
        signed = changed.select("field_name", F.lit(1).cast("long").alias("n"), "items").unionByName(changed.where("old is not null").select("field_name", F.lit(-1).cast("long").alias("n"), F.col("old").alias("items")))
        one = signed.select("field_name", "n", F.posexplode("items").alias("i", "item_a"), "items")
        two = one.select("field_name", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("item_b"), "n")
        pairs = self._kept(two.groupBy(*KEYS["pairs"]).agg(F.sum("n").alias("n")).where("n <> 0"), "pairs")
        items = self._kept(one.select("field_name", F.col("item_a").alias("item"), "n").groupBy(*KEYS["items"]).agg(F.sum("n").alias("n")).where("n <> 0"), "items")
        self.manifest = self.manifest | {"baskets": self._write("baskets", whole, touched), "pairs": self._merge("pairs", pairs), "items": self._merge("items", items)}
        self.totals = {f: self.totals.get(f, 0) + fresh.get(f, 0) for f in self.totals | fresh}
        self.pending = [*self.pending, self._scratch]
        for name in ("batch", "changed"):
            self._fs.delete(self._at(f"{self._scratch}/{name}"), True)
        self._publish()
        return self._scored(self._affected([self._scratch])[0])

    def _affected(self, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
        """(field_name, item_a, item_b, k, n_a, n_b) of the pairs whose count or item is among the deltas of these folders, and the keys of pairs that may be no more."""
        deltas = {name: self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{folder}/{name}" for folder in scratch]).select(*KEYS[name]).distinct() for name in ("pairs", "items")}
        held = self.read("pairs").withColumnRenamed("n", "k")
        if self.manifest["scores"] or scratch != self.pending:  # else all are affected
            a, b = (deltas["items"].select("field_name", F.col("item").alias(x), F.lit(True).alias(f"hit_{x}")) for x in ("item_a", "item_b"))
            held = held.join(deltas["pairs"].withColumn("hit", F.lit(True)), KEYS["pairs"], "left").join(a, ["field_name", "item_a"], "left").join(b, ["field_name", "item_b"], "left")
            held = held.where("hit or hit_item_a or hit_item_b").select(*KEYS["pairs"], "k")
        single = self.read("items")
        for x in "ab":
            held = held.join(single.select("field_name", F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")), ["field_name", f"item_{x}"])
        return held.select(*KEYS["pairs"], "k", "n_a", "n_b"), deltas["pairs"]

    def refresh(self) -> None:
        """Store the scores that the batches since the last time have affected; only the buckets they fall in are rewritten."""
        if not self.pending:
            return
        affected, gone = self._affected(self.pending)
        if not self.manifest["scores"]:
            self.manifest = self.manifest | {"scores": self._write("scores", affected, list(range(self.buckets)))}
        else:
            self._scratch = f"scratch/{uuid.uuid4().hex[:12]}"
            affected = self._kept(affected, "scores")
            keys = affected.select(*KEYS["scores"]).unionByName(gone).distinct()
            if touched := self._touched("scores", keys):
                kept = self.read("scores", touched).join(keys, KEYS["scores"], "left_anti")
                self.manifest = self.manifest | {"scores": self._write("scores", kept.unionByName(affected), touched)}
            self._fs.delete(self._at(self._scratch), True)
        self.pending = []
        self._publish()

    def _publish(self) -> None:
        """Make the state the one that holds, and remove the files that only the one before the last used."""
        self.number += 1
        new, named = self._at(f"manifests/.{self.number}-{uuid.uuid4().hex[:12]}"), self._at(f"manifests/{self.number}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps({"tables": self.manifest, "totals": self.totals, "buckets": self.buckets, "pending": self.pending}).encode()))
        out.close()
        if not self._fs.rename(new, named):
            raise RuntimeError(f"manifest {self.number} of {self.path} is there already: another writer was first")
        for number in self._manifests()[:-2]:
            kept, old = [self._load(n) for n in (self.number - 1, self.number)], self._load(number)
            used = {(name, b, v) for state in kept for name, of in state["tables"].items() for b, v in of.items()}
            for name, of in old["tables"].items():
                for b, version in of.items():
                    if (name, b, version) not in used:
                        self._fs.delete(self._at(f"{name}/{version}/bucket={b}"), True)
            for folder in set(old["pending"]).difference(*[state["pending"] for state in kept]):
                self._fs.delete(self._at(folder), True)
            self._fs.delete(self._at(f"manifests/{number}"), False)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{self._scratch}/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _scored(self, rows: DataFrame) -> DataFrame:
        totals = self.spark.createDataFrame(sorted(self.totals.items()), "field_name string, n_all long")
        scored = rows.join(F.broadcast(totals), "field_name")  # a row for each field
        return scored.select("field_name", "item_a", "item_b", "k", "n_a", "n_b", "n_all", (F.col("k") / F.col("n_a") * F.col("n_all") / F.col("n_b")).alias("lift"))

    def scores(self, least: int = 1) -> DataFrame:
        """(field_name, item_a, item_b, k, n_a, n_b, n_all, lift) of all pairs of at least ``least`` records: those stored, and those affected since as they are now."""
        rows = self.read("scores")
        if self.pending:
            affected, gone = self._affected(self.pending)
            if self.manifest["scores"]:
                old = rows.join(gone, KEYS["scores"], "left_anti")
                items = self.spark.read.schema(SCHEMAS["items"]).parquet(*[f"{self.path}/{folder}/items" for folder in self.pending]).select("field_name", "item").distinct()
                for x in ("item_a", "item_b"):
                    old = old.join(items.withColumnRenamed("item", x), ["field_name", x], "left_anti")
                affected = old.unionByName(affected)
            rows = affected
        return self._scored(rows.where(F.col("k") >= least))


def article_baskets(articles: DataFrame) -> DataFrame:
    """Baskets of the fields ``iptc`` (normalised) and ``ann`` (as they are) of every article row."""
    rows = articles.where("id is not null").select(F.col("id").alias("basket"), F.col("loaded_at").alias("version"), F.transform("iptc", normalised).alias("iptc"), "ann")
    return rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col("basket"), F.col("version"), F.col(f).alias("items")) for f in ("iptc", "ann")])).alias("x")).select("x.*")


def article_pairs(articles: DataFrame) -> PairTable:
    """The pair table of all articles, built as it would be load by load, in two batches: the rows of the first nine tenths of the loads, whose scores are stored, then the rest, which adds articles and replaces reloaded ones."""
    baskets = article_baskets(articles)
    state = PairTable(articles.sparkSession)
    late = articles.agg(F.percentile_approx("loaded_at", 0.9)).first()[0]
    if late is None:
        state.update(baskets)
    else:
        state.update(baskets.where(F.col("version").isNull() | (F.col("version") <= F.lit(late))))
        state.refresh()
        state.update(baskets.where(F.col("version") > F.lit(late)))
    return state


#: A case is a pair in so many records, so much more often than chance.
LEAST, LIFT = 5, 8


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items that are together in at least 5 articles and at least 8 times as often as by chance."""
    scored = article_pairs(table(spark, folder, "articles")).scores(least=LEAST)
    return scored.where(F.col("k") * F.col("n_all") >= LIFT * F.col("n_a") * F.col("n_b")).select("field_name", "item_a", "item_b")


def p7_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with its counts and its ratio to chance."""
    return article_pairs(table(spark, folder, "articles")).scores().withColumn("lift", F.round("lift", 6))


_SQL = r"""
with newest as (select id, r.iptc, r.ann from (select id, arg_max({'iptc': iptc, 'ann': ann}, loaded_at) r from articles where id is not null group by id)),
held as (select distinct 'iptc' field_name, id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) item from (select id, unnest(iptc) x from newest)
 union select distinct 'ann', id, x from (select id, unnest(ann) x from newest)),
kept as (select * from held where trim(item) <> ''),
single as (select field_name, item, count(*) n from kept group by all),
pair as (select a.field_name, a.item item_a, b.item item_b, count(*) k from kept a join kept b on a.field_name = b.field_name and a.id = b.id and a.item < b.item group by all),
total as (select count(*) n_all from newest)
"""

ORACLES = {
    "p7_found": f"{_SQL} select p.field_name, item_a, item_b from pair p join single a on a.field_name = p.field_name and a.item = item_a join single b on b.field_name = p.field_name and b.item = item_b, total where k >= 5 and k * n_all >= 8 * a.n * b.n",
    "p7_pairs": f"{_SQL} select p.field_name, item_a, item_b, k, a.n n_a, b.n n_b, n_all, round(k / a.n::double * n_all / b.n, 6) lift from pair p join single a on a.field_name = p.field_name and a.item = item_a join single b on b.field_name = p.field_name and b.item = item_b, total",
}
