"""Splitting, sampling and balancing of collections.

Random choices are orders by a hash of key and seed, so that they are the same on every run and engine. Positions in the whole order are found
without sorting in one task: rows are range-partitioned, partitions are counted, and a partition's rows add their place to the counts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.tables import normalised

SEED = 123


def luck(*keys: str | Column, seed: int = SEED) -> Column:
    """Text that orders rows at random: the MD5 sum of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def share(*keys: str | Column, seed: int = SEED) -> Column:
    """A number from 0 to less than 1 for each row: the first 32 bits of its hash."""
    return F.conv(F.substring(luck(*keys, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_index(rows: DataFrame, *order: str | Column, into: str = "idx") -> DataFrame:
    """rows with their place from 0 in an order that must tell all rows apart.

    One range shuffle, a sort within its partitions and a running number in each; the partitions' sizes, as many numbers as partitions, are joined back. No task sorts more than its range.
    """
    from tidewire.storage import cut

    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumns({f"_o{i}": c for i, c in enumerate(columns)})
    names = [f"_o{i}" for i in range(len(columns))]
    spread = keyed.repartitionByRange(*names).sortWithinPartitions(*names)
    # 33 low bits of this number are the row's place in its partition, the rest is the partition's number
    placed = cut(spread.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_own", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "index")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before", "_id", *names)


def shuffled(rows: DataFrame, *keys: str, seed: int = SEED) -> DataFrame:
    """rows in a random order that the seed fixes."""
    return rows.orderBy(luck(*keys, seed=seed), *keys)


def newest(articles: DataFrame, k: int = 100_000) -> DataFrame:
    """The k labelled articles of greatest number; ids that aren't numbers don't count. Each task keeps k rows."""
    number = F.try_to_number("id", F.lit("999999999999999999")).cast("long")
    return articles.where(F.size("iptc") > 0).withColumn("number", number).where("number is not null").orderBy(F.desc("number")).limit(k)


def first_of_each(rows: DataFrame, group: str, k: int, *order: str | Column) -> DataFrame:
    """The first k rows of each group; tasks pass on no more than k of a group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def bernoulli(rows: DataFrame, part: float, *keys: str, seed: int = SEED) -> DataFrame:
    """Each row with the chance ``part``, by hash."""
    return rows.where(share(*keys, seed=seed) < part)


def random_split(rows: DataFrame, weights: dict[str, float], *keys: str, seed: int = SEED, into: str = "part") -> DataFrame:
    """rows with the name of a part, drawn by weight. Nothing is shuffled."""
    total, upto, choice = sum(weights.values()), 0.0, None
    u = share(*keys, seed=seed)
    for name, w in list(weights.items())[:-1]:
        upto += w / total
        choice = F.when(u < upto, name) if choice is None else choice.when(u < upto, name)
    last = list(weights)[-1]
    return rows.withColumn(into, F.lit(last) if choice is None else choice.otherwise(last))


def ordered_split(rows: DataFrame, *order: str | Column, into: str = "part") -> DataFrame:
    """rows with train for the first six tenths of the order, test for the next two, validation for the rest."""
    placed = with_index(rows, *order)
    n = rows.agg(F.count("*").alias("_n"))
    train, test = F.floor(F.col("_n") * F.lit(6) / F.lit(10)), F.floor(F.col("_n") * F.lit(8) / F.lit(10))
    return placed.join(F.broadcast(n)).withColumn(into, F.when(F.col("idx") < train, "train").when(F.col("idx") < test, "test").otherwise("validation")).drop("_n", "idx")


def static_buckets(rows: DataFrame, buckets: int, *order: str | Column, into: str = "bucket", compat: bool = False) -> DataFrame:
    """rows with the number of their bucket of n / buckets rows along the order; the last ones go on to the end.

    compat: buckets after the first begin a row early, so that this row is in both, and the rows beyond the last whole bucket are left out.
    """
    placed = with_index(rows, *order)
    n = rows.agg(F.floor(F.count("*") / buckets).alias("_size"))
    joined = placed.join(F.broadcast(n)).where("_size > 0")
    number = F.floor(F.col("idx") / F.col("_size")).cast("int")
    if not compat:
        return joined.withColumn(into, F.least(number, F.lit(buckets - 1))).drop("_size", "idx")
    last = (F.col("idx") % F.col("_size") == F.col("_size") - 1) & (number < buckets - 1)
    twice = F.when(last, F.array(number, number + 1)).otherwise(F.array(number))
    return joined.where(number < buckets).withColumn(into, F.explode(twice)).drop("_size", "idx")


def relative_buckets(rows: DataFrame, buckets: int, key: str, *order: str | Column, seed: int = SEED) -> DataFrame:
    """rows with part and bucket: the first rows of the order are train, then each bucket's rows are halved at random into test and validation.

    s = n / (0.4 * buckets + 0.6); train has round(0.6 s) rows, a bucket 2 * round(0.2 s); rows beyond the last bucket are left out.
    """
    placed = with_index(rows, *order)
    s = F.count("*") / F.lit(0.4 * buckets + 0.6)
    n = rows.agg(F.round(0.6 * s).cast("long").alias("_train"), F.round(0.2 * s).cast("long").alias("_half"))
    joined = placed.join(F.broadcast(n))
    train = joined.where("idx < _train").withColumn("bucket", F.lit(-1)).withColumn("part", F.lit("train"))
    bucket = F.floor((F.col("idx") - F.col("_train")) / F.when(F.col("_half") > 0, 2 * F.col("_half"))).cast("int")
    held = joined.where("idx >= _train").withColumn("bucket", bucket).where(F.col("bucket") < buckets).drop("idx")
    # the place by luck within a bucket: the whole order's, less that of the buckets before, all of which are full
    rank = F.col("_place") - F.col("bucket").cast("long") * 2 * F.col("_half")
    tested = with_index(held, "bucket", luck(key, seed=seed), key, into="_place").withColumn("part", F.when(rank < F.col("_half"), "test").otherwise("validation"))
    return train.drop("idx", "_train", "_half").unionByName(tested.drop("_place", "_train", "_half"))


def excluded_terms(rows: DataFrame, part: str, term: str) -> DataFrame:
    """Terms that are in train and in another part too."""
    return rows.where(F.col(part) == "train").select(term).intersect(rows.where(F.col(part) != "train").select(term))


def balanced(rows: DataFrame, key: str, positive: Column, seed: int = SEED) -> DataFrame:
    """All positive rows and as many others, chosen by hash; all others if they are fewer."""
    marked = rows.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    n = marked.agg(F.count_if("_pos").alias("_n"))
    others = with_index(marked.where("not _pos"), luck(key, seed=seed), key).join(F.broadcast(n)).where("idx < _n").drop("idx", "_n")
    return marked.where("_pos").unionByName(others).drop("_pos")


def supersampled(rows: DataFrame, key: str, positive: Column, seed: int = 0) -> DataFrame:
    """All rows and, for each row that isn't positive, a copy of a positive one, drawn with replacement; a copy's key ends in _ and its number. Without positives nothing is added.

    So the copies are as many as the others, and positives end up more than the others, as intended.
    """
    marked = rows.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    n = marked.agg(F.count_if("_pos").alias("_n"), F.count_if(~F.col("_pos")).alias("_missing"))
    drawn = draw_with_replacement(marked.where("_pos"), n.select("_missing"), key, seed)
    return marked.unionByName(drawn).drop("_pos")


def numbered(rows: DataFrame, most: str, into: str, block: int = 100_000) -> DataFrame:
    """rows, each as many times as its number ``most``, numbered from 0. Long runs are cut into blocks that are spread over the tasks before they are made."""
    at = F.col("_block") * block
    blocks = rows.where(F.col(most) > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(most) - 1) / block))))
    return blocks.repartition(F.col("_block"), F.col(most)).withColumn(into, F.explode(F.sequence(at, F.least(F.col(most).cast("long"), at + block) - 1))).drop("_block")


def draw_with_replacement(rows: DataFrame, how_many: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Copies of rows drawn with replacement, as many as the one number of how_many; keys end in _ and the copy's number. A copy's number and the seed draw the place of its row, so no row waits for another."""
    placed = with_index(rows, key)
    n = rows.agg(F.count("*").alias("_rows"))
    wanted = numbered(how_many.toDF("_most"), "_most", "_copy")
    pick = wanted.join(F.broadcast(n)).where("_rows > 0").withColumn("idx", F.floor(share("_copy", seed=seed) * F.col("_rows")).cast("long"))
    return placed.join(pick.select("idx", "_copy"), "idx").withColumn(key, F.concat_ws("_", F.col(key).cast("string"), F.col("_copy").cast("string"))).select(*rows.columns)


def each_label(articles: DataFrame) -> DataFrame:
    """(label, and the article's columns), a row for each label of an article, normalised."""
    return articles.withColumn("label", F.explode(F.array_distinct(F.transform("iptc", normalised)))).where("label <> ''")


def subsample_labels(articles: DataFrame, seed: int = SEED) -> DataFrame:
    """For every label as many articles as the rarest label has, drawn by hash; an article that several labels draw comes once."""
    from tidewire.storage import cut

    rows = cut(each_label(articles).select("id", "label"), "labels")
    least = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    placed = with_index(rows, "label", luck("id", "label", seed=seed), "id")
    first = placed.groupBy("label").agg(F.min("idx").alias("_first"))
    return placed.join(first, "label").join(F.broadcast(least)).where("idx - _first < _least").select("id").distinct()


def supersample_labels(articles: DataFrame, cap: int | None = None, seed: int = SEED) -> DataFrame:
    """(label, id, copy): every label's articles, and copies drawn with replacement up to the number of the most frequent label, or up to cap if that is less. Copies are numbered from 1."""
    from tidewire.storage import cut

    rows = cut(each_label(articles).select("id", "label"), "labels")
    counts = rows.groupBy("label").agg(F.count("*").alias("_n"))
    most = F.max("_n") if cap is None else F.least(F.max("_n"), F.lit(cap))
    counts = counts.join(F.broadcast(counts.agg(most.alias("_most"))))
    all_places = with_index(rows, "label", "id")
    first = all_places.groupBy("label").agg(F.min("idx").alias("_first"))
    placed = all_places.join(first, "label").withColumn("idx", (F.col("idx") - F.col("_first")).cast("int"))
    wanted = numbered(counts.withColumn("_missing", F.col("_most") - F.col("_n")), "_missing", "copy").withColumn("copy", F.col("copy") + 1)
    picked = wanted.withColumn("idx", F.floor(share("label", "copy", seed=seed) * F.col("_n")).cast("int"))
    # the copies are made after the last shuffle whose size is known, so they look few; without the hint all of them would be broadcast
    copies = placed.join(picked.select("label", "idx", "copy").hint("merge"), ["label", "idx"]).select("label", "id", "copy")
    return rows.select("label", "id", F.lit(0).cast("long").alias("copy")).unionByName(copies)


def prefixes(rows: DataFrame, sizes: list[int], *order: str | Column) -> DataFrame:
    """rows with a column prefix: a row for each of the sizes whose first rows it is among. For learning curves."""
    placed = with_index(rows, *order)
    return placed.withColumn("prefix", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s > F.col("idx")))).drop("idx")
