"""Problem 1: a sample whose shares of each category match given targets.

Rows may be of several categories. A row counts for each of them, so the counts sum to more than the sample's rows, and the targets are met up to one
common factor. Inclusion probabilities are calibrated by exponential tilting, p = 1 / (1 + exp(-(l0 + the sum of l over the row's
categories))): the dual is convex and its Newton steps need only the moments of the categories, which are aggregated over
the distinct sets of categories with their counts - one small job a step. The sample's size and each count, certain rows included, are met exactly; the factor is free,
as the multiplier of the condition that l is at right angles to the targets. Steps end when the conditions hold.

Categories that can't be in proportion leave the dual: those with no more rows than asked for, and those whose l runs beyond ``TILT``, are taken with all their rows; those that
certain rows alone bring over their target get none but these. Where conditions contradict each other without any l running away, as with categories that always come together, the one that others bring over its target most leaves and goes where they lead. Floors are fixed first: the least rows asked of each other category are certain.

The sample is drawn with the pivotal method: two units at a time settle their probabilities against each other until one of them is in or out. Each
task runs along its rows in order of their set of categories, so that every set gets its share of a task to within a unit; the last unit of
each task is left open, and those, as many as tasks, are settled the same way at the end. Rows are spread by the hash of their key, so a
category of a third of all rows is no more than a third of each task. Randomness is a hash of key and seed: the same task run again draws the same.
A category that chance leaves below what is asked for gets further rows in exchange for rows of categories that have more than enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.taxonomy import subjects_by, subjects_of_labels
from tidewire.sources.tables import latest, table
from tidewire.storage import cut

SEED = 11
#: Newton steps at most, categories at most, and the tilt beyond which a category's rows are as good as all in or all out.
STEPS, CATEGORIES, TILT = 60, 1000, 14.0
#: Rows of a task of the draw at least: few rows are drawn by few tasks, as each task rounds on its own.
DRAWN = 20_000


class Dual:
    """The dual of the calibration over patterns (at array<int>, n): places of the categories of a row, and how many free rows are alike."""

    def __init__(self, patterns: DataFrame, names: list[str]) -> None:
        place = {c: i for i, c in enumerate(names)}
        lookup = F.create_map(*[F.lit(x) for c in names for x in (c, place[c])]) if names else None
        at = F.transform(F.filter("subjects", lambda x: x.isin(*names)), lambda x: F.element_at(lookup, x)) if names else F.array().cast("array<int>")
        self.patterns = cut(patterns.groupBy(at.alias("at")).agg(F.sum("n").alias("n")), "p1-dual")
        self.k = len(names)

    def moments(self, l0: float, tilt: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's sum of log(1 + exp(eta)), expected counts (first that of all rows) and their derivatives; Spark aggregates, a small square comes back."""
        numbers = F.array(*[F.lit(float(x)) for x in tilt]) if self.k else F.array(F.lit(0.0))
        eta = F.lit(l0) + F.aggregate("at", F.lit(0.0), lambda s, i: s + F.element_at(numbers, i + 1))
        rows = self.patterns.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        rows = rows.select("n", "p", F.array_insert(F.transform("at", lambda i: i + 1), 1, F.lit(0)).alias("at"), F.when(F.col("eta") > 0, F.col("eta") + F.log1p(F.exp(-F.col("eta")))).otherwise(F.log1p(F.exp("eta"))).alias("z"))
        pairs = rows.select("n", "p", "z", "at", F.explode("at").alias("i")).select("n", "p", "z", "i", F.explode("at").alias("j"))
        got = pairs.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"), F.sum(F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * F.col("z")).alias("z")).collect()
        first, second, z = np.zeros(self.k + 1), np.zeros((self.k + 1,) * 2), 0.0
        for r in got:  # at most the square of the number of categories
            second[r["i"], r["j"]] = r["h"]
            if r["i"] == r["j"]:
                first[r["i"]] = r["g"]
            if r["i"] == r["j"] == 0:
                z = r["z"]
        return z, first, second


def calibrate(patterns: DataFrame, targets: dict[str, float], fixed: dict[str, float], size: float, start: dict[str, float] | None = None) -> tuple[float, dict[str, float], float]:
    """l0, l of each category and the factor f, so that of the free rows ``size`` are expected and each category's expected count, with its fixed one, is f times its target.

    patterns: (subjects, n) of the free rows. Ends early when a category's l is beyond ``TILT``: then no f can be met; of conditions that contradict each other one is given l NaN.
    """
    names = sorted(targets)
    dual, t = Dual(patterns, names), np.array([targets[c] for c in names])
    held = np.array([fixed.get(c, 0.0) for c in names])
    tilt = np.array([(start or {}).get(c, 0.0) for c in names])
    tilt = tilt - t * (t @ tilt) / max(t @ t, 1e-12)  # at right angles to the targets
    normal = np.concatenate([[0.0], t])
    total = patterns.agg(F.sum("n")).first()[0] or 0
    l0 = float(np.log(max(size, 1e-9) / max(total - size, 1e-9))) if total else 0.0
    if not total or size <= 0 or size >= total:
        return (TILT * 3 if size > 0 else -TILT * 3), dict.fromkeys(names, 0.0), 1.0
    value = lambda z, l0, tilt: float(z - l0 * size + tilt @ held)
    z, first, second = dual.moments(l0, tilt)
    k = len(names) + 1
    for _ in range(STEPS):
        gradient = first + np.concatenate([[-size], held])
        system = np.zeros((k + 1, k + 1))
        system[:k, :k] = second
        system[:k, k], system[k, :k] = -normal, normal
        solved = np.linalg.lstsq(system, np.concatenate([-gradient, [0.0]]), rcond=1e-12)[0]
        step, factor = solved[:k], float(solved[k])
        off = np.abs(gradient - factor * normal)
        if off[0] < 0.05 and (off[1:] <= 0.05 + 1e-4 * np.maximum(t, held)).all():  # rows
            return l0, dict(zip(names, tilt.tolist(), strict=True)), factor
        if np.abs(tilt).max(initial=0) > TILT:
            return l0, dict(zip(names, tilt.tolist(), strict=True)), factor
        if np.abs(step).max(initial=0) < 1e-7 and (off[1:] > 0.05 + 1e-4 * np.maximum(t, held)).any():
            break
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        now, slope = value(z, l0, tilt), float(gradient @ step)
        for _ in range(30):
            new = dual.moments(l0 + step[0], tilt + step[1:])
            if value(new[0], l0 + step[0], tilt + step[1:]) <= now + 1e-4 * slope + 1e-9 * abs(now):
                break
            step, slope = step / 2, slope / 2
        l0, tilt = l0 + step[0], tilt + step[1:]
        z, first, second = new
    if not names:
        raise RuntimeError(f"the calibration didn't converge in {STEPS} steps")
    more = (gradient - factor * normal)[1:] / np.maximum(t, 1.0)  # what a category has beyond its target
    tilt[int(np.argmax(more if (more > 0).any() else -more))] = np.nan
    return l0, dict(zip(names, tilt.tolist(), strict=True)), factor


def pivotal(chance: np.ndarray, luck: np.ndarray, kept: tuple[int, float] | None) -> tuple[list[int], list[int], tuple[int, float] | None]:
    """Settle units along their order. kept: the number and the chance of the open unit so far; gives those in, those out and the open unit. Units are numbered from 0, the kept one has its own number."""
    taken, left = [], []
    for j, (b, u) in enumerate(zip(chance.tolist(), luck.tolist(), strict=True)):
        if kept is None:
            kept = (j, b)
            continue
        i, a = kept
        if a + b < 1:
            if u * (a + b) < a:
                left.append(j)
                kept = (i, a + b)
            else:
                left.append(i)
                kept = (j, a + b)
        elif u * (2 - a - b) < 1 - b:
            taken.append(i)
            kept = (j, a + b - 1)
        else:
            taken.append(j)
            kept = (i, a + b - 1)
        if kept[1] < 1e-9:
            left.append(kept[0])
            kept = None
        elif kept[1] > 1 - 1e-9:
            taken.append(kept[0])
            kept = None
    return taken, left, kept


def draw(rows: DataFrame, chance: str = "chance", seed: int = SEED) -> DataFrame:
    """The ids of a sample with the chances given, of as many rows as they sum to. rows: (id, subjects, chance)."""
    n = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // DRAWN))
    luck = (F.xxhash64(F.lit(seed), "id").cast("double") / F.lit(2.0**64) + 0.5).alias("luck")
    spread = rows.select("id", F.col(chance).alias("chance"), luck, F.array_join("subjects", "\x00").alias("kind")).repartition(n, "id").sortWithinPartitions("kind", "luck", "id")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, open_luck = None, 0.0
        for batch in batches:
            ids, luck_ = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            taken, _, now = pivotal(batch.column(1).to_numpy(), luck_, None if open_ is None else (-1, open_[1]))
            out = [ids[i] if i >= 0 else open_[0] for i in taken]
            open_ = None if now is None else (ids[now[0]] if now[0] >= 0 else open_[0], now[1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.nulls(len(out), pa.float64())], ["id", "open"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_[0]], pa.string()), pa.array([open_[1]], pa.float64())], ["id", "open"])

    settled = cut(spread.select("id", "chance", "luck").mapInArrow(go, "id string, open double"), "p1-settled")
    rest = sorted((r["id"], r["open"]) for r in settled.where("open is not null").collect())  # one for each task at most
    taken, _, last = pivotal(np.array([c for _, c in rest]), np.random.default_rng(seed).random(len(rest)), None)
    if last is not None and last[1] >= 0.5:
        taken.append(last[0])
    more = rows.sparkSession.createDataFrame([(rest[i][0],) for i in taken], "id string")
    return settled.where("open is null").select("id").unionByName(more)


def sample(rows: DataFrame, targets: DataFrame, size: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A sample of rows (id unique, subjects array) and its report.

    targets: (topic, target_permille, min_rows); null numbers are 0, repeated topics count once with their greatest numbers. size: the sample's, half of the rows
    if not given. The sample is (id, subjects, chance). The report is (topic, held, required, sampled, shortage, gap, target_permille, share_permille, expected): required is the
    greater of min_rows and the target's rows, rounded up; shortage is what required exceeds held by, gap what it exceeds sampled by, both 0 if met. share_permille is what the topic's
    rows are of the sample; expected is the common factor times the target's rows, or all rows held if the topic was out of reach and had to be taken whole; null for topics that others' rows bring over their target.
    Topics that no row has are reported too; rows of no target's category are drawn with what is left. If floors ask for more than the sample holds, they are only
    calibrated for. Empty tables give empty results.
    """
    spark = rows.sparkSession
    rows = cut(rows.select("id", "subjects"), "p1-rows")
    total = rows.count()
    size = total // 2 if size is None else min(size, total)
    listed = targets.where("topic is not null").groupBy("topic").agg(F.max(F.coalesce("target_permille", F.lit(0))).alias("permille"), F.max(F.coalesce("min_rows", F.lit(0))).alias("least")).limit(CATEGORIES + 1).collect()
    if len(listed) > CATEGORIES:
        raise ValueError(f"{CATEGORIES} categories at most")
    each = rows.select(F.explode("subjects").alias("topic")).groupBy("topic").agg(F.count("*").alias("held"))
    held = {r["topic"]: r["held"] for r in each.where(F.col("topic").isin([r["topic"] for r in listed])).collect()}
    need = {r["topic"]: max(int(r["least"]), -(-size * int(r["permille"]) // 1000)) for r in listed}
    share = {r["topic"]: size * int(r["permille"]) / 1000 for r in listed}
    short = {c for c in need if held.get(c, 0) <= need[c]}
    floors = {r["topic"]: int(r["least"]) for r in listed if r["topic"] not in short and r["least"]}

    # certain rows of the floors, and the distinct sets of categories
    if floors:
        first = Window.partitionBy("topic").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id")
        own = rows.select("id", F.explode("subjects").alias("topic")).where(F.col("topic").isin(list(floors)))
        own = own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(floors.values()))
        least = F.create_map(*[F.lit(x) for c, n in floors.items() for x in (c, n)])
        own = own.where(F.col("rank") <= F.element_at(least, F.col("topic"))).select("id", F.lit(True).alias("floor")).distinct()
        rows = cut(rows.join(own, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(False))), "p1-floors")
    else:
        rows = rows.withColumn("floor", F.lit(False))
    patterns = cut(rows.groupBy("subjects", "floor").agg(F.count("*").alias("n")), "p1-patterns")
    within = lambda topics: F.arrays_overlap("subjects", F.array(*[F.lit(c) for c in sorted(topics)])) if topics else F.lit(False)

    def fixed_by(whole: set[str], floor: bool) -> tuple[DataFrame, int, dict[str, int]]:
        """The condition of a certain row, how many there are, and how many of each category."""
        certain = patterns.where(within(whole) | (F.col("floor") if floor else F.lit(False)))
        count = certain.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        by = certain.select("n", F.explode("subjects").alias("topic")).where(F.col("topic").isin(list(need))).groupBy("topic").agg(F.sum("n").alias("n")).collect()
        return certain, count, {r["topic"]: r["n"] for r in by}

    whole, over, loose, floor, tilt = set(short), set(), set(), True, {}
    if fixed_by(whole, floor)[1] > size:
        floor = False
        if fixed_by(whole, floor)[1] > size:
            whole = set()
    while True:
        _, certain, fixed = fixed_by(whole, floor)
        free = patterns.where(~(within(whole) | (F.col("floor") if floor else F.lit(False))))
        goal = {c: share[c] for c in need if share[c] > 0 and held.get(c, 0) and c not in whole | over | loose}
        fixed_over = free.where(~within(over)) if over else free  # categories over their target get no further rows while others are left
        left = fixed_over.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left < size - certain:
            fixed_over, goal = free, {}
        l0, tilt, factor = calibrate(fixed_over, goal, fixed, size - certain, tilt)
        far = max(tilt, key=lambda c: np.inf if np.isnan(tilt[c]) else abs(tilt[c]), default=None)
        if far is None or abs(tilt[far]) <= TILT:
            break
        if tilt[far] < 0:  # certain rows bring it over its target
            over.add(far)
        elif tilt[far] > 0 and fixed_by(whole | {far}, floor)[1] <= size:
            whole.add(far)
        else:  # contradicted, or all its rows are more than there is room for
            loose.add(far)
        tilt = {c: v for c, v in tilt.items() if c != far and abs(v) < TILT / 2}
    out_of = within(over) if fixed_over is not free else F.lit(False)
    sure = within(whole) | (F.col("floor") if floor else F.lit(False))
    lookup = F.create_map(*[F.lit(x) for c, v in (tilt or {"": 0.0}).items() for x in (c, float(v))])
    eta = F.lit(l0) + F.aggregate("subjects", F.lit(0.0), lambda s, x: s + F.coalesce(F.element_at(lookup, x), F.lit(0.0)))
    chance = F.when(sure | F.lit(size == total), 1.0).when(out_of, 0.0).otherwise(1 / (1 + F.exp(-eta)))
    chances = rows.select("id", "subjects", chance.alias("chance"), (sure | F.lit(size == total)).alias("sure"))
    drawn = chances.where("sure")
    if size > certain and size < total:
        drawn = drawn.unionByName(chances.join(draw(chances.where("not sure and chance > 0"), "chance", seed), "id", "left_semi"))
    out = settle(cut(drawn, "p1-drawn"), chances, need, whole, seed)

    got = out.select(F.explode("subjects").alias("topic")).groupBy("topic").agg(F.count("*").alias("sampled"))
    permille = {r["topic"]: int(r["permille"]) for r in listed}
    expected = {c: float(held.get(c, 0)) if c in whole else None if c not in goal else factor * share[c] for c in need}
    frame = [(c, held.get(c, 0), n, permille[c], expected[c]) for c, n in sorted(need.items())]
    base = spark.createDataFrame(frame, "topic string, held long, required long, target_permille int, expected double")
    report = base.join(got, "topic", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)).cast("long"))
    none = F.lit(0).cast("long")
    report = report.withColumn("shortage", F.greatest(none, F.col("required") - F.col("held"))).withColumn("gap", F.greatest(none, F.col("required") - F.col("sampled")))
    return out.select("id", "subjects", "chance"), report.withColumn("share_permille", F.col("sampled") * 1000 / F.lit(max(size, 1)))


def settle(drawn: DataFrame, rows: DataFrame, need: dict[str, int], whole: set[str], seed: int) -> DataFrame:
    """drawn with rows exchanged for others until no category that has enough rows is below ``need``, as far as other categories have more than enough. Both: (id, subjects, chance, sure)."""
    for turn in range(5):
        have = dict.fromkeys(need, 0) | {r["topic"]: r["n"] for r in drawn.select(F.explode("subjects").alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).where(F.col("topic").isin(list(need))).collect()}
        lack = {c: need[c] - have[c] for c in need if have[c] < need[c] and c not in whole}
        if not lack:
            break
        luck = F.xxhash64(F.lit(seed + 2 + turn), "id")
        first = Window.partitionBy("topic").orderBy(luck, "id")
        wanted = F.create_map(*[F.lit(x) for c, n in lack.items() for x in (c, n)])
        spare = rows.join(drawn.select("id"), "id", "left_anti").withColumn("topic", F.explode("subjects")).where(F.col("topic").isin(list(lack)))
        spare = spare.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(lack.values())).where(F.col("rank") <= F.element_at(wanted, F.col("topic")))
        more = cut(spare.drop("topic", "rank").distinct(), "p1-more")
        n = more.count()
        tight = [c for c in need if have[c] - n < need[c]]
        fewer = drawn.where(~F.col("sure") & ~F.arrays_overlap("subjects", F.array(*[F.lit(c) for c in tight]).cast("array<string>"))).orderBy(luck, "id").limit(n)
        fewer = cut(fewer.select("id"), "p1-fewer")
        if not n or fewer.count() < n:
            break
        drawn = cut(drawn.join(fewer, "id", "left_anti").unionByName(more.withColumn("sure", F.lit(False))), "p1-settled")
    return drawn


def article_sample(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The sample of articles by the subjects above their labels, from each id's latest row, and its report."""
    mapping = subjects_of_labels(table(spark, folder, "topics"), table(spark, folder, "topic_edges"))
    rows = subjects_by(latest(table(spark, folder, "articles"), "iptc"), "id", "iptc", mapping)
    return sample(rows, table(spark, folder, "sample_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of which the sample has fewer rows than asked for, all it could take included."""
    return article_sample(spark, folder)[1].where("gap > 0").select("topic")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target, stock and sample of each subject."""
    return article_sample(spark, folder)[1]


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample."""
    return article_sample(spark, folder)[0]


ORACLES = {
    "p1_found": r"""
with recursive newest as (select id, r.iptc from (select id, arg_max({'iptc': iptc}, loaded_at) r from articles where id is not null group by id)),
up as (select topic_id start, topic_id here from topics union select start, parent from up join topic_edges on child = here and child <> parent),
root as (select start, here from up where not exists (select 1 from topic_edges e where e.child = here and e.parent <> e.child)),
label as (select t.topic_label, s.topic_label subject from root join topics t on t.topic_id = start join topics s on s.topic_id = here),
held as (select distinct id, subject from (select id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) x from (select id, unnest(iptc) x from newest)) join label on x = topic_label),
total as (select count(distinct id) // 2 half from held)
select topic from sample_targets, total where (select count(*) from held where subject = topic) < greatest(min_rows, ceil(half * target_permille / 1000.0))""",
}
