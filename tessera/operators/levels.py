"""Files and levels: routing, overlap, scores and the choices of compaction. ``files`` are file tables, one
row per sorted run: windows without a partition run over those of one level; keys are dealt to ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .intervals import asof, covering, overlapping, ranges

#: Levels; files that start, slow and stop level 0; deepest level of a flush; bytes of
#: level 1; multiple per level; file size; multiples of it that bound grandparents and expansion.
LEVELS, START, SLOW, STOP, FLUSH_DEEPEST = 7, 4, 8, 12, 2
LEVEL1, GROWTH, FILE, GRANDPARENTS, EXPANSION = 10 << 20, 10, 2 << 20, 10, 25
SEEK_BYTES, SEEK_LEAST = 16384, 100


def overlaps(low: Column | str, high: Column | str) -> Column:
    """A file's range touches [low, high]."""
    low, high = (F.lit(x) if isinstance(x, str) else x for x in (low, high))
    return (F.col("largest") >= low) & (F.col("smallest") <= high)


def route(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Files that hold a key's range in the order in which they are probed: level 0 from the newest
    number, deeper levels one file each. ``keys(k)``; adds ``level, number, probe`` (from 1)."""
    hit = covering(keys.select("k"), files)
    return hit.withColumn("probe", F.row_number().over(Window.partitionBy("k").orderBy("level", F.desc("number"))).cast("long")).select("k", "level", "number", "probe")


def read_amplification(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Per key the files probed, and the file that pays for it: the first one, when there were more."""
    r = route(keys, files)
    return r.groupBy("k").agg(F.count("*").alias("probed"), F.min(F.when(F.col("probe") == 1, F.col("number"))).alias("first_file")).withColumn("charged", F.when(F.col("probed") > 1, F.col("first_file"))).drop("first_file")


def seek_charges(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Charges per file against its allowance; a file out of seeks is a candidate for compaction."""
    c = read_amplification(keys, files).where("charged is not null").groupBy(F.col("charged").alias("number")).agg(F.count("*").alias("charges"))
    return c.join(allowed_seeks(files).select("number", "allowed_seeks"), "number").withColumn("exhausted", F.col("charges") >= F.col("allowed_seeks"))


def allowed_seeks(files: DataFrame) -> DataFrame:
    return files.withColumn("allowed_seeks", F.greatest(F.lit(SEEK_LEAST).cast("long"), F.expr(f"cast(size div {SEEK_BYTES} as bigint)")))


def has_overlap(files: DataFrame, level: int, low: str, high: str) -> DataFrame:
    """One row: whether any file of the level touches the range."""
    return files.where((F.col("level") == level) & overlaps(low, high)).agg((F.count("*") > 0).alias("overlaps"))


def key_exists(keys: DataFrame, files: DataFrame, level: int) -> DataFrame:
    hit = covering(keys.select("k").distinct(), files.where(F.col("level") == level)).select("k").distinct()
    return keys.join(hit, "k", "left_semi")


def islands(files: DataFrame, level: int = 0) -> DataFrame:
    """Files of a level with the island of touching ranges each belongs to."""
    w = Window.orderBy("smallest", "number")
    reach = F.max("largest").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = files.where(F.col("level") == level).withColumn("_cut", F.when(F.col("smallest") <= reach, 0).otherwise(1))
    return cut.withColumn("island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def closure(files: DataFrame, low: str, high: str) -> DataFrame:
    """Level-0 files that touch the range, or a file that does, and so on: whole islands."""
    i = islands(files)
    touched = i.groupBy("island").agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    direct = i.where(overlaps(low, high)).select("island").distinct()
    return i.join(direct, "island", "left_semi").join(touched.select("island"), "island", "left_semi").drop("island")


def overlapping_inputs(files: DataFrame, level: int, low: str, high: str) -> DataFrame:
    return closure(files, low, high) if level == 0 else files.where((F.col("level") == level) & overlaps(low, high))


def spine(spark: SparkSession) -> DataFrame:
    return spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))


def level_stats(files: DataFrame) -> DataFrame:
    """Each of the seven levels with its files and bytes."""
    per = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("long")
    return spine(files.sparkSession).join(per, "level", "left").select("level", F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"))


def scores(files: DataFrame, level1: int = LEVEL1) -> DataFrame:
    """Level 0 by its files, deeper ones by bytes over their budget; the last level is never chosen.
    Scores are whole millionths, so that they compare exactly."""
    deep = F.expr(f"cast(bytes * 1000000 div ({level1} * cast(power({GROWTH}, level - 1) as bigint)) as bigint)")
    return level_stats(files).where(F.col("level") < LEVELS - 1).withColumn("score_millionths", F.when(F.col("level") == 0, F.expr(f"cast(files * 1000000 div {START} as bigint)")).otherwise(deep))


def best_level(files: DataFrame, level1: int = LEVEL1) -> DataFrame:
    """The level with the highest score, the lowest of equals, and whether it needs compaction."""
    return scores(files, level1).orderBy(F.desc("score_millionths"), "level").limit(1).withColumn("needed", F.col("score_millionths") >= 1_000_000)


def needs_compaction(files: DataFrame, keys: DataFrame, level1: int = LEVEL1) -> DataFrame:
    """One row: whether a level is over its budget, whether reads of ``keys(k)`` used up a file's seeks, and either."""
    sought = seek_charges(keys, files).agg(F.coalesce(F.bool_or("exhausted"), F.lit(False)).alias("by_seeks"))
    by_size = best_level(files, level1).select(F.col("needed").alias("by_size"), F.lit(False).alias("by_seeks"))
    both = by_size.union(sought.select(F.lit(False), "by_seeks")).agg(F.bool_or("by_size").alias("by_size"), F.bool_or("by_seeks").alias("by_seeks"))
    return both.withColumn("needed", F.col("by_size") | F.col("by_seeks"))


def pick_by_pointer(files: DataFrame, level: int, pointer: str) -> DataFrame:
    """The first file that ends beyond the pointer, else the level's first file."""
    own = files.where(F.col("level") == level)
    return own.orderBy((F.col("largest") <= pointer).cast("int"), "smallest", "number").limit(1)


def manual_inputs(files: DataFrame, level: int, low: str, high: str, most: int = FILE) -> DataFrame:
    """Inputs of a manual compaction: below level 0 they end with the file that reaches ``most`` bytes."""
    own = overlapping_inputs(files, level, low, high)
    if level == 0:
        return own.withColumn("before", F.lit(0).cast("long"))
    w = Window.orderBy("smallest", "number").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0).cast("long"))).where(F.col("before") < most)


def trivial_moves(files: DataFrame, file_bytes: int = FILE) -> DataFrame:
    """Per file below the last level: files and bytes that it overlaps one and two levels down, and whether
    it may move down as it is. A file is told by level and number: numbers may recur in other levels."""
    own = files.select("level", "number", "smallest", "largest")

    def below(step: int, name: str) -> DataFrame:
        g = files.select((F.col("level") - step).alias("level"), F.col("smallest").alias("r_smallest"), F.col("largest").alias("r_largest"), F.col("size").alias("z"))
        return overlapping(own, g, ["level"]).groupBy("level", "number").agg(F.count("*").alias(f"{name}_files"), F.sum("z").alias(f"{name}_bytes"))

    zero = F.lit(0).cast("long")
    out = files.where(F.col("level") < LEVELS - 1).select("level", "number").join(below(1, "next"), ["level", "number"], "left").join(below(2, "grand"), ["level", "number"], "left")
    out = out.select("level", "number", F.coalesce("next_files", zero).alias("next_files"), F.coalesce("grand_bytes", zero).alias("grand_bytes"))
    return out.withColumn("trivial", (F.col("next_files") == 0) & (F.col("grand_bytes") <= GRANDPARENTS * file_bytes))


def flush_level(files: DataFrame, low: str, high: str, most: int = GRANDPARENTS * FILE // 10) -> DataFrame:
    """Where a flushed run of [low, high] goes: down while the next level has no overlap and the one
    after it little, never below level 2."""
    own = files.where(overlaps(low, high)).groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("z"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("level") == k, F.col("n"))), F.lit(0))
    z = lambda k: F.coalesce(F.sum(F.when(F.col("level") == k, F.col("z"))), F.lit(0))
    one = own.agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"), z(2).alias("z2"), z(3).alias("z3"))
    return one.select(F.expr(f"case when n0 > 0 or n1 > 0 or z2 > {most} then 0 when n2 > 0 or z3 > {most} then 1 else {FLUSH_DEEPEST} end").alias("flush_level"))


def write_state(level0: Column) -> Column:
    """What a writer does at that many files in level 0."""
    return F.when(level0 >= STOP, "stop").when(level0 >= SLOW, "slow").when(level0 >= START, "compact").otherwise("free")


def cut_points(rows: DataFrame, grandparents: DataFrame, most: int) -> DataFrame:
    """Adds ``output``, the output file of each key-ordered row: a new one starts where the grandparents that
    were passed since the last start, and after the first row, exceed ``most`` bytes. The sum starts anew
    with each output, so it is a fold over the grandparents, in the order in which keys pass them."""
    over = ranges(rows, "k")
    back = Window.partitionBy("_range").orderBy(F.desc("k"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    keys = rows.select("k").distinct().withColumn("_range", over.of(F.col("k")))
    ends = grandparents.select(F.col("largest").alias("k"), "size").withColumn("_range", over.of(F.col("k")))
    # in descending order a file's end comes after the keys beyond it, and before its own key
    both = keys.withColumn("_kind", F.lit(1)).unionByName(ends.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    inside = both.withColumn("_next", F.last(F.when(F.col("_kind") == 1, F.col("k")), ignorenulls=True).over(back)).where("_kind = 0")
    starts = sorted(r["k"] for r in keys.groupBy("_range").agg(F.min("k").alias("k")).collect())  # one per range
    if not starts:
        return rows.withColumn("output", F.lit(0))
    later = F.element_at(F.filter(F.lit(starts), lambda s: s > F.col("k")), 1)
    following = F.coalesce("_next", F.when(F.col("k") < starts[-1], later))
    passed = inside.withColumn("_next", following).where(F.col("_next") > starts[0]).groupBy(F.col("_next").alias("k")).agg(F.sum("size").alias("size"))
    steps = F.array_sort(F.collect_list(F.struct("k", "size")))
    fold = "aggregate(steps, named_struct('sum', 0L, 'cuts', cast(array() as array<string>)), (a, s) -> if(a.sum + s.size > {m}, named_struct('sum', 0L, 'cuts', concat(a.cuts, array(s.k))), named_struct('sum', a.sum + s.size, 'cuts', a.cuts)), a -> a.cuts)"
    cuts = passed.agg(steps.alias("steps")).select(F.posexplode(F.expr(fold.format(m=most))).alias("i", "k"))
    marked = asof(rows, cuts.select("k", F.struct((F.col("i") + 1).alias("output")).alias("mark")), over)
    return marked.withColumn("output", F.coalesce("mark.output", F.lit(0))).drop("mark")

