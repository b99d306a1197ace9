"""The manifest as a fold of edits, and set operations on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(edits: DataFrame) -> DataFrame:
    """Current files: of the events of a (level, number) the last one counts; inside an edit additions
    come after deletions."""
    w = Window.partitionBy("level", "number").orderBy(F.desc("edit_id"), F.desc("is_add"))
    return edits.withColumn("_r", F.row_number().over(w)).where("_r = 1 and is_add = 1").drop("_r", "is_add")


def apply(base: DataFrame, edits: DataFrame) -> DataFrame:
    """The version after ``base(level, number)`` and some edits: what they add, and of the base what none deletes."""
    before = base.select(F.lit(None).cast("long").alias("edit_id"), F.lit(1).alias("is_add"), "level", "number")
    return fold(before.union(edits.select(F.col("edit_id").cast("long"), "is_add", "level", "number"))).select("level", "number")


def live(*versions: DataFrame) -> DataFrame:
    """Distinct file numbers of any version still in use."""
    out = versions[0].select("number")
    for v in versions[1:]:
        out = out.union(v.select("number"))
    return out.distinct()


def parse_names(names: DataFrame) -> DataFrame:
    """``name`` -> ``kind`` and ``number`` of a database file; unknown names have a null kind."""
    kind = F.expr(
        "case when name = 'CURRENT' then 'current' when name = 'LOCK' then 'lock' when name rlike '^MANIFEST-[0-9]+$' then 'manifest'"
        " when name rlike '^[0-9]+[.]log$' then 'log' when name rlike '^[0-9]+[.](ldb|sst)$' then 'table' when name rlike '^[0-9]+[.]dbtmp$' then 'temp' end"
    )
    return names.withColumn("kind", kind).withColumn("number", F.when(F.col("kind").isin("manifest", "log", "table", "temp"), F.expr("cast(regexp_extract(name, '([0-9]+)', 1) as bigint)")))


def format_name(kind: str, number: int) -> str:
    """A database file's name: the inverse of :func:`parse_names`."""
    fixed = {"current": "CURRENT", "lock": "LOCK"}
    return fixed[kind] if kind in fixed else {"manifest": "MANIFEST-%06d", "log": "%06d.log", "table": "%06d.ldb", "temp": "%06d.dbtmp"}[kind] % number


def obsolete(names: DataFrame, live_files: DataFrame, manifest: int, log: int) -> DataFrame:
    """Files of a listing that may go: tables and temporary files not in use, older manifests and logs."""
    used = live_files.select("number", F.lit(True).alias("_used")).distinct()
    n = parse_names(names).where("kind is not null").join(used, "number", "left")
    unused = F.col("kind").isin("table", "temp") & F.col("_used").isNull()
    old = ((F.col("kind") == "manifest") & (F.col("number") < manifest)) | ((F.col("kind") == "log") & (F.col("number") < log))
    return n.where(unused | old).select("name", "kind", "number")


def missing(names: DataFrame, live_files: DataFrame) -> DataFrame:
    """Files in use that a listing lacks; an engine must not open with any."""
    return live_files.join(parse_names(names).where("kind = 'table'").select("number"), "number", "left_anti")


def summary(edits: DataFrame) -> DataFrame:
    """Text of each edit: ``+L-N`` for additions, ``-L-N`` for deletions."""
    item = F.format_string("%s%d-%d", F.when(F.col("is_add") == 1, "+").otherwise("-"), "level", "number")
    return edits.groupBy("edit_id").agg(F.array_join(F.array_sort(F.collect_list(item)), " ").alias("summary"))
