"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources.paths import delete, new_path, shared_dir

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths of the tables that the innermost :func:`scratch` has seen made.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def saved(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut, and a lost
    executor takes nothing with it. :func:`scratch` and :func:`drop_work` remove such tables. ``batch`` bounds
    the rows of an Arrow batch during this write, for tables of wide rows; the setting is the session's, so
    another thread's batches may be as small meanwhile, which changes no result."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(ARROW_ROWS)
    if batch:
        spark.conf.set(ARROW_ROWS, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.set(ARROW_ROWS, before)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the working tables made inside when it ends, but those that were given to the function it yields.
    Nothing that is still to be computed may read the others."""
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._work_path)
        return table

    token = _MADE.set([])
    try:
        yield keep
    finally:
        made = _MADE.get() or []
        _MADE.reset(token)
        outer = _MADE.get()
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif outer is not None:
                outer.append(path)


def discard(table: DataFrame) -> None:
    """Deletes a working table that nothing reads any more."""
    path = getattr(table, "_work_path", None)
    if path is not None:
        delete(table.sparkSession, path)


def drop_work(spark: SparkSession) -> None:
    """Delete every working table of this application; results that read them end with it."""
    delete(spark, shared_dir(spark))
