"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every contract of this package.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
FALLBACK_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode, where that is unset, our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or FALLBACK_DIR


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/prosegrain/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def purge(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once its results are written elsewhere."""
    delete(spark, own_dir(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The files are on shared storage, so a lost executor costs no recomputation
    of what came before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    by_place = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names may clash
    by_place.write.parquet(path)
    out = spark.read.schema(by_place.schema).parquet(path).toDF(*df.columns)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            delete(df.sparkSession, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    The optimizer may otherwise copy an expression into a lambda, where it
    would run once per element.
    """
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Words of ``text`` in order; an empty array for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _numbered(df: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    names = df.columns
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(names)}")
    return df.toDF(*[f"c{k}" for k in range(len(names))]), [F.col(f"c{names.index(c)}") for c in columns]


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``, by exact name, the first of equal ones; other columns cannot clash, not even in case."""
    by_place, wanted = _numbered(df, columns)
    return by_place.select(*[c.alias(n) for c, n in zip(wanted, columns)])


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """Every column of ``df``, by place, as struct ``row``; beside it the named ones under the names given (new=old)."""
    by_place, wanted = _numbered(df, tuple(columns.values()))
    return by_place.select(F.struct("*").alias("row"), *[c.alias(n) for c, n in zip(wanted, columns)])


def unpacked(rows: DataFrame, like: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``like`` out of ``row`` as made by :func:`with_row`, some of them replaced."""
    places = {like.columns.index(c): value for c, value in (new or {}).items()}
    out = rows.select(*[places.get(k, F.col("row")[f"c{k}"]).alias(f"c{k}") for k in range(len(like.columns))])
    return out.toDF(*like.columns)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are done, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving memory back to the system at its end: workers idle between tasks and stages."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
