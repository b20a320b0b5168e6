"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shared folder of a session on one machine that names none, as in local tests.
FALLBACK_SHARED = "/tmp/spanloom-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    On one machine a folder of its own does; on a cluster it must be named, since executors would
    write each to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or FALLBACK_SHARED


#: Folders of intermediate tables that :func:`cleared` is to delete, while it is open.
_MADE: list[list[str]] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the intermediate tables made inside, whose readers must be done by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            deleted(spark, path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, survives lost executors and lets later readers prune columns.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more rows than this, and than one in HOT_KEYS of all, is hot.
HOT_ROWS, HOT_KEYS = 100_000, 1000


def by_key(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key and the number of its rows as ``_rows``.

    Hot keys, of which there are HOT_KEYS at most by their definition, are broadcast, so that their
    rows stay where they are; all others are joined by shuffle, with bounded rows a key. Null keys
    match nothing. ``total``, if it is known, are all rows of ``side`` together.
    """
    total = total if total is not None else side.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, total // HOT_KEYS)
    slim = side.drop("_rows")
    if total <= HOT_ROWS or (hot := side.filter(F.col("_rows") > bound).drop("_rows")).isEmpty():
        return rows.join(slim, keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.filter(F.col("_rows") <= bound).drop("_rows"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


#: Rows that go to a Python worker at a time: whole texts, some of them very long, stand in a batch.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Batches of whole texts stay small, unless the session says otherwise already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default, meant for narrow rows
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_hash(col: Column, salt: str = "") -> Column:
    """48 uniform bits from SHA-256 of the value as text, the same in every engine; null counts as ''."""
    text = F.concat(F.lit(salt), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


HASH_BITS = 48
