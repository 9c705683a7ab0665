"""Helpers that the corpus operators share."""

from __future__ import annotations

import shutil
import tempfile
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.storage import drop_path, scratch_path

_shipped: weakref.WeakSet = weakref.WeakSet()

#: Bytes of an Arrow batch, about; a larger row is a batch of its own.
ARROW_BYTES = 2 << 20


#: Bytes of values after which a Python operator hands on what it has.
FLUSH_BYTES = 8 << 20


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, lost executors cost nothing already written."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """materialise() for the steps of one operator, whose files go once its last step no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def adopt(self, other: Scratch) -> None:
        self._paths += other._paths

    def drop_but(self, *kept: DataFrame) -> None:
        """Deletes what was written, but for the DataFrames that a result still reads."""
        for df, path in self._paths:
            if not any(df is k for k in kept):
                drop_path(self.spark, path)
        self._paths = [(df, path) for df, path in self._paths if any(df is k for k in kept)]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context, so that they needn't have it installed."""
    if spark.sparkContext not in _shipped:
        package = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as own:  # on the driver alone: Spark copies it from there
            shutil.copytree(package, f"{own}/all/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tallyloom-code-')}/{package.name}", "zip", f"{own}/all"))
        _shipped.add(spark.sparkContext)


def small_batches(spark: SparkSession) -> None:
    """Makes a session ready for Python over whole texts: the package is sent, and the bytes of an Arrow batch are bounded by ARROW_BYTES, unless the session's own bound is lower. The setting stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just two columns, under fixed names: other columns can't clash and aren't read."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def in_holdout(id_col: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder by folds. A null id counts as the empty text, so as held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema) -> DataFrame:
    """mapInArrow with state that is built once a task: make() gives the function for each batch. schema: a StructType or its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column, without a detour through str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
