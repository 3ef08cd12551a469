"""What the operators share: the folder that all executors see, tables, and text pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.lineage import materialise, shared_dir

__all__ = ["delete_folder", "drop_tables", "encoded", "materialise", "pieces", "release", "running_total", "shared_dir", "sided", "spread", "table", "tables_written", "text_or_empty", "worker_cache", "written_table"]

#: Rows of numbers that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python worker turns into arrays at once; NumPy's temporaries are a small multiple of it.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _release() -> None:
    """Gives memory that isn't used any more back to the machine: workers live on between stages, beside a JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of each piece have about PIECE_BYTES, or are a single row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i in range(batch.num_rows):
            cell = texts[i].as_buffer() if texts[i].is_valid else None
            n = cell.size if cell else 0
            if i > start and held + n > PIECE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
        del texts, batch
        _release()


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process: tasks of one worker load a vocabulary once."""
    import sys
    import types

    name = "_tessera_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


_written: list[tuple[SparkSession, str]] = []


def written_table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for columns that only some readers need; drop_tables() removes it."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tables_written(spark: SparkSession) -> int:
    """How many tables of this session there are."""
    return sum(x[0] is spark for x in _written)


def drop_tables(spark: SparkSession, after: int = 0) -> None:
    """Deletes what written_table() has written in this session, but the first so many tables; results that were not read yet are lost with it."""
    own = [x for x in _written if x[0] is spark][after:]
    for _, path in own:
        delete_folder(spark, path)
    _written[:] = [x for x in _written if x not in own]


def release(spark: SparkSession) -> None:
    """Frees what nothing on the driver refers to any more: plans that Python holds in cycles, then the JVM's heap and classes, and checkpoints with them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _release()


def sided(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, computed once, as the small side of a join: broadcast if it has at most so many rows, else joined by a shuffle. For narrow rows only."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= rows else df


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> tuple[DataFrame, int]:
    """df with the sum of value over the rows before, in the order given (which has no ties), and the sum of all.

    Rows are cut into ranges and sorted inside; one number per range reaches the driver.
    """
    spark = df.sparkSession
    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = {r["__range"]: r["s"] for r in ranged.groupBy("__range").agg(F.sum(value).cast("long").alias("s")).collect()}
    before, total = [], 0
    for i in sorted(sums):
        before.append((i, total))
        total += sums[i]
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(*order)) - F.col(value)
    summed = ranged.withColumn(name, inside).join(F.broadcast(spark.createDataFrame(before, "__range int, __before long")), "__range")
    return summed.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before"), total


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session has cores, if it has fewer: for small inputs of costly work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
