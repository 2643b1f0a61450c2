"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.session import fresh_path

#: Arrow batches handed to and back by Python tasks hold about so many bytes.
BATCH_BYTES = 8 << 20


def stored(df: DataFrame, gather: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    ``gather`` is for narrow rows that many tasks make of a large table: they are shuffled into files of the size that
    Spark aims at, instead of one small file for each task.
    """
    path = fresh_path(df.sparkSession, "llm")
    (df.hint("rebalance") if gather else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(path: str, schema: pa.Schema) -> dataset.Dataset:
    """What Spark has stored in a folder that all machines share, for tasks to read; nothing, if there is no such folder."""
    system, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return dataset.dataset(schema.empty_table())
    return dataset.dataset(place, schema=schema, format="parquet", filesystem=system)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python batches of at most ``BATCH_BYTES``: several long texts at a time, not
    thousands of them. A session that names a size of its own keeps it."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


_held: list[tuple[object, object]] = []


def held[T](key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives for ``key``, made once for all tasks of this Python worker that ask for it in a row.

    A worker keeps one such object: workers outlive their stage, and what an earlier one has left would take the memory
    of the next. ``key`` is compared by identity or equality.
    """
    if not (_held and (_held[0][0] is key or _held[0][0] == key)):
        release()
        _held.append((key, make()))
    return _held[0][1]


def release() -> None:
    """Lets go of what ``held`` keeps, for operators that keep nothing between tasks."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return in_small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per numpy array, without Python objects for the values."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def joined_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from batches sorted by it, so that no run is cut at a batch's end."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = [batch.slice(cut)]
        elif kept and kept[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = [batch]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` items over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: Keys that more than one in so many rows have are copied to the rows instead of shuffled: there are fewer than that.
HOT = 1_000


def met(rows: DataFrame, values: DataFrame, keys: list[str], often: Column, row: str = "row") -> DataFrame:
    """``rows`` left-joined with ``values``, one row per ``keys``, so that no key gathers many rows in one task.

    ``often`` says which of the values are met by more than one in ``HOT`` of all rows; these are copied to every task
    and their rows spread by ``row``.
    """
    added = [c for c in values.columns if c not in keys]
    hot = values.where(often).select(*keys, *(F.col(c).alias(f"hot_{c}") for c in added), F.lit(True).alias("is_hot"))
    salt = F.when(F.col("is_hot"), F.xxhash64(row).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    seldom = values.where(~often).withColumn("salt", F.lit(0).cast("long"))
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", salt).join(seldom, [*keys, "salt"], "left")
    return found.select(*rows.columns, *(F.coalesce(f"hot_{c}", c).alias(c) for c in added))
