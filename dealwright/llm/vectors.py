"""Vectors of tables as blocks: rows that hold some thousand vectors as a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>, usable) of every row: usable with an id, and a vector that is neither null,
    empty nor zero and has finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    return rows.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that can be compared."""
    return judged(table, vector).where("usable").drop("usable")


def to_matrix(column: pa.Array) -> np.ndarray:
    """A matrix of an Arrow list column whose lists have one length."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return values.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither very large nor very small components spoil the length."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose vectors have one length."""
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for n in np.unique(lengths):
        yield batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (width, n, ids, vectors, weights) of at most ``size`` vectors of one width, in the order of ``rows`` within a
    task. They are the bytes of 64-bit integers and floats; the weights, 1 unless ``rows`` have them as ``n``, of integers.
    Nothing is shuffled.
    """
    names = ["width", "n", "ids", "vectors", "weights"]

    def block(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        values = [vectors.shape[1], len(ids), *(np.ascontiguousarray(x).tobytes() for x in (ids, vectors, weights))]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part in by_length(batch, "embedding") if batch.num_rows else []:
                vectors = to_matrix(part.column("embedding"))
                now = [part.column("vec_id").to_numpy(), vectors, part.column("n").to_numpy()]
                width = vectors.shape[1]
                if width in held:
                    now = [np.concatenate(pair) for pair in zip(held[width], now, strict=True)]
                whole = len(now[0]) // size * size
                for at in range(0, whole, size):
                    yield block(*(x[at : at + size] for x in now))
                held[width] = [x[whole:] for x in now]
        for left in held.values():
            if len(left[0]):
                yield block(*left)

    weight = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
    return rows.select("vec_id", "embedding", weight.alias("n")).mapInArrow(
        pack, "width long, n long, ids binary, vectors binary, weights binary"
    )


def unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(vectors, np.float64).reshape(len(keys), -1)

