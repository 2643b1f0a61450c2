"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so the nearest by cosine are the nearest in space, and projected on random lines. A
block of vectors keeps, for each line, the projections sorted. A query opens a window around its own projection on every
line and widens it step by step, as if all were hashed anew with a coarser width (virtual rehashing); vectors that fall into
the windows of enough lines are verified by their exact cosine. It ends when the fifth best lies within the radius that
the windows stand for.

Every query meets every block: the set of queries is given, and blocks that are searched alike in parallel need no other
order. Each block hands on only its best, so what follows is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealwright.llm.common import stored
from dealwright.llm.vectors import packed, unit, unpacked, usable

#: Lines, and standard errors below the expected collisions of a vector at the radius at which it still counts as met.
LINES, SLACK = 128, 0.5
#: Width of a window for radius 1: half of it is one standard deviation of the projected distance.
WIDTH = 2.0
#: Radii of the steps, growing by GROWTH; at the last, the diameter, all are met.
FIRST, GROWTH = 0.7, 1.1
BLOCK, QUERIES, SEED = 4096, 1024, 17  # places in a block fit 16 bits


def _lines(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((LINES, width))


def _threshold() -> int:
    """Collisions that a vector at the radius reaches in most cases; those nearer, nearly always."""
    p = 0.6826894921370859  # of a standard normal distribution within one deviation, half of WIDTH
    return int(LINES * p - SLACK * (LINES * p * (1 - p)) ** 0.5)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their sorted arrays: per line the projections in order and whose they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            _, vectors = unpacked(row.column("ids")[0].as_py(), row.column("vectors")[0].as_py())
            projected = (unit(vectors) @ _lines(vectors.shape[1]).T).T
            order = np.argsort(projected, axis=1, kind="stable")
            ordered = np.take_along_axis(projected, order, axis=1)
            extra = [pa.array([order.astype(np.int32).tobytes()]), pa.array([ordered.tobytes()])]
            yield pa.RecordBatch.from_arrays([*row.columns, *extra], [*row.schema.names, "owners", "places"])


def _collisions(ranks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each query and vector the number of lines on which the vector lies in the query's window.

    ``ranks[j, v]`` is the place of vector v on line j, ``start`` and ``stop`` are the places of the windows' ends.
    """
    counts = np.zeros((start.shape[1], ranks.shape[1]), np.uint8)
    wide = stop - start
    for at in range(0, len(counts), 64):  # few queries at a time stay in the cache
        part = counts[at : at + 64]
        for j, rank in enumerate(ranks):
            part += (rank - start[j, at : at + 64, None]) < wide[j, at : at + 64, None]  # below start wraps around
    return counts


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, owners: np.ndarray, places: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` nearest met of each query in a block: query rows and block rows; and how many were verified."""
    asked = queries @ _lines(queries.shape[1]).T
    n, m = len(ids), len(queries)
    ranks = np.empty(owners.shape, np.uint16)
    np.put_along_axis(ranks, owners.astype(np.int64), np.arange(n, dtype=np.uint16)[None, :], axis=1)
    scores = np.full((m, n), -np.inf)
    need, radius, open_, verified = _threshold(), FIRST, np.arange(m), 0
    while len(open_):
        last, half = radius >= 2, radius * WIDTH / 2
        if last:  # the diameter: all are met
            met = np.isneginf(scores[open_])
        else:
            start = np.stack([np.searchsorted(places[j], asked[open_, j] - half, "left") for j in range(LINES)])
            stop = np.stack([np.searchsorted(places[j], asked[open_, j] + half, "right") for j in range(LINES)])
            counts = _collisions(ranks, start.astype(np.uint16), stop.astype(np.uint16))
            met = (counts >= need) & np.isneginf(scores[open_])
        rows, cols = np.nonzero(met)
        rows = open_[rows]
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            own = query_ids[r] == ids[c]
            scores[r, c] = np.where(own, -2.0, np.einsum("ij,ij->i", queries[r], vectors[c]))
        verified += len(rows)
        if last:
            break
        best = np.partition(scores[open_], max(n - k, 0), axis=1)[:, max(n - k, 0)]
        reached = np.sqrt(np.maximum(2 - 2 * best, 0)) <= radius
        open_ = open_[~(reached & (best > -1.5))]
        radius *= GROWTH
    rows, cols = np.nonzero(scores > -1.5)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(m))
    near = np.arange(len(rows)) - first[rows] < k
    return rows[near], cols[near], verified


def index(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stored index of all usable vectors of ``table`` (vec_id, embedding): a row per block."""
    kinds = "width long, n long, ids binary, vectors binary, weights binary, owners binary, places binary"
    return stored(packed(usable(table), block).mapInArrow(_index, kinds))


def nearest(table: DataFrame, indexed: DataFrame, k: int = 5, queries: int = QUERIES) -> DataFrame:
    """For every usable row of ``table`` (vec_id, embedding) its ``k`` nearest in ``indexed``: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller vec_id; ``score`` is the cosine in double precision. Rows with the query's own id
    are no candidates. Rows that repeat an id count once, with their best score; vectors of another width are never
    near. Null ids, null, zero and non-finite vectors and empty tables give no rows.
    """
    wanted = usable(table)
    dealt = wanted.repartition(max(1, -(-wanted.count() // queries)))
    asked = stored(packed(dealt, queries).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    met = asked.crossJoin(indexed.select("ids", "vectors", "owners", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                query_ids, asked = unpacked(row["q_ids"], row["q_vectors"])
                ids, vectors = unpacked(row["ids"], row["vectors"])
                if asked.shape[1] != vectors.shape[1]:
                    continue
                once = np.unique(ids, return_index=True)[1]
                owners = np.frombuffer(row["owners"], np.int32).reshape(LINES, -1)
                places = np.frombuffer(row["places"], np.float64).reshape(LINES, -1)
                more = k + len(ids) - len(once)  # room for ids that the block repeats
                rows, cols, _ = search_block(query_ids, unit(asked), ids, unit(vectors), owners, places, more)
                a, b = asked[rows], vectors[cols]
                a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[rows]), pa.array(ids[cols]), pa.array(score)], ["query_id", "vec_id", "score"]
                )

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
