"""Near-duplicate vectors by epsilon grid order.

Vectors are scaled to length one, so a cosine of at least c means a distance of at most eps = sqrt(2 - 2c). They are sorted
by the cells of a grid of width eps on their leading principal dimensions. Blocks that follow each other in this order are
joined with themselves and with every block that is not provably more than eps away in those dimensions; two blocks are
halved again and again, skipping intervals that are provably apart, until they are small enough to compare all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import local_roots, stored
from dealwright.llm.graph import components
from dealwright.llm.vectors import by_length, judged, packed, to_matrix, unit, unpacked

MIN_COSINE = 0.95
#: Leading principal dimensions that make the grid and the tests of distance.
DIMENSIONS = 8
#: Vectors of a block, and of an interval that is compared as a whole.
BLOCK, LEAF = 4096, 256
#: Blocks of a group, and the bytes of its vectors at most; two groups meet in one task.
TILE, TILE_BYTES = 4, 32 << 20
#: Far above what rounding does to a distance, far below what matters: skipping stays safe.
SAFE = 1e-9


def principal_axes(rows: DataFrame, most: int = DIMENSIONS) -> dict[int, np.ndarray]:
    """Leading eigenvectors of the vectors' second moments, for each width: sums of products over all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in by_length(batch, "embedding") if batch.num_rows else []:
                vectors = unit(to_matrix(part.column("embedding")))
                width = vectors.shape[1]
                held[width] = held.get(width, 0) + vectors.T @ vectors
        for width, total in held.items():
            place = np.arange(width * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), width)), pa.array(place), pa.array(total.ravel())], ["width", "place", "total"]
            )

    moments = rows.select("embedding").mapInArrow(sums, "width long, place long, total double")
    found = moments.groupBy("width", "place").agg(F.sum("total").alias("total")).toPandas()
    axes = {}
    for width, part in found.groupby("width"):
        matrix = part.sort_values("place")["total"].to_numpy().reshape(width, width)
        axes[int(width)] = np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1][:, :most]
    return axes


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distance of boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(axis=-1)


class _Side:
    """A block's vectors, in grid order, with their leading coordinates and the bounds of any interval."""

    def __init__(self, row: dict, axes: dict[int, np.ndarray]):
        self.ids, self.raw = unpacked(row["ids"], row["vectors"])
        self.weights = np.frombuffer(row["weights"], np.int64)
        vectors, axes = self.raw, axes[self.raw.shape[1]]
        self.units = unit(vectors)
        self.leading = self.units @ axes
        self.bounds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.bounds:
            part = self.leading[a:b]
            self.bounds[a, b] = part.min(axis=0), part.max(axis=0)
        return self.bounds[a, b]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def join_blocks(x: _Side, y: _Side, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Links of each vector of x and of y with the other block, by weight, and links that connect all that are linked.

    For one block joined with itself (x is y) each link is counted at both ends, in the first result.
    """
    eps2 = 2 - 2 * least + SAFE
    count_x, count_y = np.zeros(len(x.ids), np.int64), np.zeros(len(y.ids), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, len(x.ids), 0, len(y.ids))]
    while todo:
        a, b, c, d = todo.pop()
        if x is y and c < a or a == b or c == d:
            continue  # the mirrored interval does it
        if _apart(*x.box(a, b), *y.box(c, d)) > eps2:
            continue
        if max(b - a, d - c) > LEAF:
            if b - a >= d - c and not (x is y and (a, b) == (c, d)):
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            elif x is y and (a, b) == (c, d):
                m = (a + b) // 2
                todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        near = x.units[a:b] @ y.units[c:d].T
        rows, cols = np.nonzero(near >= least - SAFE)
        if x is y and a == c:
            rows, cols = rows[rows < cols], cols[rows < cols]
        doubt = np.flatnonzero(near[rows, cols] < least + SAFE)
        if len(doubt):
            use = np.ones(len(rows), bool)
            use[doubt] = _cosine(x.raw[a + rows[doubt]], y.raw[c + cols[doubt]]) >= least
            rows, cols = rows[use], cols[use]
        if len(rows):
            np.add.at(count_x, a + rows, y.weights[c + cols])
            np.add.at(count_x if x is y else count_y, c + cols, x.weights[a + rows])
            root = local_roots(rows, cols + (b - a), b - a + d - c)
            ids = np.concatenate((x.ids[a:b], y.ids[c:d]))
            other = root != np.arange(len(root))
            held.append((ids[other], ids[root[other]]))
    return count_x, count_y, held


def _blocks(axes: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the bounds of their leading coordinates."""
    for batch in batches:
        low, high = [], []
        for i in range(batch.num_rows):
            _, vectors = unpacked(batch.column("ids")[i].as_py(), batch.column("vectors")[i].as_py())
            leading = unit(vectors) @ axes[vectors.shape[1]]
            low.append(leading.min(axis=0).tolist())
            high.append(leading.max(axis=0).tolist())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, kind), pa.array(high, kind)], [*batch.schema.names, "low", "high"])


def _met(axes: dict[int, np.ndarray], least: float, tile: pa.Table) -> pa.Table:
    """(vec_id, other, links) of a tile, that is every block of one group with every block of another or of its own:
    counts of links with other null, and connecting links with links null."""
    one, two = tile.column("a")[0].as_py(), tile.column("b")[0].as_py()
    rows = sorted(tile.select(["group", "block", "ids", "vectors", "weights"]).to_pylist(), key=lambda r: r["block"])
    sides = [(r["group"], r["block"], _Side(r, axes)) for r in rows]
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for group, block, x in sides:
        for other_group, other_block, y in sides:
            if (group, other_group) != (one, two) or block > other_block or x.raw.shape[1] != y.raw.shape[1]:
                continue
            count_x, count_y, links = join_blocks(x, y, least)
            counted += [(side.ids[count > 0], count[count > 0]) for side, count in ((x, count_x), (y, count_y))]
            held += links
    none = np.empty(0, np.int64)
    ids, links = (np.concatenate((none, *side)) for side in zip((none, none), *counted, strict=True))
    ids, at = np.unique(ids, return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, at, links)
    u, v = (np.concatenate((none, *side)) for side in zip((none, none), *held, strict=True))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = local_roots(at[: len(u)], at[len(u) :], len(nodes))
    other = root != np.arange(len(nodes))
    u, v = nodes[other], nodes[root[other]]
    return pa.table({
        "vec_id": np.concatenate((ids, u)),
        "other": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(v, pa.int64())]),
        "links": pa.concat_arrays([pa.array(total, pa.int64()), pa.nulls(len(u), pa.int64())]),
    })


def near_vectors(table: DataFrame, least: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    ``n_links`` counts the other vectors with a cosine of ``least`` or more, in double precision; ``component_id`` is the
    smallest vec_id reachable by links. Equal vectors are compared once: their rows share a class, whose size counts. So
    do rows that repeat an id with an equal vector, each linked with the others. Null, zero and non-finite vectors and
    vectors without an id link with nothing; vectors of another width are never near. Extra columns play no part.
    """
    rows = judged(table).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    hashed = rows.withColumns({"_h": F.xxhash64("embedding"), "_g": F.xxhash64(F.lit(1), "embedding")})
    members = stored(hashed.select("vec_id", "usable", "_h", "_g"))
    classes = hashed.where("usable").groupBy("_h", "_g").agg(
        F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    classes = stored(classes.withColumn("vec_id", F.monotonically_increasing_id()))  # an id may come with two vectors
    axes = principal_axes(classes)
    if not axes:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    eps = (2 - 2 * least) ** 0.5

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "embedding") if batch.num_rows else []:
                vectors = to_matrix(part.column("embedding"))
                grid = np.floor(unit(vectors) @ axes[vectors.shape[1]] / eps).astype(np.int32)
                cell = pa.array(grid.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, cell], [*part.schema.names, "cell"])

    placed = classes.select("vec_id", "embedding", "n").mapInArrow(
        cells, "vec_id long, embedding array<double>, n long, cell array<int>"
    )
    ordered = placed.repartitionByRange(F.size("embedding"), "cell", "vec_id").sortWithinPartitions(F.size("embedding"), "cell", "vec_id")
    kinds = "width long, n long, ids binary, vectors binary, weights binary, low array<double>, high array<double>"
    blocks = packed(ordered, block).mapInArrow(lambda it: _blocks(axes, it), kinds)
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()))

    # pairs of blocks meet in the cells of the first dimension that they share, or are next to each other in
    known = blocks.select("block", "width", "low", "high")
    cell = lambda x: F.floor(x / F.lit(eps))
    left = known.select(
        F.col("block").alias("a"), "width", F.col("low").alias("_la"), F.col("high").alias("_ha"),
        F.explode(F.sequence(cell(F.col("low")[0] - eps), cell(F.col("high")[0] + eps))).alias("_cell"),
    )
    right = known.select(
        F.col("block").alias("b"), "width", F.col("low").alias("_lb"), F.col("high").alias("_hb"),
        F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("_cell"),
    )
    gaps = F.zip_with(
        F.zip_with("_la", "_hb", lambda l, h: l - h), F.zip_with("_lb", "_ha", lambda l, h: l - h), lambda p, q: F.greatest(p, q, F.lit(0.0))
    )
    distance = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    pairs = left.join(right, ["width", "_cell"]).where(F.col("a") <= F.col("b")).where(distance <= eps * eps + SAFE)
    # groups of blocks that follow each other meet as tiles: a block travels once for each tile, not for each pair
    size = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_BYTES) / (F.col("width") * 8 * block))))
    group = lambda c: F.floor(F.col(c) / size)
    tiles = stored(pairs.select(group("a").alias("a"), group("b").alias("b")).distinct())
    grouped = blocks.select(group("block").alias("group"), "block", "ids", "vectors", "weights")
    sent = tiles.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("group"))
    met = sent.join(grouped, "group").groupBy("a", "b")
    found = stored(met.applyInArrow(lambda tile: _met(axes, least, tile), "vec_id long, other long, links long"))

    linked = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("u"), F.col("other").alias("v")))
    counts = found.where("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
    told = classes.select("_h", "_g", "first_id", "n", "vec_id").join(counts, "vec_id", "left")
    told = told.join(linked.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    told = stored(told.withColumn("component", F.coalesce("component", "vec_id")).drop("vec_id"))
    first = told.groupBy("component").agg(F.min("first_id").alias("component_id"))
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")
    known = stored(told.join(first, "component").select("_h", "_g", links, "component_id"))
    linking = members.where("usable").join(known, ["_h", "_g"]).select("vec_id", "n_links", "component_id")
    alone = members.where("NOT usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id"))
    return linking.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
