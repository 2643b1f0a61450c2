"""Vector code compression: product codes of vectors with codebooks from exact integer Lloyd rounds.

Active-entry Lloyd: every part of a vector keeps the entry it is assigned to and its exact distance. After an update
only some entries have moved. A part whose entry stayed compares the moved ones alone with its stored distance; a part
whose entry moved looks at all entries again. Ties go to the lower index either way, so codes are those of full scans.

Vectors never meet each other: a round reads the stored state of the last one, writes its own, and adds up each entry's
members within tasks. The driver holds the codebooks, parts x entries x width numbers, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import stored
from dealwright.llm.vectors import by_length, to_matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components must stay within, so that the sum of a vector's squared distances fits a long.
MOST = 1 << 25
#: Vectors that a task compares at once.
SLICE = 8_192

#: A vector's state, or (``entry`` not null) what a task has added up of the members of an entry of a part.
STATE = (
    "vec_id long, label string, vector array<long>, codes array<int>, distances array<long>, "
    "part int, entry int, members long, sums array<long>"
)
NAMES = [column.split()[0] for column in STATE.split(", ")]


def integers(table: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector): rows whose vector has finite components only, each x as floor(256 x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return table.where(finite).select("vec_id", F.col(label).cast("string").alias("label"), whole.alias("vector"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, width of a part) from the smallest vec_ids of ``rows`` (vec_id, vector).

    The width is that of the smallest one which can be cut into ``parts``; repeated ids are in the order of their vectors.
    """
    usable = rows.where(F.size("vector") % parts == 0)
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = usable.orderBy(*order).select(F.size("vector").alias("width")).first()
    if first is None:
        return np.zeros((parts, 0, 0), np.int64)
    chosen = usable.where(F.size("vector") == first["width"]).orderBy(*order).limit(entries).select("vector").collect()
    vectors = np.array([r["vector"] for r in chosen], np.int64).reshape(len(chosen), parts, -1)
    return vectors.transpose(1, 0, 2).copy()


def _distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    total = np.zeros((len(part), len(entries)), np.int64)
    for j in range(part.shape[1]):
        gap = part[:, j, None] - entries[None, :, j]
        total += gap * gap
    return total


def assign(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row, by a look at all entries."""
    found = _distances(part, entries)
    codes = found.argmin(axis=1).astype(np.int32)  # the first of equal ones
    return codes, found[np.arange(len(part)), codes]


def reassign(
    part: np.ndarray, entries: np.ndarray, moved: np.ndarray, codes: np.ndarray, distances: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """As ``assign``, from the last round's result and the entries that have moved since."""
    codes, distances = codes.copy(), distances.copy()
    lost = moved[codes]
    if lost.any():
        codes[lost], distances[lost] = assign(part[lost], entries)
    active = np.flatnonzero(moved)
    kept = np.flatnonzero(~lost)
    if len(active) and len(kept):
        near, found = assign(part[kept], entries[active])
        near = active[near].astype(np.int32)
        better = (found < distances[kept]) | ((found == distances[kept]) & (near < codes[kept]))
        codes[kept[better]], distances[kept[better]] = near[better], found[better]
    return codes, distances


def _vectors(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The rows whose vector has the codebooks' width."""
    return next((b for b in by_length(batch, "vector") if len(b.column("vector")[0]) == width), batch.slice(0, 0))


def _lists(values: np.ndarray) -> pa.ListArray:
    """Each row of a matrix as a list."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, sums: bool) -> DataFrame:
    """The state of all vectors under ``books`` and, if asked for, the sums of each entry's members by task."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros((parts, entries), np.int64)
        added = np.zeros(books.shape, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = _vectors(whole.slice(at, SLICE), parts * size)
                n = batch.num_rows
                if not n:
                    continue
                vectors = (to_matrix(batch.column("vector")) if size else np.zeros((n, 0), np.int64)).reshape(n, parts, size)
                if vectors.size and (vectors.max() > MOST or vectors.min() < -MOST):
                    raise ValueError(f"a component times {SCALE} lies beyond {MOST}: squared distances would not fit a long")
                if moved is None:
                    found = [assign(vectors[:, p], books[p]) for p in range(parts)]
                else:
                    codes, distances = to_matrix(batch.column("codes")), to_matrix(batch.column("distances"))
                    found = [
                        reassign(vectors[:, p], books[p], moved[p], codes[:, p], distances[:, p]) for p in range(parts)
                    ]
                codes, distances = (np.stack(x, axis=1) for x in zip(*found, strict=True))
                if sums:
                    for p in range(parts):
                        members[p] += np.bincount(codes[:, p], minlength=entries)
                        np.add.at(added[p], codes[:, p], vectors[:, p])
                nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                kept = [batch.column(c) for c in ("vec_id", "label", "vector")]
                yield pa.RecordBatch.from_arrays([*kept, _lists(codes), _lists(distances), *nothing], NAMES)
        at_part, at_entry = np.nonzero(members)
        n = len(at_part)
        if n:
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            made = [pa.array(at_part, pa.int32()), pa.array(at_entry, pa.int32()), pa.array(members[at_part, at_entry])]
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, t) for t in kinds), *made, _lists(added[at_part, at_entry])], NAMES
            )

    return rows.mapInArrow(run, STATE)


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its members' mean."""
    of_tasks = state.where("entry IS NOT NULL").select("part", "entry", "members", F.posexplode("sums").alias("j", "s"))
    totals = of_tasks.groupBy("part", "entry", "j").agg(F.sum("members").alias("n"), F.sum("s").alias("s"))
    books = books.copy()
    for r in totals.collect():  # at most one row for each number of the codebooks
        books[r["part"], r["entry"], r["j"]] = r["s"] // r["n"]
    return books


def fit(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[np.ndarray, DataFrame]:
    """Codebooks, and (vec_id, label, vector, codes, distances) of ``rows`` (vec_id, label, vector) under them."""
    books, moved, state = first_codebooks(rows, parts, entries), None, rows
    if not books.shape[1]:
        return books, rows.sparkSession.createDataFrame([], STATE).select(*NAMES[:5])
    for _ in range(rounds):
        state = stored(_round(state, books, moved, sums=True))
        new = _updated(state, books)
        books, moved = new, (new != books).any(axis=2)
        state = state.where("entry IS NULL")
    return books, stored(_round(state, books, moved, sums=False).select(*NAMES[:5]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out, and so are vectors of another width
    than the smallest vec_id that can be cut into ``parts``, as the codebooks say nothing of them. A null vec_id is coded
    but begins no codebook unless ids run out; fewer vectors than ``entries`` make smaller codebooks; repeated rows are
    coded each. Rows without a label count as one label. An empty table gives no rows. Components beyond 2^17 raise an
    error that says so: their distances do not fit a long. Other columns play no part, so their names cannot clash.
    """
    books, state = fit(integers(table, vector, label), parts, entries, rounds)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda total, d: total + d)
    coded = state.select("vec_id", "label", code.alias("code"), error.alias("error"))
    # stored: Spark then knows how large it is and copies it to the rows or shuffles it, splitting large labels
    by_label = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
