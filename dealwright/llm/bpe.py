"""Byte-level BPE encoding and decoding.

Overlapping chunk encoding: texts are cut into chunks that overlap, the chunks are pre-tokenised independently of each
other, neighbours are stitched at the first boundary that both find in their overlap (from a common boundary on, the
pattern sees the same text and so goes on alike), and the pieces between the stitches are encoded. A text of one chunk
needs no stitch. A pair of chunks without a common boundary, as in a run of thousands of letters, sends its text to be
pre-tokenised as a whole: such a text is one row of bounded size anyway.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.llm.common import BATCH_BYTES, held, list_array, stored

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 65_536, 1_024
#: A match that ends so near a chunk's end may go on in the full text: the longest lookahead of the pattern.
LOOKAHEAD = 3
#: Pieces whose ids a task remembers; when there are more, it starts anew. Bounds memory, not results.
REMEMBERED = 100_000

Ranks = dict[bytes, int]


def load_ranks(path: str) -> Ranks:
    """Token bytes and ids of a rank file. Read by the driver; a vocabulary has a fixed size of about a megabyte."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Pieces:
    """Ids of pieces, with a memory of bounded size."""

    def __init__(self, pattern: str, ranks: Ranks):
        self.split = regex.compile(pattern)
        self.single = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, list[int]] = {}
        self.token = {rank: token for token, rank in ranks.items()}

    def decoded_digest(self, ids: np.ndarray) -> str:
        """Lower-case hex SHA-256 of the bytes that ids stand for."""
        return hashlib.sha256(b"".join(map(self.token.__getitem__, ids.tolist()))).hexdigest()

    def ids(self, pieces: Sequence[str]) -> np.ndarray:
        known, out = self.known, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self.single.encode_single_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return np.array(out, np.int32)

    def forget(self) -> None:
        """At a task's end: the Python worker stays, and what runs in it next needs the memory."""
        self.known.clear()
        pa.default_memory_pool().release_unused()


def _pieces(pattern: str, ranks: Ranks) -> _Pieces:
    """The encoder of this Python worker, made once for all its tasks with the same vocabulary."""
    return held((pattern, ranks), lambda: _Pieces(pattern, ranks))


def _with_ids(
    batches: Iterator[pa.RecordBatch], column: str, ids_of: Callable[..., np.ndarray], digest: Callable | None = None
) -> Iterator[pa.RecordBatch]:
    """The batches with ``column`` and all ``_own`` columns replaced by the ids and, if asked for, the digest of what they
    decode to, in batches of bounded size."""
    for batch in batches:
        keep = [i for i, n in enumerate(batch.schema.names) if n != column and not n.startswith("_own")]
        extra = [batch.column(n).to_pylist() for n in batch.schema.names if n.startswith("_own")]
        texts, start, parts, size = batch.column(column), 0, [], 0
        for i in range(batch.num_rows):
            parts.append(ids_of(texts[i].as_py() or "", *(e[i] for e in extra)))
            size += parts[-1].nbytes
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                kept = [batch.column(k).slice(start, i + 1 - start) for k in keep]
                names = [batch.schema.names[k] for k in keep]
                made, added = [list_array(parts, pa.int32())], ["ids"]
                if digest:
                    made.append(pa.array(map(digest, parts), pa.string()))
                    added.append("decoded_sha256")
                yield pa.RecordBatch.from_arrays([*kept, *made], [*names, *added])
                start, parts, size = i + 1, [], 0


def _cut(chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        for i in range(batch.num_rows):
            text, kept = texts[i].as_py(), batch.slice(i, 1).drop_columns(["_text"])
            for c, at in enumerate(range(0, max(1, len(text) - overlap), chunk)):
                body = text[at : at + chunk + overlap]
                made = [*kept.columns, pa.array([c], pa.int32()), pa.array([at + len(body) >= len(text)]), pa.array([body])]
                yield pa.RecordBatch.from_arrays(made, [*kept.schema.names, "_chunk", "_last", "_body"])


def _ends(pattern: str, chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundaries that can be relied on: ``head`` in the overlap with the chunk before, ``tail`` with the next."""
    split = regex.compile(pattern)
    for batch in batches:
        bodies, last = batch.column("_body"), batch.column("_last").to_pylist()
        heads, tails = [], []
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            ends = np.cumsum([0, *map(len, split.findall(body))])
            if not last[i]:
                ends = ends[ends <= len(body) - LOOKAHEAD]
            heads.append(ends[ends <= overlap])
            tails.append(ends[ends >= chunk] - chunk)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("_chunk"), list_array(heads, pa.int32()), list_array(tails, pa.int32())],
            ["_row", "_chunk", "_head", "_tail"],
        )


def encode(
    docs: DataFrame,
    ranks: Ranks,
    pattern: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and ``ids`` array<int>, the ids of the whole text.

    With ``decoded`` also decoded_sha256, the digest of the bytes that the ids decode to, made by the task that has found
    them: encoding and decoding share one Python worker and one vocabulary. As the vocabulary's own library encodes it without special tokens. A null or empty text has no ids. Repeated rows
    stay repeated, columns of any value or null may be kept; other columns play no part, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [f"_k{i}" for i in range(len(keep))]
    narrow = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), F.col(text).alias("_text"))
    schema = narrow.drop("_text").schema
    found_ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    added = [found_ids, T.StructField("decoded_sha256", T.StringType())] if decoded else [found_ids]
    out = T.StructType([*schema.fields, *added])
    length = F.coalesce(F.length("_text"), F.lit(0))

    def whole(batches):
        made = _pieces(pattern, shared.value)
        digest = made.decoded_digest if decoded else None
        yield from _with_ids(batches, "_text", lambda t: made.ids(made.split.findall(t)), digest)
        made.forget()

    def owned(batches):
        made = _pieces(pattern, shared.value)

        def ids(body, start, end):
            pieces = made.split.findall(body, start)
            if end is not None:  # the pieces after the stitch belong to the next chunk
                at = start + np.cumsum([len(p) for p in pieces])
                pieces = pieces[: int(np.searchsorted(at, end, "right"))]
            return made.ids(pieces)

        yield from _with_ids(batches, "_body", ids)
        made.forget()

    short = narrow.where(length <= chunk + overlap).mapInArrow(whole, out)

    row = T.StructField("_row", T.LongType())
    number = T.StructField("_chunk", T.IntegerType())
    cut = [*schema.fields, row, number, T.StructField("_last", T.BooleanType()), T.StructField("_body", T.StringType())]
    long = narrow.where(length > chunk + overlap).withColumn("_row", F.monotonically_increasing_id())
    chunks = stored(
        long.mapInArrow(lambda it: _cut(chunk, overlap, it), T.StructType(cut)).repartition("_row", "_chunk")
    )
    ints = T.ArrayType(T.IntegerType())
    found = chunks.select("_row", "_chunk", "_last", "_body").mapInArrow(
        lambda it: _ends(pattern, chunk, overlap, it),
        T.StructType([row, number, T.StructField("_head", ints), T.StructField("_tail", ints)]),
    )
    in_order = Window.partitionBy("_row").orderBy("_chunk")
    stitched = found.withColumn(
        "_own_start",
        F.when(F.col("_chunk") == 0, 0).otherwise(
            F.array_min(F.array_intersect(F.lag("_tail").over(in_order), F.col("_head")))
        ),
    ).select(
        "_row",
        "_chunk",
        "_own_start",
        (F.lead("_own_start").over(in_order) + F.lit(chunk)).alias("_own_end"),
        F.max(F.col("_own_start").isNull()).over(Window.partitionBy("_row")).alias("_apart"),
    )
    stitched = stored(stitched)
    parts = (
        chunks.join(stitched.where("NOT _apart").drop("_apart"), ["_row", "_chunk"])
        .select(*names, "_row", "_chunk", "_body", "_own_start", "_own_end")
        .mapInArrow(owned, T.StructType([*schema.fields, row, number, found_ids]))
    )
    one = parts.groupBy("_row").agg(
        F.first(F.struct(*names)).alias("_k"), F.array_sort(F.collect_list(F.struct("_chunk", "ids"))).alias("_p")
    )
    stitches = one.select("_k.*", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
    if decoded:
        joined = decode(stitches, ranks, keep=(*names, "ids"))
        stitches = joined.withColumn("decoded_sha256", F.sha2("bytes", 256)).drop("bytes")
    again = (
        chunks.join(stitched.where("_apart AND _chunk = 0").select("_row"), "_row", "left_semi")
        .withColumn("_body", F.when(F.col("_last"), F.col("_body")).otherwise(F.substring("_body", 1, chunk)))
        .groupBy("_row")
        .agg(F.first(F.struct(*names)).alias("_k"), F.array_sort(F.collect_list(F.struct("_chunk", "_body"))).alias("_p"))
        .select("_k.*", F.array_join(F.transform("_p", lambda p: p["_body"]), "").alias("_text"))
        .mapInArrow(whole, out)
    )
    result = short.unionByName(stitches).unionByName(again)
    return result.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), *(f.name for f in added))


def decode(rows: DataFrame, ranks: Ranks, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row: the columns ``keep`` and ``bytes``, the bytes of all ids in order; null ids give none.

    An id outside the vocabulary is an error, as its bytes are unknown.
    """
    shared = rows.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    narrow = rows.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column("_ids")
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            start, parts, size = 0, [], 0
            for i in range(batch.num_rows):
                parts.append(b"".join(map(token, values[offsets[i] : offsets[i + 1]].tolist())))
                size += len(parts[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    kept = [batch.column(k).slice(start, i + 1 - start) for k in keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(parts, pa.binary())], [*keep, "bytes"])
                    start, parts, size = i + 1, [], 0

    schema = T.StructType([*narrow.drop("_ids").schema.fields, T.StructField("bytes", T.BinaryType())])
    return narrow.mapInArrow(join, schema)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def round_trip(docs: DataFrame, ranks: Ranks, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids."""
    found = encode(docs, ranks, pattern, decoded=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), "decoded_sha256"
    )
