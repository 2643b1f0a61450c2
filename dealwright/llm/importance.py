"""Target-distribution importance resampling of documents by hashed word features.

Segment deduplication: newlines, which no word contains, cut texts into lines. Spark counts how often each distinct line
occurs; its features are found once, and the corpus counts of a bucket are the line's times its occurrences. Runs of
words that cross a line's end depend on the document and are added separately. A document's weight is the sum of its
lines' weights, met by a join on the line's hash of 128 bits, and of its crossing runs' gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.llm.common import HOT, list_array, met, stored

#: Features whose bucket a task remembers; bounds memory, not results.
REMEMBERED = 200_000
#: Tasks that add up what the others have counted.
SUMS = 16

#: Bytes of a text as words see them: A-Z in lower case, ASCII that is neither digit nor letter a gap.
_AS_WORDS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Features are runs of 1 to ``max_n`` words, hashed to ``buckets``; documents of ``min_words`` can be drawn, and of
    those ``percent`` are."""

    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


class _Buckets(dict):
    """The bucket of a feature's bytes, remembered within bounds."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def _runs(words: list[bytes], max_n: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, max_n + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def _crossing(text: bytes, max_n: int) -> Iterator[bytes]:
    """The runs of words whose first and last word are in different lines."""
    lines = [line.translate(_AS_WORDS).split() for line in text.split(b"\n")]
    words = [word for line in lines for word in line]
    line_of = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
    for n in range(2, max_n + 1):
        for i in np.flatnonzero(line_of[n - 1 :] != line_of[: max(0, len(words) - n + 1)]):
            yield b" ".join(words[i : i + n])


def _bytes(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2"))


def segments(docs: DataFrame, settings: Settings) -> DataFrame:
    """(k1, k2, occurrences, n_words, buckets) of every distinct line that is not empty, over all documents."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    named = distinct.select(_line_key(F.col("line")).alias("k"), "occurrences", "line").select("k.*", "occurrences", "line")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(settings.buckets).__getitem__
        for batch in batches:
            lists, n_words = [], []
            for line in _bytes(batch.column("line")):
                words = line.translate(_AS_WORDS).split()
                n_words.append(len(words))
                runs = words if settings.max_n == 1 else _runs(words, settings.max_n)
                lists.append(np.array(list(map(bucket, runs)), np.int32))
            kept = batch.drop_columns(["line"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(n_words, pa.int64()), list_array(lists, pa.int32())],
                [*kept.schema.names, "n_words", "buckets"],
            )

    return named.mapInArrow(find, "k1 long, k2 long, occurrences long, n_words long, buckets array<int>")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a list column in one array, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _counted(rows: DataFrame, buckets: int) -> np.ndarray:
    """The features in each bucket of rows (buckets, occurrences). Each task adds up its rows to one array, and a bounded
    number of tasks adds up those; what is left for the driver is ``SUMS`` arrays at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, offsets = _values(batch.column("buckets"))
            np.add.at(total, values, np.repeat(batch.column("occurrences").to_numpy(), np.diff(offsets)))
        yield told(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column("counts").to_pylist():
                total += np.frombuffer(one, np.int64)
        yield told(total)

    def told(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()] if total.any() else [], pa.binary())], ["counts"])

    of_tasks = rows.select("buckets", "occurrences").mapInArrow(count, "counts binary")
    sums = of_tasks.repartition(SUMS).mapInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r["counts"], np.int64) for r in sums), np.zeros(buckets, np.int64))


def _cross_features(docs: DataFrame, settings: Settings) -> DataFrame:
    """(buckets, occurrences = 1) of each document's runs of words that cross the end of a line."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(settings.buckets).__getitem__
        for batch in batches:
            lists = [np.array(list(map(bucket, _crossing(t, settings.max_n))), np.int32) for t in _bytes(batch.column(0))]
            ones = pa.array(np.ones(len(lists), np.int64))
            yield pa.RecordBatch.from_arrays([list_array(lists, pa.int32()), ones], ["buckets", "occurrences"])

    return docs.select("text").mapInArrow(find, "buckets array<int>, occurrences long")


def bucket_counts(docs: DataFrame, settings: Settings, found: DataFrame | None = None) -> np.ndarray:
    """How many features of all documents fall into each bucket; ``found`` are their segments, if already at hand."""
    rows = (segments(docs, settings) if found is None else found).select("buckets", "occurrences")
    if settings.max_n > 1:
        rows = rows.unionByName(_cross_features(docs, settings))
    return _counted(rows, settings.buckets)


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the corpus, one added to every bucket."""
    buckets, all_target, all_corpus = len(corpus), int(target.sum()), int(corpus.sum())
    up, down = float(all_corpus + buckets), float(all_target + buckets)
    ratios = ((float(t + 1) * up) / (float(s + 1) * down) for t, s in zip(target.tolist(), corpus.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(k1, k2, occurrences, n_words, n_features, weight) of segments."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _values(batch.column("buckets"))
            sums = np.concatenate(([0], np.cumsum(gain[values])))
            made = [pa.array(np.diff(offsets), pa.int64()), pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())]
            kept = batch.drop_columns(["buckets"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, "n_features", "weight"])

    return found.mapInArrow(add, "k1 long, k2 long, occurrences long, n_words long, n_features long, weight long")


def _with_crossing(rows: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """``rows`` with (n_cross, cross) instead of text: number and gains of the runs that cross the end of a line."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(settings.buckets).__getitem__
        for batch in batches:
            found = [list(map(bucket, _crossing(t, settings.max_n))) for t in _bytes(batch.column("text"))]
            n, weight = [len(x) for x in found], [int(gain[x].sum()) for x in found]
            kept = batch.drop_columns(["text"])
            made = [*kept.columns, pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, [*kept.schema.names, "n_cross", "cross"])

    added = [T.StructField("n_cross", T.LongType()), T.StructField("cross", T.LongType())]
    return rows.mapInArrow(add, T.StructType([*rows.drop("text").schema.fields, *added]))


def weights(docs: DataFrame, found: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every document, from the stored segments of all."""
    keys = F.transform(F.filter(F.split("text", "\n", -1), lambda line: line != ""), _line_key)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", keys.alias("keys"), "text")
    if settings.max_n > 1:
        heads = _with_crossing(rows, gain, settings)
    else:
        heads = rows.drop("text").withColumns({"n_cross": F.lit(0).cast("long"), "cross": F.lit(0).cast("long")})
    group = ["row", "doc_id", "n_cross", "cross"]
    lines = heads.select(*group, F.explode_outer("keys").alias("k")).select(*group, "k.*")

    total = found.agg(F.sum("occurrences")).first()[0] or 0
    often = F.col("occurrences") * HOT > total
    summed = met(lines, _weighed(found, gain), ["k1", "k2"], often).groupBy(*group).agg(
        *(F.sum(F.coalesce(c, F.lit(0))).alias(f"sum_{c}") for c in ("n_words", "n_features", "weight"))
    )
    return summed.select(
        "row",
        "doc_id",
        F.col("sum_n_words").alias("n_words"),
        (F.col("sum_n_features") + F.col("n_cross")).alias("n_features"),
        (F.col("sum_weight") + F.col("cross")).alias("weight"),
    )


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) from a digest of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place`` 1, 2, 3 ... in an order: sorted ranges, each counted on from those before it."""
    ranges = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before")  # a row for each range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("within", within).join(sizes.select("range", before), "range").withColumn(
        "place", F.col("before") + F.col("within")
    )


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank.

    ``target`` (text) is what drawn documents should look like. A document's weight is the sum of its features' gains,
    its score adds noise that is fixed by its id, and of the N documents of ``min_words`` words the floor(percent N /
    100) best are drawn: rank is their place, null for others. Ties go to the smaller doc_id, null last, then to the
    earlier row. A null or empty text has no features and weight 0; repeated rows are documents of their own, with one
    score; empty tables give an empty result or gains of 0. Other columns play no part, so their names cannot clash.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    found = stored(segments(docs, settings))
    gain = gains(bucket_counts(target, settings), bucket_counts(docs, settings, found))
    scored = weights(docs, found, gain, settings).select(
        "row", "doc_id", "n_features", "weight",
        (F.col("weight") + _noise(F.col("doc_id"), settings.seed)).alias("score"),
        (F.col("n_words") >= settings.min_words).alias("open"),
    )
    order = (F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    placed = _placed(scored, *order)
    wanted = settings.percent * placed.where("open").count() // 100
    drawn = F.col("open") & (F.col("place") <= wanted)
    return placed.select(
        "doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).cast("long").alias("rank")
    )
