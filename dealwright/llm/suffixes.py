"""Removal of passages that repeat across documents, by sparse suffixes.

Texts are sequences of words. A suffix is retained where the hash of its first ``GRAM`` words is the smallest of
``WINDOW`` neighbouring positions, so the choice depends on content alone: any window of ``MIN_WORDS`` words has the same
smallest hash in every document, at one of its first ``WINDOW`` words. A window can only repeat if a suffix that begins
with that hash is retained in another document, and windows are looked at only there. Neighbouring windows of one smallest
hash form a block. Blocks of equal content are settled together, by the smallest and the largest document that have them;
where blocks of one hash differ, one document's block of each content meets the others window by window. So every window
is judged as if compared with all documents, whatever surrounds it and however many have it. Windows that follow each
other join to spans, so a passage may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.llm.common import list_array, stored

MIN_WORDS, GRAM, WINDOW = 50, 10, 32
#: Windows of a block at most; only runs of one repeated word have more, and results do not depend on where they are cut.
GROUP = 32

_FACTOR, _UNFACTOR, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _WORD
    x = (x ^ (x >> np.uint64(29))) * _WORD
    return x ^ (x >> np.uint64(32))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of every word; a word is a run of bytes other than 9 to 13 and 32."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not _powers or len(_powers[0]) <= len(raw):
        size = max(1 << 16, 2 * len(raw))
        made = []
        for base in (_FACTOR, _UNFACTOR):
            powers = np.full(size, base)
            powers[0] = 1
            made.append(np.cumprod(powers, dtype=np.uint64))
        _powers[:] = made
    power, unpower = _powers
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])))
    hashes = _mixed((sums[end] - sums[start]) * unpower[start])
    if len(_powers[0]) > 1 << 22:
        _powers.clear()
    return hashes, start, end


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = pick(values[:-step], values[step:])
        span += step
    return values


def _lowest(hashes: np.ndarray) -> np.ndarray:
    """For each window of ``MIN_WORDS`` words the hash of its retained suffix: the smallest hash of ``GRAM`` words that
    begin at one of its first ``WINDOW`` words."""
    n = len(hashes) - GRAM + 1
    gram = hashes[:n].copy()
    for k in range(1, GRAM):
        gram = gram * _FACTOR + hashes[k : n + k]
    return _slide(_mixed(gram), WINDOW, np.minimum)[: len(hashes) - MIN_WORDS + 1].view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, words = [], []
        for text in batch.column("text"):
            found, _, _ = words_of((text.as_py() or "").encode("utf-8", "surrogatepass"))
            hashes.append(np.unique(_lowest(found)) if len(found) >= MIN_WORDS else np.empty(0, np.int64))
            words.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_doc", "_k1", "_k2")), pa.array(words, pa.int32()), list_array(hashes, pa.int64())],
            ["_doc", "_k1", "_k2", "words", "h"],
        )


def _window_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of every window of ``MIN_WORDS`` words, from those of its words."""
    n = len(hashes) - MIN_WORDS + 1
    window = hashes[:n].copy()
    for k in range(1, MIN_WORDS):
        window = window * _UNFACTOR + hashes[k : n + k]
    return _mixed(window)


def _blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for at most ``size`` following windows whose smallest hash is one of the shared ``hits``: the hash, the first
    window's place and the hashes of the windows."""
    for batch in batches:
        for i in range(batch.num_rows):
            hits = batch.column("hits")[i].values.to_numpy(zero_copy_only=False)
            hashes, _, _ = words_of(batch.column("text")[i].as_py().encode("utf-8", "surrogatepass"))
            windows = _window_hashes(hashes).view(np.int64)
            low = _lowest(hashes)
            place = np.arange(len(low))
            run = np.maximum.accumulate(np.where(np.concatenate(([True], low[1:] != low[:-1])), place, 0))
            start = np.flatnonzero((place - run) % size == 0)
            end = np.append(start[1:], len(low))
            shared = np.isin(low[start], hits)
            start, end = start[shared], end[shared]
            for k in range(0, len(start), 8192):
                at, to = start[k : k + 8192], end[k : k + 8192]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(low[at]),
                        pa.array(np.full(len(at), batch.column("_doc")[i].as_py()), pa.int64()),
                        pa.array(np.full(len(at), batch.column("_k1")[i].as_py()), pa.int64()),
                        pa.array(at, pa.int32()),
                        list_array([windows[x:y] for x, y in zip(at, to, strict=True)], pa.int64()),
                    ],
                    ["h", "_doc", "_k1", "start_word", "windows"],
                )


def _with_keys(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` with two hashes of the text and an order: null ids come behind all others."""
    k1 = F.xxhash64("text")
    order = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(k1, 2) + F.lit(1 << 62))
    return docs.select("doc_id", "text", *more, k1.alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2"), order.alias("_doc"))


def _joined(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans that overlap or touch made one, by document."""
    by = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_new", F.when(F.col("start_word") > before, 1).otherwise(F.when(before.isNull(), 1).otherwise(0)))
    numbered = opens.withColumn("_part", F.sum("_new").over(by))
    return numbered.groupBy(*keys, "_part").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")
    ).drop("_part")


def _settled(blocks: DataFrame) -> DataFrame:
    """(doc, k1, start_word, end_word, repeated) from blocks of windows: spans that a smaller document has too (repeated),
    and those that only larger ones have."""
    ends = [F.min("_doc").alias("low"), F.max("_doc").alias("high")]
    contents = stored(blocks.groupBy("h", "content").agg(*ends))
    hashes = contents.groupBy("h").agg((F.min("content") != F.max("content")).alias("differ"))
    contents = stored(contents.join(hashes, "h"))
    open_ = F.col("differ") & (F.col("_doc") == F.col("low"))
    told = stored(
        blocks.join(contents, ["h", "content"]).select(
            "h", "_doc", "_k1", "start_word", "low", "high", "differ",
            (F.col("start_word") + F.size("windows") + (MIN_WORDS - 1)).alias("end_word"), F.when(open_, F.col("windows")).alias("windows"),
        )
    )
    repeated = (F.col("_doc") > F.col("low")).alias("repeated")
    whole = told.where("_doc > low OR NOT differ AND high > low").select("_doc", "_k1", "start_word", "end_word", repeated)
    each = told.where("windows IS NOT NULL").select(
        "h", "_doc", "_k1", "start_word", "high", F.posexplode("windows").alias("at", "window")
    )
    met = stored(
        each.groupBy("h", "window").agg(F.min("_doc").alias("low"), F.max("high").alias("most")).where("low <> most")
    )
    start = (F.col("start_word") + F.col("at")).alias("start_word")
    single = each.join(met, ["h", "window"]).select("_doc", "_k1", start, (start + MIN_WORDS).alias("end_word"), repeated)
    return whole.unionByName(single)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, k1, start_word, end_word, repeated) of ``docs`` (doc_id, text): see ``repeated_passages``."""
    keyed = _with_keys(docs).where("text IS NOT NULL")
    kinds = "_doc long, _k1 long, _k2 long, words int, h array<long>"
    sketches = stored(keyed.select("_doc", "_k1", "_k2", "text").mapInArrow(_sketched, kinds), gather=True)
    sketches = sketches.where(F.col("words") >= MIN_WORDS)
    texts = stored(sketches.groupBy("_k1", "_k2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.max("words").alias("words")))
    one_each = sketches.join(texts.select("_k1", "_k2", F.col("_first").alias("_doc")), ["_k1", "_k2", "_doc"], "left_semi")
    suffixes = one_each.select("_doc", "_k1", F.explode("h").alias("h"))
    shared = stored(suffixes.groupBy("h").agg(F.min("_doc").alias("low"), F.max("_doc").alias("high")).where("low <> high").select("h"))
    hits = suffixes.join(shared, "h").groupBy("_doc", "_k1").agg(F.collect_list("h").alias("hits"))
    found = keyed.select("_doc", "_k1", "text").join(hits, ["_doc", "_k1"])
    size = GROUP
    kinds = "h long, _doc long, _k1 long, start_word int, windows array<long>"
    blocks = stored(found.mapInArrow(lambda it: _blocks(size, it), kinds).withColumn("content", F.xxhash64("windows")), gather=True)
    near = _settled(blocks)
    copies = texts.where("_first <> _last")
    whole = [F.lit(0).alias("start_word"), F.col("words").alias("end_word")]
    firsts = copies.select(F.col("_first").alias("_doc"), "_k1", *whole, F.lit(False).alias("repeated"))
    later = sketches.join(copies.select("_k1", "_k2", "_first"), ["_k1", "_k2"]).where("_doc <> _first")
    spans = near.unionByName(firsts).unionByName(later.select("_doc", "_k1", *whole, F.lit(True).alias("repeated")))
    return _joined(spans, "_doc", "_k1", "repeated")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of ``docs`` (doc_id, text) that also occurs in another document: doc_id, start_word,
    end_word (exclusive, in words of the whole text), n_words, kept.

    A passage counts from ``MIN_WORDS`` words on. ``kept`` is false where a document with a smaller doc_id has it and
    true in the document that keeps it; a document may have both kinds, but none that is kept within one that is not. Whole copies of a text are found by its hashes
    (128 bits) and are looked at once. Null and shorter texts have no rows; null ids come last, by the text's hash;
    rows with one doc_id are one document and do not repeat each other. Extra columns play no part.
    """
    spans = stored(repeated_spans(docs))
    gone = spans.where("repeated").select("_doc", "_k1", F.col("start_word").alias("_from"), F.col("end_word").alias("_to"))
    within = (F.col("start_word") >= F.col("_from")) & (F.col("end_word") <= F.col("_to"))
    stays = spans.where("NOT repeated").alias("s").join(
        gone.alias("g"), (F.col("s._doc") == F.col("g._doc")) & (F.col("s._k1") == F.col("g._k1")) & within, "left_anti"
    )
    spans = spans.where("repeated").unionByName(stays)
    ids = _with_keys(docs).select("doc_id", "_doc", "_k1").distinct()
    return spans.join(ids, ["_doc", "_k1"]).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        (~F.col("repeated")).alias("kept"),
    )


def _without(text: str, spans: list) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    _, start, _ = words_of(raw)
    edges = np.append(start, len(raw))
    parts, at = [], 0
    for span in sorted((s["start_word"], s["end_word"]) for s in spans):
        parts.append(raw[at : edges[span[0]]])
        at = edges[span[1]]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and others) without the passages that ``repeated_passages`` does not keep.

    n_chars follows the text. A document of which no word is left goes; one that had no words stays as it was.
    """
    columns = docs.columns
    spans = repeated_spans(docs).where("repeated").groupBy("_doc", "_k1").agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("_cuts")
    )
    # the other columns travel in one, under names that cannot clash
    others = [c for c in columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(True).alias("there"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(others)))
    packed = docs.select("doc_id", "text", rest.alias("_rest"))
    joined = _with_keys(packed, "_rest").join(stored(spans), ["_doc", "_k1"], "left").select("doc_id", "text", "_rest", "_cuts")
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "_cuts"), T.StructField("_changed", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column("text"), batch.column("_cuts")
            changed = cuts.is_valid()
            some = zip(texts.filter(changed), cuts.filter(changed), strict=True)
            left = pa.array([_without(t.as_py(), s.as_py()) for t, s in some], texts.type)
            if len(left):
                texts = pc.replace_with_mask(texts, changed, left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), texts, batch.column("_rest"), changed], ["doc_id", "text", "_rest", "_changed"]
            )

    # all rows in one pass, as each branch of a union would shuffle the texts again
    done = joined.mapInArrow(cut, schema).where(~F.col("_changed") | has_words(F.col("text")))
    found = {c: F.col("_rest")[f"f{i}"] for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        found["n_chars"] = F.when(F.col("_changed"), n_chars).otherwise(found["n_chars"])
    return done.select(*(found[c].alias(c) for c in columns))


def has_words(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")
