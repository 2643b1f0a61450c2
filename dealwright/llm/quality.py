"""Quality by perplexity under a model of trusted text.

An interpolated modified Kneser-Ney model of ``ORDER`` characters is learned for each language from all trusted documents.
Spark counts the n-grams; counts, contexts and what shorter n-grams need are cut into shards by the two characters before
the last, which an n-gram shares with its shorter forms and its context, so that a shard of bounded size can answer alone for
every character that falls to it. Documents are joined with one shard after the other, in place: each pass adds up the
log-probabilities of the characters that the shard answers for, and only those sums are moved. A document's perplexity is
compared with quantiles of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import stored

ORDER, BITS = 5, 9
SYMBOLS = 1 << BITS
#: n-grams of a shard, about: 40 bytes each in a task.
SHARD_NGRAMS = 2_000_000
#: Characters that are worked on at once.
SLICE = 1 << 20
#: Quantiles of the trusted documents' cross-entropies that bound what is kept, and by how much of their distance to the
#: median the bounds are widened.
LOW, HIGH, WIDENED = 0.001, 0.999, 0.5
#: One in so many trusted documents is not learned from: what a document fits that the model has not seen, they tell.
HELD_OUT = 5
#: Characters from which a document's cross-entropy is taken as it is; shorter ones scatter more, by the root of the ratio.
STEADY = 2000
NO_LANGUAGE = ""

_tables: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """0 for white space, otherwise the code point; beyond the alphabet of SYMBOLS code points share symbols."""
    if not _tables:
        points = np.arange(0x110000)
        space = np.fromiter((chr(p).isspace() for p in range(0x3001)), bool, 0x3001)
        table = np.where(points < SYMBOLS, points, points % 251 + SYMBOLS - 251)
        table[:0x3001][space] = 0
        _tables.append(table.astype(np.int64))
    return _tables[0]


def codes_of(text: str, lang: int) -> Iterator[np.ndarray]:
    """Codes of the n-grams ending at each character and behind the last, a language's number in their highest bits.

    White space counts as one gap; a text of nothing else has no characters. Slices have a bounded size.
    """
    table, last = _symbol_table(), np.zeros(ORDER - 1, np.int64)
    for at in range(0, len(text), SLICE):
        symbols = table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = symbols == 0
        symbols = symbols[~(gap & np.concatenate(([last[-1] == 0], gap[:-1])))]
        if at + SLICE >= len(text) and (symbols[-1] if len(symbols) else last[-1]):
            symbols = np.append(symbols, 0)
        if len(symbols):
            run = np.concatenate((last, symbols))
            code = run[: len(symbols)] + (lang << BITS)
            for k in range(1, ORDER):
                code = (code << BITS) | run[k : k + len(symbols)]
            yield code
            last = run[-(ORDER - 1) :]


def _slices(batch: pa.RecordBatch, lang: str, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of many texts at once, and the row that each belongs to."""
    held, owner, size = [], [], 0
    for i, (number, value) in enumerate(zip(batch.column(lang).to_pylist(), batch.column(text), strict=True)):
        for code in codes_of(value.as_py() or "", number) if number is not None else ():
            held.append(code)
            owner.append(i)
            size += len(code)
            if size >= SLICE:
                yield np.concatenate(held), np.repeat(owner, [len(c) for c in held])
                held, owner, size = [], [], 0
    if held:
        yield np.concatenate(held), np.repeat(owner, [len(c) for c in held])


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(code, n) over all rows (lang_number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, _ in _slices(batch, "lang_number", "text"):
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["code", "n"])

    rows = trusted.select("lang_number", "text").mapInArrow(run, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def _masked(code, order: int):
    """The language and the last ``order`` characters of a code of the next longer order."""
    low = (1 << BITS * order) - 1
    if isinstance(code, Column):
        lang = F.shiftleft(F.shiftright(code, BITS * (order + 1)), BITS * order)
        return lang.bitwiseOR(code.bitwiseAND(F.lit(low)))
    return ((code >> (BITS * (order + 1))) << (BITS * order)) | (code & low)


def levels_of(counts: DataFrame) -> list[DataFrame]:
    """(code, n) of each order, longest first: counts at the top, numbers of different left neighbours below."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy(_masked(F.col("code"), order).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    return levels


def _discounts(levels: Sequence[DataFrame]) -> list[np.ndarray]:
    """The three discounts of each order (for counts of 1, 2 and more), from how many n-grams have counts of 1 to 4."""
    tallies = [
        level.where("n <= 4").groupBy(F.lit(i).alias("level"), "n").agg(F.count(F.lit(1)).alias("times"))
        for i, level in enumerate(levels)
    ]
    times = np.zeros((len(levels), 5))
    for row in reduce(DataFrame.unionByName, tallies).collect():
        times[row["level"], row["n"]] = row["times"]
    made = []
    for _, n1, n2, n3, n4 in times:
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        made.append(np.array([0.0] + [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]))
    return made


@dataclass
class Level:
    """An order's sorted n-gram codes with their discounted shares, and contexts with the weight left to shorter ones."""

    codes: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, discounts: np.ndarray) -> Level:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        contexts, where = np.unique(codes >> BITS, return_inverse=True)
        total = np.bincount(where, counts, len(contexts))
        cut = discounts[np.minimum(counts, 3)]
        share = np.maximum(counts - cut, 0) / total[where]
        return cls(codes, share, contexts, np.bincount(where, np.minimum(cut, counts), len(contexts)) / total)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _taken(values: np.ndarray, at: np.ndarray, there: np.ndarray, other: float) -> np.ndarray:
    return np.where(there, values[at], other) if len(values) else np.full(len(at), other)


def probabilities(levels: Sequence[Level], codes: np.ndarray) -> np.ndarray:
    """Interpolated probability of each code's last character after those before it."""
    result, weight = np.zeros(len(codes)), np.ones(len(codes))
    for order, level in zip(range(ORDER, 0, -1), levels, strict=True):
        result += weight * _taken(level.share, *_find(level.codes, codes), 0.0)
        weight = weight * _taken(level.rest, *_find(level.contexts, codes >> BITS), 1.0)
        codes = _masked(codes, order - 1)
    return result + weight / SYMBOLS


@dataclass
class Shard:
    """The part of the model that answers for the codes of one shard; ``log_p`` holds those seen in training."""

    number: int
    shards: int
    levels: list[Level]

    def __post_init__(self):
        self.codes = self.levels[0].codes
        self.log_p = np.log(probabilities(self.levels, self.codes))

    def score(self, codes: np.ndarray) -> np.ndarray:
        at, there = _find(self.codes, codes)
        if not len(self.codes):
            return np.log(probabilities(self.levels, codes))
        result = self.log_p[at]
        result[~there] = np.log(probabilities(self.levels, codes[~there]))
        return result


def shard_of(code, shards: int, order: int = ORDER):
    """The shard of an n-gram of three characters or more: by its language and the two characters before the last."""
    pair = (1 << 2 * BITS) - 1
    if isinstance(code, Column):
        key = F.shiftright(code, BITS).bitwiseAND(F.lit(pair)) + F.shiftright(code, BITS * order) * F.lit(7919)
        return F.shiftright(key * F.lit(40503), 8) % shards
    key = ((code >> BITS) & pair) + (code >> (BITS * order)) * 7919
    return ((key * 40503) >> 8) % shards


def _to_level(rows: DataFrame, discounts: np.ndarray) -> Level:
    found = rows.select("code", "n").toArrow()
    return Level.of(found["code"].to_numpy(), found["n"].to_numpy(), discounts)


def _score(docs: DataFrame, shard, keys: Sequence[str]) -> DataFrame:
    """``keys``, and the sum and number of the characters of each row that the shard answers for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shard.value
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for codes, owner in _slices(batch, "lang_number", "text"):
                if model.shards > 1:
                    mine = shard_of(codes, model.shards) == model.number
                    codes, owner = codes[mine], owner[mine]
                total += np.bincount(owner, model.score(codes), batch.num_rows)
                n += np.bincount(owner, minlength=batch.num_rows)
            kept = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(n)], [*keys, "log_p", "n"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, *({"lang_number", "text"} - set(keys))).mapInArrow(run, f"{kinds}, log_p double, n long")


def perplexities(docs: DataFrame, trusted: DataFrame, keys: Sequence[str], shard_ngrams: int = SHARD_NGRAMS) -> DataFrame:
    """``keys``, log_p and n of every row of ``docs`` (lang_number, text, keys), by a model of ``trusted`` (lang_number, text).

    Rows that agree in all keys must agree in their text; they stay as many as they are.
    """
    spark = docs.sparkSession
    levels = [stored(level) for level in levels_of(stored(ngram_counts(trusted)))]
    discounts = _discounts(levels)
    shards = max(1, -(-levels[0].count() // shard_ngrams))
    # the two shortest orders, bounded by the alphabet and the languages, go with every shard
    short = [_to_level(level, d) for level, d in zip(levels[-2:], discounts[-2:], strict=True)]
    passes = []
    for number in range(shards):
        long = [
            _to_level(level.where(shard_of(F.col("code"), shards, ORDER - i) == number), discounts[i])
            for i, level in enumerate(levels[:-2])
        ]
        shared = spark.sparkContext.broadcast(Shard(number, shards, [*long, *short]))
        passes.append(_score(docs, shared, keys) if shards == 1 else stored(_score(docs, shared, keys), gather=True))
    if shards == 1:
        return passes[0]
    summed = reduce(DataFrame.unionByName, passes).groupBy(*keys).agg(
        F.sum("log_p").alias("log_p"), F.sum("n").alias("n"), (F.count(F.lit(1)) / shards).cast("int").alias("_times")
    )
    each = summed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return each.select(*keys, (F.col("log_p") / F.col("_times")).alias("log_p"), (F.col("n") / F.col("_times")).cast("long").alias("n"))


def _held(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT)) == 0


def _excess(ce: Column, middle: Column, n: Column) -> Column:
    """Distance from the median, less for short documents, as chance moves them further."""
    return (ce - middle) * F.sqrt(F.least(n, F.lit(STEADY)) / STEADY)


def classify(docs: DataFrame, labels: DataFrame, shard_ngrams: int = SHARD_NGRAMS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_characters, perplexity, quality, kept.

    Trusted are all documents that ``labels`` (doc_id, quality, toxic) call good (1) and nowhere bad or toxic. ``quality``
    is the distance of the log-perplexity from the median of the trusted documents of the language, in units of the
    bound on that side; 1 or less is kept. The bounds are the quantiles ``LOW`` of all and ``HIGH`` of held-out trusted
    documents, widened: text that is far too predictable repeats itself, text that is far too surprising is no prose. A language without trusted documents,
    null included, is judged by all trusted documents together; null, empty and blank texts have no perplexity and are
    not kept; without any trusted document nothing is. Repeated rows stay as many as they are; extra columns play no part.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("_good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("_toxic")
    )
    trusted_ids = stored(good.where("_good AND _toxic = 0").select("doc_id"))
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("_lang"))
    trusted = rows.where("text IS NOT NULL").where(~_held("doc_id"))
    trusted = trusted.join(trusted_ids.hint("merge"), "doc_id", "left_semi").select("_lang", "text")
    names = sorted(r[0] for r in rows.select("_lang").distinct().collect())
    if len(names) >= 1 << (63 - ORDER * BITS):
        raise ValueError("more languages than the codes have numbers for")
    number = F.element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, range(len(names))))), F.col("_lang")) if names else F.lit(None)
    rows = rows.withColumn("lang_number", number.cast("long")).withColumn("_h", F.xxhash64("text"))
    trusted = trusted.withColumn("lang_number", number.cast("long"))
    keys = ("doc_id", "_lang", "_h")
    found = stored(perplexities(rows, trusted, keys, shard_ngrams), gather=True).withColumn("ce", -F.try_divide("log_p", "n"))

    judged = found.where("n > 0").join(trusted_ids, "doc_id", "left_semi").select("_lang", "ce", "n", _held("doc_id").alias("_out"))
    both = judged.unionByName(judged.withColumn("_lang", F.lit(None).cast("string")))  # null stands for all together

    def quantile(value: str, level: float, held: bool) -> Column:
        every = F.percentile_approx(value, level, 10_000)
        return F.coalesce(F.percentile_approx(F.when(F.col("_out"), F.col(value)), level, 10_000), every) if held else every

    middle = stored(both.groupBy("_lang").agg(quantile("ce", 0.5, True).alias("middle")))
    scaled = both.join(middle, both["_lang"].eqNullSafe(middle["_lang"])).select(
        middle["_lang"], "middle", "_out", _excess(F.col("ce"), F.col("middle"), F.col("n")).alias("_x")
    )
    ends = scaled.groupBy("_lang", "middle").agg(
        quantile("_x", LOW, False).alias("_low"),
        F.greatest(quantile("_x", HIGH, True), quantile("_x", HIGH, False)).alias("_high"),
    )
    bounds = {r["_lang"]: (r["middle"], r["_low"], r["_high"]) for r in ends.collect()}
    none = (float("nan"), 0.0, 0.0)
    told = [bounds.get(name, bounds.get(None, none)) for name in names] or [none]
    of = lambda i: F.element_at(F.array(*(F.lit(float(t[i])) for t in told)), (F.col("_number") + 1).cast("int"))
    numbered = found.withColumn("_number", number if names else F.lit(0))
    excess = _excess(F.col("ce"), of(0), F.col("n"))
    side = F.when(excess < 0, of(1)).otherwise(of(2)) * (1 + WIDENED)
    quality = F.when((F.col("n") > 0) & ~F.isnan(of(0)), F.when(side == 0, F.when(excess == 0, 0.0).otherwise(float("inf"))).otherwise(excess / side))
    return numbered.select(
        "doc_id",
        F.when(F.col("_lang") != NO_LANGUAGE, F.col("_lang")).alias("lang"),
        F.col("n").alias("n_characters"),
        F.when(F.col("n") > 0, F.exp("ce")).alias("perplexity"),
        quality.alias("quality"),
        F.coalesce(quality <= 1, F.lit(False)).alias("kept"),
    )
