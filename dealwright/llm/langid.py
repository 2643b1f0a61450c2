"""Language identification by character models.

For every language an interpolated Kneser-Ney model of ``ORDER`` characters is learned. Spark counts the n-grams of all
orders and stores them in shards by the two characters before the last, which an n-gram shares with its context and its
shorter forms. Tasks read one shard after the other and keep it as sorted arrays of n-gram codes with a column of
log-probabilities per language, so that one binary search per character scores all languages. The language with the
lowest cross-entropy per character wins.

A character is a letter or the gap between words: text is lower-cased, everything that is no letter becomes one gap.
A letter has ``BITS`` bits of a code, so an n-gram is an integer whose context and shorter form are shifts and masks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import held, list_array, stored, stored_rows
from dealwright.session import fresh_path

ORDER, BITS = 4, 11
SYMBOLS = 1 << BITS
#: n-grams of a shard, about, over all languages: what a task holds at a time.
SHARD_NGRAMS = 4_000_000
#: Characters that are worked on at once.
SLICE = 1 << 20
#: Characters that a task holds while it reads one shard after the other, if there are several.
HELD = 1 << 24
#: Steps of the margin for which accuracy is measured.
MARGIN_STEPS = 128
#: A document is rejected if its cross-entropy lies so many standard errors beyond its language's bound.
REJECT_ERRORS = 3.0

_letters: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    if not _letters:
        points = np.arange(sys.maxunicode + 1)
        is_letter = np.fromiter((chr(p).isalpha() for p in points), bool, len(points))
        _letters.append(np.where(is_letter, points % (SYMBOLS - 1) + 1, 0).astype(np.int64))
    return _letters[0]


def codes_of(text: str) -> Iterator[np.ndarray]:
    """Codes of the n-grams that end at each character after the start and at the gap behind the last word.

    Comes in slices of bounded size; a text without letters has none.
    """
    table, last = _symbol_table(), np.zeros(ORDER - 1, np.int64)
    for at in range(0, len(text), SLICE):
        lowered = text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass")
        symbols = table[np.frombuffer(lowered, np.uint32)]
        gap = symbols == 0
        before = np.concatenate(([last[-1] == 0], gap[:-1]))
        symbols = symbols[~(gap & before)]
        if at + SLICE >= len(text) and (symbols[-1] if len(symbols) else last[-1]):
            symbols = np.append(symbols, 0)
        run = np.concatenate((last, symbols))
        if len(symbols):
            code = run[: len(symbols)].copy()
            for k in range(1, ORDER):
                code = (code << BITS) | run[k : k + len(symbols)]
            yield code
            last = run[-(ORDER - 1) :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a batch, counted slice by slice."""

    def told(lang, slices):
        codes, n = np.unique(np.concatenate(slices), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes)), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"]
        )

    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for code in codes_of(text.as_py()):
                held.setdefault(lang, []).append(code)
                size[lang] = size.get(lang, 0) + len(code)
                if size[lang] >= SLICE:
                    yield told(lang, held.pop(lang))
                    size[lang] = 0
        for lang, slices in held.items():
            yield told(lang, slices)


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows (lang, text); what a task has counted is combined before and after the shuffle."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = rows.mapInArrow(_counted, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def levels_of(counts: DataFrame) -> list[DataFrame]:
    """(lang, code, n) of each order, longest first: counts at the top, numbers of different left neighbours below."""
    levels = [stored(counts)]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("code")
        levels.append(stored(levels[-1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n"))))
    return levels


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


@dataclass
class Level:
    """One order of one language's model: sorted n-gram codes and their discounted shares, contexts and what is left."""

    codes: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, discount: float) -> Level:
        contexts, where = np.unique(codes >> BITS, return_inverse=True)
        total = np.bincount(where, counts, len(contexts))
        share = np.maximum(counts - discount, 0) / total[where]
        return cls(codes, share, contexts, np.bincount(where, np.minimum(counts, discount), len(contexts)) / total)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted ``keys`` by binary search, and whether each wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _levels(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Kneser-Ney levels, longest first: raw counts at the top, numbers of different left neighbours below."""
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append(Level.of(codes, counts, _discount(np.count_nonzero(counts == 1), np.count_nonzero(counts == 2))))
        if order > 1:
            codes, counts = np.unique(codes & ((1 << BITS * (order - 1)) - 1), return_counts=True)
    return levels


def _probability(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Interpolated probability of each code's last symbol after the others; unseen contexts leave it to shorter ones."""
    result, weight = np.zeros(len(codes)), np.ones(len(codes))
    for order, level in zip(range(len(levels), 0, -1), levels, strict=True):
        at, there = _find(level.codes, codes)
        if len(level.codes):
            result += np.where(there, weight * level.share[at], 0)
        at, there = _find(level.contexts, codes >> BITS)
        if len(level.contexts):
            weight = weight * np.where(there, level.rest[at], 1)
        codes = codes & ((1 << BITS * (order - 1)) - 1)
    return result + weight / SYMBOLS


@dataclass
class Shard:
    """The part of all languages' models that answers for the codes of one shard."""

    levels: list[list[Level]]
    codes: np.ndarray = field(init=False)
    log_p: np.ndarray = field(init=False)

    def __post_init__(self):
        self.codes = np.unique(np.concatenate([levels[0].codes for levels in self.levels]))
        self.log_p = self._log_p(self.codes).astype(np.float32)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each code in each language."""
        if not len(self.codes):
            return self._log_p(codes)
        at, there = _find(self.codes, codes)
        scores = self.log_p[at].astype(np.float64)
        missing = ~there
        if missing.any():
            scores[missing] = self._log_p(codes[missing])
        return scores

    def _log_p(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([np.log(_probability(levels, codes)) for levels in self.levels], axis=1)


@dataclass(frozen=True)
class CharacterModels:
    """Where the models of all languages are stored; ``discounts`` has those of each language, by order."""

    langs: tuple[str, ...]
    path: str
    shards: int
    discounts: tuple[tuple[float, ...], ...]


def shard_of(code, shards: int):
    """The shard of an n-gram of three characters or more: by the two characters before the last."""
    pair = (1 << 2 * BITS) - 1
    if isinstance(code, Column):
        return F.shiftright(F.shiftright(code, BITS).bitwiseAND(F.lit(pair)) * F.lit(40503), 8) % shards
    return ((((code >> BITS) & pair) * 40503) >> 8) % shards


_NGRAMS = pa.schema([("lang", pa.string()), ("level", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])


def _shard(models: CharacterModels, number: int) -> Shard:
    return held((models, number), lambda: _shard_read(models, number))


def _shard_read(models: CharacterModels, number: int) -> Shard:
    rows = pa.concat_tables([stored_rows(f"{models.path}/{part}", _NGRAMS).to_table() for part in (f"long/shard={number}", "short")])
    place = {lang: i for i, lang in enumerate(models.langs)}
    names = rows["lang"].combine_chunks().dictionary_encode()
    owner = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    kind = owner * ORDER + rows["level"].to_numpy()
    codes, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((codes, kind))
    ends = np.searchsorted(kind[order], np.arange(len(place) * ORDER + 1))
    parts = [order[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    return Shard([
        [Level.of(codes[part], n[part].astype(np.float64), d) for part, d in zip(parts[i * ORDER : (i + 1) * ORDER], found, strict=True)]
        for i, found in enumerate(models.discounts)
    ])


def learn(labelled: DataFrame, shard_ngrams: int = SHARD_NGRAMS) -> CharacterModels:
    """Models from rows (lang, text); rows with a null in either teach nothing.

    All n-grams stay. Those of three and four characters lie in shards; the shorter ones, which the alphabet bounds, go
    with every shard.
    """
    levels = [level.withColumn("level", F.lit(i)) for i, level in enumerate(levels_of(ngram_counts(labelled)))]
    times = {}
    rare = reduce(DataFrame.unionByName, levels).groupBy("lang", "level")
    for r in rare.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(c) for k, c in ((1, "ones"), (2, "twos"))), F.count(F.lit(1)).alias("size")).collect():
        times[r["lang"], r["level"]] = r
    langs = tuple(sorted({lang for lang, _ in times}))
    size = sum(r["size"] for (_, level), r in times.items() if level == 0) * max(1, len(langs) / 8)
    shards, path = max(1, int(-(-size // shard_ngrams))), fresh_path(labelled.sparkSession, "langid")
    if langs:
        columns = ["lang", "level", "code", "n"]
        long = levels[0].unionByName(levels[1]).select(*columns, shard_of(F.col("code"), shards).alias("shard"))
        long.write.partitionBy("shard").parquet(f"{path}/long")
        levels[2].unionByName(levels[3]).select(*columns).write.parquet(f"{path}/short")
    discounts = tuple(tuple(_discount(times[x, i]["ones"], times[x, i]["twos"]) for i in range(ORDER)) for x in langs)
    return CharacterModels(langs, path, shards, discounts)


def score(docs: DataFrame, models: CharacterModels, keys: list[str]) -> DataFrame:
    """``keys``, ``n`` (characters scored, 0 without letters) and ``ce``: mean cross-entropy in each language."""
    limit = SLICE if models.shards == 1 else HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, int, np.ndarray]] = []
        size = 0

        def told():
            for kept, n, sums in waiting:
                ce = -sums / np.maximum(n, 1)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(n), list_array(list(ce), pa.float64())], [*kept.schema.names, "n", "ce"]
                )
            waiting.clear()

        for batch in batches:
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(models.langs)))
            waiting.append((batch.drop_columns(["_text"]), n, sums))
            for i, text in enumerate(batch.column("_text")):
                for code in codes_of(text.as_py() or ""):
                    n[i] += len(code)
                    held.append((code, i, sums))
                    size += len(code)
                    if size >= limit:
                        _add(models, held)
                        held, size = [], 0
            if models.shards == 1 or not held:
                _add(models, held)
                held, size = [], 0
                yield from told()
        _add(models, held)
        yield from told()

    narrow = docs.select(*keys, F.col("text").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "_text")
    return narrow.mapInArrow(run, f"{kept}, n long, ce array<double>")


def _add(models: CharacterModels, held: list[tuple[np.ndarray, int, np.ndarray]]) -> None:
    """Adds the log-probabilities of each part of a text to the row of the sums that it belongs to."""
    if not held or not models.langs:
        return
    codes, owner = np.concatenate([c for c, _, _ in held]), np.repeat(np.arange(len(held)), [len(c) for c, _, _ in held])
    total = np.zeros((len(held), len(models.langs)))
    for number in range(models.shards):
        model = _shard(models, number)
        for at in range(0, len(codes), SLICE):
            part, row = codes[at : at + SLICE], owner[at : at + SLICE]
            if models.shards > 1:
                mine = shard_of(part, models.shards) == number
                part, row = part[mine], row[mine]
            if len(part):
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[row[starts]] += np.add.reduceat(model.score(part), starts, axis=0)
    for (_, i, sums), value in zip(held, total, strict=True):
        sums[i] += value


def _isotonic(n: list[float], right: list[float]) -> list[float]:
    """Accuracy by step, made rising by pooling neighbours."""
    pools: list[list[float]] = []
    for total, good in zip(n, right, strict=True):
        pools.append([total, good, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
            total, good, width = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + good, pools[-1][2] + width]
    return [good / total for total, good, width in pools for _ in range(int(width))]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; a null id counts as the text '' does (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): ``keys``, held_out, lang_pred, score, rejected, n_scored.

    ``lang_pred`` is a learned language, ``und`` for a null text, one without letters, or if nothing could be learned.
    ``score`` is the share of correct predictions among learning documents with as clear a lead over the second
    language (0 for ``und``). ``rejected`` marks ``und`` and documents whose cross-entropy lies beyond the bound of
    their language: midway between that of its own and of other documents, and ``REJECT_ERRORS`` standard errors
    more. Ties go to the first language by name. Repeated rows and null ids are rows like any other; extra columns
    play no part. lang is read for learning only.
    """
    taught = ~held_out(F.col("doc_id"))
    models = learn(docs.where(taught).select("lang", "text"))
    langs = models.langs
    rows = docs.select(*keys, "text", F.when(taught, F.col("lang")).alias("_lang"), (~taught).alias("held_out"))
    scored = score(rows, models, [*keys, "_lang", "held_out"])
    if not langs:
        return scored.select(
            *keys, "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"), F.col("n").alias("n_scored"),
        )
    scored = stored(scored, gather=True)
    names = F.array(*map(F.lit, langs))
    best = F.array_min("ce")
    place = F.array_position("ce", best).cast("int")
    second = F.coalesce(F.element_at(F.array_sort("ce"), 2) if len(langs) > 1 else F.lit(None), best + 8)
    lead = F.least(F.lit(MARGIN_STEPS - 1), F.floor((second - best) * F.sqrt("n") * 2)).cast("int")
    told = scored.select("*", best.alias("_best"), F.element_at(names, place).alias("_pred"), lead.alias("_lead"))

    learned = told.where("_lang IS NOT NULL AND n > 0")
    steps = {
        r[0]: r[1:]
        for r in learned.groupBy("_lead").agg(F.count(F.lit(1)), F.count(F.when(F.expr("_pred = _lang"), 1))).collect()
    }
    prior = 1 / len(langs)
    n, right = zip(*(steps.get(i, (0, 0)) for i in range(MARGIN_STEPS)), strict=True)
    accuracy = _isotonic([x + 0.5 for x in n], [x + 0.5 * max(prior, 0.5) for x in right])
    level = F.element_at(F.array(*map(F.lit, accuracy)), F.col("_lead") + 1)

    by_lang = learned.select("_lang", "n", F.posexplode(F.arrays_zip(names.alias("l"), F.col("ce").alias("c")))).select(
        F.col("col.l").alias("l"), (F.col("_lang") == F.col("col.l")).alias("own"), F.col("col.c").alias("c"), "n"
    )
    total = by_lang.groupBy("l").agg(
        (F.sum(F.when(F.col("own"), F.col("c") * F.col("n"))) / F.sum(F.when(F.col("own"), F.col("n")))).alias("own"),
        F.avg(F.when(~F.col("own"), F.col("c"))).alias("other"),
        F.sqrt(F.avg(F.when(F.col("own"), F.col("c") * F.col("c") * F.col("n")))).alias("spread"),
    )
    bounds = {r["l"]: r for r in total.collect()}
    limit, error = [], []
    for lang in langs:
        own = bounds[lang]["own"]
        other = bounds[lang]["other"]
        limit.append((own + (other if other is not None else 2 * own)) / 2)
        error.append(own)  # the spread of a character's cost is about its mean
    bound = F.element_at(F.array(*map(F.lit, limit)), place) + REJECT_ERRORS * F.element_at(
        F.array(*map(F.lit, error)), place
    ) / F.sqrt("n")
    some = F.col("n") > 0
    return told.select(
        *keys,
        "held_out",
        F.when(some, F.col("_pred")).otherwise("und").alias("lang_pred"),
        F.when(some, level).otherwise(0.0).alias("score"),
        F.when(some, F.col("_best") > bound).otherwise(True).alias("rejected"),
        F.col("n").alias("n_scored"),
    )
