"""Language-model scoring by prediction by partial matching.

A text is the sequence of its words, one space between them and an end behind the last. Its bytes are predicted from the
``ORDER`` bytes before them by a trie of byte contexts that is learned from training documents: a symbol that the longest
known context has not seen costs an escape (method D: half of each different symbol's first count goes to it) and is
looked for in the next shorter context, where the symbols of the longer one are excluded. Counts of shorter contexts are
those of the different longer ones (update exclusion). What escapes every context is one of the symbols never seen.

The trie is a table per order, made by Spark from counts of all training documents. What a context's symbols exclude one
order below depends on the context alone, so its escapes are columns. The most frequent contexts with their symbol, a
bounded number, go to every task and answer for nearly all positions; all others are told apart as rows and meet the
tables by joins, order by order. Nothing is left out, and no task reads the whole model. Words are met the same way. What
goes to every task is stored, and tasks read it from there: it passes neither the driver nor a broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealwright.llm.common import HOT, held, met, release, stored, stored_rows
from dealwright.session import fresh_path

#: Bytes of a context. With its symbol it is 56 bits of a code, which leaves 8 for the piece it is in.
ORDER = 6
PIECE_BITS = 8
#: Part of a symbol's first count that goes to the escape.
ESCAPED = 0.5
#: The end of a text, and what is before its first byte: a byte that UTF-8 never has.
END = 0xFF
#: Bytes that UTF-8 can have, and the end.
SYMBOLS = 244
#: Contexts with their symbol, and words, that go to every task.
RESIDENT, RESIDENT_WORDS = 3_000_000, 300_000
#: Bytes that are worked on at once, and different codes and words that a task counts before it tells them.
SLICE, COUNTED, COUNTED_WORDS = 1 << 20, 4_000_000, 500_000
#: Rows that a task tells at once: an executor holds what it is told outside its heap.
TOLD = 1 << 17
#: What every token's count is raised by in the base score.
RAISED = 0.1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: what is between spaces and the control characters 9 to 13."""
    return (text or b"").translate(_LOWER).split()


def _pieces(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each code) of some texts at a time; long ones come in parts that see the bytes before them."""
    before, held, owner, size = bytes([END]) * ORDER, [], [], 0

    def told():
        run = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
        codes = np.zeros(len(run) - ORDER, np.uint64)
        for k in range(ORDER + 1):
            codes = (codes << np.uint64(8)) | run[k : len(run) - ORDER + k]
        lengths = np.array([len(h) - ORDER for h in held])
        starts = np.cumsum([0, *(lengths[:-1] + ORDER)])
        at = np.repeat(starts - np.cumsum([0, *lengths[:-1]]), lengths) + np.arange(lengths.sum())
        return codes[at], np.repeat(np.array(owner), lengths)

    for i, text in enumerate(texts):
        run = before + text
        for at in range(0, len(text), SLICE):
            held.append(run[at : at + SLICE + ORDER])
            owner.append(i)
            size += len(held[-1])
            if size >= SLICE or len(held) >= 1 << PIECE_BITS:
                yield told()
                held, owner, size = [], [], 0
    if held:
        yield told()


def _grouped(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, owner, n) in the order of the codes: one sort of both in one number."""
    first = owner[0]  # owners rise, and there are at most as many as PIECE_BITS can tell apart
    keys = np.sort((codes << np.uint64(PIECE_BITS)) | (owner - first).astype(np.uint64))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, n = keys[starts], np.diff(np.append(starts, len(keys)))
    return (keys >> np.uint64(PIECE_BITS)).astype(np.int64), (keys & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64) + first, n


def _sequence(words: list[bytes]) -> bytes:
    return b" ".join(words) + bytes([END])


class _Counts:
    """Codes and how often they came, merged as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > COUNTED and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        codes, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []  # let go before the sort takes as much again
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        n = n[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        self.parts = [(codes[starts], np.add.reduceat(n, starts))]
        self.size = len(starts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.merge()
        found = self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return found


def _batch(columns: dict[str, pa.Array | None], schema: pa.Schema) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


_COUNTS = pa.schema([("code", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, word, n) of a task's texts, either code or word being null."""
    release()
    codes, words = _Counts(), Counter()

    def told_codes():
        found, n = codes.take()
        for at in range(0, len(found), TOLD):
            part = slice(at, at + TOLD)
            yield _batch({"code": pa.array(found[part].astype(np.int64)), "n": pa.array(n[part], pa.int64())}, _COUNTS)

    def told_words():
        made = pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())
        words.clear()
        for at in range(0, len(made[0]), TOLD):
            yield _batch({"word": made[0].slice(at, TOLD), "n": made[1].slice(at, TOLD)}, _COUNTS)

    def split(texts):
        for text in texts:
            own = words_of(text)
            words.update(own)
            yield _sequence(own)

    for batch in batches:
        for found, _ in _pieces(split(batch.column(0).cast(pa.binary()).to_pylist())):
            codes.add(found)
            if codes.size > COUNTED:
                yield from told_codes()
        if len(words) > COUNTED_WORDS:
            yield from told_words()
    yield from told_codes()
    yield from told_words()


def counts(training: DataFrame) -> DataFrame:
    """Stored (code, word, n) over all rows (text): how often each context comes with a symbol, and each word.

    A task tells a code about once, so rows are dealt out before they are added up: adding them up first would shorten nothing.
    """
    found = training.select("text").mapInArrow(_count, "code long, word binary, n long").repartition("code", "word")
    return stored(found.groupBy("code", "word").agg(F.sum("n").alias("n")))


def _low(code: Column, size: int) -> Column:
    """The last ``size`` bytes of a code."""
    return code.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _log_ratio(part: Column, whole: Column) -> Column:
    return F.log10(part) - F.log10(whole)


class Trie:
    """Tables of an order each: ``symbols`` (code, n) and ``contexts`` (context, sees, escape, below, escape_below).

    ``sees`` is log10 of what a context's symbols share and ``escape`` that of its escape, if it is the longest known;
    ``below`` and ``escape_below`` are those of the context shorter by one byte after an escape from this one, without
    its symbols.
    """

    def __init__(self, top: DataFrame):
        self.symbols = {ORDER: top}
        for k in range(ORDER - 1, -1, -1):
            shorter = self.symbols[k + 1].groupBy(_low(F.col("code"), k + 1).alias("code"))
            self.symbols[k] = stored(shorter.agg(F.count(F.lit(1)).alias("n")))
        self.contexts: dict[int, DataFrame] = {}
        for k in range(ORDER + 1):
            rows = self.symbols[k]
            if k:  # a shorter context has counted a symbol as often as there are longer ones with it
                rows = rows.withColumn("low", F.count(F.lit(1)).over(Window.partitionBy(_low(F.col("code"), k))))
            else:
                rows = rows.withColumn("low", F.lit(0).cast("long"))
            own = rows.groupBy(F.shiftright("code", 8).alias("context")).agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("low").alias("excluded")
            )
            if k:
                shorter = self.contexts[k - 1].select(
                    F.col("context").alias("low"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds")
                )
                own = own.join(shorter, _low(F.col("context"), k - 1) == F.col("low")).drop("low")
                left = F.col("low_total") - F.col("excluded")
                new = F.col("low_kinds") - F.col("kinds")
                below, escape = F.log10(left), F.when(new > 0, _log_ratio(new * ESCAPED, left)).otherwise(0.0)
            else:
                below, escape = F.lit(None).cast("double"), F.lit(None).cast("double")
            self.contexts[k] = stored(
                own.select(
                    "context", "total", "kinds", F.log10("total").alias("sees"),
                    _log_ratio(F.col("kinds") * ESCAPED, F.col("total")).alias("escape"),
                    below.alias("below"), escape.alias("escape_below"),
                )
            )
        self.unseen = SYMBOLS - self.symbols[0].count()

    def resident(self) -> DataFrame:
        """The most frequent codes, at most ``RESIDENT``, and ``p``: log10 of their symbol's probability."""
        often = self.symbols[ORDER].where(most_frequent(self.symbols[ORDER], RESIDENT))
        known = self.contexts[ORDER].select("context", "sees")
        rows = often.join(known, F.shiftright("code", 8) == F.col("context"))
        return rows.select("code", (F.log10(F.col("n") - ESCAPED) - F.col("sees")).alias("p"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (code, times) with ``p``: log10 of the probability of each code's symbol after its context."""
        nothing = F.lit(None).cast("double")
        rows = rows.select(
            "code", "times", F.lit(0.0).alias("p"), F.lit(False).alias("done"), nothing.alias("from"), nothing.alias("on")
        )
        for k in range(ORDER, -1, -1):
            seen = self.symbols[k].select(F.col("code").alias("seen"), F.log10(F.col("n") - ESCAPED).alias("gain"))
            context = self.contexts[k].select("context", "sees", "escape", "below", "escape_below")
            both = rows.join(seen, _low(F.col("code"), k + 1) == F.col("seen"), "left").join(
                context, _low(F.shiftright("code", 8), k) == F.col("context"), "left"
            )
            step = (
                F.when(F.col("done"), 0.0)
                .when(F.col("seen").isNotNull(), F.col("gain") - F.coalesce("from", "sees"))
                .otherwise(F.coalesce("on", "escape", F.lit(0.0)))
            )
            rows = both.select(
                "code", "times", (F.col("p") + step).alias("p"), (F.col("done") | F.col("seen").isNotNull()).alias("done"),
                F.col("below").alias("from"), F.col("escape_below").alias("on"),
            )
        rest = F.lit(float(np.log10(max(1, self.unseen))))
        return rows.select("code", "times", F.when(F.col("done"), F.col("p")).otherwise(F.col("p") - rest).alias("p"))


def most_frequent(counted: DataFrame, limit: int) -> Column:
    """Whether ``n`` is among the highest of ``counted``, so that at most ``limit`` rows are: by eighths of its logarithm."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["step"]: r["count"] for r in counted.groupBy(step.alias("step")).count().collect()}
    cut, room = max(sizes, default=0) + 1, limit
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        cut = at
    return step >= cut


_TOLD = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
    ("score", pa.float64()), ("code", pa.int64()), ("word", pa.binary()), ("n", pa.int64()),
])


_RESIDENT = pa.schema([("code", pa.int64()), ("p", pa.float64())])
_RESIDENT_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _resident(path: str, whole: float) -> tuple[np.ndarray, np.ndarray, dict[bytes, float]]:
    """Codes in order, log10 of their symbol's probability, and that of each word, as they are stored under ``path``."""
    rows = stored_rows(f"{path}/codes", _RESIDENT)
    codes, p, at = np.empty(size := rows.count_rows(), np.int64), np.empty(size, np.float64), 0
    for batch in rows.to_batches(batch_readahead=1, fragment_readahead=1, use_threads=False):
        codes[at : at + len(batch)], p[at : at + len(batch)] = batch["code"].to_numpy(), batch["p"].to_numpy()
        at += len(batch)
    order = np.argsort(codes)
    codes = codes[order]
    p = p[order]
    words = stored_rows(f"{path}/words", _RESIDENT_WORDS).to_table().sort_by([("n", "descending")])  # frequent ones lie together
    log_p = np.log10((words["n"].to_numpy() + RAISED) / whole).tolist()
    known_words = dict(zip(words["word"].to_pylist(), log_p, strict=True))
    del rows, words, order, log_p
    pa.default_memory_pool().release_unused()
    return codes, p, known_words


def _told(docs: DataFrame, resident: str, whole: float, end: float) -> DataFrame:
    """Stored rows of three kinds: documents, and the codes and words of each that those under ``resident`` don't answer for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, p, known_words = held(resident, lambda: _resident(resident, whole))
        for batch in batches:
            rows = batch.column("row").to_numpy()
            tokens, known, base = (np.zeros(len(rows), t) for t in (np.int64, np.int64, np.float64))
            score = np.zeros(len(rows))
            absent = []

            def split(texts, tokens=tokens, known=known, base=base, absent=absent):
                for i, text in enumerate(texts):
                    own = words_of(text)
                    tokens[i] = len(own) + 1
                    found = [x for x in map(known_words.get, own) if x is not None]
                    known[i] = len(found)
                    base[i] = sum(found) + end
                    if len(found) < len(own):
                        absent.append((i, Counter(w for w in own if w not in known_words)))
                    yield _sequence(own)

            for found, owner in _pieces(split(batch.column("text").cast(pa.binary()).to_pylist())):
                code, of, n = _grouped(found, owner)
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                at = np.minimum(np.searchsorted(codes, code[first]), max(0, len(codes) - 1))
                known_code = codes[at] == code[first] if len(codes) else np.zeros(len(first), bool)
                times = np.diff(np.append(first, len(code)))
                there = np.repeat(known_code, times)
                gain = np.repeat(p[at[known_code]], times[known_code])
                score += np.bincount(of[there], n[there] * gain, len(rows))
                gone = ~there
                if gone.any():
                    yield _batch({"row": pa.array(rows[of[gone]]), "code": pa.array(code[gone]), "n": pa.array(n[gone])}, _TOLD)
            for start in range(0, len(absent), 1_000):
                some = absent[start : start + 1_000]
                yield _batch(
                    {
                        "row": pa.array(np.repeat(rows[[i for i, _ in some]], [len(c) for _, c in some])),
                        "word": pa.array([w for _, c in some for w in c], pa.binary()),
                        "n": pa.array([n for _, c in some for n in c.values()], pa.int64()),
                    },
                    _TOLD,
                )
            yield _batch(
                {
                    "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(tokens),
                    "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score),
                },
                _TOLD,
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "row long, doc_id long, n_tokens long, n_known long, base double, score double, code long, word binary, n long"
    )
    return stored(rows.mapInArrow(run, schema))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; a null id counts as the text '' does (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents that are not held out. ``base_score`` is log10 of the text by single tokens, words and
    one end, with counts raised by ``RAISED``; ``score`` is that of its bytes by the trie. A null, empty or blank text
    has one token, its end. Repeated rows are documents of their own. Without training documents nothing is known: each
    byte is one of all symbols. An empty table gives no rows. Other columns play no part, so their names cannot clash.
    """
    out = held_out(F.col("doc_id"))
    training = docs.where(~out)
    found = counts(training)
    word_counts = found.where("word IS NOT NULL").select("word", "n")
    sums = word_counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    n_docs = training.count()
    all_tokens, kinds = (sums["n"] or 0) + n_docs, sums["kinds"] + (1 if n_docs else 0)
    whole = all_tokens + RAISED * (kinds + 1)

    trie = Trie(found.where("code IS NOT NULL").select("code", "n"))
    resident = fresh_path(docs.sparkSession, "ppm")
    trie.resident().write.parquet(f"{resident}/codes")
    word_counts.where(most_frequent(word_counts, RESIDENT_WORDS)).write.parquet(f"{resident}/words")
    told = _told(docs, resident, whole, float(np.log10((n_docs + RAISED) / whole)))

    codes = told.where("code IS NOT NULL").select("row", "code", "n")
    kinds_of = trie.scored(codes.groupBy("code").agg(F.count(F.lit(1)).alias("times")))
    by_code = met(codes, stored(kinds_of), ["code"], F.col("times") * HOT > codes.count())
    rest = told.where("word IS NOT NULL").select("row", "word", "n")
    asked = rest.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    answers = asked.join(word_counts.withColumnRenamed("n", "c"), "word", "left").fillna(0, ["c"])
    by_word = met(rest, stored(answers), ["word"], F.col("times") * HOT > rest.count())
    zero = F.lit(0).cast("long")
    parts = [
        by_code.select("row", zero.alias("known"), F.lit(0.0).alias("more"), (F.col("n") * F.col("p")).alias("added")),
        by_word.select(
            "row", F.when(F.col("c") > 0, F.col("n")).otherwise(zero).alias("known"),
            (F.col("n") * F.log10((F.col("c") + RAISED) / whole)).alias("more"), F.lit(0.0).alias("added"),
        ),
    ]
    more = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "more", "added")))
    documents = told.where("n_tokens IS NOT NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    both = documents.join(more, "row", "left")
    end_known = 1 if n_docs else 0
    return both.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero) + end_known).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )
