"""Fuzzy matching of typed text to fixed options and to the catalog of segments."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.functions.scoring import best_option, edit_similarity, weighted_ratio
from dealwright.session import materialise

CHUNK = 5000
#: Texts and names of a tile at most when all are compared by matching blocks, places that characters are dealt to, and
#: names that are looked at before the bounds of the others are seen again.
ASKED, NAMES, LETTERS, AT_ONCE = 4096, 16_384, 128, 64
#: Similarities at which the closest name is looked for by its pairs of characters, one after the other.
LEVELS = (0.9, 0.8, 0.65)
FALLBACK_SEGMENT = ("General", "Model")


def fuzzy_match(df: DataFrame, column: str, options: Sequence[str], threshold: float = 80) -> DataFrame:
    """Add the closest option, its score of 100 and a note; no option below the threshold."""
    best = best_option(F.col(column), options)
    out = df.withColumn("_best", best)
    accepted = F.col("_best.score") >= threshold
    return out.withColumns(
        {
            "match_score": F.col("_best.score"),
            "matched": F.when(accepted, F.col("_best.option")),
            "match_note": F.when(~accepted, "not recognised").when(F.col("_best.score") < 100, "corrected"),
        }
    ).drop("_best")


def fuzzy_match_weighted(df: DataFrame, column: str, options: Sequence[str], threshold: float = 80) -> DataFrame:
    """As ``fuzzy_match``, by the weighted ratio: words may be swapped, added or cut.

    Each distinct text is compared once. The first option wins a tie; a null or blank text matches nothing.
    """
    texts = df.select(column).distinct()
    # one row per option: a literal in every place would repeat the whole expression per option
    known = F.array(*(F.struct(F.lit(-i).alias("preference"), F.lit(str(o)).alias("option")) for i, o in enumerate(options)))
    scored = texts.select(column, F.explode(known).alias("_o")).select(
        column, F.struct(weighted_ratio(F.col(column), F.col("_o.option")).alias("score"), "_o.preference", "_o.option").alias("_s")
    )
    best = materialise(scored.groupBy(column).agg(F.max("_s").alias("_best")))
    out = df.join(best.withColumnRenamed(column, "_text"), F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")
    score = F.coalesce(F.col("_best.score"), F.lit(0))
    accepted = score >= threshold
    return out.withColumns(
        {
            "match_score": score,
            "matched": F.when(accepted, F.col("_best.option")),
            "match_note": F.when(~accepted, "not recognised").when(score < 100, "corrected"),
        }
    ).drop("_best")


def in_chunks(df: DataFrame, columns: Sequence[str], chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """The rows of a candidate table as arrays of about ``chunk`` structs: (chunk, options), and how many."""
    n = max(1, -(-df.count() // chunk))
    number = F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    grouped = df.select(number.alias("chunk"), F.struct(*columns).alias("_row"))
    return grouped.groupBy("chunk").agg(F.collect_list("_row").alias("options")), n


def best_in_chunks(
    df: DataFrame, id_column: str, candidates: DataFrame, columns: Sequence[str], score, chunk: int = CHUNK
) -> DataFrame:
    """(id, best): the best-scoring candidate of every row, over all of a few candidates.

    Each row meets every chunk of candidates by an equi-join on the chunk number and keeps only the best of it, so
    no pair of row and candidate is ever a row. ``score(options)`` gives a struct that orders by quality first. Made
    for the handful of classes of a classifier; a catalog is searched by ``fuzzy_segment``.
    """
    options, n = in_chunks(candidates, columns, chunk)
    rows = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = rows.join(materialise(options), "chunk").select(id_column, score(F.col("options")).alias("_best"))
    return pairs.groupBy(id_column).agg(F.max("_best").alias("best"))


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has: a few bytes of text can be much work, which their size does not tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _edit_score(query: str):
    def score(options: Column) -> Column:
        return F.array_max(
            F.transform(
                options,
                lambda o: F.struct(
                    edit_similarity(o["text"], F.col(query)).alias("score"), o["text"], o["make"], o["model"]
                ),
            )
        )

    return score


def _letters(texts: Sequence[str]) -> np.ndarray:
    """How often each text holds each character, characters dealt to ``LETTERS`` places."""
    counts = np.zeros((len(texts), LETTERS), np.int32)
    for i, text in enumerate(texts):
        for letter, n in Counter(text).items():
            counts[i, ord(letter) % LETTERS] += n
    return counts


def _places(text: str) -> dict[str, int]:
    """A bit for each place of each character."""
    places: dict[str, int] = {}
    for i, letter in enumerate(text):
        places[letter] = places.get(letter, 0) | 1 << i
    return places


def _common(places: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text of that size and another one; its rows are bits of a number."""
    whole = (1 << size) - 1
    rows = whole
    for letter in text:
        met = rows & places.get(letter, 0)
        rows = ((rows + met) | (rows - met)) & whole
    return size - rows.bit_count()


def _closest_of_tile(cutoff: float):
    """Best name of a tile for each of its texts by matching-blocks ratio; the last text in order on ties.

    Matching blocks are a common subsequence, and that has no more characters than the texts share in any order: two bounds
    of the ratio. Names are compared from the highest bound on, until none can reach the best or the cutoff.
    """

    def closest(key: tuple, queries: pa.Table, options: pa.Table) -> pa.Table:
        asked, names = queries["query"].to_pylist(), options.select(["text", "make", "model"]).to_pylist()
        if not asked or not names:
            return _CLOSEST.empty_table()
        texts = [n["text"] for n in names]
        held, lengths = _letters(texts), np.array([len(t) for t in texts])
        told = []
        matcher = difflib.SequenceMatcher()
        for text, own in zip(asked, _letters(asked)):
            some = np.flatnonzero(own)
            shared = np.minimum(held[:, some], own[some]).sum(axis=1)
            # as the matcher has it: 1 for two empty texts
            both = lengths + len(text)
            bound = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)
            order = np.argsort(-bound, kind="stable")
            places, best, chosen = _places(text), (cutoff,), None
            matcher.set_seq2(text)
            for at in range(0, len(order), AT_ONCE):
                some = order[at : at + AT_ONCE]
                some = some[bound[some] >= best[0]]
                if not len(some):
                    break
                common = np.array([_common(places, len(text), texts[i]) for i in some])
                closer = np.where(both[some] > 0, 2.0 * common / np.maximum(both[some], 1), 1.0)
                for j in np.argsort(-closer, kind="stable"):
                    if closer[j] < best[0]:
                        break
                    name = names[some[j]]
                    matcher.set_seq1(name["text"])
                    # a null is before any other, as in Spark
                    found = (matcher.ratio(), name["text"], *((v is not None, v or "") for v in (name["make"], name["model"])))
                    if found > best:
                        best, chosen = found, name
            if chosen:
                told.append((text, {"score": best[0], **chosen}))
        return pa.table({"query": [q for q, _ in told], "best": [b for _, b in told]}, schema=_CLOSEST)

    return closest


_CLOSEST = pa.schema([
    ("query", pa.string()),
    ("best", pa.struct([("score", pa.float64()), ("text", pa.string()), ("make", pa.string()), ("model", pa.string())])),
])


def best_by_sequence(queries: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """(query, best) of the texts with a name at the cutoff or more, over all names, by matching-blocks ratio.

    Texts and names meet as tiles: a name travels once for each block of texts, a text once for each block of names, and a
    task holds one tile.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = queries.count()
    rows = max(1, -(-size // max(-(-size // ASKED), 4 * tasks)))
    texts, names = max(1, -(-size // rows)), max(1, -(-known.count() // NAMES))
    block = F.pmod(F.xxhash64("query"), F.lit(texts)).cast("int").alias("block")
    asked = queries.where("query IS NOT NULL").select("query", block, F.explode(F.sequence(F.lit(0), F.lit(names - 1))).alias("part"))
    part = F.pmod(F.xxhash64("text", "make", "model"), F.lit(names)).cast("int").alias("part")
    told = known.select("text", "make", "model", part, F.explode(F.sequence(F.lit(0), F.lit(texts - 1))).alias("block"))
    asked, told = (_spread(df, "block", "part").groupBy("block", "part") for df in (asked, told))
    met = asked.cogroup(told).applyInArrow(
        _closest_of_tile(cutoff), "query string, best struct<score:double,text:string,make:string,model:string>"
    )
    return met.groupBy("query").agg(F.max("best").alias("best"))


def _within_lengths(queries: DataFrame, known: DataFrame, cutoff: float, score) -> DataFrame:
    """(query, best) over the candidates whose length alone does not keep them below the cutoff.

    A distance is at least the difference of the lengths, so a text meets only names between cutoff and 1 / cutoff times
    its own length: an equi-join on the length, with names of one length in arrays of about ``CHUNK``.
    """
    sized = known.withColumn("length", F.length("text"))
    counts = materialise(sized.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts")))
    part = F.pmod(F.xxhash64("text", "make", "model"), F.col("parts"))
    options = sized.join(counts, "length").withColumn("part", part).groupBy("length", "part").agg(
        F.collect_list(F.struct("make", "model", "text")).alias("options")
    )
    shortest = F.ceil(F.length("query") * cutoff).cast("int")
    longest = F.floor(F.length("query") / cutoff).cast("int")
    wanted = queries.withColumn("length", F.explode(F.sequence(shortest, longest)))
    met = _spread(wanted, "query", "length").join(materialise(options), "length").select("query", score(F.col("options")).alias("_best"))
    return met.groupBy("query").agg(F.max("_best").alias("best"))


def _grams(text: Column) -> Column:
    """The different pairs of neighbouring characters of a text; none below two characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: text.substr(i, F.lit(2)))
    return F.when(F.length(text) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def gram_index(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n): names that hold each gram; (gram, part, options): the names, in arrays of about ``CHUNK``."""
    grams = known.select(F.explode(_grams(F.col("text"))).alias("gram"), "text", "make", "model")
    counts = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("text", "make", "model"), F.ceil(F.col("n") / CHUNK))
    options = grams.join(counts, "gram").groupBy("gram", part.alias("part")).agg(
        F.collect_list(F.struct("make", "model", "text")).alias("options")
    )
    return counts, materialise(options)


def gram_probes(queries: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(query, gram, n): the grams of which a name with a similarity of ``least`` must hold at least one, rarest first.

    A distance of d changes 2 d pairs of a text's characters at most, and of a text of length l no more than
    2 (1 - least) l for any name in reach, whatever its length. So one more of its different pairs than that cannot all be
    missing in the name. Texts with fewer different pairs have no row: this level says nothing about them.
    """
    lost = F.floor(2 * (1 - least) * F.length("query") + 1e-9).cast("int")
    grams = queries.select("query", F.explode(_grams(F.col("query"))).alias("gram"))
    held = grams.join(counts, "gram", "left").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams")
    )
    first = held.where(F.size("grams") > lost).select("query", F.explode(F.slice("grams", F.lit(1), lost + 1)).alias("g"))
    return first.where(F.col("g.n") > 0).select("query", "g.gram", "g.n")


def _by_grams(queries: DataFrame, index: tuple[DataFrame, DataFrame], least: float) -> DataFrame:
    """(query, best) of the texts with a name at ``least`` or more: exact for these, no row for the others."""
    counts, options = index
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK) - 1)
    probes = gram_probes(queries, counts, least).select("query", "gram", F.explode(parts).alias("part"))
    size = F.length("query")
    in_reach = F.filter(
        "options", lambda o: (F.length(o["text"]) >= size * least - 1e-9) & (F.length(o["text"]) * least <= size + 1e-9)
    )
    met = _spread(probes, "query", "gram", "part").join(options, ["gram", "part"]).select("query", in_reach.alias("options")).where(F.size("options") > 0)
    best = met.groupBy("query").agg(F.max(_edit_score("query")(F.col("options"))).alias("best"))
    return best.where(F.col("best.score") >= least)


def fuzzy_segment(
    requests: DataFrame, column: str, catalog: DataFrame, cutoff: float = 0.5, similarity: str = "edit"
) -> DataFrame:
    """(text, known_make, known_model, score): the catalog segment closest to each distinct requested text.

    Texts that are a catalog name meet it by equality. Others meet the names that hold one of their rarest pairs of
    characters, first at a similarity of 0.9, then 0.8 and 0.65 (``LEVELS``): what is found there is the closest. Pairs cannot
    exclude names less similar than that, so texts still without one meet all names of a length that can reach the cutoff.
    The matching-blocks ratio is searched by ``best_by_sequence``. Without a match at the cutoff it is the first segment
    of the catalog, and with an empty catalog a fixed general one.
    A null text is one text without a match. ``similarity`` is 'edit' (edit distance, in the JVM) or 'sequence' (matching blocks).
    """
    known = catalog.select("make", "model").distinct()
    known = materialise(known.withColumn("text", F.lower(F.concat_ws(" ", "make", "model"))))
    first = known.agg(F.min(F.struct("make", "model")).alias("s")).first()["s"] or FALLBACK_SEGMENT
    if similarity not in ("edit", "sequence"):
        raise ValueError(f"unknown similarity {similarity!r}")
    queries = materialise(requests.select(F.lower(F.col(column)).alias("query")).distinct())
    same = known.groupBy(F.col("text").alias("query")).agg(
        F.max(F.struct(F.lit(1.0).alias("score"), "text", "make", "model")).alias("best")
    )
    equal = queries.join(same, "query")
    others = queries.join(same, "query", "left_anti")
    if similarity == "edit":
        index, found_at = gram_index(known), []
        for level in (level for level in LEVELS if level > cutoff):
            found_at.append(materialise(_by_grams(others, index, level)))
            others = materialise(others.join(found_at[-1], "query", "left_anti"))
        near = reduce(DataFrame.union, found_at, _within_lengths(others, known, cutoff, _edit_score("query")))
    else:
        near = best_by_sequence(others, known, cutoff)
    best = equal.select("query", "best").union(near.select("query", "best"))
    found = F.coalesce(F.col("best.score") >= cutoff, F.lit(False))
    return queries.join(best, "query", "left").select(
        F.col("query").alias("text"),
        F.when(found, F.col("best.make")).otherwise(F.lit(first[0])).alias("known_make"),
        F.when(found, F.col("best.model")).otherwise(F.lit(first[1])).alias("known_model"),
        F.when(found, F.col("best.score")).alias("score"),
    )
