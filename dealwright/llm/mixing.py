"""Mixing sources to target weights, with DataFrame operations only.

The documents of a source, in the order of a hash, are one stream of words that is packed into blocks of fixed length.
The mix has a number of slots for blocks, dealt to output shards of fixed size; the sources' counts in a shard are a
multinomial draw on the condition that all shards together give each source its number of slots, which a pseudorandom
permutation of the slots does: totals meet the targets without the noise of free draws. The slots of a source take its
blocks by pseudorandom permutations of their indexes, one permutation for each time all have been taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealwright.llm.common import stored

WEIGHTS = (5, 2, 1)
#: Part of all words that the mix has, and how often a document may be taken at most.
SHARE, MOST = 1.5, 2
#: Words of a block, slots of an output shard, and the rounds of a permutation.
BLOCK, SHARD, ROUNDS = 64, 8192, 16
#: Slots that a task draws, about.
SLOTS = 1 << 16
#: Documents whose words are summed in one window, about.
STRETCH = 4_000

WORD = r"[^\x20\x09-\x0D]+"
#: A word and the white space behind it, whole or not at all.
WORDS = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def permuted(index: Column, size: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, as a function of the index: in each round an index and its mirror
    at a random place change places or not, as a hash of the larger of both says."""

    def swap(x: Column, step: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*seed, step), size) - x, size)
        return F.when(F.xxhash64(*seed, step + ROUNDS, F.greatest(x, mirror)) < 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, swap)


def _source_key(source: Column) -> Column:
    """A text that tells null from every source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_key, source_size, n_blocks, target) of the sources (_key, source, source_size).

    Weights repeat over the sources by code point, null last. Targets share ``share`` of all words by weight; none goes
    beyond ``most`` times its source, what is over being shared again by weight: the sources that stop are those with
    the smallest size for their weight. One row per source goes through one window.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place.cast("int") + 1)
    weighed = sizes.withColumn("_weight", weight)
    by_room = Window.orderBy(F.col("source_size") / F.col("_weight"), "_key")
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    given = F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most
    level = weighed.withColumn("_level", (wanted - given) / F.sum("_weight").over(rest))
    stops = F.col("_level") * F.col("_weight") >= F.col("source_size") * most
    last = level.withColumn("_open", F.max(F.when(~stops, F.col("_level"))).over(everything))
    target = F.when(stops, F.col("source_size") * F.lit(float(most))).otherwise(F.col("_open") * F.col("_weight"))
    return last.select("_key", "source_size", target.cast("double").alias("target"))


def _streams(sized: DataFrame, stretches: int) -> DataFrame:
    """Rows (_row, _key, size) with the words of their source before them, in the order of a hash.

    Summed in stretches of the hash, each with the total of those before it, so that no source is one group.
    """
    cut = F.pmod(F.shiftrightunsigned("_order", 20), F.lit(stretches)).cast("int")
    rows = sized.withColumn("_cut", cut)
    totals = rows.groupBy("_key", "_cut").agg(F.sum("size").alias("_in"))
    upto = Window.partitionBy("_key").orderBy("_cut")
    before = totals.select("_key", "_cut", (F.sum("_in").over(upto) - F.col("_in")).alias("_before"))
    inside = Window.partitionBy("_key", "_cut").orderBy("_order", "_row")
    summed = rows.withColumn("_within", F.sum("size").over(inside) - F.col("size"))
    return summed.join(before, ["_key", "_cut"]).select(
        "_row", "_key", "size", (F.col("_before") + F.col("_within")).alias("start")
    )


def draws(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(_key, block, pass, shard) of every slot of the mix, from sources (_key, source_size, target)."""
    blocks = F.ceil(F.col("source_size") / block)
    wanted = F.least(F.round(F.col("target") * blocks / F.col("source_size")), blocks * MOST).cast("long")
    sources = plan.where("source_size > 0").select(
        "_key", blocks.cast("long").alias("_blocks"), wanted.alias("_slots")
    )
    by_name = Window.orderBy("_key")
    sources = sources.withColumn("_from", F.sum("_slots").over(by_name) - F.col("_slots")).withColumn(
        "_all", F.sum("_slots").over(Window.partitionBy())
    )
    chunk, slots = SLOTS, sources.agg(F.sum("_slots")).first()[0] or 0
    dealt = sources.where("_slots > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / chunk)))
    )
    first = F.col("_chunk") * chunk
    # as many tasks as there are chunks of slots: a number that adaptive execution, which sees only few rows here, leaves alone
    slots = dealt.repartition(max(1, -(-slots // chunk))).withColumn(
        "_slot", F.explode(F.sequence(first, F.least(first + chunk, F.col("_slots")) - 1))
    )
    turn = F.floor(F.col("_slot") / F.col("_blocks"))
    place = permuted(F.col("_from") + F.col("_slot"), F.col("_all"), F.lit("slots"))
    index = permuted(F.col("_slot") % F.col("_blocks"), F.col("_blocks"), F.col("_key"), turn)
    return slots.select(
        "_key", index.alias("block"), turn.cast("int").alias("pass"), F.floor(place / shard).alias("shard")
    )


def shard_counts(plan: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, _key, n): the draw of each output shard, how many of its slots every source has."""
    return draws(plan, block, shard).groupBy("shard", "_key").agg(F.count(F.lit(1)).alias("n"))


def _prepared(docs: DataFrame, size: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (_row, doc_id, _key, size, _order) and the sources' plan."""
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            _source_key(F.col("source")).alias("_key"),
            size.alias("size"),
            F.xxhash64(F.lit("order"), "doc_id", "text").alias("_order"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        gather=True,
    )
    sizes = rows.groupBy("_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    return rows, stored(targets(sizes))


def _taken_blocks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(_row, start, block, _n, times) for the blocks of each document: words it has in one, times the mix takes it."""
    stretches = max(1, rows.count() // STRETCH)
    placed = _streams(rows, stretches).where("size > 0")
    touched = placed.withColumn(
        "block",
        F.explode(
            F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))
        ),
    )
    # stored, as Spark can't tell from the few sources how many slots they make
    times = stored(draws(plan).groupBy("_key", "block").agg(F.count(F.lit(1)).alias("times")))
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return touched.join(times, ["_key", "block"], "left").select(
        "_row", "start", "block", (high - low).alias("_n"), F.coalesce("times", F.lit(0)).cast("int").alias("times")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes, repeats included: at most twice ``size``. A null text has size 0; a
    null source is one of its own, last in order. Repeated rows are documents of their own. The draws are hashes, so
    reruns agree. Extra columns play no part.
    """
    rows, plan = _prepared(docs, word_count(F.col("text")))
    words = _taken_blocks(rows, plan).groupBy("_row").agg(F.sum(F.col("_n") * F.col("times")).alias("taken"))
    return (
        rows.join(words, "_row", "left")
        .join(plan, "_key")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time that words of a document are taken.

    The first has the blocks taken at least once, the second those taken twice, in the order of the document and with
    its white space; n_chars follows. A document taken whole comes as it was, from its first word on. Documents without
    words are in no block and so in no mix.
    """
    # read twice under the same row numbers, whatever executors are lost; a row in a struct, so that no name can clash
    kept = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")))
    text = F.col("doc.text")
    sized = kept.select(
        F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"),
        _source_key(F.col("doc.source")).alias("_key"), word_count(text).alias("size"),
        F.xxhash64(F.lit("order"), "doc.doc_id", "doc.text").alias("_order"), "_row",
    )
    rows = stored(sized, gather=True)
    sizes = rows.groupBy("_key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    taken = _taken_blocks(rows, stored(targets(sizes)))
    passes = (
        taken.groupBy("_row", (F.col("start") % BLOCK).alias("_skip"))
        .agg(F.array_sort(F.collect_list(F.struct("block", "times"))).alias("_blocks"))
        .withColumn("_times", F.transform("_blocks", lambda b: b["times"]))
        .select("_row", "_skip", "_times", F.explode(F.sequence(F.lit(1), F.lit(MOST))).alias("_pass"))
        .where(F.exists("_times", lambda t: t >= F.col("_pass")))
    )
    # the words up to the first border of a block, then block by block
    trimmed = F.ltrim(text, F.lit(" \t\n\x0b\f\r"))
    first = F.concat(F.lit(f"^(?:{WORDS}){{1,"), (BLOCK - F.col("_skip")).cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", trimmed, first, F.lit(0))
    rest = F.substring(trimmed, F.length(head) + 1, F.length(trimmed))
    pieces = F.concat(F.array(head), F.regexp_extract_all(rest, F.lit(f"((?:{WORDS}){{1,{BLOCK}}}+)"), F.lit(1)))
    some = F.filter(pieces, lambda piece, i: F.element_at("_times", i + 1) >= F.col("_pass"))
    whole = F.forall("_times", lambda t: t >= F.col("_pass"))
    words = F.when(whole, trimmed).otherwise(F.array_join(some, ""))
    texts = kept.join(passes, "_row").select("doc", words.alias("words"))
    changed = {"text": F.col("words")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("words").cast(docs.schema["n_chars"].dataType)
    return texts.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
