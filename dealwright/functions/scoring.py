"""Scores: discount, blend weight, tail correction, similarity, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealwright.config import BlendSettings


def discount_pct(prediction: Column, price: Column) -> Column:
    """How far the ask lies below the estimate, in percent of the estimate."""
    return F.try_divide(prediction - price, prediction) * 100


def pct_change(value: Column, base: Column) -> Column:
    return F.try_divide(value - base, base) * 100


def blend_weight(n: Column, blend: BlendSettings = BlendSettings()) -> Column:
    """Share of the segment's own model, by its training size."""
    n = F.coalesce(n, F.lit(0))
    lo, hi = blend.full_general_below, blend.full_specific_from
    return F.when(n < lo, 0.0).when(n >= hi, 1.0).otherwise((n - lo) / float(hi - lo))


def blended(
    specific: Column, general: Column, n: Column, blend: BlendSettings = BlendSettings()
) -> Column:
    """Weighted mean of both estimates; the only one there is; null when there is none."""
    if not blend.enabled:
        return specific
    weight = blend_weight(n, blend)
    both = weight * specific + (1 - weight) * general
    return F.coalesce(both, specific, general)


def tail_side(estimate: Column, q25: Column, q75: Column, low: Column, high: Column) -> Column:
    """'low' or 'high' when the estimate lies strictly outside the quartiles and that tail has a model."""
    return F.when((estimate < q25) & low.isNotNull(), "low").when(
        (estimate > q75) & high.isNotNull(), "high"
    )


def tail_adjusted(estimate: Column, side: Column, low: Column, high: Column) -> Column:
    """Half the estimate, half the tail model, on the side given."""
    return (
        F.when(side == "low", 0.5 * estimate + 0.5 * low)
        .when(side == "high", 0.5 * estimate + 0.5 * high)
        .otherwise(estimate)
    )


def edit_similarity(left: Column, right: Column) -> Column:
    """Edit similarity in [0, 1]: one minus distance over the longer length."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.coalesce(1 - F.try_divide(F.levenshtein(left, right), longest), F.lit(1.0))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two short texts: one row of lengths, renewed letter by letter."""
    wanted = _letters(right)
    size = F.size(wanted)

    def next_row(row: Column, letter: Column) -> Column:
        def reach(found: Column, j: Column) -> Column:
            same = F.get(wanted, j) == letter
            here = F.when(same, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.get(found, j)))
            return F.array_append(found, here)

        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), reach)

    start = F.array_repeat(F.lit(0), size + 1)
    return F.element_at(F.aggregate(_letters(left), start, next_row), -1)


def common_ratio(left: Column, right: Column) -> Column:
    """Share of the letters of both texts that their longest common subsequence covers, 0..100 in whole points."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, 100).otherwise(F.round(200.0 * common_length(left, right) / F.nullif(total, F.lit(0)))).cast("int")


def plain_words(text: Column) -> Column:
    """Letters and digits in lower case, everything else one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda word: word != "")


def in_order(text: Column) -> Column:
    """The words of a text, sorted."""
    return F.array_join(F.array_sort(_tokens(text)), " ")


def partial_ratio(left: Column, right: Column) -> Column:
    """The best ratio of the shorter text with a part of the longer one that is as long."""
    swap = F.length(left) > F.length(right)
    short, long = F.when(swap, right).otherwise(left), F.when(swap, left).otherwise(right)
    starts = F.sequence(F.lit(1), F.length(long) - F.length(short) + 1)
    best = F.array_max(F.transform(starts, lambda i: common_ratio(short, F.substring(long, i, F.length(short)))))
    return F.when(F.length(short) == 0, F.when(F.length(long) == 0, 100).otherwise(0)).otherwise(best)


def word_set_ratio(left: Column, right: Column, ratio=common_ratio) -> Column:
    """The best ratio among the words both share and each text's words, the shared ones first."""
    a, b = F.array_distinct(_tokens(left)), F.array_distinct(_tokens(right))
    both = F.array_join(F.array_sort(F.array_intersect(a, b)), " ")
    rest = [F.array_join(F.array_sort(F.array_except(x, y)), " ") for x, y in ((a, b), (b, a))]
    one, two = (F.trim(F.concat_ws(" ", both, r)) for r in rest)
    with_shared = F.when(both != "", F.greatest(ratio(both, one), ratio(both, two))).otherwise(0)
    return F.greatest(ratio(one, two), with_shared)


#: What ratios of sorted or shared words count for beside the plain one, and ratios of parts of much longer texts.
WORDS_COUNT, PARTS_COUNT, SMALL_PARTS_COUNT = 0.95, 0.9, 0.6
LONGER, MUCH_LONGER = 1.5, 8


def weighted_ratio(left: Column, right: Column) -> Column:
    """Similarity 0..100 that forgives swapped, extra and cut words: the best of the plain ratio and those of sorted and of
    shared words, or, where one text is much longer, of its parts. A null text, or one without letters
    or digits, is like none: 0."""
    a, b = (plain_words(F.coalesce(text, F.lit(""))) for text in (left, right))
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    part = F.when(longer > MUCH_LONGER * shorter, SMALL_PARTS_COUNT).otherwise(PARTS_COUNT)
    alike = F.greatest(common_ratio(in_order(a), in_order(b)), word_set_ratio(a, b)) * WORDS_COUNT
    words_of_parts = F.greatest(partial_ratio(in_order(a), in_order(b)), word_set_ratio(a, b, partial_ratio)) * WORDS_COUNT
    parts = F.greatest(partial_ratio(a, b).cast("double"), words_of_parts) * part
    other = F.when(longer >= LONGER * shorter, parts).otherwise(alike)
    best = F.greatest(common_ratio(a, b).cast("double"), other)
    return F.when(shorter == 0, 0).otherwise(F.round(best)).cast("int")


def best_option(text: Column, options: Sequence[str]) -> Column:
    """Struct (score, option): the closest of a fixed list, score 0..100, first option on ties."""
    wanted = F.lower(F.trim(text))
    scored = F.array(
        *[
            F.struct(
                F.round(edit_similarity(wanted, F.lit(str(option).lower())) * 100, 6).alias("score"),
                F.lit(-position).alias("preference"),
                F.lit(str(option)).alias("option"),
            )
            for position, option in enumerate(options)
        ]
    )
    return F.array_max(scored)


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins; the top value falls in the last bin, a single value in bin 1."""
    return F.when(high > low, F.least(F.width_bucket(value, low, high, F.lit(bins)), F.lit(bins))).otherwise(
        F.when(value.isNotNull(), 1)
    )
