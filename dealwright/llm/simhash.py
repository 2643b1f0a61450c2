"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit for each of 64 positions: 1 if the bit is set in over half of its shingles' hashes.
Different fingerprints within ``max_bits`` bits are linked. The 64 bits are cut into segments. By the pigeonhole
principle two linked fingerprints agree up to a few bits in at least one of them, so each fingerprint enters one table
per segment and looks up the Hamming ball around its own value there; what is met is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import joined_runs, local_roots, stored
from dealwright.llm.graph import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Bits of the tables' segments, from the lowest: about as many as a number of fingerprints has, so that few share a value.
SEGMENTS = (22, 21, 21)
#: Hashes whose bits are counted at once.
SLICE = 1 << 16
#: Pairs of one table value up to which all are compared; above, links are followed outwards.
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of ``shingle`` words at a time, repeats included; the whole sequence if it has fewer, 0 if none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        first, last = starts[at : min(at + SLICE, n)].tolist(), (ends[size - 1 + at :][: min(SLICE, n - at)] - 1).tolist()
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and fp long of every row, the fingerprint as a signed number."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            kept = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], [*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, fp long")


def _balls(max_bits: int, segments: tuple[int, ...]) -> list[list[int]]:
    """For each segment the masks to look up, the first being 0.

    Of ``max_bits`` differing bits spread over the segments, either one of the first ``max_bits % parts + 1`` segments
    has at most ``max_bits // parts`` of them, or a later one has fewer than that.
    """
    radius, extra = divmod(max_bits, len(segments))
    balls, low = [], 0
    for i, width in enumerate(segments):
        most = radius if i <= extra else radius - 1
        bits = range(low, low + width)
        balls.append([sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)])
        low += width
    return balls


def _links(max_bits: int, table: np.ndarray, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the members of one table value, enough to hold together all that are linked.

    From a first member all others in reach are taken out of the rest, then from those in turn: a dense group is used
    up after few steps, whatever its size.
    """
    rest = np.unique(np.concatenate((table, both)))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            now = queue.pop()
            near = np.bitwise_count(now ^ rest) <= max_bits
            if near.any():
                found = rest[near]
                yield np.full(len(found), now), found
                queue.extend(found)
                rest = rest[~near]


def _met(max_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) among rows (key, probe, fp) sorted by key, those of the table (probe 0) first."""
    for rows in joined_runs(batches, "key"):
        key, probe = rows["key"].to_numpy(), rows["probe"].to_numpy()
        fp = rows["fp"].to_numpy().view(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        inside = np.add.reduceat((probe == 0).astype(np.int64), start)
        large = inside * size > PAIRS
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(large):
            members = fp[start[i] : start[i] + size[i]]
            made += _links(max_bits, members[: inside[i]], members[inside[i] :])
        todo = np.flatnonzero(~large & (inside > 0) & (size > 1))
        pairs = np.cumsum(inside[todo] * size[todo])
        for part in np.split(todo, np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS))) if len(todo) else []:
            if not len(part):
                continue
            rows_of = np.repeat(start[part], size[part]) + _counting(size[part])
            times = np.repeat(inside[part], size[part])
            left = np.repeat(rows_of, times)
            right = np.repeat(np.repeat(start[part], size[part]), times) + _counting(times)
            a, b = fp[left], fp[right]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            made.append((a[near], b[near]))
        if made:
            nodes, at = np.unique(np.concatenate([x for pair in made for x in pair]).view(np.int64), return_inverse=True)
            if len(nodes):
                cuts = np.cumsum([len(x) for pair in made for x in pair])[:-1]
                sides = np.split(at, cuts)
                root = local_roots(np.concatenate(sides[0::2]), np.concatenate(sides[1::2]), len(nodes))
                other = root != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["u", "v"])


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def link_fingerprints(found: DataFrame, max_bits: int = MAX_BITS, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Links (u, v) between different values of ``fp``: not all pairs, but enough to connect all that are linked."""
    entries, low = [], 0
    for i, (width, masks) in enumerate(zip(segments, _balls(max_bits, segments), strict=True)):
        field, *signed = (m - (1 << 64) if m >> 63 else m for m in [((1 << width) - 1) << low, *masks])
        own = F.col("fp").bitwiseAND(F.lit(field))
        ball = F.transform(F.array(*map(F.lit, signed)), lambda mask: F.col("_own").bitwiseXOR(mask))
        looked_up = found.select("fp", own.alias("_own")).withColumn("_value", F.explode(ball))
        probe = (F.col("_value") != F.col("_own")).cast("byte").alias("probe")
        entries.append(looked_up.select(F.xxhash64(F.lit(i), "_value").alias("key"), probe, "fp"))
        low += width
    rows = entries[0]
    for more in entries[1:]:
        rows = rows.unionByName(more)
    dealt = rows.repartition("key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(lambda it: _met(max_bits, it), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``keys``, fingerprint, component_id, group_key.

    ``component_id`` is the smallest doc_id that is linked directly or through others, the row's own included (null if
    all are null); ``group_key`` names the group by its smallest fingerprint, also where ids are null. Null and empty
    texts have fingerprint zero and are linked like any other. Equal fingerprints are one node of the graph however many
    rows have them, so repeated rows and large groups of copies cost no pairs. Extra columns play no part.
    """
    found = stored(fingerprints(docs, shingle, keys), gather=True)
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(link_fingerprints(nodes.select("fp"), max_bits))
    grouped = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    first = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = stored(grouped.join(first, "component").select("fp", "component", "component_id"))
    return found.join(ids, "fp").select(
        *keys,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.lower(F.lpad(F.hex("component"), 16, "0")).alias("group_key"),
    )
