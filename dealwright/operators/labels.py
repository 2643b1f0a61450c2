"""Free-text descriptions to a small set of labels: embed, cluster, name, classify."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealwright.operators.match import best_in_chunks
from dealwright.session import materialise

UNKNOWN = "Unknown"
NOISE = -1
#: Characters of a gram, characters counted at once, about, and different runs that a table is kept for.
GRAM, LETTERS_AT_ONCE, MOST_RUNS = 3, 1_000_000, 4_000_000


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """(value, weight): each distinct text with its number of rows. Everything below works on these."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def _hashed(grams: list[str], dimensions: int) -> np.ndarray:
    """The places that Spark's ``HashingTF`` gives to words: 32-bit murmur hashes of their bytes with the seed 42."""
    words = [g.encode() for g in grams]
    sizes, places = np.array([len(w) for w in words], np.int64), np.zeros(len(words), np.int64)
    u32 = np.uint32

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * u32(0xCC9E2D51)
        return (k << u32(15) | k >> u32(17)) * u32(0x1B873593)

    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        whole = -(-size // 4) * 4
        blocks = np.frombuffer(b"".join(words[i].ljust(whole, b"\0") for i in at), "<u4").reshape(len(at), -1)
        h = np.full(len(at), 42, u32)
        for j in range(size // 4):
            h ^= mixed(blocks[:, j])
            h = (h << u32(13) | h >> u32(19)) * u32(5) + u32(0xE6546B64)
        if size % 4:
            h ^= mixed(blocks[:, -1])
        h ^= u32(size)
        h = (h ^ h >> u32(16)) * u32(0x85EBCA6B)
        h = (h ^ h >> u32(13)) * u32(0xC2B2AE35)
        places[at] = (h ^ h >> u32(16)).view(np.int32)
    return np.mod(places, dimensions)


def gram_counts(texts: list[str], dimensions: int, n: int) -> np.ndarray:
    """A row for each text: how many of its runs of ``n`` lower-case characters, a space between each two, hash to each place.

    Each different run is hashed once. A text has a space before and behind.
    """
    coded = [np.frombuffer(f" {t} ".lower().encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    letters = np.concatenate([np.zeros(0, np.uint32), *coded])
    starts = len(letters) - n + 1
    if starts < 1:
        return np.zeros((len(texts), dimensions))
    known, number = np.zeros(0x110000, bool), np.zeros(0x110000, np.int64)
    known[letters] = True
    alphabet = np.flatnonzero(known)
    number[alphabet] = np.arange(len(alphabet))
    letters = number[letters]
    runs = letters[:starts].copy()
    for i in range(1, n):
        runs *= len(alphabet)
        runs += letters[i : i + starts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:starts] == owner[n - 1 :]  # a run lies in one text
    runs, owner = runs[inside], owner[:starts][inside]
    if len(alphabet) ** n <= MOST_RUNS:
        met = np.zeros(len(alphabet) ** n, bool)
        met[runs] = True
        different = np.flatnonzero(met)
        table = np.zeros(len(met), np.int64)
    else:
        different, runs = np.unique(runs, return_inverse=True)
        table = None
    spelled = [chr(c) for c in alphabet]
    parts = [different // len(alphabet) ** (n - 1 - i) % len(alphabet) for i in range(n)]
    places = _hashed([" ".join(spelled[i] for i in run) for run in zip(*parts)], dimensions)
    if table is None:
        table = places
    else:
        table[different] = places
    return np.bincount(owner * dimensions + table[runs], minlength=len(texts) * dimensions).reshape(len(texts), -1).astype(float)


def _counted(texts: DataFrame, dimensions: int, n: int = GRAM) -> DataFrame:
    """Add ``_counts``, hashed character n-grams, counted for some texts at a time."""

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            told, some, size = [], [], 0
            for text in values:
                some.append(text)
                size += len(text)
                if size > LETTERS_AT_ONCE:
                    told.extend(gram_counts(some, dimensions, n))
                    some, size = [], 0
            yield pd.Series([*told, *gram_counts(some, dimensions, n)] if some else told, dtype=object)

    return texts.withColumn("_counts", array_to_vector(F.pandas_udf(counts, "array<double>")("value")))


def text_embedder() -> Pipeline:
    """Counts weighted by rarity, scaled to unit length."""
    return Pipeline(
        stages=[IDF(inputCol="_counts", outputCol="_weighted"), Normalizer(inputCol="_weighted", outputCol="_unit")]
    )


def fit_embedder(texts: DataFrame, dimensions: int = 256) -> PipelineModel:
    """The rarity of hashed character n-grams among the texts."""
    return text_embedder().fit(_counted(texts, dimensions))


def embed_text(texts: DataFrame, embedder: PipelineModel) -> DataFrame:
    """Add ``embedding``, an array, to distinct texts. Any other encoder that adds this column will do as well."""
    counted = _counted(texts, embedder.stages[0].idf.size)
    return embedder.transform(counted).withColumn("embedding", vector_to_array("_unit")).select(*texts.columns, "embedding")


# --- Density clustering -------------------------------------------------------------------------------------


def plane_signs(bands: int, bits: int, dimensions: int) -> np.ndarray:
    """Signs of bands x bits hyperplanes through the origin, from a digest of 'band|bit|dimension'."""
    digest = [
        int(hashlib.md5(f"{b}|{k}|{d}".encode()).hexdigest()[0], 16) >= 8
        for b in range(bands)
        for k in range(bits)
        for d in range(dimensions)
    ]
    return np.where(np.array(digest), 1.0, -1.0).reshape(bands * bits, dimensions)


def cells_of(embedding: Column, bands: int, bits: int, dimensions: int) -> Column:
    """The cell of a vector in each band: on which side of the band's hyperplanes it lies."""
    planes = plane_signs(bands, bits, dimensions).T
    places = 1 << np.arange(bits)
    offsets = np.arange(bands) * (1 << bits)

    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors):
                side = np.stack(vectors.to_numpy()).astype(float) @ planes > 0
                numbers = side.reshape(len(vectors), bands, bits) @ places + offsets
                yield pd.Series(list(numbers.astype(np.int64)))
            else:
                yield pd.Series([], dtype=object)

    return F.pandas_udf(cells, "array<bigint>")(embedding)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b) edges.

    Labels spread to neighbours and then jump to their label's label, so the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder before the next reads it.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = materialise(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("_near"))
        )
        spread = labels.join(near, "node", "left").select(
            "node", F.least("component", F.coalesce("_near", "component")).alias("component")
        )
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = materialise(
            spread.join(jump, "component", "left").select(
                "node", F.least("component", F.coalesce("_next", "component")).alias("component")
            )
        )
        before = labels.withColumnRenamed("component", "_before")
        if moved.join(before, "node").where(F.col("component") != F.col("_before")).isEmpty():
            return moved
        labels = moved


def cell_bits(rows: int, min_cluster_size: int) -> int:
    """Hyperplanes of a band, so that evenly spread rows leave less than half of the smallest cluster in a cell."""
    return max(1, round(math.log2(max(1.0, rows / min_cluster_size)) + 1))


def cluster_cells(
    vectors: DataFrame,
    id_column: str,
    bands: int = 4,
    bits: int | None = None,
    dimensions: int = 64,
    min_cluster_size: int = 10,
    weight: str | None = None,
    min_cosine: float = 0.2,
    min_share: float = 0.5,
) -> DataFrame:
    """(id, cluster): groups of vectors that share dense cells, -1 for noise: ``density.cluster_density`` at the price of
    a few cells per vector, for very many texts and low similarities.

    Each band cuts the space into 2^bits cells by random hyperplanes, as many as the number of rows calls for. A cell
    keeps the vectors within ``min_cosine`` of its members' mean, and is dense if ``min_cluster_size`` rows are left.
    Dense cells of different bands belong to one cluster if they share at least that many rows and ``min_share`` of the
    larger one: few common members do not join what lies apart, nor does a cell that holds two groups. A vector goes to
    the cluster of the cell whose mean it is closest to. The graph joins cells, not vectors, and no pairs of vectors are
    formed. ``weight`` counts a vector several times.
    """
    count = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = vectors.select(id_column, F.col("embedding").cast("array<double>").alias("embedding"), count.alias("_weight"))
    if bits is None:
        bits = cell_bits(int(rows.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]), min_cluster_size)
    cells = F.posexplode(cells_of(F.col("embedding"), bands, bits, dimensions)).alias("band", "cell")
    placed = materialise(rows.select("*", cells))
    size = F.sum("_weight").alias("_size")
    filled = placed.groupBy("cell").agg(size).where(F.col("_size") >= min_cluster_size).select("cell")
    members = placed.join(materialise(filled), "cell")
    centres = (
        members.select("cell", "_weight", F.posexplode("embedding").alias("_at", "_x"))
        .groupBy("cell", "_at")
        .agg((F.sum(F.col("_x") * F.col("_weight")) / F.sum("_weight")).alias("_x"))
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_parts"))
        .select("cell", F.transform("_parts", lambda p: p["_x"]).alias("_centre"))
    )
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("_centre"), F.col("_centre")))
    near = F.round(F.try_divide(dot(F.col("embedding"), F.col("_centre")), length), 9)
    met = members.join(materialise(centres), "cell").withColumn("_near", near).where(F.col("_near") >= min_cosine)
    inside = materialise(met.select(id_column, "_weight", "band", "cell", "_near"))
    dense = materialise(inside.groupBy("cell").agg(size).where(F.col("_size") >= min_cluster_size))
    inside = inside.join(dense, "cell")
    a, b = inside.alias("a"), inside.alias("b")
    both = (F.col(f"a.{id_column}") == F.col(f"b.{id_column}")) & (F.col("a.band") < F.col("b.band"))
    shared = (
        a.join(b, both)
        .groupBy(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"))
        .agg(F.sum("a._weight").alias("_shared"), F.first(F.greatest("a._size", "b._size")).alias("_larger"))
    )
    linked = (F.col("_shared") >= min_cluster_size) & (F.col("_shared") >= min_share * F.col("_larger"))
    components = connected_components(dense.select(F.col("cell").alias("node")), shared.where(linked).select("a", "b"))
    named = inside.join(components.withColumnRenamed("node", "cell"), "cell")
    clusters = named.groupBy(id_column).agg(F.max_by("component", F.struct("_near", -F.col("component"))).alias("cluster"))
    return vectors.select(id_column).join(clusters, id_column, "left").fillna(NOISE, ["cluster"])


def drop_noise(clustered: DataFrame) -> DataFrame:
    return clustered.where(F.col("cluster") != NOISE)


def mode_per_cluster(clustered: DataFrame, value: str = "value", weight: str | None = None) -> DataFrame:
    """(cluster, label): the most frequent value of each cluster, the first in order on ties."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    counts = clustered.groupBy("cluster", value).agg(count.alias("_n"))
    return counts.groupBy("cluster").agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("label"))


def label_lookup(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    return clustered.join(labels, "cluster")


# --- Classifiers --------------------------------------------------------------------------------------------


def centroids(labelled: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): the mean embedding of each label."""
    return (
        labelled.select(label, F.posexplode("embedding").alias("_at", "_x"))
        .groupBy(label, "_at")
        .agg(F.avg("_x").alias("_x"))
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_parts"))
        .select(F.col(label), F.transform("_parts", lambda p: p["_x"]).alias("centroid"))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def classify_by_centroid(vectors: DataFrame, id_column: str, centres: DataFrame, label: str = "label") -> DataFrame:
    """(id, predicted, score): the label whose centroid has the largest dot product with the vector."""

    def score(options: Column) -> Column:
        return F.array_max(
            F.transform(
                options,
                lambda o: F.struct(dot(F.col("embedding"), o["centroid"]).alias("score"), o[label].alias("predicted")),
            )
        )

    vectors = vectors.select(id_column, F.col("embedding").cast("array<double>").alias("embedding"))
    best = best_in_chunks(vectors, id_column, centres, [label, "centroid"], score, chunk=500)
    return best.select(id_column, "best.predicted", "best.score")


def train_label_classifier(labelled: DataFrame, weight: str | None = None) -> PipelineModel:
    """Multinomial logistic regression from ``embedding`` to ``label``."""
    stages = [
        StringIndexer(inputCol="label", outputCol="_class", handleInvalid="skip"),
        LogisticRegression(
            featuresCol="_features", labelCol="_class", predictionCol="_predicted", family="multinomial",
            regParam=0.01, maxIter=50, **({"weightCol": weight} if weight else {}),
        ),
    ]
    rows = labelled.withColumn("_features", array_to_vector("embedding"))
    fitted = Pipeline(stages=stages).fit(rows)
    names = IndexToString(inputCol="_predicted", outputCol="predicted", labels=fitted.stages[0].labels)
    return PipelineModel([*fitted.stages[1:], names])


def predict_label(vectors: DataFrame, classifier: PipelineModel) -> DataFrame:
    rows = vectors.withColumn("_features", array_to_vector("embedding"))
    return classifier.transform(rows).select(*vectors.columns, "predicted")


def label_texts(df: DataFrame, column: str, fill: str, dimensions: int = 256, bits: int | None = None) -> DataFrame:
    """(value, label) of every distinct text, by a classifier trained on its dense clusters.

    'Unknown' throughout when the column holds nothing but the fill value or no cluster is dense.
    """
    texts = materialise(distinct_texts(df.fillna({column: fill}), column))
    unknown = texts.select("value", F.lit(UNKNOWN).alias("label"))
    if texts.where(F.col("value") != fill).isEmpty():
        return unknown
    vectors = materialise(embed_text(texts, fit_embedder(texts, dimensions)))
    clusters = cluster_cells(vectors, "value", bits=bits, dimensions=dimensions, weight="weight")
    members = drop_noise(clusters).join(vectors, "value")
    labelled = materialise(label_lookup(members, mode_per_cluster(members, "value", "weight")))
    names = labelled.select("label").distinct().limit(2).collect()
    if not names:
        return unknown
    if len(names) == 1:
        return texts.select("value", F.lit(names[0]["label"]).alias("label"))
    classifier = train_label_classifier(labelled, "weight")
    return predict_label(vectors, classifier).select("value", F.col("predicted").alias("label"))


def classify_column(df: DataFrame, column: str, label: str, fill: str, **options) -> DataFrame:
    """Add ``label`` to the rows: texts are labelled once each and joined back."""
    labels = label_texts(df, column, fill, **options).withColumnRenamed("value", column)
    labels = labels.withColumnRenamed("label", label)
    return df.fillna({column: fill}).join(labels, column, "left")
