"""A training corpus from the documents table: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.llm import bpe, langid, mixing, simhash, suffixes
from dealwright.llm.common import in_small_batches, stored, table

VOCABULARY = "byte_bpe_50k.tiktoken"
KEYS = ("doc_id", "_text_hash")


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` with a hash that tells rows of one doc_id apart by their text."""
    return in_small_batches(docs).select("doc_id", "text", *more, F.xxhash64("text").alias("_text_hash"))


def _whole(docs: DataFrame) -> DataFrame:
    """The same keys beside the whole row in one column, so that no name of it can clash."""
    rows = in_small_batches(docs).select(F.struct(*docs.columns).alias("doc"))
    return rows.select("doc", F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc.text").alias("_text_hash"))


def _same(left: DataFrame, right: DataFrame):
    """Whether rows agree in their keys, nulls included."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["_text_hash"] == right["_text_hash"])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject: null texts, texts without letters or of no known language go.

    Repeated rows stay or go together. Without any learned language all go.
    """
    rows = _whole(docs)
    rejected = stored(langid.identify(_texts(docs, "lang"), KEYS).where("rejected").select(*KEYS).distinct())
    return rows.join(rejected, _same(rows, rejected), "left_anti").select("doc.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (4 words, 4 bits) the document with the smallest doc_id, once if its row is repeated.

    Null and empty texts are one group; null ids stay only in a group without any other id.
    """
    rows = _whole(docs)
    found = simhash.near_duplicates(_texts(docs), shingle=4, max_bits=4, keys=KEYS)
    smallest = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    times = smallest.groupBy("group_key", *KEYS).agg(F.count(F.lit(1)).alias("_times"))
    chosen = times.groupBy("group_key").agg(F.min_by(F.struct("doc_id", "_text_hash", "_times"), "_text_hash").alias("_c"))
    chosen = stored(chosen.select("_c.*"))
    kept = rows.join(chosen, _same(rows, chosen)).select(rows["*"], "_times")
    repeated = kept.where("_times > 1").dropDuplicates(list(KEYS))
    return kept.where("_times = 1").unionByName(repeated).select("doc.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller doc_id has.

    Null, empty and shorter texts stay as they are, rows of one doc_id do not repeat each other, and a document of which
    no word is left goes. Null ids come after all others.
    """
    return suffixes.remove_repeats(in_small_batches(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of all sources takes, a row for each pass over a document, twice at most.

    Texts without words are in no mix; a null source is one of its own; repeated rows are documents of their own.
    """
    return mixing.mixture(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, lang, source, n_tokens, ids, and the digest of the bytes they decode to.

    A null or empty text has no ids and the digest of nothing; repeated rows are encoded each.
    """
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    keep = ("doc_id", "lang", "source")
    found = bpe.encode(in_small_batches(docs), ranks, public_tokenizers.PATTERN, keep=keep, decoded=True)
    return found.select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Hashes, learned models and pseudorandom draws are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
