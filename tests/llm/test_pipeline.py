"""The pipeline's stages on their own inputs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from dealwright.llm import mixing, simhash
from dealwright.llm.common import table

from test_text_operators import LIBRARY, SCHEMA, plain_components, plain_fingerprint, plain_repeats, prose

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_columns(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, SF))
        assert docs.columns == columns and docs.count() > 0, name
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = sorted(r["text"] for r in docs.collect())
    assert sorted(LIBRARY.decode(r["ids"]) for r in last) == texts
    assert [s for s, _ in pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "mixing", "bpe"]


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_rejected_documents_go_and_others_stay_whole(spark):
    rng = random.Random(11)
    texts = [prose(rng, 30) for _ in range(40)] + [None, "", "123 --", "Ωμέγα και άλφα βήτα " * 40]
    docs = rows(spark, texts, [None, None, *range(2, len(texts))])
    kept = pipeline.keep_known_languages(spark, docs, SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.limit(40).collect()), key=str)


def test_one_of_each_near_copy_group_stays(spark):
    rng = random.Random(12)
    base = [prose(rng, 500) for _ in range(4)]
    texts = [b + rng.choice(["", " x", " y z"]) for b in base for _ in range(6)] + [None, "", "one two", "one two"]
    got = [r["doc_id"] for r in pipeline.keep_one_of_near_copies(spark, rows(spark, texts), SF).collect()]
    want = plain_components({i: plain_fingerprint(t) for i, t in enumerate(texts)}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert sorted(got) == sorted(set(want.values()))
    same = rows(spark, ["a b c d e"] * 3 + ["q r s t u v"] * 2, [5, 5, 5, None, None])
    assert sorted(str(r["doc_id"]) for r in pipeline.keep_one_of_near_copies(spark, same, SF).collect()) == ["5", "None"]
    assert simhash.near_duplicates(same).count() == 5


def test_later_copies_of_passages_go(spark):
    rng = random.Random(13)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randint(0, 30)) + " " + passage + " " + prose(rng, rng.randint(0, 30)) for _ in range(8)]
    left = {r["doc_id"]: r["text"] for r in pipeline.cut_repeated_passages(spark, rows(spark, texts), SF).collect()}
    _, later = plain_repeats(texts)
    for i, t in enumerate(texts):
        assert left.get(i, "").split() == [w for k, w in enumerate(t.split()) if k not in later.get(i, ())]


def test_mix_of_the_stage_is_that_of_the_operator(spark):
    docs = table(spark, SF, "documents")
    taken = {}
    for r in pipeline.mix_sources(spark, docs, SF).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}


CLASHING = """_row _pass _times _skip _blocks _n _key doc words _k1 _k2 _doc _cuts _rest there f0 _text_hash _c group_key component_id
fingerprint start_word end_word ids decoded_sha256 _text _k0 lang_pred rejected score _lang held_out ce n""".split()


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_take_columns_of_any_name_long_texts_and_empty_tables(spark, name):
    rng = random.Random(14)
    passage = prose(rng, 60)
    texts = [prose(rng, 40) for _ in range(20)] + [passage + " one", "two " + passage, None, "", prose(rng, 20_000), "x" * 300_000]
    plain = rows(spark, texts + [texts[0]], [*range(len(texts)), 0])
    clashing = plain.select("*", *(F.lit(c).alias(c) for c in CLASHING))
    stage = dict(pipeline.STAGES)[name]
    got = stage(spark, clashing, SF)
    want = stage(spark, plain, SF)
    if name == "bpe":
        assert got.columns == want.columns
    else:
        assert got.columns == clashing.columns
        assert all(r[c] == c for r in got.select(*CLASHING).collect() for c in CLASHING)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.count() > 0 and stage(spark, plain.limit(0), SF).count() == 0


def test_the_mix_is_drawn_in_as_many_tasks_as_it_has_chunks(spark):
    words = 64 * 1_000_000
    plan = spark.createDataFrame([("a", words, 2.0 * words)], "_key string, source_size long, target double")
    drawn = mixing.draws(plan)
    tasks = drawn.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 2_000_000 and len(tasks) >= 25 and max(r["n"] for r in tasks) <= 2 * mixing.SLOTS
