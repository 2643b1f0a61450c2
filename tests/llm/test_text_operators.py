"""Operators on texts against plain versions of what they compute."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from dealwright.llm import bpe, langid, mixing, simhash, suffixes

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LIBRARY = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = "the of and tion ere ing hat was for that with by on are this be at or from as".split()


def frame(spark, texts, ids=None, clash=True):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = "ids h n _row run component block taken _key score _k0 _text key fp".split()
    return df.select("*", *(F.lit("x").alias(c) for c in extra)) if clash else df


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


ODD = [None, "", " ", "\n\t\x0b ", "x", "don't  stop", "   a\n\n b ", "é" * 3, "😀 ok   z", "1234567 a1b2", "'re 're", "a" * 700,
       " " * 500 + "b", "The <|endoftext|> end", "!!!???...", "ab" * 200 + "  " + "12" * 200]


def encoded(df):
    return {r["doc_id"]: list(r["ids"]) for r in df.collect()}


@pytest.mark.parametrize("chunk, overlap", [(64, 24), (37, 16), (1000, 100)])
def test_bpe_is_what_the_library_gives_however_texts_are_cut(spark, chunk, overlap):
    rng = random.Random(1)
    texts = ODD + [prose(rng, n) + rng.choice([" ", "\n\n  ", "'ll "]) + prose(rng, n) for n in (5, 40, 200, 900)]
    texts += ["".join(rng.choices("ab 1'rels\n.é", k=900)) for _ in range(12)]
    got = encoded(bpe.encode(frame(spark, texts), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap))
    assert got == {i: LIBRARY.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_bpe_round_trip_and_digests(spark):
    texts = [*ODD, prose(random.Random(2), 30_000)]
    rows = bpe.round_trip(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_null_ids_repeated_rows_and_an_empty_table(spark):
    df = frame(spark, ["a b", "a b", None], ids=[None, 7, 7])
    rows = bpe.round_trip(df.unionByName(df), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == [(-1, 2), (-1, 2), (7, 0), (7, 0), (7, 2), (7, 2)]
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    """Smallest id reachable from each (id, key)."""
    reach = {}
    rest = set(keys.values())
    while rest:
        queue, group = [rest.pop()], set()
        while queue:
            now = queue.pop()
            group.add(now)
            near = {x for x in rest if linked(now, x)}
            rest -= near
            queue += near
        members = [i for i, k in keys.items() if k in group]
        reach.update(dict.fromkeys(members, min(members)))
    return reach


def test_simhash_fingerprints_and_groups(spark):
    rng = random.Random(3)
    base = [prose(rng, n).split() for n in (3, 30, 80, 300, 1000)]
    texts = ODD[:9] + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    for words in base:
        for _ in range(25):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS)
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    rows = simhash.near_duplicates(frame(spark, texts)).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == fps
    assert all(len(r["fingerprint"]) == 16 for r in rows)
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


@pytest.mark.parametrize("max_bits, segments", [(4, (22, 21, 21)), (3, (32, 32)), (7, (16, 16, 16, 16)), (4, (13, 13, 13, 13, 12))])
def test_simhash_balls_miss_no_link(spark, max_bits, segments, monkeypatch):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    for v in list(values):
        for _ in range(12):
            near = v
            for b in rng.sample(range(64), rng.randint(1, max_bits + 2)):
                near ^= 1 << b
            values.append(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = plain_components(dict(enumerate(set(values))), lambda a, b: (a ^ b).bit_count() <= max_bits)
    for pairs in (1 << 20, 4):  # also with every group taken as a large one
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        links = [(r["u"], r["v"]) for r in simhash.link_fingerprints(df, max_bits, segments).collect()]
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in links)
        groups = plain_components({v % (1 << 64): v % (1 << 64) for v in signed}, lambda a, b, s={frozenset((u % (1 << 64), v % (1 << 64))) for u, v in links}: frozenset((a, b)) in s)
        assert len(set(groups.values())) == len(set(want.values()))


def test_simhash_nulls_repeats_and_an_empty_table(spark):
    df = frame(spark, [None, "", "a b c d e", "a b c d e", "a b c d e"], ids=[9, None, None, 5, 5])
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == [(-1, 5), (-1, 9), (5, 5), (5, 5), (9, 9)]
    alone = simhash.near_duplicates(frame(spark, ["q w e r t"], ids=[None])).collect()
    assert alone[0]["component_id"] is None and alone[0]["group_key"] == alone[0]["fingerprint"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_repeats(texts, size=50):
    """Words of each text that lie in a window of ``size`` words some other text has too."""
    where = {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        for p in range(len(words) - size + 1):
            where.setdefault(tuple(words[p : p + size]), set()).add(i)
    covered, later = {}, {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        for p in range(len(words) - size + 1):
            docs = where[tuple(words[p : p + size])]
            if len(docs) > 1:
                covered.setdefault(i, set()).update(range(p, p + size))
                if min(docs) < i:
                    later.setdefault(i, set()).update(range(p, p + size))
    return covered, later


def passages(rows):
    covered, later = {}, {}
    for r in rows:
        span = range(r["start_word"], r["end_word"])
        covered.setdefault(r["doc_id"], set()).update(span)
        if not r["kept"]:
            later.setdefault(r["doc_id"], set()).update(span)
    return covered, later


@pytest.mark.parametrize("group", [20_000, 3])
def test_suffix_passages_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (50, 51, 60, 75, 130, 400)]
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(30)] + [None, "", "x", shared[4], shared[4], "For " * 300, "Say " + "For " * 200]
    for p in shared:
        for _ in range(6):
            texts.append(prose(rng, rng.randint(0, 120)) + " " + p + "\n" + prose(rng, rng.randint(0, 120)))
    texts.append(prose(rng, 20) + " " + " ".join(shared[2].split()[:49]) + " " + prose(rng, 20))
    covered, later = passages(suffixes.repeated_passages(frame(spark, texts)).collect())
    want_covered, want_later = plain_repeats(texts)
    assert covered == want_covered
    assert later == want_later


def test_suffix_passages_of_near_copies(spark):
    """Every window that a smaller document has goes, up to few words at changes, and one copy of each stays."""
    rng = random.Random(6)
    base = prose(rng, 600).split()
    texts = [" ".join(base)]
    for _ in range(30):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    covered, later = passages(suffixes.repeated_passages(frame(spark, texts)).collect())
    want_covered, want_later = plain_repeats(texts)
    assert set(covered) == set(want_covered) and 0 not in later
    for i in want_later:
        assert later[i] <= want_later[i] and len(later[i]) >= 0.95 * len(want_later[i])
    left = suffixes.remove_repeats(frame(spark, texts, clash=False)).collect()
    assert {r["text"] for r in left} >= {texts[0]} and all(r["n_chars"] == len(r["text"]) for r in left)


def test_suffix_passages_that_end_in_a_frequent_line_or_begin_in_the_smallest_document(spark):
    rng = random.Random(11)
    line = prose(rng, 28)
    passages_, fragment = [f"{prose(rng, 22)} {line}" for _ in range(25)], prose(rng, 60)
    texts = [f"{prose(rng, 20)} {' '.join(fragment.split()[:45])} {prose(rng, 20)}"]
    texts += [f"{prose(rng, 40)} {p} {prose(rng, 40)}" for p in passages_ for _ in range(2)]
    texts += [f"{prose(rng, 40)} {line} {prose(rng, 40)}" for _ in range(150)]
    texts += [f"{prose(rng, rng.randint(1, 60))} {fragment} {prose(rng, 40)}" for _ in range(40)]
    covered, later = passages(suffixes.repeated_passages(frame(spark, texts)).collect())
    want_covered, want_later = plain_repeats(texts)
    assert covered == want_covered and later == want_later and 0 not in covered


@pytest.mark.parametrize("group", [20_000, 3])
def test_suffix_passages_in_many_documents_of_a_line_whose_first_document_has_only_the_line(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(12)
    line = prose(rng, 30)
    texts = [f"{prose(rng, 30)} {line} {prose(rng, 30)}" for _ in range(20)]
    for copies in (2, 2, 2, 40):
        passage = f"{prose(rng, 15)} {line} {prose(rng, 15)}"
        texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(copies)]
    covered, later = passages(suffixes.repeated_passages(frame(spark, texts)).collect())
    want_covered, want_later = plain_repeats(texts)
    assert covered == want_covered and later == want_later


def test_suffix_removal_cuts_words_and_nothing_else(spark):
    rng = random.Random(7)
    passage = prose(rng, 80)
    texts = [f"one  two {passage}\n\nthree é", f"\tfour {passage} five\n", passage, passage, "six", "  ", None, ""]
    left = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(frame(spark, texts, clash=False)).collect()}
    assert left == {0: texts[0], 1: "\tfour five\n", 4: "six", 5: "  ", 6: None, 7: ""}
    none = suffixes.remove_repeats(frame(spark, texts, clash=False).limit(0))
    assert none.count() == 0 and none.columns == "doc_id text lang source n_chars".split()


def test_suffix_removal_shuffles_texts_once(spark):
    """Cut and untouched texts come out of one join; a join for each would move all texts twice."""
    rng = random.Random(9)
    passage = prose(rng, 80)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = suffixes.remove_repeats(frame(spark, [passage, passage + " one", "two"], clash=False))
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 1
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()} == {(0, passage, len(passage)), (1, "one", 3), (2, "two", 3)}


def test_suffix_null_and_repeated_ids(spark):
    rng = random.Random(8)
    passage = prose(rng, 90)
    df = frame(spark, [passage + " a", passage + " b", passage + " c", passage + " c"], ids=[None, 5, 3, 3])
    rows = {(r["doc_id"], r["kept"]) for r in suffixes.repeated_passages(df).collect()}
    assert rows == {(None, False), (5, False), (3, True)}


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, total = {s: 0.0 for s in sizes}, 1.5 * sum(sizes.values())
    while total > 1e-9:
        open_ = [s for s in sizes if target[s] < 2 * sizes[s] - 1e-9]
        share = total / sum(weight[s] for s in open_)
        total = 0
        for s in open_:
            target[s] += share * weight[s]
            if target[s] > 2 * sizes[s]:
                total += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
    return target


def test_mixing_targets_and_draws(spark):
    rng = random.Random(9)
    names = [None, "b", "a", "é", "z", "B"]
    rows = [(i, None if i % 97 == 0 else prose(rng, rng.randint(0, 400)), "en", names[min(int(rng.expovariate(1)), 5)], 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("_key", F.lit(1))
    mixed = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in mixed) == list(range(900))
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    of = {}
    for i, _, _, s, _ in rows:
        of[s] = of.get(s, 0) + size[i]
    want = plain_targets(of)
    taken = dict.fromkeys(of, 0)
    for r in mixed:
        s = rows[r["doc_id"]][3]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of[s])
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in of:
        assert abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK, s
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in mixed}
    texts = {}
    for r in mixing.mixture(df).collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in mixed:
        parts = texts.get(r["doc_id"], [])
        assert sum(len(p.split()) for p in parts) == r["taken"]
        for p in parts:  # a pass takes words in their order
            words = iter(rows[r["doc_id"]][1].split())
            assert all(w in words for w in p.split())


def test_mixing_small_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, "a", 1)], SCHEMA)
    assert sorted(map(tuple, mixing.mix(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixture(blank).count() == 0
    same = spark.createDataFrame([(1, "a b", "en", "s", 3)] * 3, SCHEMA)
    assert all(r["taken"] <= 4 and r["target"] == 9 for r in mixing.mix(same).collect())


def test_permutations_hit_every_index_once(spark):
    for n in (1, 2, 3, 10, 257):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k"), F.lit(0)).alias("p"))
        assert sorted(r["p"] for r in rows.collect()) == list(range(n))


def test_mixing_draws_of_the_shards_are_multinomial_given_the_totals(spark):
    plan = spark.createDataFrame([("a", 64_000, 96_000.0), ("b", 32_000, 16_000.0), ("c", 640, 1_280.0)], "_key string, source_size long, target double")
    rows = mixing.shard_counts(plan, shard=100).collect()
    total, by_shard = {}, {}
    for r in rows:
        total[r["_key"]] = total.get(r["_key"], 0) + r["n"]
        by_shard.setdefault(r["shard"], {})[r["_key"]] = r["n"]
    assert total == {"a": 1500, "b": 250, "c": 20}
    sizes = sorted(sum(s.values()) for s in by_shard.values())
    assert sizes == [70] + [100] * 17
    share = [s.get("b", 0) for s in by_shard.values() if sum(s.values()) == 100]
    assert len(set(share)) > 4 and 9 < sum(share) / len(share) < 19 and max(share) < 32
    taken = {}
    for r in mixing.draws(plan, shard=100).collect():
        taken.setdefault((r["_key"], r["block"]), []).append(r["pass"])
    assert len(taken) == 1000 + 250 + 10 and all(sorted(t) == list(range(len(t))) for t in taken.values())


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_language_codes_do_not_depend_on_slices(monkeypatch):
    text = "Éa b'c  1 ñ!! " * 40
    whole = [int(c) for part in langid.codes_of(text) for c in part]
    monkeypatch.setattr(langid, "SLICE", 7)
    assert [int(c) for part in langid.codes_of(text) for c in part] == whole
    assert whole[-1] & (langid.SYMBOLS - 1) == 0 and list(langid.codes_of("12 !")) == [] and list(langid.codes_of("")) == []


def test_language_models_are_distributions():
    import numpy as np

    codes = np.concatenate([c for c in langid.codes_of("abra cadabra abracadabra bar")])
    found, n = np.unique(codes, return_counts=True)
    levels = langid._levels(found, n.astype(float))
    for context in (*(found[:4] >> langid.BITS), 12345):
        every = (np.int64(context) << langid.BITS) | np.arange(langid.SYMBOLS)
        assert langid._probability(levels, every).sum() == pytest.approx(1)


@pytest.mark.parametrize("shard_ngrams", [2_000_000, 300])
def test_language_scores_are_those_of_all_ngrams_in_shards_of_any_size(spark, monkeypatch, shard_ngrams):
    import numpy as np

    rng = random.Random(13)
    rows = [(i, prose(rng, 200) if i % 2 else prose(rng, 150).translate(str.maketrans("aeiou", "éüøåw")), "aé"[i % 2], None, 0) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    models = langid.learn(df.select("lang", "text"), shard_ngrams)
    assert (models.shards > 1) == (shard_ngrams == 300)
    plain = []
    for lang in models.langs:
        codes, n = np.unique(np.concatenate([c for r in rows if r[2] == lang for c in langid.codes_of(r[1])]), return_counts=True)
        plain.append(langid._levels(codes, n.astype(float)))
    seen = df.unionByName(spark.createDataFrame([(100, "zzz qqq éa", None, None, 0), (101, None, None, None, 0)], SCHEMA))
    texts = {r["doc_id"]: r["text"] or "" for r in seen.collect()}
    got = langid.score(seen, models, ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        codes = np.concatenate([np.empty(0, np.int64), *langid.codes_of(texts[r["doc_id"]])])
        want = [-np.log(langid._probability(levels, codes)).mean() if len(codes) else 0 for levels in plain]
        assert r["n"] == len(codes) and r["ce"] == pytest.approx(want, rel=1e-5)


def test_language_models_keep_ngrams_past_the_former_limit(spark):
    rng = random.Random(14)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)]
    made = spark.createDataFrame([(i, "".join(rng.choices(letters, k=55_000)), "zh", None, 0) for i in range(40)], SCHEMA)
    models = langid.learn(made.unionByName(made.where("doc_id < 4")).select("lang", "text"))
    stored_ = spark.read.parquet(f"{models.path}/long").where("level = 0")
    assert stored_.count() > 2_100_000 and 0.7 < models.discounts[0][0] < 0.9


def test_languages_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in df.collect()}
    rows = langid.identify(df.withColumn("n", F.lit(1)).withColumn("ce", F.lit("x"))).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and not any(r["rejected"] for r in rows)


def test_language_odd_rows(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 40), "en", None, 0) for i in range(30)]
    rows += [(100 + i, "über schön größe ja nein " * 8, "de", None, 0) for i in range(30)]
    rows += [(None, None, "en", None, 0), (301, "", "de", None, 0), (302, "12 ?! 3", "en", None, 0), (303, "a", None, None, 0),
             (304, "Ωμέγα και άλφα βήτα γάμμα " * 30, None, None, 0), (304, "Ωμέγα", None, None, 0)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], r["n_scored"]): r for r in got}
    for key in [(None, 0), (301, 0), (302, 0)]:
        assert kept[key]["lang_pred"] == "und" and kept[key]["score"] == 0 and kept[key]["rejected"]
    assert [r["rejected"] for r in got if r["doc_id"] == 304 and r["n_scored"] > 50] == [True]
    assert not any(r["rejected"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert langid.identify(spark.createDataFrame(rows[:1], SCHEMA).limit(0)).count() == 0
    nothing = langid.identify(spark.createDataFrame([(1, "a b", None, None, 0)], SCHEMA)).collect()
    assert nothing[0]["lang_pred"] == "und" and nothing[0]["rejected"]
